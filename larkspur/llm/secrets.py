"""Secret scans with corpus-wide ownership frequency.

Candidates are found in each text by pattern. A credential is known to its
owner; an example from a manual is everywhere. So the hash of every candidate
value is counted over the whole corpus by distinct repositories and by
distinct owners: a value that three owners have, or two in many repositories,
is a widely copied example; one that a single owner has, in however many
repositories, is owner-specific and looks live.

The base kinds (assign, access, hex) are always reported; the further kinds
match much that is harmless and are reported only where they look live.

Everything is built of SQL functions on rows. Texts never move: only candidate
hashes are shuffled, counted first by (value, repository, owner) so that a
value or an owner with a third of all rows is summed before it meets itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt_join, stage

#: Base kinds in the order in which equal starts are listed; fixed patterns.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Further kinds, of more candidates than secrets.
FURTHER = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "prefixed": r"(?:gh[pousr]_|xox[abprs]-|sk-|glpat-)[A-Za-z0-9_-]{16,}",
    "mixed": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}",
}
KINDS = [*BASE, *FURTHER]
#: Characters that the value of an assignment needs.
LEAST_VALUE = 6
#: Owners from which on a value counts as widely copied; with one less it does from so many repositories on.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 8


def _let(name: str, value: str, body: str) -> str:
    """SQL has no binding in an expression; a lambda over one element is one."""
    return f"transform(array({value}), {name} -> {body})[0]"


def matches(text: str, kind: str) -> Column:
    """array<struct<start, rank, end, value>> of a kind's matches: leftmost, not
    overlapping; places in code points, end exclusive.

    What lies between the matches gives their places. Lengths are summed in
    blocks of about the square root of their number, then over the blocks, so
    that a text of many matches takes n**1.5 steps.
    """
    pattern = BASE.get(kind) or FURTHER[kind]
    quoted = "r'" + pattern.replace("'", r"\x27") + "'"
    rank = KINDS.index(kind)
    none = "cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)"
    start = "a.at + length(g[i])"
    add = f"named_struct('at', {start} + length(f[i]), 'out', concat(a.out, array(named_struct('start', {start}, 'rank', {rank}, 'end', {start} + length(f[i]), 'value', v[i]))))"
    within = f"aggregate(sequence(k * w, least(k * w + w, size(f)) - 1), named_struct('at', 0, 'out', {none}), (a, i) -> {add})"
    blocks = f"transform(sequence(0, (size(f) - 1) div w), k -> transform(array(cast(k as int)), k -> {within})[0])"
    before = "aggregate(bs, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, b) -> named_struct('at', a.at + b.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    moved = "named_struct('start', x.start + o, 'rank', x.rank, 'end', x.end + o, 'value', x.value)"
    spans = f"flatten(zip_with(bs, {before}, (b, o) -> transform(b.out, x -> {moved})))"
    spans = _let("w", "cast(ceil(sqrt(size(f))) as int)", _let("bs", blocks, spans))
    values = f"regexp_extract_all({text}, {quoted}, 1)" if kind == "assign" else "f"
    spans = _let("f", f"regexp_extract_all({text}, {quoted}, 0)", _let("g", f"split({text}, {quoted}, -1)", _let("v", values, spans)))
    spans = f"if({text} rlike {quoted}, {spans}, {none})"
    if kind == "assign":
        spans = f"filter({spans}, x -> length(x.value) >= {LEAST_VALUE})"
    return F.expr(spans)


def listed(spans: str) -> Column:
    """kind:start:end of spans in order of start, then kind, joined by commas."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat({kinds}[x.rank], ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Base spans and further candidates of the whole texts of ``docs``.

    Columns: doc_id, base, more (arrays of struct start, rank, end, value hash),
    repository, owner. A null text counts as empty; null repositories or owners
    count together as one.
    """
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    hashed = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.unhex(F.sha2(x["value"], 256)).alias("value"))
    gather = lambda kinds: F.transform(F.concat(*[matches("text", k) for k in kinds]), hashed)
    rows = named.withColumn("base", gather(BASE)).withColumn("more", gather(FURTHER))
    return rows.select("doc_id", "repository", "owner", "base", "more")


def apart(each: DataFrame) -> DataFrame:
    """Of overlapping candidates of a text (rows with row and c) those of the
    earliest kind; base spans all stay. Two passes in order of place, no pairs:
    what began before must have ended, what begins after must not begin within."""
    forth = Window.partitionBy("row").orderBy("c.start", "c.rank", "c.end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("c.start"), F.desc("c.rank"), F.desc("c.end")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.lit(False)
    for rank in range(len(BASE), len(KINDS)):
        earlier = F.col("c.rank") < rank
        over = (F.max(F.when(earlier, F.col("c.end"))).over(forth) > F.col("c.start")) | (F.min(F.when(earlier, F.col("c.start"))).over(back) < F.col("c.end"))
        hit = hit | ((F.col("c.rank") == rank) & F.coalesce(over, F.lit(False)))
    return each.withColumn("hit_", hit).filter("not hit_").drop("hit_")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, repositories, owners), distinct ones, of rows (value, repository, owner)."""
    return candidates.groupBy("value").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))


def scan_documents(docs: DataFrame, repository: str = "doc_id", owner: str = "source", wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """Secrets of all documents, one row each.

    spans lists the base spans and those further candidates whose value is not
    widely copied: fewer than ``wide_owners`` owners have it, and if but one
    fewer, they have it in fewer than ``wide_repositories`` repositories. n_live
    and n_copied count the document's candidates of either class. Texts without
    any have zeros and empty lists; repeated rows each get their own result; an
    empty table gives no rows. Of ``docs`` doc_id, text and the two named
    columns are read, so that others' names can't clash.
    """
    # Row numbers must not change between the two uses of the scan.
    found = stage(scan(docs, F.col(repository), F.col(owner)).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.filter(F.size("base") + F.size("more") > 0)
    each = stage(apart(some.select("row", "repository", "owner", F.explode(F.concat("base", "more")).alias("c"))).withColumn("value", F.col("c.value")), "spans")
    counts = ownership(each.select("value", "repository", "owner"))
    judged = dealt_join(each, counts, "value", "row")
    live = (F.col("owners") < wide_owners - 1) | ((F.col("owners") == wide_owners - 1) & ((F.col("owners") == 1) | (F.col("repositories") < wide_repositories)))
    add = (F.col("c.rank") >= len(BASE)) & live
    result = judged.groupBy("row").agg(
        F.collect_list(F.when(add, F.struct("c.start", "c.rank", "c.end"))).alias("added"),
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(~live, 1)).alias("n_copied"),
    )
    with_any = some.join(result, "row").select("doc_id", "base", "added", "n_live", "n_copied")
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    without = found.filter(F.size("base") + F.size("more") == 0).select("doc_id", "base", none.alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    rows = with_any.unionByName(without)
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    plain = F.expr("transform(base, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end))")
    rows = rows.withColumn("plain", plain).withColumn("everything", F.concat("plain", "added"))
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(listed("plain"), 256).alias("base_sha256"), listed("everything").alias("spans"), "n_live", "n_copied")
