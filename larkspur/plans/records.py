"""Queries over records: typed fields, census, identifiers, texts, splits, placement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import candidates, contracts, placement, ranks
from larkspur.plans.registry import query
from larkspur.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# --- contracts ---------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, list_filter([CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'lang' END, CASE WHEN NOT regexp_full_match(sha256(text), '[0-9a-f]{64}') THEN 'sha256' END, CASE WHEN source IS NULL OR source = '' THEN 'source' END, CASE WHEN n_chars IS NULL OR n_chars < 100 THEN 'n_chars' END, CASE WHEN n_chars <> length(text) THEN 'length' END], lambda x: x IS NOT NULL) AS e FROM documents)
SELECT doc_id, array_to_string(e, ',') AS errors, len(e) = 0 AS valid FROM r""")
def typed_fields(spark, sf_dir):
    bad = lambda c: F.coalesce(c, F.lit(True))
    rules = [
        ("lang", bad(~F.col("lang").isin("en", "de", "fr"))),
        ("sha256", bad(~F.sha2("text", 256).rlike("^[0-9a-f]{64}$"))),
        ("source", bad(F.col("source") == "")),
        ("n_chars", bad(F.col("n_chars") < 100)),
        ("length", F.col("n_chars") != F.length("text")),
    ]
    return contracts.all_reasons(_docs(spark, sf_dir), rules).select("doc_id", F.col("reasons").alias("errors"), (F.col("reasons") == "").alias("valid"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'no label' WHEN NOT quality > 0 THEN 'below threshold' WHEN n_chars < 500 THEN 'short' ELSE 'kept' END AS reason FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS nth FROM r) SELECT reason, count(*) AS n, string_agg(CASE WHEN nth <= 5 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS examples FROM k GROUP BY 1""")
def threshold_losses(spark, sf_dir):
    """Losses by reason with the first five examples; these are few rows per reason before they meet."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = contracts.first_reason(d, [("no label", F.col("quality").isNull()), ("below threshold", F.col("quality") <= 0), ("short", F.col("n_chars") < 500)]).select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))
    first = r.withColumn("nth", F.row_number().over(Window.partitionBy("reason").orderBy("doc_id"))).filter("nth <= 5")
    examples = first.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(examples, "reason")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'unknown' ELSE 'known' END AS half FROM (SELECT doc_id FROM documents WHERE n_chars % 3 = 0) LEFT JOIN labels USING (doc_id)""")
def redo_partition(spark, sf_dir):
    asked = _docs(spark, sf_dir).filter("n_chars % 3 = 0").select("doc_id")
    return asked.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), "unknown").otherwise("known").alias("half"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) SELECT CASE WHEN o_orderkey IS NULL THEN 'only audit' WHEN l_orderkey IS NULL THEN 'only manifest' ELSE 'both' END AS side, count(*) AS n, coalesce(sum(lines), 0)::BIGINT AS lines FROM orders FULL JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def one_to_one_audit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))  # noqa: E741
    both = table(spark, sf_dir, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    side = F.when(F.col("o_orderkey").isNull(), "only audit").when(F.col("l_orderkey").isNull(), "only manifest").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("lines"))


_STAGES = "s AS (SELECT d.doc_id, stage, CASE WHEN q.doc_id IS NULL THEN 'absent' WHEN stage = 'mask' AND text <> regexp_replace(text, '[0-9]+', '#', 'g') THEN 'stale' WHEN stage = 'fold' AND text <> lower(text) THEN 'stale' ELSE 'fresh' END AS verdict FROM documents d LEFT JOIN labels q USING (doc_id), (VALUES ('mask'), ('fold')) t(stage))"


def _stages(spark, sf_dir):
    """A stage is stale where what it would make now differs from what is there."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there")), "doc_id", "left")
    now = lambda made: F.when(F.col("there").isNull(), "absent").when(F.sha2("text", 256) != F.sha2(made, 256), "stale").otherwise("fresh")
    each = F.array(F.struct(F.lit("mask").alias("stage"), now(F.regexp_replace("text", "[0-9]+", "#")).alias("verdict")), F.struct(F.lit("fold").alias("stage"), now(F.lower("text")).alias("verdict")))
    return d.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")


@query(f"WITH {_STAGES} SELECT stage, verdict, count(*) AS n FROM s GROUP BY 1, 2")
def freshness(spark, sf_dir):
    return _stages(spark, sf_dir).groupBy("stage", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STAGES} SELECT doc_id, string_agg(stage, ',' ORDER BY stage) AS stages FROM s WHERE verdict <> 'fresh' GROUP BY 1")
def rederivation_worklist(spark, sf_dir):
    stale = _stages(spark, sf_dir).filter("verdict <> 'fresh'")
    return stale.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("stage")), ",").alias("stages"))


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1), r AS (SELECT sha256(text) AS h, count(*) AS m FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) > 1)
SELECT CASE WHEN n IS NULL THEN 'only report' WHEN m IS NULL THEN 'only derived' WHEN n = m THEN 'equal' ELSE 'differs' END AS verdict, count(*) AS groups FROM g FULL JOIN r USING (h) GROUP BY 1""")
def duplicate_report_check(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("h", F.sha2("text", 256)).select("doc_id", "h")
    groups = lambda df, n: df.groupBy("h").agg(F.count(F.lit(1)).alias(n)).filter(f"{n} > 1")
    both = groups(d, "n").join(groups(d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "m"), "h", "full")
    verdict = F.when(F.col("n").isNull(), "only report").when(F.col("m").isNull(), "only derived").when(F.col("n") == F.col("m"), "equal").otherwise("differs")
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("groups"))


@query("""SELECT source, count(*) AS rows, count(quality) AS landed, (count(*) - count(quality))::BIGINT AS lost, sum((fresh = 1)::INT)::BIGINT AS added FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS fresh FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def contribution_accounting(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(1).alias("fresh"))
    all_ = d.join(first, "doc_id", "left").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return all_.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count("quality").alias("landed"), (F.count(F.lit(1)) - F.count("quality")).alias("lost"), F.count("fresh").alias("added"))


@query("""WITH x AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum((text IS NULL OR text = '')::INT)::BIGINT AS empty, count(DISTINCT source) AS sources FROM documents), o AS (SELECT count(*) AS n FROM labels ANTI JOIN documents USING (doc_id)), s AS (SELECT count(*) FILTER (toxic NOT IN (0, 1) OR quality NOT IN (0, 1)) AS n FROM labels)
SELECT * FROM (SELECT 'rows' AS check_name, n > 0 AS passed, n AS detail FROM x UNION ALL SELECT 'unique ids', n = ids, n - ids FROM x UNION ALL SELECT 'no empty text', empty = 0, empty FROM x UNION ALL SELECT 'sources', sources > 1, sources FROM x UNION ALL SELECT 'labels have documents', n = 0, n FROM o UNION ALL SELECT 'label range', n = 0, n FROM s)""")
def dataset_audit(spark, sf_dir):
    """All checks of a release as one report."""
    d, q = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    x = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_distinct("source").alias("sources"))
    orphans = q.join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    range_ = q.agg(F.count_if(~F.col("toxic").isin(0, 1) | ~F.col("quality").isin(0, 1)).alias("outside"))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check_name"), F.expr(ok).alias("passed"), F.expr(detail).alias("detail"))
    checks = [row("rows", "n > 0", "n"), row("unique ids", "n = ids", "n - ids"), row("no empty text", "empty = 0", "empty"), row("sources", "sources > 1", "sources"), row("labels have documents", "orphans = 0", "orphans"), row("label range", "outside = 0", "outside")]
    one = x.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(range_))
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


@query("""SELECT l_orderkey, l_linenumber, l_quantity::INT || '/' || (l_linenumber - 1) AS rate, round(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity::INT / (l_linenumber - 1) END, 6) AS frames_per_second,
CASE WHEN l_linenumber = 1 THEN false ELSE abs(l_quantity::INT / (l_linenumber - 1) - 10) / greatest(l_quantity::INT / (l_linenumber - 1), 10) > 0.02 END AS variable, lpad((l_quantity::INT * 7 // 60)::VARCHAR, 2, '0') || ':' || lpad((l_quantity::INT * 7 % 60)::VARCHAR, 2, '0') AS clock FROM lineitem""")
def rational_rates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int"), F.lit("/"), F.col("l_linenumber") - 1).alias("rate"), (F.col("l_quantity").cast("int") * 7).alias("s"))
    fps = F.coalesce(F.try_divide(F.split_part("rate", F.lit("/"), F.lit(1)).cast("double"), F.split_part("rate", F.lit("/"), F.lit(2)).cast("double")), F.lit(0.0))
    variable = F.when(fps == 0, F.lit(False)).otherwise(F.abs(fps - 10) / F.greatest(fps, F.lit(10.0)) > 0.02)
    return li.select("l_orderkey", "l_linenumber", "rate", F.round(fps, 6).alias("frames_per_second"), variable.alias("variable"), F.format_string("%02d:%02d", F.expr("s div 60"), F.col("s") % 60).alias("clock"))


# --- identifiers and texts ---------------------------------------------------


@query("""WITH k AS (SELECT c_custkey, unnest([{'k': c_name, 'p': 1}, {'k': lower(c_name), 'p': 2}, {'k': regexp_replace(c_name, '^.*#0*', ''), 'p': 3}, {'k': c_mktsegment || ':' || c_nationkey, 'p': 4}]) AS x FROM customer), r AS (SELECT x.k AS spelling, x.p AS priority, c_custkey, row_number() OVER (PARTITION BY x.k ORDER BY x.p, c_custkey) AS nth, count(*) OVER (PARTITION BY x.k) AS claims FROM k)
SELECT spelling, priority, c_custkey, claims FROM r WHERE nth = 1""")
def spelling_index(spark, sf_dir):
    """Every row by several keys; the first claim of a key wins."""
    spell = lambda k, p: F.struct(k.alias("spelling"), F.lit(p).alias("priority"))
    keys = F.array(spell(F.col("c_name"), 1), spell(F.lower("c_name"), 2), spell(F.regexp_replace("c_name", "^.*#0*", ""), 3), spell(F.concat("c_mktsegment", F.lit(":"), "c_nationkey"), 4))
    k = table(spark, sf_dir, "customer").select("c_custkey", F.explode(keys).alias("k")).select("c_custkey", "k.*")
    first = k.groupBy("spelling").agg(F.min(F.struct("priority", "c_custkey")).alias("f"), F.count(F.lit(1)).alias("claims"))
    return first.select("spelling", "f.priority", "f.c_custkey", "claims")


@query("""WITH n AS (SELECT p_partkey, regexp_extract(p_name, '^(.+) ([a-z]+)$', 1) AS stem, regexp_extract(p_name, '^(.+) ([a-z]+)$', 2) AS tail, p_name FROM part) SELECT p_partkey, coalesce(nullif(stem, ''), p_name) AS stem, nullif(tail, '') AS tail, split_part(p_name, ' ', -1) AS last_field, regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') AS canonical FROM n""")
def name_fields(spark, sf_dir):
    part = lambda i: F.nullif(F.regexp_extract("p_name", "^(.+) ([a-z]+)$", i), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(part(1), "p_name").alias("stem"), part(2).alias("tail"), F.substring_index("p_name", " ", -1).alias("last_field"), F.regexp_replace(F.lower("p_name"), "[^a-z]+", "_").alias("canonical"))


@query("""SELECT event_id, strftime(to_timestamp((((event_id + 1704067200) << 32) >> 32)) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM events""")
def snowflake_dates(spark, sf_dir):
    """The upper 32 bits of an id are seconds, shown at UTC+8."""
    snowflake = F.shiftleft(F.col("event_id") + 1_704_067_200, 32)
    at = F.timestamp_seconds(F.shiftright(snowflake, 32))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[\[(][^\])]*[\])]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM t)
SELECT page_id, plain, len(string_split(plain, ' ')) AS words, contains(plain, 'the') AS loose FROM n""")
def title_normalisation(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[\[(][^\])]*[\])]", " "), "[^a-z0-9]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("plain")).select("page_id", "plain", F.size(F.split("plain", " ")).cast("long").alias("words"), F.contains("plain", F.lit("the")).alias("loose"))


@query("""SELECT event_id, 'A ' || event_type || CASE WHEN value >= 50 THEN ' of high value' ELSE ' of low value' END || CASE WHEN k IS NOT NULL THEN ' (k ' || k || ')' ELSE '' END || '.' AS sentence FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def rendered_sentences(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("A "), "event_type", F.when(F.col("value") >= 50, " of high value").otherwise(" of low value"), F.when(k.isNotNull(), F.concat(F.lit(" (k "), k, F.lit(")"))).otherwise(""), F.lit(".")).alias("sentence"))


@query("""SELECT doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 15))::BIGINT AS seed, ('0x' || substr(sha256('7:' || doc_id), 1, 15))::BIGINT % 16 AS shard FROM documents""")
def seeded_shards(spark, sf_dir):
    """A seed per entity, and the shard that owns it."""
    seed = F.conv(F.substring(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), 1, 15), 16, 10).cast("long")
    return _docs(spark, sf_dir).select("doc_id", seed.alias("seed")).withColumn("shard", F.pmod("seed", F.lit(16)).cast("long"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), p AS (SELECT p_partkey, array_to_string(w[1:i], ' ') AS prefix FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
g AS (SELECT prefix, count(*) AS members, md5(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS who FROM p GROUP BY 1 HAVING count(*) > 1) SELECT prefix, members FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY length(prefix) DESC, prefix) AS n FROM g) WHERE n = 1""")
def maximal_prefixes(spark, sf_dir):
    """The longest prefix of each set of members. A set is told by its size and
    an order-free sum of hashes, so that a prefix of many members is only summed."""
    w = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    p = w.select("p_partkey", F.explode(F.expr("transform(sequence(1, size(w)), i -> array_join(slice(w, 1, i), ' '))")).alias("prefix"))
    h = F.xxhash64("p_partkey")
    g = p.groupBy("prefix").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 24)).alias("s")).filter("members > 1")
    longest = g.groupBy("members", "x", "s").agg(F.min(F.struct(-F.length("prefix"), "prefix")).alias("m"))
    return longest.select(F.col("m.prefix").alias("prefix"), "members")


# --- order, sampling, splits -------------------------------------------------


@query("""SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:' || c_custkey), c_custkey) - 1 AS turn FROM customer""")
def round_robin_interleave(spark, sf_dir):
    ranked = ranks.hash_rank(table(spark, sf_dir, "customer"), "c_custkey", by=["c_mktsegment"])
    return ranked.select("c_custkey", "c_mktsegment", (F.col("rank") - 1).alias("turn"))


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_suppkey, s_nationkey FROM r WHERE n <= 3 OR i = 0 OR i * 2 // (n - 1) > (i - 1) * 2 // (n - 1)""")
def evenly_spaced_sample(spark, sf_dir):
    return placement.evenly_spaced(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", 3).select("s_suppkey", "s_nationkey")


@query("""SELECT doc_id FROM documents WHERE n_chars >= 300 ORDER BY sha256('salt:' || doc_id) LIMIT 25""")
def first_qualifying_by_hash(spark, sf_dir):
    """A larger sample extends a smaller one; the limit is the operator."""
    ok = _docs(spark, sf_dir).filter("n_chars >= 300").select("doc_id", F.sha2(F.concat(F.lit("salt:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return ok.orderBy("h").limit(25).select("doc_id")


@query("""WITH t AS (SELECT p_partkey, p_type, p_retailprice, p_size FROM part), r AS (SELECT a.p_partkey, b.p_partkey AS donor, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), b.p_partkey) AS k FROM t a JOIN t b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 100 = 0) SELECT p_partkey, donor FROM r WHERE k = 1""")
def nearest_in_class(spark, sf_dir):
    """Of the stated queries (ids divisible by 100): the row of the same class of nearest value, the lesser id of equals."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_type", "p_size").alias("class"), "p_retailprice").filter("class.p_type is not null and class.p_size is not null")
    got = candidates.nearest_in_class(t.filter("p_partkey % 100 = 0"), t, "class", "p_partkey", "p_retailprice")
    return got.select("p_partkey", "donor")


_SPLIT = "s AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN ('0x' || substr(sha256('5:' || c_custkey), 1, 6))::BIGINT % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM customer)"


def _split(spark, sf_dir):
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit("5:"), F.col("c_custkey").cast("string")), 256), 1, 6), 16, 10).cast("long")
    return table(spark, sf_dir, "customer").withColumn("split", F.when(draw % 10 < 8, "train").otherwise("val")).withColumn("component", F.concat_ws(":", "c_nationkey", "c_mktsegment"))


@query(f"WITH {_SPLIT}, n AS (SELECT c_nationkey || ':' || c_mktsegment AS component, split, count(*) AS n FROM s GROUP BY 1, 2) SELECT component, count(*) AS sides, (sum(n) - max(n))::BIGINT AS moves FROM n GROUP BY 1 HAVING count(*) > 1")
def straddling_components(spark, sf_dir):
    return placement.straddling(_split(spark, sf_dir), "component", "split")


@query(f"WITH {_SPLIT}, n AS (SELECT c_nationkey || ':' || c_mktsegment AS component, count(*) AS n FROM s GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(*) AS components, round(max(n) / sum(n), 6) AS largest_share, max(n) / sum(n) > 0.02 AS void FROM n")
def chaining_guard(spark, sf_dir):
    return placement.chaining_guard(_split(spark, sf_dir), "component", 0.02)


@query(f"WITH {_SPLIT}, n AS (SELECT c_nationkey || ':' || c_mktsegment AS component, count(*) AS members, list_sort(list_distinct(list(CASE WHEN c_custkey % 5 = 0 THEN split END))) AS pins FROM s GROUP BY 1) SELECT component, members, CASE WHEN len(pins) = 0 THEN 'free' WHEN len(pins) = 1 THEN pins[1] ELSE 'refused' END AS placement FROM n")
def pinned_placement(spark, sf_dir):
    held = _split(spark, sf_dir).withColumn("pin", F.when(F.col("c_custkey") % 5 == 0, F.col("split")))
    return placement.pinned(held, "component", "pin")


@query("""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY sha256(text)) AS k FROM documents) SELECT count(*) AS rows, sum((n = 1)::INT)::BIGINT AS encoded, max(k) AS most FROM h""")
def encode_once(spark, sf_dir):
    """Distinct texts to encode, with the rows that share them."""
    h = _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("k"))
    return h.agg(F.sum("k").alias("rows"), F.count(F.lit(1)).alias("encoded"), F.max("k").alias("most"))


@query("""WITH l AS (SELECT DISTINCT event_type AS raw FROM events WHERE event_type <> 'view') SELECT e.event_id, CASE WHEN e.event_type = 'view' THEN 0 ELSE (SELECT count(*) FROM l WHERE l.raw <= e.event_type) END AS compact FROM events e""")
def compact_ids(spark, sf_dir):
    """Dense ids from 1 of the names in use, 0 for filler; the table of names is small by what it is."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    names = e.filter("event_type <> 'view'").select("event_type").distinct().withColumn("compact", F.row_number().over(Window.orderBy("event_type")).cast("long"))
    return e.join(names, "event_type", "left").select("event_id", F.coalesce("compact", F.lit(0)).alias("compact"))


@query("""WITH a AS (SELECT doc_id, 'one' AS arm FROM documents WHERE n_chars % 5 <> 0 UNION ALL SELECT doc_id, 'two' FROM documents WHERE n_chars % 7 <> 0), s AS (SELECT doc_id FROM a GROUP BY 1 HAVING count(DISTINCT arm) = 2) SELECT count(*) AS shared, min(doc_id) AS first_id, (SELECT count(DISTINCT doc_id) FROM a ANTI JOIN s USING (doc_id)) AS dropped FROM s""")
def arms_on_shared_clips(spark, sf_dir):
    d = _docs(spark, sf_dir)
    arms = d.select("doc_id", (F.col("n_chars") % 5 != 0).alias("one"), (F.col("n_chars") % 7 != 0).alias("two"))
    return arms.agg(F.count_if(F.col("one") & F.col("two")).alias("shared"), F.min(F.when(F.col("one") & F.col("two"), F.col("doc_id"))).alias("first_id"), F.count_if(F.col("one") != F.col("two")).alias("dropped"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey), x AS (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT a, b FROM p WHERE a NOT IN (SELECT l_orderkey FROM x) AND b NOT IN (SELECT l_orderkey FROM x)""")
def pairs_without_excluded(spark, sf_dir):
    """Pairs within an account, of rows that are not excluded: a self join on the account, which is bounded by its orders."""
    out = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    k = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey").join(out, "o_orderkey", "left_anti")
    pairs = k.withColumnRenamed("o_orderkey", "a").join(k.withColumnRenamed("o_orderkey", "b"), "o_custkey").filter("a < b")
    return pairs.select("a", "b")
