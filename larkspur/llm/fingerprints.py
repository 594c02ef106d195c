"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document is the set of its paragraphs' 64-bit digests: 44 bits of hash over
20 bits of check sum. A sketch XORs every digest into three cells, one in each
of three subtables. Sketches of two texts subtract (XOR) cell by cell, what
they share cancels, and peeling (take a cell whose check sum and place are
those of a single digest, remove it from its other cells, go on) recovers the
digests in which they differ; all cells empty shows that it is complete.

The fingerprint of a text is its sketch of 24 cells. Two fingerprints are
subtracted and peeled first; where that fails, the comparison retries larger:
digests are dealt into blocks of about four, each with a sketch of 24 cells,
and blocks that fail get 96 and then 384 cells. Blocks that even these leave
undecoded (equal cells in all three subtables, about once in 10**6 blocks) are
compared as sets.

Everything is built of SQL functions on rows: no Python runs on executors. One
exchange, of rows to ranges of doc_id, brings each text next to its successor;
there are as many ranges as the rows need, and one id's rows may have several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, whole_text

#: A paragraph: a line, cut after the sentence that passes 160 code points, at 320 at most.
PARAGRAPH = r"[^\n]{160,319}?[.!?](?=\s|$)|[^\n]{1,320}"
#: Cells in a subtable, of the fingerprint and of each retry.
SIZES = (8, 32, 128)
#: Rounds of peeling; more are needed for a few blocks in a million, which retry.
ROUNDS = 7
#: Parts of equal size that ids are cut into first, and again by value into
#: ranges. The driver sees the ids between the parts, and no others.
PARTS = 4096
#: Bits of a digest: check sum below, then the places in the subtables, then the block.
CHECK_BITS, PLACE_BITS = 20, 7
BLOCK_FROM = CHECK_BITS + 3 * PLACE_BITS

_NONE = "cast(array() as array<bigint>)"
_CHECK = f"(xxhash64(shiftrightunsigned({{0}}, {CHECK_BITS})) & {2**CHECK_BITS - 1}L)"


def digests(text: Column) -> Column:
    """The distinct digests of the paragraphs of a text (null: none)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    high = F.transform(found, lambda p: F.shiftleft(F.xxhash64(p), CHECK_BITS))
    return F.array_distinct(F.transform(high, lambda d: d.bitwiseOR(F.xxhash64(F.shiftrightunsigned(d, CHECK_BITS)).bitwiseAND(2**CHECK_BITS - 1))))


def _let(name: str, value: str, body: str) -> str:
    """SQL has no binding in an expression; a lambda over one element is one."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _place(d: str, table: int, size: int) -> str:
    return f"(shiftrightunsigned({d}, {CHECK_BITS + PLACE_BITS * table}) & {size - 1}L)"


def _sketch(ds: str, size: int) -> str:
    """struct(c0, c1, c2) of the cells of the three subtables."""
    cells = f"sequence(0L, {size - 1}L)"
    one = lambda j: f"transform({cells}, c -> aggregate({ds}, 0L, (a, x) -> if({_place('x', j, size)} = c, a ^ x, a)))"
    return "named_struct(" + ", ".join(f"'c{j}', {one(j)}" for j in range(3)) + ")"


def _subtract(left: str, right: str) -> str:
    return "named_struct(" + ", ".join(f"'c{j}', zip_with({left}.c{j}, {right}.c{j}, (x, y) -> x ^ y)" for j in range(3)) + ")"


def _peel(cells: str, size: int) -> str:
    """struct(ok, found): the digests recovered, and whether they are all."""
    single = lambda j: f"filter(s.c{j}, (x, c) -> x != 0L and {_place('x', j, size)} = c and {_CHECK.format('x')} = (x & {2**CHECK_BITS - 1}L))"
    pure = f"array_distinct(concat({single(0)}, {single(1)}, {single(2)}))"
    less = ", ".join(f"'c{j}', transform(s.c{j}, (x, c) -> aggregate(pure, x, (a, p) -> if({_place('p', j, size)} = c, a ^ p, a)))" for j in range(3))
    step = _let("pure", pure, f"if(size(pure) = 0, named_struct('c0', s.c0, 'c1', s.c1, 'c2', s.c2, 'found', s.found, 'live', false), named_struct({less}, 'found', concat(s.found, pure), 'live', true))")
    start = _let("z", cells, f"named_struct('c0', z.c0, 'c1', z.c1, 'c2', z.c2, 'found', {_NONE}, 'live', true)")
    done = "named_struct('ok', " + " and ".join(f"forall(s.c{j}, x -> x = 0L)" for j in range(3)) + ", 'found', s.found)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(s.live, {step}, s), s -> {done})"


def _block_difference() -> str:
    """The digests in which blocks p and q differ."""
    tried = "array_union(array_except(p, q), array_except(q, p))"
    for size in reversed(SIZES):
        name = f"t{size}"
        tried = _let(name, _peel(_subtract(_sketch("p", size), _sketch("q", size)), size), f"if({name}.ok, {name}.found, {tried})")
    return f"if(size(p) + size(q) = 0, {_NONE}, {tried})"


def _blocks(ds: str, bits: str) -> str:
    """Digests dealt into 2**bits blocks, in two steps so that a long text's
    work stays near n**1.5."""
    hi = f"cast({bits} div 2 as int)"
    top, width = f"(shiftleft(1L, {hi}) - 1)", f"(shiftleft(1L, cast({bits} - {hi} as int)) - 1)"
    outer = f"transform(sequence(0L, {top}), u -> filter({ds}, i -> (shiftrightunsigned(i, {BLOCK_FROM}) & {top}) = u))"
    inner = f"transform(sequence(0L, {width}), v -> filter(o, i -> (shiftrightunsigned(i, {BLOCK_FROM} + {hi}) & {width}) = v))"
    return f"flatten(transform({outer}, o -> {inner}))"


def sketch(ds: str) -> Column:
    """The 24 cells of the column of digests named ``ds``."""
    return F.expr(_sketch(ds, SIZES[0]))


def encoded(cells: str, ds: str) -> Column:
    """A fingerprint as a string: the number of digests, then the cells."""
    return F.expr(f"lower(concat(size({ds}), ':', concat_ws(',', transform(concat({cells}.c0, {cells}.c1, {cells}.c2), x -> hex(x)))))")


def difference(left: str, right: str, left_cells: str, right_cells: str) -> Column:
    """The digests of one text only, recovered from the fingerprints of both,
    or from larger sketches on failure."""
    bits = f"cast(ceil(log2(greatest(size({left}), size({right}), 4) / 4.0D)) as bigint)"
    larger = f"flatten(zip_with({_blocks(left, 'b')}, {_blocks(right, 'b')}, (p, q) -> {_block_difference()}))"
    larger = _let("b", bits, larger)
    first = _peel(_subtract(left_cells, right_cells), SIZES[0])
    # More digests than cells differ for certain: peeling the fingerprint can't succeed.
    sure = f"abs(size({left}) - size({right})) > {3 * SIZES[0]}"
    return F.expr(f"if({sure}, {larger}, {_let('t', first, f'if(t.ok, t.found, {larger})')})")


def likeness(left: str, diff: str) -> Column:
    """Shared digests over all digests of both texts; 1 for two without any."""
    only_left = f"size(array_intersect({diff}, {left}))"
    union = f"(size({left}) + size({diff}) - {only_left})"
    return F.expr(f"if({union} = 0, 1.0D, (size({left}) - {only_left}) / cast({union} as double))")


def ranges(ids: DataFrame, rows_per_range: int) -> DataFrame:
    """``ids`` (key, tie and others) with ``part`` and ``range``, in order of
    (key, tie): a part is cut evenly by value into as many ranges as its rows need."""
    n = ids.count()
    parts = max(1, min(PARTS, n // rows_per_range))
    cuts = ids.agg(F.percentile_approx("key", [(i + 1) / parts for i in range(parts - 1)] or [1.0], 50_000)).first()[0] or []
    cuts = cuts[: parts - 1]
    # An id that holds several cuts is a part of its own.
    cuts = sorted({*cuts, *(c - 1 for c, d in zip(cuts, cuts[1:], strict=False) if c == d)})
    wide = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("key")))
    if not wide:
        part = F.lit(0)
    else:
        at = below(F.lit([w[-1] for w in wide]))
        part = at * 64 + below(F.element_at(F.array(*[F.lit(w) for w in wide], F.lit([2**63 - 1])), at + 1))
    rows = ids.withColumn("part", part.cast("long"))
    spread = rows.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))
    spread = stage(spread.select("part", "lo", (F.col("hi").cast("double") - F.col("lo") + 1).alias("width"), F.ceil(F.col("n") / rows_per_range).alias("ranges")).repartition(1), "parts")
    place = F.col("key").cast("double") - F.col("lo") + (F.col("tie") / 2.0**64 + 0.5)
    nth = F.least(F.floor(place / F.col("width") * F.col("ranges")), F.col("ranges") - 1)
    return rows.join(F.broadcast(spread), "part").withColumn("range", F.shiftleft("part", 40) + nth).drop("lo", "width", "ranges")


def with_next(df: DataFrame, carried: list[str], rows_per_range: int = 512) -> DataFrame:
    """Add ``next_<c>`` of each carried column from the next row by descending
    doc_id (after the last: the first; equal ids by text hash; null ids last).

    Rows go to ranges of ids, and the first row of each range also to the range
    before it, so that one exchange suffices whatever the number of rows. The
    table of ranges has a row for 512 documents; Spark broadcasts it while it is
    small and joins by range beyond that.
    """
    keyed = df.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    tagged = ranges(keyed, rows_per_range)
    heads = stage(tagged.select("part", "range", "key", "tie").groupBy("part", "range").agg(F.max(F.struct("key", "tie")).alias("head")), "heads")
    lows = heads.groupBy("part").agg(F.min("range").alias("low"))
    every = Window.partitionBy(F.lit(0))
    lows = lows.select("part", F.coalesce(F.lead("low").over(every.orderBy("part")), F.min("low").over(every)).alias("low"))
    above = F.lead("range").over(Window.partitionBy("part").orderBy("range"))
    to = heads.withColumn("above", above).join(F.broadcast(lows), "part").select("range", "head", F.coalesce("above", "low").alias("goes_to"))
    to = stage(to.coalesce(1 + heads.count() // 2**20), "goes")
    here, there = F.struct(F.col("range").alias("r"), F.lit(0).alias("copy")), F.struct(F.col("goes_to").alias("r"), F.lit(1).alias("copy"))
    rows = tagged.join(to, "range").withColumn("at", F.explode(F.when(F.struct("key", "tie") == F.col("head"), F.array(here, there)).otherwise(F.array(here))))
    w = Window.partitionBy("at.r").orderBy("at.copy", F.desc("key"), F.desc("tie"))
    rows = rows.select(*df.columns, "at", "key", "tie").withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return rows.filter("at.copy = 0").drop("at", "key", "tie")


def fingerprint_edits(docs: DataFrame, rows_per_range: int = 512) -> DataFrame:
    """Fingerprints of all texts and of their edited versions.

    A null text counts as an empty one, whose fingerprint has no digests;
    equal texts, repeated rows too, have equal fingerprints, and two texts
    without paragraphs have likeness 1. Other columns than doc_id and text are
    not read, so their names cannot clash; an empty table gives no rows.
    """
    base = docs.select("doc_id", whole_text().alias("text")).withColumn("digests", digests(F.col("text")))
    near = with_next(base, ["text", "digests"], rows_per_range)
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = near.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", cut)
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - cut), substring(next_text, 1, cut))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digests", "next_digests", digests(F.col("edited")).alias("edited_digests"))
    rows = rows.withColumns({"cells": sketch("digests"), "edited_cells": sketch("edited_digests"), "next_cells": sketch("next_digests")})
    rows = rows.withColumns(
        {
            "edited_difference": difference("digests", "edited_digests", "cells", "edited_cells"),
            "next_difference": difference("digests", "next_digests", "cells", "next_cells"),
        }
    )
    return rows.withColumns(
        {
            "fingerprint": encoded("cells", "digests"),
            "edited_fingerprint": encoded("edited_cells", "edited_digests"),
            "near_edited": likeness("digests", "edited_difference"),
            "near_next": likeness("digests", "next_difference"),
        }
    )
