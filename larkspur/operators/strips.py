"""Every row of a table against all its rows, strip by strip: the rows stay in shuffles, none pass the driver."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from larkspur.operators import retrieval
from larkspur.session import staged

#: Strips of a table, rows of a strip at least and at most (a task holds a strip's rows), rows of a pack.
STRIPS, LEAST, MOST, PACK = 24, 256, 16_384, 512

#: Rows of a strip that meet a pack at once, in single and in double precision.
TILE, HALF_TILE = 1024, 256


class Pack:
    """Ids, marks and vectors of some rows."""

    def __init__(self, key: np.ndarray, mark: np.ndarray, x: np.ndarray):
        self.key, self.mark, self.x = key, mark, x
        self.length = np.einsum("ij,ij->i", x, x)

    def left(self, kind: str) -> np.ndarray:
        """So that ``left @ right`` is the squared distance, as one product."""
        return np.column_stack([-2 * self.x, self.length, np.ones(len(self.x))]).astype(kind)

    def right(self, kind: str) -> np.ndarray:
        return np.ascontiguousarray(np.column_stack([self.x, np.ones(len(self.x)), self.length]).astype(kind).T)


def squared(left: Pack, at: np.ndarray, right: Pack, of: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (at, of), dimension after dimension, as a left-to-right sum adds them."""
    total = np.zeros(len(at))
    for i in range(0, len(at), 4096):
        step = left.x[at[i : i + 4096]] - right.x[of[i : i + 4096]]
        for x in step.T:
            total[i : i + 4096] += x * x
    return total


def packed(rows: DataFrame, key: str, vector: str, mark: str) -> tuple[DataFrame, int]:
    """(block, first, keys, marks, xs) with up to PACK rows each, in order of id within a block, and the number
    of blocks. Equal ids are in one block. Vectors have one length; null ones and null ids take no part."""
    kind = "f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "f8"
    of = {"f4": "float", "f8": "double"}[kind]
    r = rows.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key_"), F.coalesce(F.col(mark).cast("double"), F.lit(float("nan"))).alias("mark_"), F.transform(vector, lambda x: x.cast(of)).alias("x_"))
    n = r.count()
    strips = max(1, min(STRIPS, -(-n // LEAST)), -(-n // MOST))
    dealt = r.withColumn("block", F.pmod(F.xxhash64("key_"), F.lit(strips)).cast("int")).repartition(strips, "block").sortWithinPartitions("block", "key_")

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            block, keys, marks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "key_", "mark_"))
            xs = b.column("x_").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)
            ends = [*np.flatnonzero(np.diff(block)) + 1, b.num_rows]
            cuts = [(i, min(i + PACK, end)) for at, end in zip([0, *ends], ends) for i in range(at, end, PACK)]
            told = [(block[i], keys[i], keys[i:j].tobytes(), marks[i:j].tobytes(), xs[i:j].tobytes()) for i, j in cuts]
            columns = zip(*told, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "first", "keys", "marks", "xs"])

    return dealt.mapInArrow(pack, "block int, first long, keys binary, marks binary, xs binary").withColumn("kind", F.lit(kind)), strips


def met(packs: DataFrame, strips: int, measure: Callable[[Pack, Iterator[tuple[Pack, bool]]], Iterator[pa.RecordBatch]], schema: str, halves: bool = False) -> DataFrame:
    """``measure`` of each block's rows and of all packs, one after another, each with whether it is of the
    block itself (those come first). With ``halves`` two blocks meet once, in one of their two strips.

    A task holds one block, one pack and what measure keeps. Each pack is sent to all strips, or
    half of them: their number grows with the table once blocks have MOST rows.
    """
    to = F.sequence(F.lit(0), F.lit(strips - 1))
    if halves:
        gap = lambda s: F.pmod(F.col("block") - s, F.lit(strips)) * 2
        to = F.filter(to, lambda s: (gap(s) < strips) | ((gap(s) == strips) & (s < F.col("block"))))
    sent = packs.withColumn("strip", F.explode(to)).withColumn("other", F.col("strip") != F.col("block"))

    def parts(batches):
        for b in batches:
            for i in range(b.num_rows):
                strip, other, keys, marks, xs, kind = (b.column(c)[i].as_py() for c in ("strip", "other", "keys", "marks", "xs", "kind"))
                key = np.frombuffer(keys, dtype=np.int64)
                yield strip, other, Pack(key, np.frombuffer(marks), np.frombuffer(xs, dtype=kind).reshape(len(key), -1).astype(float))

    def of_strip(batches):
        for _, found in itertools.groupby(parts(batches), key=lambda p: p[0]):
            by_side = itertools.groupby(found, key=lambda p: p[1])
            other, first = next(by_side)
            if other:
                continue
            own = [p for _, _, p in first]
            whole = Pack(*(np.concatenate([getattr(p, c) for p in own]) for c in ("key", "mark", "x")))
            rest = (p for _, side in by_side for _, _, p in side)
            yield from measure(whole, itertools.chain(((p, True) for p in own), ((p, False) for p in rest)))

    return sent.repartitionById(strips, "strip").sortWithinPartitions("strip", "other", "first").mapInArrow(of_strip, schema)


def nearest(rows: DataFrame, key: str, vector: str, mark: str, k: int) -> DataFrame:
    """:func:`retrieval.nearest` with every row as a query.

    Products of single precision tell which pairs may be among the first k, by the most that they can be off;
    only those pairs' distances are taken, as sums.
    """

    def measure(own, packs):
        n, last = len(own.key), np.iinfo(np.int64).max
        # Not yet found is a distance that is no number, of the last id.
        d, ids, marks = np.full((n, k), np.nan), np.full((n, k), last), np.full((n, k), np.nan)
        left, off = own.left("f4"), 2 * (own.x.shape[1] + 2) * np.finfo(np.float32).eps
        for p, same in packs:
            right, first = p.right("f4"), p.key.min()
            for i in range(0, n, TILE):
                q = slice(i, min(i + TILE, n))
                rough = left[q] @ right
                itself = own.key[q, None] == p.key[None, :] if same else None
                if same:
                    rough[itself] = np.inf
                sizes = own.length[q] + p.length.max()
                # Beyond that, single precision may overflow.
                slack = np.where(sizes < 1e37, off * sizes + 1e-9, np.inf)
                far, least = d[q, -1], ids[q, -1]
                # Of two as far the lesser id is first; distances are rounded to millionths.
                limit = far + np.where(least < first, -5e-7, 5e-7) + slack
                open_ = np.isnan(far)
                if open_.any() and len(p.key) > k:
                    limit[open_] = np.partition(rough[open_], k - 1, axis=1)[:, k - 1] + 1e-6 + 2 * slack[open_]
                limit[(far == 0) & (least < first)] = -np.inf
                fine = rough > np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
                np.logical_not(fine, out=fine)
                if same:
                    fine &= ~itself
                at, of = np.divmod(np.flatnonzero(fine), len(p.key))
                if not len(at):
                    continue
                exact = np.round(squared(own, at + i, p, of), 6)
                touched, place = np.unique(at, return_inverse=True)
                all_ = [np.concatenate([known[touched + i].ravel(), new]) for known, new in ((d, exact), (ids, p.key[of]), (marks, p.mark[of]))]
                of_query = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
                order = np.lexsort((all_[1], all_[0], of_query))
                kept = order[(np.searchsorted(of_query[order], np.arange(len(touched)))[:, None] + np.arange(k)).ravel()]
                for known, new in zip((d, ids, marks), all_, strict=True):
                    known[touched + i] = new[kept].reshape(-1, k)
        at, of = np.nonzero(ids < last)
        for i in range(0, len(at), 65_536):
            a, o = at[i : i + 65_536], of[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own.key[a], own.mark[a], ids[a, o], marks[a, o], d[a, o])], names=["query_id", "query_mark", "row_id", "mark", "distance"])

    near = met(*packed(rows, key, vector, mark), measure, "query_id long, query_mark double, row_id long, mark double, distance double")
    return retrieval.top_k(near, "query_id", [F.asc("distance"), F.asc("row_id")], k)


def whole_distances(left: Pack, left_of: np.ndarray, right: Pack, right_of: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Squared distances of all pairs in whole millionths, in the second array of ``room``. Products tell them, but
    for the pairs that may be off by one, whose distances are taken as sums."""
    shape = len(left.key), len(right.key)
    scaled, whole = (x[: shape[0] * shape[1]].reshape(shape) for x in room)
    np.matmul(left_of, right_of, out=scaled)
    np.multiply(scaled, 1e6, out=scaled)
    np.rint(scaled, out=whole)
    np.subtract(scaled, whole, out=scaled)
    np.abs(scaled, out=scaled)
    np.abs(whole, out=whole)
    off = 4e6 * (left.x.shape[1] + 2) * np.finfo(float).eps * (left.length.max() + right.length.max())
    at, of = np.divmod(np.flatnonzero(~(scaled < 0.5 - off)), len(right.key))
    for i in range(0, len(at), 65_536):
        a, o = at[i : i + 65_536], of[i : i + 65_536]
        whole[a, o] = np.rint(np.round(squared(left, a, right, o), 6) * 1e6)
    return whole


def _halves(packs: DataFrame, strips: int, measure: Callable[[Iterator[tuple[np.ndarray, np.ndarray, int]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``measure`` of tiles: the whole distances and whether marks are equal, of pairs of different ids that
    are in it, and for how many pairs each stands (two when the blocks meet once)."""

    def of_strip(own, packs):
        left = [Pack(*(x[i : i + HALF_TILE] for x in (own.key, own.mark, own.x))) for i in range(0, len(own.key), HALF_TILE)]
        lefts, room = [x.left("f8") for x in left], (np.empty(HALF_TILE * PACK), np.empty(HALF_TILE * PACK))

        def tiles():
            for p, same_block in packs:
                right = p.right("f8")
                for x, of in zip(left, lefts, strict=True):
                    whole, equal = whole_distances(x, of, p, right, room), x.mark[:, None] == p.mark[None, :]
                    if same_block:
                        other = x.key[:, None] != p.key[None, :]
                        whole, equal = whole[other], equal[other]
                    yield whole.ravel(), equal.ravel(), 1 if same_block else 2

        yield from measure(tiles())

    return met(packs, strips, of_strip, schema, halves=True)


def operating_point(rows: DataFrame, key: str, vector: str, mark: str, q: float) -> tuple[float, DataFrame] | None:
    """The quantile of :func:`retrieval.ranked_distances` with every row as a query, and (same, same_hit,
    other, other_hit): how many pairs have equal marks or not, and how many of them are within it."""
    longest = retrieval.longest_of(rows, vector)
    if longest is None:
        return None
    bits = retrieval.bits_of(longest)
    packs, strips = packed(rows, key, vector, mark)
    packs = staged(packs, "packs")
    # Digits of one size, so that no pass has more counts than it needs.
    digit_bits = -(-bits // -(-bits // retrieval.DIGIT))

    def counted(shift, known, upper):
        # Of pairs of different marks: counts of the first digit, then of the next one within each that is known.
        size = 1 << (bits - shift if known is None else upper - shift)

        def first(tiles):
            n = np.zeros(size + 1, dtype=np.int64)
            for whole, equal, times in tiles:
                place = (whole * 0.5**shift).astype(np.int64)
                place[equal] = size
                n += times * np.bincount(place, minlength=size + 1)
            at = np.flatnonzero(n[:size])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["digit", "n"])

        def within(tiles):
            n = np.zeros((len(known), size), dtype=np.int64)
            for whole, equal, times in tiles:
                for i, digit in enumerate(known):
                    least = digit << upper
                    at = np.flatnonzero((whole >= least) & (whole < least + (1 << upper)) & ~equal)
                    n[i] += times * np.bincount(whole[at].astype(np.int64) - least >> shift, minlength=size)
            of, at = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(known)[of] * size + at), pa.array(n[of, at])], names=["digit", "n"])

        found = _halves(packs, strips, first if known is None else within, "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n")).collect()
        return sorted((r["digit"], r["n"]) for r in found)

    cut = retrieval.ranked(bits, digit_bits, q, counted)
    if cut is None:
        return None
    # The last whole distance that is within it.
    last = math.floor(cut * 1e6)
    last += (last + 1) / 1e6 <= cut
    last -= last / 1e6 > cut

    def hits(tiles):
        n = np.zeros(4, dtype=np.int64)
        for whole, equal, times in tiles:
            hit = whole <= last
            same, same_hit, all_hit = (int(np.count_nonzero(x)) for x in (equal, equal & hit, hit))
            n += times * np.array([same, same_hit, len(whole) - same, all_hit - same_hit])
        yield pa.RecordBatch.from_pydict({name: [int(x)] for name, x in zip(("same", "same_hit", "other", "other_hit"), n, strict=True)})

    return cut, _halves(packs, strips, hits, "same long, same_hit long, other long, other_hit long")
