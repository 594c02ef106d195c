"""Exact top-k search by inner product: norm-sorted vectors, rotated partial sums, residual bounds.

All vectors are rotated onto the singular directions of the whole table, so
that the first coordinates hold most of an inner product. Candidates are put in
order of descending length and packed into blocks. Each query first meets the
longest vectors (a head of fixed size), which gives it a score to beat; divided
by its own length that score is its reach, the least length that a vector needs
to matter (Cauchy-Schwarz). Queries of like reach are packed together, so a
group of them meets only the groups of candidates that are long enough. Inside
such a cell blocks come by descending length, and a pair is scored in full only
if its partial sum plus the product of both residual lengths still reaches the
query's score to beat, which rises on the way. Bounds carry a slack for
rounding and only ever skip pairs that cannot win; scores are exact integers.

Both sides of the search are dealt in groups of fixed size: no query set is
broadcast, and one plan serves any number of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage


@dataclass(frozen=True)
class Sizes:
    """How the work is dealt; no choice of these changes a result."""

    block: int = 1_024  # vectors that are compared at a time
    head: int = 4_096  # longest vectors that give the first scores to beat; they are broadcast
    queries: int = 65_536  # most queries of a cell
    candidates: int = 131_072  # most candidates of a cell
    leading: int = 4  # the partial sum takes a part of the dimensions: one in so many


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector is null or has a null or non-finite component."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; by floats where these hold every sum."""
    most = int(max(np.abs(a).max(initial=0), 1)) * int(max(np.abs(b).max(initial=0), 1)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a score passes 64 bits")
    return exact.astype(np.int64)


def _rotation(vectors: DataFrame, width: int, spark) -> np.ndarray:
    """The singular directions of all vectors, from their summed outer products
    (width * width numbers): partial sums in tasks, added up in two rounds."""

    def outer(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column(0), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches):
        total = np.zeros(width * width)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = vectors.select("ints").mapInArrow(outer, "sums binary")
    rows = parts.repartition(16).mapInArrow(added, "sums binary").coalesce(1).mapInArrow(added, "sums binary").collect()
    total = np.zeros(width * width)
    for r in rows:
        total += np.frombuffer(r["sums"])
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller id, in order."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], ids[keep]


def _to_beat(query: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best score of each of n queries so far, minus infinity where there are fewer."""
    counts = np.bincount(query, minlength=n)
    ends = np.cumsum(counts)
    out = np.full(n, -np.inf)
    full = counts >= k
    out[full] = score[ends[full] - 1]
    return out


class Search:
    """A set of queries that meets blocks of candidates, longest first."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, rotation: np.ndarray, beat: np.ndarray, k: int, leading: int):
        self.ids, self.ints, self.k, self.beat = ids, ints, k, beat.astype(np.float64)
        self.rotation, self.lead = rotation, max(1, ints.shape[1] // leading)
        turned = ints.astype(np.float64) @ rotation
        self.head, self.rest = turned[:, : self.lead], np.linalg.norm(turned[:, self.lead :], axis=1)
        self.norm = np.linalg.norm(turned, axis=1)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def meet(self, ids: np.ndarray, ints: np.ndarray) -> None:
        turned = ints.astype(np.float64) @ self.rotation
        norm, rest = np.linalg.norm(turned, axis=1), np.linalg.norm(turned[:, self.lead :], axis=1)
        slack = 1e-6 + 1e-9 * self.norm * norm.max(initial=0.0)
        live = np.flatnonzero(self.norm * norm.max(initial=0.0) >= self.beat - slack)
        if not len(live):
            return
        partial = self.head[live] @ turned[:, : self.lead].T
        partial += self.rest[live, None] * rest[None, :]
        may = partial >= (self.beat - slack)[live, None]
        columns = np.flatnonzero(may.any(axis=0))
        if not len(columns):
            return
        score = _products(self.ints[live], ints[columns])
        may = may[:, columns] & (score >= self.beat[live, None]) & (self.ids[live, None] != ids[columns][None, :])
        q, c = np.nonzero(may)
        old = self.found
        self.found = _best(np.concatenate([old[0], live[q]]), np.concatenate([old[1], score[q, c]]), np.concatenate([old[2], ids[columns][c]]), self.k)
        self.beat = np.maximum(self.beat, _to_beat(self.found[0], self.found[1], len(self.ids), self.k))


PACKED = "ids binary, ints binary, top double, low double, cell long, n int"


def top_k(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, scale: int = 256, sizes: Sizes = Sizes()) -> DataFrame:
    """Each query's k highest inner products with all other rows: query_id, rank
    from 1, vec_id, score; ties go to the smaller id, fewer rows give all.

    Components count as floor(scale * x). Null vectors and ids and vectors with
    null or non-finite components take no part, neither as queries nor as
    candidates; of vectors of different lengths the shorter counts as filled up
    with zeros, so an empty one scores 0. A query does not meet rows of its own
    id; a repeated row is a candidate each time, and a repeated query is asked
    once, with the largest of its vectors in array order. Columns other than
    the two named are read only by ``is_query``. An empty table gives no rows,
    and a score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(key).cast("long").alias("id"), integers(F.col(vector), scale).alias("ints"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stage(chosen.filter("id is not null and ints is not null"), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("ints"))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    width = max(1, width)
    turn = spark.sparkContext.broadcast(_rotation(rows, width, spark))
    length = F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    measured = rows.withColumn("norm", length)

    def packs(rows_of_cell: int, low: str | None):
        """Sorted rows into blocks; ``cell`` numbers groups of at most ``rows_of_cell`` rows within a task."""

        def pack(batches):
            from pyspark import TaskContext

            part, seen, held, have = TaskContext.get().partitionId() << 32, 0, [], 0

            def block(table):
                nonlocal seen
                ints = _matrix(table.column("ints").combine_chunks() if isinstance(table.column("ints"), pa.ChunkedArray) else table.column("ints"), width)
                norm = table.column("norm").to_numpy()
                least = table.column(low).to_numpy() if low else norm
                cell = part + seen // rows_of_cell
                seen += len(ints)
                ids = table.column("id").to_numpy().astype(np.int64)
                beat = table.column(low).to_numpy().astype(np.float64).tobytes() if low else b""
                return pa.RecordBatch.from_arrays([pa.array([ids.tobytes() + beat], pa.binary()), pa.array([np.ascontiguousarray(ints, dtype=np.int64).tobytes()], pa.binary()), pa.array([norm.max()]), pa.array([(least / np.maximum(norm, 1e-300)).min() if low else norm.min()]), pa.array([cell], pa.int64()), pa.array([len(ints)], pa.int32())], names=["ids", "ints", "top", "low", "cell", "n"])

            for b in batches:
                held.append(b)
                have += b.num_rows
                while have >= sizes.block:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, sizes.block))
                    held = table.slice(sizes.block).to_batches()
                    have -= sizes.block
            if have:
                yield block(pa.Table.from_batches(held))

        return pack

    # Enough cells for the cluster's cores, each of at most sizes.candidates rows.
    per_cell = min(sizes.candidates, max(sizes.block, n // (4 * spark.sparkContext.defaultParallelism)))
    ranged = measured.select("id", "ints", "norm").repartitionByRange(-(-n // per_cell), F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    blocks = stage(ranged.mapInArrow(packs(per_cell, None), PACKED), "blocks")

    # The head: the longest vectors, of fixed number; every query's first scores to beat.
    longest = measured.select("id", "ints", "norm").orderBy(F.desc("norm"), "id").limit(sizes.head).collect()
    longest = [np.array([r["id"] for r in longest], dtype=np.int64), np.array([r["ints"] + [0] * (width - len(r["ints"])) for r in longest], dtype=np.int64).reshape(-1, width)]
    longest = spark.sparkContext.broadcast(longest)

    def first_scores(batches):
        for b in batches:
            ids, ints = b.column("id").to_numpy().astype(np.int64), _matrix(b.column("ints"), width)
            beat = np.full(len(ids), -np.inf)
            for lo in range(0, len(ids), sizes.block):
                own = slice(lo, lo + sizes.block)
                search = Search(ids[own], ints[own], turn.value, beat[own], k, sizes.leading)
                for at in range(0, len(longest.value[0]), sizes.block):
                    search.meet(longest.value[0][at : at + sizes.block], longest.value[1][at : at + sizes.block])
                beat[own] = search.beat
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ints"), b.column("norm"), pa.array(beat)], names=["id", "ints", "norm", "beat"])

    asked = measured.filter("asks").groupBy("id").agg(F.max("ints").alias("ints"))
    asked = asked.withColumn("norm", length).mapInArrow(first_scores, "id long, ints array<long>, norm double, beat double")
    asked = stage(asked, "asked")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], out)
    reach = F.when(F.col("norm") > 0, F.col("beat") / F.col("norm")).otherwise(F.lit(float("-inf")))
    sorted_ = asked.repartitionByRange(-(-n_asked // sizes.queries), reach, "id").sortWithinPartitions(reach, "id")
    asked = stage(sorted_.mapInArrow(packs(sizes.queries, "beat"), PACKED), "questions")

    # Which group of queries reaches which group of candidates: from one row a group.
    reaches = asked.groupBy(F.col("cell").alias("q_cell")).agg(F.min("low").alias("reach"))
    tops = blocks.groupBy(F.col("cell").alias("c_cell")).agg(F.max("top").alias("top"))
    cells = stage(reaches.join(tops, F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("reach")).select("q_cell", "c_cell"), "cells")
    left = asked.withColumnRenamed("cell", "q_cell").join(cells, "q_cell")
    right = blocks.withColumnRenamed("cell", "c_cell").join(cells, "c_cell")

    def meet(key, questions, candidates):
        found = []
        order = np.argsort(-candidates.column("top").to_numpy(), kind="stable")
        ids_of, ints_of = candidates.column("ids").to_pylist(), candidates.column("ints").to_pylist()
        unpacked = lambda x: np.frombuffer(x, dtype=np.int64).reshape(-1, width)
        for ids, ints, m in zip(questions.column("ids").to_pylist(), questions.column("ints").to_pylist(), questions.column("n").to_pylist(), strict=True):
            ids, beat = np.frombuffer(ids[: 8 * m], dtype=np.int64), np.frombuffer(ids[8 * m :])
            search = Search(ids, unpacked(ints), turn.value, beat, k, sizes.leading)
            for i in order:
                search.meet(np.frombuffer(ids_of[i], dtype=np.int64), unpacked(ints_of[i]))
            q, score, vec = search.found
            found.append((ids[q], vec, score))
        q, vec, score = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

    by = ["q_cell", "c_cell"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_embeddings(embeddings: DataFrame) -> DataFrame:
    """The five best of each vector whose id is divisible by 50."""
    return top_k(embeddings, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
