"""Retrieval scored on pools of a fixed size, drawn again and again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drawn(rows: DataFrame, key: str, size: int, repeats: int, seed: int = 42) -> DataFrame:
    """``repeats`` pools of ``size`` different rows: each has those with the least
    sha256 of "seed:draw:key". Adds ``draw``, from 1. One pass over the rows;
    a task passes on at most ``size`` rows of each draw."""
    told = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    told = told.withColumn("hash_", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(key).cast("string")), 256))
    order = Window.partitionBy("draw").orderBy("hash_", key)
    return told.withColumn("at_", F.row_number().over(order)).filter(F.col("at_") <= size).drop("hash_", "at_")


def _standard(x: np.ndarray) -> np.ndarray:
    deviation = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(deviation >= 1e-10, deviation, 1.0)


def _distances(x: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(x)))
    for k in range(x.shape[1]):
        total += (x[:, k, None] - x[None, :, k]) ** 2
    return np.round(np.sqrt(total), 9)


def r_precision(by: np.ndarray, other: np.ndarray, groups: list | None, top: int) -> tuple[int, int]:
    """(hits, clips scored) of one pool: a clip's nearest neighbour by the one
    vector is a hit if at most ``top`` candidates are as near by the other. Each
    dimension is standardised over the pool. Candidates are the other clips,
    or, with groups, those of other groups; a clip with ``top`` of them or
    fewer is not scored. The first of equally near neighbours counts."""
    d, e = _distances(_standard(by)), _distances(_standard(other))
    fine = ~np.eye(len(by), dtype=bool)
    if groups is not None:
        # Null groups are one group.
        _, codes = np.unique([repr(g) for g in groups], return_inverse=True)
        fine &= codes[:, None] != codes[None, :]
    hits = scored = 0
    for i in range(len(by)):
        candidates = np.flatnonzero(fine[i])
        if len(candidates) <= top:
            continue
        nearest = candidates[np.argmin(d[i, candidates])]
        hits += int((e[i, candidates] <= e[i, nearest]).sum()) <= top
        scored += 1
    return hits, scored


def precision_at_pool(rows: DataFrame, key: str, by: str, other: str, size: int, repeats: int, top: int = 3, seed: int = 42, group: str | None = None) -> DataFrame:
    """One row: pool_size, draws, draws_scored, r_mean, r_std, r_min, r_max,
    chance_r. R is the percentage of hits (see :func:`r_precision`) of a drawn
    pool, whose rows are taken in order of ``key``.

    A draw in which no clip can be scored is counted and left out; if there is
    none, or fewer rows than ``size``, or a ``size`` under top + 2, that is an
    error. Rows without a key or a vector take no part.
    """
    if size < top + 2:
        raise ValueError(f"a pool of {size} cannot support the first {top}")
    fine = rows.filter(F.col(key).isNotNull() & F.col(by).isNotNull() & F.col(other).isNotNull())
    if (n := fine.count()) < size:
        raise ValueError(f"cannot draw a pool of {size} from {n} rows")
    pools = drawn(fine.select(key, by, other, *([group] if group else [])), key, size, repeats, seed)

    def score(draw: tuple, pool: pa.Table) -> pa.Table:
        pool = pool.sort_by(key)
        vectors = lambda c: np.array(pool.column(c).to_pylist(), dtype=float)
        hits, scored = r_precision(vectors(by), vectors(other), pool.column(group).to_pylist() if group else None, top)
        return pa.table({"draw": pa.array([draw[0].as_py()], pa.int32()), "r": pa.array([100.0 * hits / scored if scored else None], pa.float64())})

    each = pools.groupBy("draw").applyInArrow(score, "draw int, r double")
    r = lambda f, name: F.round(f("r"), 2).alias(name)
    none = F.raise_error(F.lit(f"no pool of {size} could be scored"))
    return each.agg(F.count("r").alias("draws_scored"), r(F.avg, "r_mean"), r(F.stddev_pop, "r_std"), r(F.min, "r_min"), r(F.max, "r_max")).select(
        F.lit(size).alias("pool_size"), F.lit(repeats).alias("draws"), F.when(F.col("draws_scored") > 0, F.col("draws_scored")).otherwise(none.cast("long")).alias("draws_scored"), "r_mean", "r_std", "r_min", "r_max", F.lit(round(100.0 * top / (size - 1), 2)).alias("chance_r"))
