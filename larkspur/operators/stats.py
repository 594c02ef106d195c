"""Statistics and tests on tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeline
from .ranks import quantile_range, row_numbers


def rank_auc(df: DataFrame, score: str, positive: Column, digits: int | None = 6, parts: int = 4096) -> DataFrame:
    """Area under the ROC curve by ranks, ties counting half, from counts per score.

    The running sum goes by ranges first, cut at approximate quantiles, so that
    scores of any scale are spread.
    """
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(1)).alias("q"))
    ranges = counts.withColumn("r", quantile_range(counts, "s", parts))
    sums = ranges.groupBy("r").agg(F.sum("q").alias("rq"))
    before = sums.withColumn("rb", F.coalesce(F.sum("rq").over(Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("r", "rb")
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = ranges.withColumn("b", F.coalesce(F.sum("q").over(inside), F.lit(0))).join(before, "r")
    wins = F.sum(F.col("p") * (F.col("rb") + F.col("b")) + F.col("p") * F.col("q") / 2)
    auc = F.col("w") / (F.col("positives") * F.col("negatives"))
    return below.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), wins.alias("w")).select("positives", "negatives", (auc if digits is None else F.round(auc, digits)).alias("auc"))


def js_divergence(df: DataFrame, group: str, value: str, left: str, right: str) -> DataFrame:
    """Jensen-Shannon divergence, in bits, of a value's distribution in two groups."""
    counts = df.filter(F.col(group).isin(left, right)).groupBy(value).agg(F.sum((F.col(group) == left).cast("long")).alias("a"), F.sum((F.col(group) == right).cast("long")).alias("b"))
    both = counts.crossJoin(F.broadcast(counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))))
    p = both.withColumn("p", F.try_divide("a", "all_a")).withColumn("q", F.try_divide("b", "all_b")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    return p.agg(F.round(F.sum(term("p") / 2 + term("q") / 2), 6).alias("js_bits"), F.count(F.lit(1)).alias("values"))


def sign_test(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Pairs won, lost and tied, and the exact two-sided p: twice the smaller
    binomial tail of the untied pairs, at most 1."""
    got = df.agg(F.sum((x > y).cast("long")).alias("wins"), F.sum((x < y).cast("long")).alias("losses"), F.sum((x == y).cast("long")).alias("ties"))
    n, most = F.col("wins") + F.col("losses"), F.greatest("wins", "losses")
    # From k = n down: the logarithm of C(n, k) / 2**n grows by ln(k / (n - k + 1)).
    step = lambda a, k: F.struct((a["l"] + F.log(k) - F.log(n - k + 1)).alias("l"), (a["s"] + F.exp(a["l"])).alias("s"))
    start = F.struct((-n * math.log(2.0)).alias("l"), F.lit(0.0).alias("s"))
    # The step for k adds the tail's term for k, then moves on to k - 1.
    tail = F.aggregate(F.sequence(n, most, F.lit(-1).cast("long")), start, step, lambda a: a["s"])
    return got.withColumn("p", F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * tail), 9)))


def _drawn(seed: int, *key: Column) -> Column:
    """A draw below 2**32 from sha256 of the seed and a key, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def permutation_p(entities: DataFrame, key: str, value: str, group: Column, rounds: int = 100, seed: int = 42) -> DataFrame:
    """Share of relabelings of the entities (one row each) whose difference of
    group means is as large as the one seen, with one added to both counts.

    A relabeling gives the group to the same number of entities, the first in a
    seeded order. Rows are values per entity, not the events behind them.
    """
    rows = entities.select(key, F.col(value).cast("double").alias("x"), group.cast("int").alias("g"))
    sizes = rows.agg(F.sum("g").alias("k"))
    spread = rows.select(key, "x", "g", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    # A round's order by ranges of the draws and their counts, so that no task sorts all entities.
    placed = spread.withColumn("draw_", _drawn(seed, F.col("round"), F.col(key)))
    placed = placed.withColumns({"key_": F.struct("round"), "block_": F.floor(F.col("draw_") / 2**20), "order_": F.struct("draw_", key)})
    given = timeline.running(placed, "round", F.col("block_"), "order_", {"n": ("sum", F.lit(1))}).crossJoin(F.broadcast(sizes)).withColumn("h", F.when(F.col("round") == 0, F.col("g") == 1).otherwise(F.col("n") <= F.col("k")))
    means = given.groupBy("round").agg(F.avg(F.when(F.col("h"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("h"), F.col("x"))).alias("b"))
    diff = means.select("round", F.round(F.abs(F.col("a") - F.col("b")), 9).alias("d"))
    seen = diff.filter("round = 0").select(F.col("d").alias("seen"))
    both = diff.filter("round > 0").crossJoin(F.broadcast(seen))
    return both.agg(F.round(F.max("seen"), 6).alias("difference"), F.round((F.sum((F.col("d") >= F.col("seen")).cast("long")) + 1) / (rounds + 1), 6).alias("p_value"))


def bootstrap_mean(entities: DataFrame, key: str, value: str, rounds: int = 100, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean over entities (one row each), drawn with
    replacement as often as there are entities, by seeded draws."""
    one = entities.select(F.lit(0).alias("one_"), key, F.col(value).cast("double").alias("x"))
    numbered = row_numbers(one, "one_", key, "i", timeline.BLOCK).drop("one_")
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    draws = numbered.select("i", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).crossJoin(F.broadcast(n))
    taken = draws.select("round", F.pmod(_drawn(seed, F.col("round"), F.col("i")), F.col("n")).alias("i"))
    means = taken.join(numbered.select("i", "x"), "i").groupBy("round").agg(F.avg("x").alias("m"))
    return means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.count(F.lit(1)).alias("rounds"))


def summed(df: DataFrame, columns: list[str], add: Callable[..., np.ndarray], size: int) -> DataFrame:
    """One row ``sums``: an array of ``size`` doubles (as bytes), which ``add`` gives
    of each batch of the columns. Tasks add up their batches, sixteen tasks the
    tasks' arrays, one task those; no row is copied and none goes through the driver."""

    def partial(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += add(*[b.column(i) for i in range(len(columns))])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches):
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    schema = "sums binary"
    return df.select(*columns).mapInArrow(partial, schema).repartition(16).mapInArrow(added, schema).repartition(1).mapInArrow(added, schema)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _moments_size(width: int) -> int:
    return 1 + width + width * width


def _moments(x: np.ndarray) -> np.ndarray:
    """Count, sums and sums of products of rows."""
    return np.concatenate([[float(len(x))], x.sum(axis=0), (x.T @ x).ravel()])


def _frechet(one: np.ndarray, two: np.ndarray, width: int) -> float:
    """From both sides' moments; the trace of the root of a product by its eigenvalues."""

    def mean_and_covariance(m):
        n, s, q = m[0], m[1 : 1 + width], m[1 + width :].reshape(width, width)
        return s / n, (q - np.outer(s, s) / n) / (n - 1)

    (m1, c1), (m2, c2) = mean_and_covariance(one), mean_and_covariance(two)
    roots = np.sqrt(np.maximum(np.linalg.eigvals(c1 @ c2).real, 0.0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * roots)


def _width(df: DataFrame, vector: str) -> int:
    found = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if found[0] is None or found[0] != found[1]:
        raise ValueError(f"vectors of {vector} need one length, found {found[0]} to {found[1]}")
    return found[0]


def _set(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull())


def frechet(left: DataFrame, right: DataFrame, vector: str) -> DataFrame:
    """One row ``frechet``: the Frechet distance of two sets of vectors, from their
    means and covariances (sums of d and d*d numbers in one pass over each side).
    Null vectors do not count; a side of fewer than two is an error."""
    left, right = _set(left, vector), _set(right, vector)
    width = _width(left, vector)
    if width != _width(right, vector):
        raise ValueError("the two sides' vectors differ in length")
    add = lambda c: _moments(_rows(c, width))
    sides = [summed(df, [vector], add, _moments_size(width)).select(F.lit(i).alias("side"), "sums") for i, df in enumerate((left, right))]

    def told(batches):
        sums = {}
        for b in batches:
            sums |= dict(zip(b.column("side").to_pylist(), map(np.frombuffer, b.column("sums").to_pylist()), strict=True))
        if min(sums[0][0], sums[1][0]) < 2:
            raise ValueError("a side has fewer than two vectors")
        yield pa.RecordBatch.from_arrays([pa.array([_frechet(sums[0], sums[1], width)])], names=["frechet"])

    return sides[0].union(sides[1]).repartition(1).mapInArrow(told, "frechet double")


def paired_swaps(pairs: DataFrame, key: str, arm: str, baseline: str, truth: DataFrame, vector: str, rounds: int = 100, seed: int = 42) -> DataFrame:
    """One row: observed_delta, null_sd, p_one_sided, permutations. The Frechet
    distance of the baselines to the truth less that of the arms, against rounds
    in which each pair's two vectors are swapped where sha256 of
    "seed:round:key" begins with a digit below 8. p is the share of rounds at
    least as far out on the side of what was seen.

    One pass over the pairs: a round's sums are those of the arms plus, for the
    swapped pairs, the difference of the two vectors' products; all rounds' sums
    are one array (rounds times d*d + d numbers). Pairs with a null side do not count.
    """
    pairs = pairs.filter(F.col(arm).isNotNull() & F.col(baseline).isNotNull())
    truth = _set(truth, vector)
    width = _width(truth, vector)
    if {_width(pairs, arm), _width(pairs, baseline)} != {width}:
        raise ValueError("the sides' vectors differ in length")
    m = _moments_size(width)
    swap = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: (F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), F.col(key).cast("string")), 256), 1, 1) < "8").cast("double"))

    def add(a, b, s):
        x, y, s = _rows(a, width), _rows(b, width), _rows(s, rounds)
        total = np.zeros((rounds + 2, m))
        total[0], total[1] = _moments(x), _moments(y)
        for lo in range(0, len(x), 256):  # so many rows' products are held at a time
            own = slice(lo, lo + 256)
            products = lambda v: np.concatenate([v, (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)], axis=1)
            total[2:, 1:] += s[own].T @ (products(y[own]) - products(x[own]))
        return total.ravel()

    both = summed(pairs.withColumn("swap_", swap), [arm, baseline, "swap_"], add, (rounds + 2) * m).select(F.lit(0).alias("side"), "sums")
    real = summed(truth, [vector], lambda c: _moments(_rows(c, width)), m).select(F.lit(1).alias("side"), "sums")

    def told(batches):
        sums = {}
        for b in batches:
            sums |= dict(zip(b.column("side").to_pylist(), map(np.frombuffer, b.column("sums").to_pylist()), strict=True))
        of, aim = sums[0].reshape(rounds + 2, m), sums[1]
        delta = lambda one, two: _frechet(two, aim, width) - _frechet(one, aim, width)
        seen = delta(of[0], of[1])
        null = np.array([delta(of[0] + of[2 + r], of[1] - of[2 + r]) for r in range(rounds)])
        tail = float((null >= seen).mean() if seen >= 0 else (null <= seen).mean())
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([float(null.std(ddof=1))]), pa.array([tail]), pa.array([rounds], pa.int32())], names=["observed_delta", "null_sd", "p_one_sided", "permutations"])

    return both.union(real).repartition(1).mapInArrow(told, "observed_delta double, null_sd double, p_one_sided double, permutations int")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts by truth and prediction with the share of the truth's rows."""
    counts = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))
