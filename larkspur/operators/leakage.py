"""Whether held-out sequences have a copy among the training ones: measured, against controls and a null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.session import staged

#: Sequences of either side that are compared in one task.
SIDE = 64


def drawn(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """The ``size`` rows of least sha256 of "seed:key", ties by key; all rows where there are fewer."""
    named = rows.withColumn("hash_", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    return named.orderBy("hash_", key).limit(size).drop("hash_")


def distance(left: np.ndarray, right: np.ndarray, lag: int, least: int) -> float | None:
    """The median over frames of the distance of ``left`` at t and ``right`` at
    t - lag, to nine decimals; None where fewer than ``least`` frames overlap."""
    begin, end = max(0, lag), min(len(left), len(right) + lag)
    if end - begin < least:
        return None
    gap = left[begin:end] - right[begin - lag : end - lag]
    return round(float(np.median(np.sqrt((gap**2).sum(axis=1)))), 9)


def _matrix(series) -> np.ndarray:
    return np.array([np.asarray(frame, dtype=float) for frame in series])


def _pairs(held: DataFrame, pool: DataFrame, key: str, series: str, least: int, sizes: tuple[int, int]) -> DataFrame:
    """(held, other, d, back): distances of all drawn pairs, block by block, to the other and to it reversed."""
    kind = held.schema[key].dataType.simpleString()
    blocks = [-(-n // SIDE) for n in sizes]
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    shown = lambda df: df.select(F.col(key).alias("key_"), F.col(series).alias("series_"), key)
    left = shown(held).withColumn("p_", block(blocks[0])).withColumn("q_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[1] - 1).cast("long")))).drop(key)
    right = shown(pool).withColumn("q_", block(blocks[1])).withColumn("p_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[0] - 1).cast("long")))).drop(key)

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        others = [(k, _matrix(s)) for k, s in zip(b["key_"], b["series_"], strict=True)]
        out = []
        for k, s in zip(a["key_"], a["series_"], strict=True):
            one = _matrix(s)
            for other, there in others:
                d = distance(one, there, 0, least)
                if d is not None:
                    out.append((k, other, d, distance(one, there[::-1], 0, least)))
        return pd.DataFrame(out, columns=["held", "other", "d", "back"])

    return left.groupBy("p_", "q_").cogroup(right.groupBy("p_", "q_")).applyInPandas(compared, f"held {kind}, other {kind}, d double, back double")


def _rescored(pairs: DataFrame, held: DataFrame, pool: DataFrame, key: str, series: str, d: str, top: int, lags: list[int], least: int, back: bool) -> DataFrame:
    """(held, nearest, distance, lag): the best of each held sequence's ``top`` nearest, each at its best lag."""
    order = Window.partitionBy("held").orderBy(d, "other")
    close = pairs.withColumn("at_", F.row_number().over(order)).filter(F.col("at_") <= top).select("held", "other")
    side = lambda df, name, x: df.select(F.col(key).alias(name), x.alias(f"{name}_"))
    there = F.reverse(series) if back else F.col(series)
    met = close.join(side(held, "held", F.col(series)), "held").join(side(pool, "other", there), "other")

    @F.pandas_udf("struct<distance: double, lag: int>")
    def best(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            one, two = _matrix(x), _matrix(y)
            found = [(v, lag) for lag in lags if (v := distance(one, two, lag, least)) is not None]
            # The first lag of equally near ones.
            out.append(min(found, key=lambda f: f[0], default=(None, None)))
        return pd.DataFrame(out, columns=["distance", "lag"]).astype({"distance": "float64", "lag": "Int32"})

    told = met.select("held", "other", best("held_", "other_").alias("b_"))
    first = told.filter("b_.distance is not null").groupBy("held").agg(F.min(F.struct("b_.distance", "other", "b_.lag")).alias("m_"))
    return first.select("held", F.col("m_.other").alias("nearest"), "m_.distance", "m_.lag")


def _ratio(best: DataFrame, pairs: DataFrame, d: str, share: float, fewest: int, name: str) -> DataFrame:
    """Add the larger of a distance's parts of the held sequence's and of its neighbour's own low quantile."""
    low = lambda by: pairs.groupBy(by).agg(F.when(F.count(d) >= fewest, F.percentile(d, share)).alias(f"{by}_low"))
    own = best.join(low("held"), "held").filter("held_low is not null")
    both = own.join(low("other").withColumnRenamed("other", "nearest"), "nearest")
    part = lambda c: F.when(F.col(c) > 0, F.col("distance") / F.col(c))
    return both.withColumn(name, F.greatest(part("held_low"), part("other_low")))


def measured(held: DataFrame, pool: DataFrame, key: str, series: str, lags: list[int], sizes: tuple[int, int], least: int = 8, top: int = 5, share: float = 0.05, fewest: int = 20) -> DataFrame:
    """One row per drawn held-out sequence with enough comparisons: its nearest training sequence, how far
    at which lag, and three ratios.

    ``series`` is an array of frames, each an array of numbers. ``sizes`` sequences of
    ``held`` and ``pool`` are drawn by hash (give their counts for all); all drawn pairs
    are compared at lag 0, the ``top`` nearest at every one of ``lags``. A ratio is the
    distance over the low quantile (``share``) of the same held sequence's distances, or
    of its neighbour's to all held ones if that gives more: a copy is close both ways, a
    sequence near to everything only one way. Sequences with fewer than ``fewest``
    comparisons have no row. ``null_ratio`` is the same reading of the pool played
    backwards at lag 0, ``matched_ratio`` of it at its best lags. Null series and keys take no part; keys are distinct.
    """
    fine = lambda df: df.filter(F.col(key).isNotNull() & F.col(series).isNotNull()).select(key, series)
    held, pool = (staged(drawn(fine(df), key, n), name) for df, n, name in ((held, sizes[0], "held"), (pool, sizes[1], "pool")))
    pairs = staged(_pairs(held, pool, key, series, least, sizes), "leakage_pairs")
    ahead = _ratio(_rescored(pairs, held, pool, key, series, "d", top, lags, least, False), pairs, "d", share, fewest, "ratio")
    back = pairs.groupBy("held").agg(F.min(F.struct("back", "other")).alias("m_")).select("held", F.col("m_.other").alias("nearest"), F.col("m_.back").alias("distance"))
    null = _ratio(back, pairs, "back", share, fewest, "null_ratio").select("held", "null_ratio")
    matched = _ratio(_rescored(pairs, held, pool, key, series, "back", top, lags, least, True), pairs, "back", share, fewest, "matched_ratio").select("held", "matched_ratio")
    told = ahead.join(null, "held", "left").join(matched, "held", "left")
    return told.select(F.col("held").alias(key), "nearest", "distance", "lag", "held_low", "other_low", "ratio", "null_ratio", "matched_ratio")


def _nearest_rank(values: Column, q: float) -> Column:
    ordered = F.sort_array(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int")))


def report(readings: DataFrame, linked: Column, partnered: Column) -> DataFrame:
    """One row: how many readings fall under the threshold that the controls set, and how many by chance.

    ``linked`` says that a held-out sequence is known to be related to any other, ``partnered`` that one of those is in the
    pool. The threshold is the unlinked ones' ratio of rank 0.05 (ten of them at least, else null and nothing
    is flagged). ``excess`` and ``matched_excess`` are what is flagged beyond the readings of the
    reversed pool; ``controls_separate`` asks that the partnered ones' median ratio (five at least) is
    under the unlinked ones' lower quartile. The readings are as many as were drawn.
    """
    got = readings.withColumns({"linked_": F.coalesce(linked, F.lit(False)), "partnered_": F.coalesce(partnered, F.lit(False))})
    each = F.collect_list(F.struct("ratio", "null_ratio", "matched_ratio"))
    sums = got.agg(F.count(F.lit(1)).alias("checked"), each.alias("all_"), F.collect_list(F.when(~F.col("linked_"), F.col("ratio"))).alias("negative_"), F.collect_list(F.when(F.col("partnered_"), F.col("ratio"))).alias("positive_"))
    sums = sums.withColumn("threshold", F.when(F.size("negative_") >= 10, _nearest_rank(F.col("negative_"), 0.05)))
    under = lambda name: F.size(F.filter("all_", lambda r: F.coalesce(r[name] < F.col("threshold"), F.lit(False))))
    middle = lambda a: F.expr(f"aggregate(slice(sort_array({a}), int((size({a}) + 1) div 2), if(size({a}) % 2 = 0, 2, 1)), 0d, (s, x) -> s + x, s -> s / if(size({a}) % 2 = 0, 2, 1))")
    sums = sums.withColumns({"flagged": under("ratio"), "null_flagged": under("null_ratio"), "matched_flagged": under("matched_ratio")})
    sums = sums.withColumn("positive_median", F.when(F.size("positive_") > 0, middle("positive_")))
    paired = F.filter("all_", lambda r: r["ratio"].isNotNull() & r["matched_ratio"].isNotNull())
    separate = (F.size("positive_") >= 5) & (F.size("negative_") >= 10) & (F.col("positive_median") < _nearest_rank(F.col("negative_"), 0.25))
    return sums.select(
        "checked",
        "threshold",
        F.size("positive_").alias("positives"),
        "positive_median",
        F.size("negative_").alias("negatives"),
        F.coalesce(separate, F.lit(False)).alias("controls_separate"),
        "flagged",
        "null_flagged",
        (F.col("flagged") - F.col("null_flagged")).alias("excess"),
        (F.col("flagged") - F.col("matched_flagged")).alias("matched_excess"),
        F.size(paired).alias("paired"),
        F.size(F.filter(paired, lambda r: r["ratio"] < r["matched_ratio"])).alias("closer_than_reversed"),
    )
