"""Segments of sequences: series, spans, windows, stitching and clean-up.

Functions take long tables (sequence, frame, ...) with frames from 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import timeline


def padded_mean(df: DataFrame, sequence: str, frame: str, value: str, half: int, block: int = timeline.BLOCK) -> DataFrame:
    """Add ``smooth``: the mean within ``half`` frames, edges repeated."""

    def mean(w):
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before, after = (half - F.count(F.lit(1)).over(w.rowsBetween(*r)) for r in ((-half, -1), (1, half)))
        inside = F.sum(value).over(w.rowsBetween(-half, half))
        return {"smooth": (inside + before * F.first(value).over(every) + after * F.last(value).over(every)) / (2 * half + 1)}

    return timeline.near(df, sequence, frame, half, mean, block)


def differences(df: DataFrame, sequence: str, frame: str, value: str, orders: int, block: int = timeline.BLOCK) -> DataFrame:
    """Add d1, d2, ...: differences of the series, null where it is too short."""

    def steps(w):
        row, out = [F.lag(value, k).over(w) if k else F.col(value) for k in range(orders + 1)], {}
        for k in range(1, orders + 1):
            row = [a - b for a, b in zip(row, row[1:])]
            out[f"d{k}"] = row[0]
        return out

    return timeline.near(df, sequence, frame, orders, steps, block)


def minima(df: DataFrame, sequence: str, frame: str, value: str, under: float, block: int = timeline.BLOCK) -> DataFrame:
    """Rows lower than the one before, not above the one after, and under so many times the sequence's mean."""
    low = lambda w: (F.col(value) < F.lag(value).over(w)) & (F.col(value) <= F.lead(value).over(w))
    lows = timeline.near(df, sequence, frame, 1, lambda w: {"low_": low(w)}, block).filter("low_").drop("low_")
    means = df.groupBy(F.col(sequence).alias("sequence_")).agg(F.avg(value).alias("mean_"))
    return lows.join(means, F.col(sequence).eqNullSafe(F.col("sequence_"))).filter(F.col(value) <= under * F.col("mean_")).select(*df.columns)


def apart(points: DataFrame, sequence: str, frame: str, value: str, gap: int, most: int) -> DataFrame:
    """Deepest points first, each at least ``gap`` from those taken, at most so many per sequence."""
    found = points.groupBy(sequence).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(frame).cast("long").alias("f")))).alias("p"))
    free = lambda a, x: (F.size(a) < most) & ~F.exists(a, lambda k: F.abs(k - x["f"]) < gap)
    taken = F.aggregate("p", F.expr("cast(array() as array<bigint>)"), lambda a, x: F.when(free(a, x), F.concat(a, F.array(x["f"]))).otherwise(a))
    return found.select(sequence, F.explode(taken).alias(frame))


def merged_points(points: DataFrame, sequence: str, frame: str, value: str, gap: int) -> DataFrame:
    """In order of frames: of a point closer than ``gap`` to the last one the lower stays (the earlier of equals)."""
    found = points.groupBy(sequence).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).cast("long").alias("f"), F.col(value).alias("v")))).alias("p"))
    last = lambda a: F.element_at(a, -1)
    near = lambda a, x: (F.size(a) > 0) & (x["f"] - F.when(F.size(a) > 0, last(a)["f"]) < gap)
    lower = lambda a, x: F.when(x["v"] < last(a)["v"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a)
    step = lambda a, x: F.when(F.coalesce(near(a, x), F.lit(False)), lower(a, x)).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate("p", F.expr("cast(array() as array<struct<f:bigint,v:double>>)"), step)
    return found.select(sequence, F.explode(kept).alias("k")).select(sequence, F.col("k.f").alias(frame), F.col("k.v").alias(value))


def lagged_correlation(df: DataFrame, sequence: str, frame: str, x: str, y: str, lags: int, least: int, block: int = timeline.BLOCK) -> DataFrame:
    """(sequence, lag, r, n): correlation of x with y so many frames later, where at least so many overlap."""
    wide = timeline.near(df, sequence, frame, lags, lambda w: {"ys_": F.array(*[F.lead(y, k).over(w) for k in range(lags + 1)])}, block)
    each = wide.select(sequence, F.col(x).alias("x"), F.posexplode("ys_").alias("lag", "y")).filter("y is not null")
    return each.groupBy(sequence, "lag").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def located(points: DataFrame, spans: DataFrame, sequence: str, at: str, keep: list[str], block: int = timeline.BLOCK) -> DataFrame:
    """As-of: add start and end of the span that begins last at or before each point (null before all; the longest of those that begin together)."""
    p = points.select(sequence, F.col(at).alias("t_"), F.struct(at, *keep).alias("p_"))
    s = spans.select(sequence, F.col("start").alias("t_"), F.struct("start", "end").alias("s_"))
    both = p.unionByName(s, allowMissingColumns=True)
    found = timeline.running(both, sequence, timeline.block_of("t_", block), "t_", {"span_": ("max", F.col("s_"))}).filter("p_ is not null")
    return found.select(sequence, "p_.*", F.col("span_.start").alias("span_start"), F.col("span_.end").alias("span_end"))


def snapped_windows(lengths: DataFrame, sequence: str, length: str, size: int, stride: int) -> DataFrame:
    """Windows every ``stride`` frames and one that ends with the sequence; none where it is shorter."""
    last = (F.col(length) - size).cast("long")
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))
    return lengths.filter(last >= 0).select(sequence, F.explode(starts).alias("start")).withColumn("end", F.col("start") + size)


def stitched(windows: DataFrame, sequence: str, frame: str, start: str, label: str) -> DataFrame:
    """One label per frame from overlapping windows: the first writer's; with whether others differ."""
    return windows.groupBy(sequence, frame).agg(F.min_by(label, start).alias(label), F.count(F.lit(1)).alias("writers"), (F.min(label) != F.max(label)).alias("conflict"))


def blended(windows: DataFrame, sequence: str, frame: str, value: str, weight: Column) -> DataFrame:
    """Overlap-add: the weighted mean of what the windows say of a frame."""
    return windows.groupBy(sequence, frame).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias("blend"))


def resampled(values: Column, n: int) -> Column:
    """A sequence's array at ``n`` evenly spaced places from first to last, linearly between neighbours."""
    m = F.size(values)

    def at(i):
        place = i * (m - 1) / float(n - 1)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, m - 1)
        return F.element_at(values, low + 1) * (1 - (place - low)) + F.element_at(values, high + 1) * (place - low)

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def tiled(values: Column, n: int) -> Column:
    """An array repeated whole and cut to ``n`` elements."""
    times = F.ceil(F.lit(n) / F.greatest(F.size(values), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(values, times)), 1, n)


def merged_short(runs: DataFrame, sequence: str, label: str, least: int) -> DataFrame:
    """Runs (start, end) after short ones are merged, the shortest first (the
    earlier of equals), each into its shorter neighbour (the left of equals),
    until none is shorter than ``least`` or one is left; neighbours that then
    have one label join. One sequence's runs, not its frames, are one group."""
    out = f"{sequence} {runs.schema[sequence].dataType.simpleString()}, {label} {runs.schema[label].dataType.simpleString()}, start long, end long"

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        parts = [list(p) for p in zip(frame[label], frame["start"], frame["end"], strict=True)]
        size = lambda p: p[2] - p[1]
        while len(parts) > 1:
            i = min(range(len(parts)), key=lambda i: (size(parts[i]), i))
            if size(parts[i]) >= least:
                break
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(parts)]
            j = min(near, key=lambda j: (size(parts[j]), j))
            parts[min(i, j)] = [parts[j][0], parts[min(i, j)][1], parts[max(i, j)][2]]
            del parts[max(i, j)]
            at = min(i, j)
            for k in (at, at - 1):
                if 0 <= k < len(parts) - 1 and parts[k][0] == parts[k + 1][0]:
                    parts[k][2] = parts[k + 1][2]
                    del parts[k + 1]
        return pd.DataFrame([(key[0], *p) for p in parts], columns=[sequence, label, "start", "end"])

    return runs.select(sequence, label, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).groupBy(sequence).applyInPandas(fold, out)
