"""Power spectra of sequences by half-overlapping windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import timeline


def welch(df: DataFrame, sequence: str, frame: str, values: list[str], segment: int, rate: float) -> DataFrame:
    """(sequence, bin, frequency, power, windows): the mean periodogram over Hann windows of ``segment`` frames
    that overlap by half, each less its mean, and over the columns in ``values``.

    Frames count from 0 without gaps. Windows with a null or a number that is not finite
    take no part; a sequence without a window has no rows. A window is one
    row, so a long sequence is many tasks, and the powers are means that combine before the shuffle.
    """
    if segment < 4:
        raise ValueError(f"a window of {segment} frames has no spectrum")
    wide = df.select(F.struct(sequence).alias("key_"), F.col(frame).cast("long").alias("at_"), F.array(*[F.col(v).cast("double") for v in values]).alias("x_"))
    shown = timeline.in_windows(wide, "at_", segment, segment // 2)
    fine = ~F.exists("x_", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = shown.filter(fine).groupBy("key_", "start").agg(F.array_sort(F.collect_list(F.struct("at_", "x_"))).alias("rows_")).filter(F.size("rows_") == segment)
    hann = np.hanning(segment)
    scale = (hann**2).sum() * rate

    @F.pandas_udf("array<double>")
    def periodogram(flat: pd.Series) -> pd.Series:
        if not len(flat):
            return pd.Series([], dtype=object)
        x = np.stack(flat.to_numpy()).reshape(len(flat), segment, -1)
        spectrum = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann[None, :, None], axis=1)
        return pd.Series(list((np.abs(spectrum) ** 2).mean(axis=2) / scale))

    flat = F.flatten(F.transform("rows_", lambda r: r["x_"]))
    each = whole.select("key_", F.posexplode(periodogram(flat)).alias("bin", "power_"))
    mean = each.groupBy("key_", "bin").agg(F.avg("power_").alias("power"), F.count(F.lit(1)).alias("windows"))
    return mean.select(F.col(f"key_.{sequence}").alias(sequence), "bin", (F.col("bin") * F.lit(rate / segment)).alias("frequency"), "power", "windows")


def band_share(spectrum: DataFrame, sequence: str, low: float, high: float) -> DataFrame:
    """(sequence, share): how much of a sequence's power above frequency 0 lies in [low, high); 0 where it is still."""
    inside = F.sum(F.when((F.col("frequency") >= low) & (F.col("frequency") < high), F.col("power")).otherwise(0.0))
    moving = spectrum.filter("bin > 0").groupBy(sequence)
    return moving.agg((inside / F.greatest(F.sum("power"), F.lit(1e-30))).alias("share"))
