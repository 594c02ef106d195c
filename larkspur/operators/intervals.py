"""Joins of half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, sequence: str, width: int) -> DataFrame:
    """Pairs of intervals (``sequence``, start, end, further columns) that overlap.

    Both sides are dealt to bins of ``width``; a pair is found once, in the bin
    in which the later one starts. Adds ``overlap``. The right side's start, end
    and other columns get the prefix ``right_``. Empty intervals meet nothing.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / F.lit(width)), F.floor((F.col("end") - 1) / F.lit(width)))).alias("bin_")
    a = left.filter("start < end").select("*", bins)
    b = right.filter("start < end").select(F.col(sequence), *[F.col(c).alias(f"right_{c}") for c in right.columns if c != sequence], bins)
    begin, end = F.greatest("start", "right_start"), F.least("end", "right_end")
    met = a.join(b, [sequence, "bin_"]).filter((begin < end) & (F.floor(begin / F.lit(width)) == F.col("bin_")))
    return met.withColumn("overlap", end - begin).drop("bin_")
