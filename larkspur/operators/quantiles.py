"""Exact quantiles of groups of any size."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import ranks, timeline


def counted(df: DataFrame, group: str, value: str, rows: int = timeline.BLOCK) -> DataFrame:
    """(group, value, same, upto, n): how many rows of its group have a value, have it or a lesser one, and are there; nulls do not count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("same"))
    upto = timeline.running(counts, group, ranks.quantile_range(counts, value, rows=rows), value, {"upto": ("sum", F.col("same"))})
    sizes = counts.groupBy(F.col(group).alias("group_")).agg(F.sum("same").alias("n"))
    return upto.join(sizes, F.col(group).eqNullSafe(F.col("group_"))).drop("group_")


def linear(df: DataFrame, group: str, value: str, wanted: dict[str, float], rows: int = timeline.BLOCK) -> DataFrame:
    """One row per group with values, and its quantiles by name, linear between neighbours.

    They are found from counts per value, in ranges of values, so neither a
    group's rows nor its distinct values are one task.
    """
    c = counted(df, group, value, rows)
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    reached = lambda at: F.min(F.when(F.col("upto") > at, F.col(value).cast("double")))
    ends = [f for name, q in wanted.items() for f in (reached(F.floor(place(q))).alias(f"{name}_low"), reached(F.ceil(place(q))).alias(f"{name}_high"))]
    found = c.groupBy(group).agg(F.max("n").alias("n"), *ends)
    part = lambda q: place(q) - F.floor(place(q))
    # Between equal neighbours it is their value, to the last bit, so that a comparison with the values holds.
    between = lambda low, high, q: F.when(low == high, low).otherwise(low * (1 - part(q)) + high * part(q))
    return found.select(group, *[between(F.col(f"{name}_low"), F.col(f"{name}_high"), q).alias(name) for name, q in wanted.items()])


def lower(df: DataFrame, group: str, value: str, q: float, name: str, rows: int = timeline.BLOCK) -> DataFrame:
    """One row per group with values: the value at place floor(q * (n - 1)) of their order, from 0.

    A value is above the linear q-quantile exactly if it is above this one, as none lies
    between its neighbours. ``q`` is the decimal that it is written as, so that the place
    is exact (in floating point 0.7 * 90 is less than 63) and nothing is interpolated.
    """
    part = Fraction(str(q))
    c = counted(df, group, value, rows).withColumn("place_", F.expr(f"({part.numerator} * (n - 1)) div {part.denominator}"))
    return c.groupBy(group).agg(F.min(F.when(F.col("upto") > F.col("place_"), F.col(value))).alias(name))
