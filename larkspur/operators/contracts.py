"""Contract checks: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent (a null key has none), with their rows counted."""
    keys = child.groupBy(child_key).agg(F.count(F.lit(1)).alias("rows"))
    return keys.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def disagreements(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Keys of both sides with the fields that differ, nulls being equal."""
    both = left.alias("l").join(right.alias("r"), key)
    names = F.filter(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return both.select(*key, F.array_join(names, ",").alias("differing")).filter("differing <> ''")


def compared(left: DataFrame, right: DataFrame, key: str, field: str) -> DataFrame:
    """Census of two versions: same, differs, only left, only right."""
    both = left.select(F.col(key).alias("k"), F.col(field).alias("x"), F.lit(1).alias("in_l")).join(right.select(F.col(key).alias("k"), F.col(field).alias("y"), F.lit(1).alias("in_r")), "k", "full")
    verdict = F.when(F.col("in_r").isNull(), "only left").when(F.col("in_l").isNull(), "only right").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("differs")
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def first_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``reason``: the first rule that a row breaks, null if none."""
    reason = None
    for name, broken in rules:
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)
    return df.withColumn("reason", reason)


def all_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``reasons``: every rule that a row breaks, joined by commas."""
    names = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    return df.withColumn("reasons", F.array_join(names, ","))


def agreed_alias(columns: list[str]) -> Column:
    """One of several spellings of a field; an error where two disagree."""
    values = F.array_compact(F.array(*[F.col(c) for c in columns]))
    return F.when(F.size(F.array_distinct(values)) > 1, F.raise_error(F.lit(f"aliases disagree: {', '.join(columns)}"))).otherwise(F.coalesce(*columns))
