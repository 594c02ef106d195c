"""Order rules: global ranks without a single-partition window, first-of-group rules, ranked quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, key: str, seed: int = 42, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rank from 1 by (sha256 of "seed:key", key), globally or within ``by``.

    Rows are ranked within the first three hex digits of the hash; what stands
    before each of these 4096 ranges comes from their counts.
    """
    by = by or []
    df = df.withColumn("hash_", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).withColumn("range_", F.substring("hash_", 1, 3))
    counts = df.groupBy(*by, "range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).withColumn("total_", F.sum("n_").over(Window.partitionBy(*by, F.lit(0))))
    within = Window.partitionBy(*by, "range_").orderBy("hash_", key)
    ranked = df.withColumn("at_", F.row_number().over(within))
    for b in by:
        starts = starts.withColumnRenamed(b, f"{b}__")
    same = [ranked["range_"] == starts["range_"], *[ranked[b].eqNullSafe(starts[f"{b}__"]) for b in by]]
    out = ranked.join(starts, same).withColumn(rank, F.col("at_") + F.col("before_")).withColumn("population", F.col("total_"))
    return out.select(*[c for c in df.columns if c not in ("hash_", "range_")], rank, "population")


def quantile_range(df: DataFrame, value: str, parts: int = 4096, rows: int = 512) -> Column:
    """The number of a row's range, in order of ``value``, a number or a time: ranges of
    about ``rows`` rows, cut at approximate quantiles (at most ``parts`` numbers). Nulls are in the first."""
    # One pass for the count and the cuts; fewer ranges take some of these.
    n, fine = df.agg(F.count(F.lit(1)), F.percentile_approx(F.col(value).cast("double"), [(i + 1) / parts for i in range(parts - 1)] or [1.0], 50_000)).first()
    wanted = max(1, min(parts, n // rows))
    if wanted == 1 or not fine:
        return F.lit(0)
    cuts = sorted({fine[min(len(fine) - 1, -(-(i + 1) * parts // wanted) - 1)] for i in range(wanted - 1)})
    wide = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    if not wide:
        return F.lit(0)
    below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col(value).cast("double")))
    at = below(F.lit([w[-1] for w in wide]))
    return at * 64 + below(F.element_at(F.array(*[F.lit(w) for w in wide], F.lit([float("inf")])), at + 1))


def mean_ranks(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Add the rank from 1 by ``value``, ties getting their mean, from counts per
    value and running sums within and over ranges of values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n_"))
    wide = counts.withColumn("range_", quantile_range(counts, value))
    sums = wide.groupBy("range_").agg(F.sum("n_").alias("m_"))
    before = Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range_", F.coalesce(F.sum("m_").over(before), F.lit(0)).alias("before_"))
    within = Window.partitionBy("range_").orderBy(value)
    placed = wide.withColumn("upto_", F.sum("n_").over(within)).join(starts, "range_")
    return df.join(placed.select(value, (F.col("before_") + F.col("upto_") - (F.col("n_") - 1) / 2.0).alias(rank)), value)


def row_numbers(df: DataFrame, by: str, order: str | list[str], number: str, rows: int = 512) -> DataFrame:
    """Number the rows of each group from 0 by ``order``, which has no ties. Where a
    group has more than ``rows`` rows, within ranges of the first column of the order, whose
    starts come from counts, so that no such group is one task."""
    order = [order] if isinstance(order, str) else order
    largest = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_")).agg(F.max("n_")).first()[0] or 0
    if largest <= rows:
        return df.withColumn(number, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))
    # The group as a struct: null groups are equal in the join too, and rows stay where the window has them.
    ranged = df.withColumns({"by_": F.struct(by), "range_": quantile_range(df, order[0], rows=rows)})
    counts = ranged.groupBy("by_", "range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("by_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("by_", "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    within = F.row_number().over(Window.partitionBy("by_", "range_").orderBy(*order)) - 1
    return ranged.withColumn("at_", within).join(starts, ["by_", "range_"]).withColumn(number, F.col("at_") + F.col("before_")).select(*df.columns, number)


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in a total order (latest wins with a descending one)."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("n_ = 1").drop("n_")


def majority(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value per key; of equally frequent ones the least."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("votes"))
    return first_rows(counts, key, [F.desc("votes"), F.asc(value)])


def ranked_quantile(df: DataFrame, value: str, q: float, rule: str) -> DataFrame:
    """A quantile that is one of the values: rank ceil(q*n) ('ceil'), or
    round-half-even of q*(n-1), from 0 ('nearest'). Found from counts by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n_"))
    wide = counts.withColumn("range_", quantile_range(counts, value))
    ranges = wide.groupBy("range_").agg(F.sum("n_").alias("m_"))
    up_to = ranges.withColumn("upto_", F.sum("m_").over(Window.partitionBy(F.lit(0)).orderBy("range_"))).withColumn("all_", F.sum("m_").over(Window.partitionBy(F.lit(0))))
    want = F.greatest(F.ceil(F.lit(q) * F.col("all_")), F.lit(1)) if rule == "ceil" else F.bround(F.lit(q) * (F.col("all_") - 1)) + 1
    chosen = up_to.withColumn("want_", want.cast("long")).filter((F.col("want_") <= F.col("upto_")) & (F.col("want_") > F.col("upto_") - F.col("m_")))
    inside = wide.join(chosen.select("range_", "want_", (F.col("upto_") - F.col("m_")).alias("before_"), "all_"), "range_")
    inside = inside.withColumn("at_", F.col("before_") + F.sum("n_").over(Window.partitionBy("range_").orderBy(value)))
    return inside.filter((F.col("at_") >= F.col("want_")) & (F.col("at_") - F.col("n_") < F.col("want_"))).select(F.col(value).alias("quantile"), F.col("all_").alias("n"))
