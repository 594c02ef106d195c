"""Rules that narrow pools of candidates (one row per pool and candidate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import folds, quantiles, ranks, timeline
from larkspur.session import staged


def best_share(rows: DataFrame, pool: str, score: Column, ordinal: str, share: float, least: int = 2, untouched: int = 2) -> DataFrame:
    """The ceil(n*share) best of each pool by score (ties by ordinal), ``least`` at
    least; pools of at most ``untouched`` stay whole, as do candidates of a pool
    none of which has a score. Adds ``rank`` and ``pool_size``."""
    scored = rows.withColumn("score_", score)
    sizes = scored.groupBy(F.col(pool).alias("pool_")).agg(F.count(F.lit(1)).alias("pool_size"), F.count("score_").alias("scored_"))
    placed = scored.withColumn("score_", F.coalesce(-F.col("score_").cast("double"), F.lit(float("inf"))))
    placed = ranks.row_numbers(placed, pool, ["score_", ordinal], "at_", timeline.BLOCK)
    ranked = placed.join(sizes, F.col(pool).eqNullSafe(F.col("pool_"))).withColumn("rank", F.col("at_") + 1).drop("pool_", "at_")
    most = F.greatest(F.ceil(F.col("pool_size") * share), F.lit(least))
    return ranked.filter((F.col("pool_size") <= untouched) | (F.col("scored_") == 0) | (F.col("rank") <= most)).drop("score_", "scored_")


def above_floor(rows: DataFrame, group: str, energy: str, q: float) -> DataFrame:
    """Rows whose energy is not under the group's q-quantile."""
    floor = quantiles.linear(rows, group, energy, {"floor_": q}).withColumnRenamed(group, "of_")
    return rows.join(floor, F.col(group).eqNullSafe(F.col("of_"))).filter(F.col(energy) >= F.col("floor_")).drop("floor_", "of_")


def first_of_tied(rows: DataFrame, pool: str, cost: str, ordinal: str, seed: int) -> DataFrame:
    """(pool, cost, tied, by_index, by_salt): of a pool's cheapest candidates the first by
    ordinal, and the first by sha256 of "seed:pool:ordinal", which never leaves the tied."""
    salt = F.sha2(F.concat_ws(":", F.lit(seed), F.col(pool), F.col(ordinal)), 256)
    tied = rows.groupBy(pool, cost).agg(F.count(F.lit(1)).alias("tied"), F.min(ordinal).alias("by_index"), F.min_by(ordinal, salt).alias("by_salt"))
    best = F.min(F.struct(cost, "tied", "by_index", "by_salt"))
    return tied.groupBy(pool).agg(best.alias("b_")).select(pool, "b_.*")


def stretch_report(slots: DataFrame, candidates: DataFrame, label: str, length: str) -> DataFrame:
    """Per slot, a report and no filter: the longest candidate of its class, the
    stretch that it takes, and whether it must be stretched."""
    longest = candidates.groupBy(label).agg(F.max(length).alias("longest"))
    return slots.join(longest, label, "left").withColumn("stretch", F.col(length) / F.col("longest")).withColumn("stretched", F.col("stretch") > 1)


def phrase_starts(rows: DataFrame, sequence: str, frame: str, novelty: str, q: float, least: int) -> DataFrame:
    """Frames that begin a phrase: 0, and in order those whose novelty is above the
    sequence's q-quantile and that stand at least ``least`` after the last start."""
    cut = quantiles.lower(rows, sequence, novelty, q, "cut_").withColumnRenamed(sequence, "of_")
    high = rows.join(cut, F.col(sequence).eqNullSafe(F.col("of_"))).filter(F.col(novelty) > F.col("cut_"))
    # Frame 0 stands before all others and is always taken.
    zero = rows.select(sequence, F.lit(0).cast("long").alias(frame)).distinct()
    return folds.apart(high.select(sequence, F.col(frame).cast("long").alias(frame)).filter(F.col(frame) > 0).union(zero), sequence, frame, least)


def nearest_in_class(queries: DataFrame, rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(key, donor): for each query the other row of its group whose value is nearest, the
    lesser key of equally near ones; rows without a value come last. ``group`` is not null.

    A group's values stand in order with the two least keys of each, so a query looks at
    its own value and at those beside it: no pairs are formed, however large a group is.
    """
    keyed = rows.select(F.col(group).alias("of_"), F.col(key).alias("key__"), F.col(value).alias("value_"))
    # The least keys by two aggregates of fixed size: the least, and the least of the others.
    least = keyed.groupBy("of_", "value_").agg(F.min("key__").alias("one_"))
    second = keyed.join(least.select(F.struct("of_", "value_").alias("at_"), "one_"), F.struct("of_", "value_").eqNullSafe(F.col("at_"))).filter("key__ <> one_")
    second = second.groupBy(F.struct("of_", "value_").alias("at_")).agg(F.min("key__").alias("two_"))
    values = staged(least.withColumn("at_", F.struct("of_", "value_")).join(second, "at_", "left").drop("at_"), "values")
    numbered = ranks.row_numbers(values.filter("value_ is not null"), "of_", "value_", "nth_", timeline.BLOCK)
    side = lambda w, f: F.when(f("value_").over(w).isNotNull(), F.struct(f("value_").over(w).alias("value"), f("one_").over(w).alias("key")))
    placed = timeline.near(numbered, "of_", "nth_", 1, lambda w: {"below_": side(w, F.lag), "above_": side(w, F.lead)})
    # Without a value near it, a query takes the least other key of its group.
    lead = values.join(values.groupBy("of_").agg(F.min("one_").alias("lead_")), "of_")
    whole = lead.groupBy("of_", "lead_").agg(F.min(F.when(F.col("one_") == F.col("lead_"), F.col("two_")).otherwise(F.col("one_"))).alias("next_"))
    asked = queries.select(F.col(group).alias("of_"), F.col(key), F.col(value).alias("value_"))
    told = asked.join(placed.drop("nth_"), ["of_", "value_"], "left").join(whole, "of_")
    own = F.when(F.col("one_") != F.col(key), F.col("one_")).otherwise(F.col("two_"))
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("value_") - F.col(f"{c}.value")).alias("d"), F.col(f"{c}.key").alias("donor")))
    other = F.when(F.col("lead_") != F.col(key), F.col("lead_")).otherwise(F.col("next_"))
    donor = F.coalesce(F.when(F.col("value_").isNotNull(), F.coalesce(own, F.least(gap("below_"), gap("above_"))["donor"])), other)
    return told.select(key, donor.alias("donor")).filter("donor is not null")
