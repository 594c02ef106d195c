"""Controls that a measure is held against: seeded pairings, shufflings and redraws.

Draws are the first 32 bits of sha256, so they depend on keys and seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import ranks


def draw(seed: int, *key: Column) -> Column:
    """A whole number below 2**32 from the seed and the key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def deranged(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, partner): each row's is the next one in seeded order, so none is its own unless it is alone."""
    ranked = ranks.hash_rank(df.select(key), key, seed)
    other = ranked.select(F.col(key).alias("partner"), F.col("rank").alias("rank_"))
    return ranked.join(other, F.col("rank_") == F.col("rank") % F.col("population") + 1).select(key, "partner")


def shuffled_groups(df: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """(key, group, shuffled): groups of the same sizes with members drawn anew.

    The n-th row in seeded order takes the n-th place of the groups laid end to end.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy(group))
    ends = sizes.select(F.col(group).alias("shuffled"), (upto - F.col("n_")).alias("first_"), (upto - 1).alias("last_"))
    # Groups are cut to stretches of places, so that a place finds its group by equality.
    stretch = F.explode(F.sequence(F.floor(F.col("first_") / 1024), F.floor(F.col("last_") / 1024))).alias("stretch_")
    ranked = ranks.hash_rank(df.select(key, group), key, seed).withColumn("at_", F.col("rank") - 1).withColumn("stretch_", F.floor(F.col("at_") / 1024))
    met = ranked.join(ends.select("*", stretch), "stretch_").filter("at_ between first_ and last_")
    return met.select(key, group, "shuffled")


def redrawn(df: DataFrame, key: list[str], label: str, seed: int) -> DataFrame:
    """Add ``redrawn``: a label by the shares that labels have in the table. The distinct labels are one row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy(label))
    total = F.sum("n_").over(Window.partitionBy(F.lit(0)))
    table = counts.select(F.struct(upto.alias("upto"), F.col(label).alias("label")).alias("c_"), total.alias("all_")).agg(F.array_sort(F.collect_list("c_")).alias("classes_"), F.max("all_").alias("all_"))
    place = F.floor(draw(seed, *[F.col(k) for k in key]) * F.col("all_") / F.lit(2**32))
    met = df.crossJoin(F.broadcast(table)).withColumn("place_", place)
    return met.withColumn("redrawn", F.filter("classes_", lambda c: c["upto"] > F.col("place_"))[0]["label"]).drop("classes_", "all_", "place_")


def stratified_pairs(df: DataFrame, key: str, group: str, draws: DataFrame, number: str, seed: int) -> DataFrame:
    """(number, group, left, right): for each draw first a group, then two of its
    members, so small groups count as much as large ones. Groups of one have no pairs."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size_")).filter("size_ > 1")
    every = Window.partitionBy(F.lit(0))
    numbered = sizes.withColumn("g_", F.row_number().over(every.orderBy(group)) - 1).withColumn("groups_", F.count(F.lit(1)).over(every))
    known = F.broadcast(numbered.agg(F.max("groups_").alias("groups_")))
    drawn = draws.select(number).crossJoin(known).withColumn("g_", draw(seed, F.col(number), F.lit("group")) % F.col("groups_")).drop("groups_")
    drawn = drawn.join(numbered.drop("groups_"), "g_")
    first = draw(seed, F.col(number), F.lit("left")) % F.col("size_")
    second = (first + 1 + draw(seed, F.col(number), F.lit("right")) % (F.col("size_") - 1)) % F.col("size_")
    drawn = drawn.withColumn("a_", first).withColumn("b_", second)
    members = ranks.row_numbers(df.select(key, group), group, key, "m_")
    left = members.select(group, F.col("m_").alias("a_"), F.col(key).alias("left"))
    right = members.select(group, F.col("m_").alias("b_"), F.col(key).alias("right"))
    return drawn.join(left, [group, "a_"]).join(right, [group, "b_"]).select(number, group, "left", "right")
