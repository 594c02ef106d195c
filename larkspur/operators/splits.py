"""Deterministic splits and their leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import staged

from . import timeline
from .ranks import hash_rank, quantile_range, row_numbers


def rank_split(df: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """train, val and test by hash rank: floor(n*share) rows each, the rest test."""
    ranked = hash_rank(df, key, seed, by=by)
    train, val = F.floor(F.col("population") * shares[0]), F.floor(F.col("population") * shares[1])
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "population")


def group_fill_split(df: DataFrame, group: str, mass: str, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Whole groups, heaviest first (ties by name), fill train, then val, then test
    by the mass that stands before them. One row per group."""
    sizes = staged(df.groupBy(group).agg(F.sum(mass).alias("mass"), F.count(F.lit(1)).alias("members")), "sizes")
    # Running sums within ranges of masses and over their totals.
    placed = sizes.withColumns({"key_": F.struct(F.lit(0)), "light_": -F.coalesce("mass", F.lit(0)).cast("double")})
    placed = placed.withColumns({"block_": quantile_range(placed, "light_"), "order_": F.struct("light_", group)})
    summed = timeline.running(placed, group, F.col("block_"), "order_", {"upto": ("sum", F.coalesce("mass", F.lit(0)))}, keep=True)
    sized = summed.withColumn("before", F.col("upto") - F.coalesce("mass", F.lit(0))).crossJoin(F.broadcast(sizes.agg(F.sum("mass").alias("total"))))
    split = F.when(F.col("before") < F.col("total") * shares[0], "train").when(F.col("before") < F.col("total") * (shares[0] + shares[1]), "val").otherwise("test")
    return sized.withColumn("split", split).select(group, "mass", "members", "split")


def spanning_groups(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Values of any of the keys that occur in more than one split."""
    stacked = df.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k"))
    seen = stacked.filter(F.col("k.value").isNotNull()).groupBy("k.key", "k.value", split).agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n_splits"), F.sum("n").alias("members")).filter("n_splits > 1")


def duplicate_groups(df: DataFrame, key: str, content: str, split: str | None = None, hashed: bool = False) -> DataFrame:
    """Contents (or with ``hashed`` their hashes) that several rows have, and whether they cross the splits."""
    base = df.withColumn("content_sha256", F.col(content) if hashed else F.sha2(content, 256))
    spread = [F.count_distinct(split).alias("n_splits"), (F.count_distinct(split) > 1).alias("cross_split_collision")] if split else []
    return base.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first_id"), *spread).filter("members > 1")


def shared_between(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """For each two splits, how many keys they share."""
    seen = df.select(key, split).distinct()
    pairs = seen.alias("a").join(seen.alias("b"), key).filter(F.col(f"a.{split}") < F.col(f"b.{split}"))
    return pairs.groupBy(F.col(f"a.{split}").alias("left_split"), F.col(f"b.{split}").alias("right_split")).agg(F.count(F.lit(1)).alias("shared"))


#: Distinct masses that ``largest_deficit`` takes; n of them need n*n/2 rows at least.
MOST_MASSES = 1_000_000

#: Places of a split that are written out by one task.
PLACES = 65_536


def largest_deficit(df: DataFrame, group: str, mass: str, shares: dict[str, int], held: dict[str, int] | None = None, seed: int | None = None) -> DataFrame:
    """Whole groups, heaviest first, each to the split farthest below its share of
    all mass (ties to the greatest name). One row per group. Masses are whole
    numbers. Equal masses go by the number ``group``, or with a seed by sha256
    of "seed:group". ``held`` is the mass that splits have already; it is part of all mass.

    Groups of one mass differ by name only, so the driver walks through the
    distinct masses and their counts, whose number is checked. Of m equal groups
    a split takes as many as it has places among the m largest of the deficits
    left before each; every place's turn follows from the other splits' deficits.
    """
    sizes = df.groupBy(group).agg(F.sum(mass).cast("long").alias("mass"))
    counts = sizes.groupBy("mass").agg(F.count(F.lit(1)).alias("n"))
    if counts.count() > MOST_MASSES:
        raise ValueError(f"more than {MOST_MASSES} distinct masses")
    table, names, unit = sorted(map(tuple, counts.collect()), reverse=True), sorted(shares, reverse=True), sum(shares.values())
    held = held or {}
    total = sum(m * n for m, n in table) + sum(held.values())
    left, quotas = [shares[s] * total - unit * held.get(s, 0) for s in names], []
    for m, n in table:
        step = unit * m
        if step == 0:
            taken = [n if i == left.index(max(left)) else 0 for i in range(len(names))]
        else:
            over = lambda t: [max(0, (d - t) // step + 1) for d in left]  # noqa: B023, E731  places of deficit t or more
            low, high = min(left) - step * n, max(left) + 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if sum(over(middle)) >= n else (low, middle)
            taken, level = over(low + 1), over(low)
            for i in range(len(names)):
                more = min(level[i] - taken[i], n - sum(taken))
                taken[i] += max(0, more)
        quotas += [(m, i, left[i], k, left[:], taken) for i, k in enumerate(taken) if k]
        left = [d - step * k for d, k in zip(left, taken, strict=True)]
    given = df.sparkSession.createDataFrame(quotas, "mass long, split_ int, from_ long, n_ long, all_ array<long>, taken_ array<long>")
    step = F.col("mass") * unit
    # Places in two steps, so that the many of one mass are many tasks' and no long array.
    parts = given.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / PLACES)))).repartition("mass", "split_", "part_")
    first = F.col("part_") * PLACES
    places = parts.withColumn("i_", F.explode(F.sequence(first, F.least(first + PLACES, F.col("n_")) - 1)))
    key = F.col("from_") - step * F.col("i_")
    before = lambda j: F.expr(f"greatest(0L, least(taken_[{j}], if(all_[{j}] < key_, 0L, (all_[{j}] - key_) div nullif(mass * {unit}, 0) + if({j} < split_ or (all_[{j}] - key_) % nullif(mass * {unit}, 0) <> 0, 1L, 0L))))")
    turn = sum((F.when(F.col("split_") == j, F.col("i_")).otherwise(before(j)) for j in range(len(names))), F.lit(0))
    placed = places.withColumn("key_", key).withColumn("turn_", F.when(F.col("mass") == 0, F.col("i_")).otherwise(turn)).select("mass", "turn_", "split_")
    order = [group]
    if seed is not None:
        sizes = sizes.withColumn("hash_", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256))
        sizes, order = sizes.withColumn("early_", F.conv(F.substring("hash_", 1, 12), 16, 10).cast("long")), ["early_", "hash_", group]
    numbered = row_numbers(sizes, "mass", order, "turn_")
    return numbered.join(placed, ["mass", "turn_"]).select(group, "mass", F.element_at(F.lit(names), F.col("split_") + 1).alias("split"))


def guarded_fill(df: DataFrame, group: str, mass: str, parts: dict[str, int], of: int, most: float, seed: int = 42) -> DataFrame:
    """Whole groups in the order of sha256 of "seed:group" fill each part by the mass
    (whole numbers) before them, ``parts`` of ``of`` shares; the rest, and every
    group with more than ``most`` of all mass, is train. Running sums by ranges
    of the hash, so that no task takes all groups."""
    sizes = df.groupBy(group).agg(F.sum(mass).cast("long").alias("mass"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("mass").alias("total_")))).withColumn("oversize", F.col("mass") > F.col("total_") * most)
    sizes = sizes.withColumn("hash_", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256)).withColumn("range_", F.substring("hash_", 1, 3))
    counted = F.when(F.col("oversize"), F.lit(0)).otherwise(F.col("mass"))
    ranges = sizes.groupBy("range_").agg(F.sum(counted).alias("m_"))
    ranges = ranges.select("range_", F.coalesce(F.sum("m_").over(Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    within = Window.partitionBy("range_").orderBy("hash_", group).rowsBetween(Window.unboundedPreceding, -1)
    sized = sizes.withColumn("at_", F.coalesce(F.sum(counted).over(within), F.lit(0))).join(ranges, "range_").withColumn("before_", F.col("at_") + F.col("start_"))
    split, upto = F.when(F.col("oversize"), "train"), 0
    for name, share in parts.items():
        upto += share
        split = split.when(F.col("before_") * of < F.col("total_") * upto, name)
    return sized.select(group, "mass", "oversize", split.otherwise("train").alias("split"))
