"""Whether cuts are where a sequence changes, and whether plans agree about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import quantiles, ranks, timeline


def sudden(df: DataFrame, sequence: str, score: str, floor: float, ratio: float) -> DataFrame:
    """The rows whose score is over ``floor`` and over ``ratio`` times the median of their
    sequence (a millionth at least); null scores are none, and null sequences one sequence."""
    middle = quantiles.linear(df, sequence, score, {"median_": 0.5}).select(F.col(sequence).alias("of_"), "median_")
    met = df.join(middle, F.col(sequence).eqNullSafe(F.col("of_")))
    return met.filter((F.col(score) > floor) & (F.col(score) > ratio * F.greatest("median_", F.lit(1e-6)))).drop("of_", "median_")


def _across(frames: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Add ``alike``, the cosine of the mean unit vectors of the ``window`` frames before and from a place on."""
    each = places.withColumn("k_", F.explode(F.sequence(F.lit(-window), F.lit(window - 1)))).withColumn("at_", F.col("place_") + F.col("k_"))
    met = each.join(frames, ["key_", "at_"]).groupBy("key_", "place_", "cut_", (F.col("k_") < 0).alias("before_"))
    # At most as many vectors as a window has frames, in their order, so that sums are the same in every run.
    sides = met.agg(F.array_sort(F.collect_list(F.struct("at_", "unit_"))).alias("u_"))
    total = F.aggregate(F.expr("slice(u_, 2, size(u_))"), F.col("u_")[0]["unit_"], lambda acc, u: F.zip_with(acc, u["unit_"], lambda a, b: a + b))
    summed = sides.withColumn("sum_", total).groupBy("key_", "place_", "cut_").agg(F.first(F.when(F.col("before_"), F.col("sum_")), True).alias("a_"), F.first(F.when(~F.col("before_"), F.col("sum_")), True).alias("b_"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return summed.select("key_", "cut_", (dot("a_", "b_") / (F.sqrt(dot("a_", "a_")) * F.sqrt(dot("b_", "b_")) + 1e-12)).alias("alike"))


def contrast(frames: DataFrame, cuts: DataFrame, sequence: str, frame: str, vector: str, window: int, seed: int = 42) -> DataFrame:
    """(sequence, cuts, drawn, contrast): how much less alike the frames on either side of a cut are than
    those around a random place, on average; null without cuts or without places.

    Cuts nearer than ``window`` to an end do not count. Places are at least that far
    in (as far before the end and one more) and more than ``window`` from every cut that counts; as many as
    there are cuts are drawn, those of least sha256 of "seed:place". Frames count from 0
    without gaps and have vectors without nulls. Repeated cuts are one.
    """
    keyed = F.struct(sequence).alias("key_")
    norm = F.sqrt(F.aggregate("v_", F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    rows = frames.select(sequence, keyed, F.col(frame).cast("long").alias("at_"), F.transform(vector, lambda x: x.cast("double")).alias("v_"))
    rows = rows.withColumn("unit_", F.transform("v_", lambda x: x / norm)).drop("v_")
    lengths = rows.groupBy("key_").agg(F.max("at_").alias("last_"))
    inner = cuts.select(keyed, F.col(frame).cast("long").alias("place_")).distinct().join(lengths, "key_")
    inner = inner.filter((F.col("place_") >= window) & (F.col("place_") <= F.col("last_") + 1 - window)).select("key_", "place_")
    marked = rows.select(sequence, "key_", "at_").join(inner.select("key_", F.col("place_").alias("at_"), F.lit(1).alias("cut_")), ["key_", "at_"], "left").drop("key_")
    near = timeline.near(marked, sequence, "at_", window, lambda w: {"close_": F.max("cut_").over(w.rowsBetween(-window, window))})
    free = near.filter("close_ is null").select(F.struct(sequence).alias("key_"), F.col("at_").alias("place_")).join(lengths, "key_")
    free = free.filter((F.col("place_") >= window) & (F.col("place_") <= F.col("last_") - window)).select("key_", "place_")
    counts = inner.groupBy("key_").agg(F.count(F.lit(1)).alias("n_"))
    drawn = ranks.hash_rank(free, "place_", seed, "rank_", by=["key_"]).join(counts, "key_").filter(F.col("rank_") <= F.col("n_")).select("key_", "place_")
    both = inner.withColumn("cut_", F.lit(True)).unionByName(drawn.withColumn("cut_", F.lit(False)))
    told = _across(rows.select("key_", "at_", "unit_"), both, window).groupBy("key_").agg(F.count_if("cut_").alias("cuts"), F.count_if(~F.col("cut_")).alias("drawn"), (F.avg(F.when(~F.col("cut_"), F.col("alike"))) - F.avg(F.when(F.col("cut_"), F.col("alike")))).alias("contrast"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return lengths.join(told, "key_", "left").select(F.col(f"key_.{sequence}").alias(sequence), zero("cuts"), zero("drawn"), "contrast")


def disagreement(plans: DataFrame, seed: str, clip: str, frame: str, label: str) -> DataFrame:
    """(seed, other, clips, mean, least, most): for each two seeds how large a part of the frames that both
    plans of a clip have differ in label (nulls being equal), over the clips that both have."""
    rows = plans.filter(F.col(seed).isNotNull()).select(F.struct(clip, frame).alias("key_"), F.struct(clip).alias("clip_"), F.col(seed).alias("seed_"), F.col(label).alias("label_"))
    other = rows.select("key_", F.col("seed_").alias("other_"), F.col("label_").alias("said_"))
    pairs = rows.join(other, "key_").filter(F.col("seed_") < F.col("other_"))
    each = pairs.groupBy("seed_", "other_", "clip_").agg((F.count_if(~F.col("label_").eqNullSafe(F.col("said_"))) / F.count(F.lit(1))).alias("part_"))
    return each.groupBy(F.col("seed_").alias(seed), F.col("other_").alias("other")).agg(F.count(F.lit(1)).alias("clips"), F.avg("part_").alias("mean"), F.min("part_").alias("least"), F.max("part_").alias("most"))
