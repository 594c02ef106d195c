"""Bars: frames pooled into tokens with the evidence that they round-trip, their labels by span, their grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import segments, timeline


def tokens(frames: DataFrame, bars: DataFrame, sequence: str, frame: str, label: str, beat: Column, means: list[str], sums: list[str], block: int = timeline.BLOCK) -> DataFrame:
    """One row per bar (``sequence``, start, end; they don't overlap): its frames' majority label (the least
    of equally frequent ones), the mean and sum of columns, how many frames the label gets
    wrong, whether it is mixed, how many beats it holds and whether one is on its first frame.

    A bar that is empty or has a frame without a row or label is an error: a part of a bar is no
    bar. Nulls in pooled columns are left out of them. Frames outside all bars are.
    """
    rows = frames.select(sequence, F.col(frame).cast("long").alias("at_"), F.col(label).alias("label_"), F.coalesce(beat, F.lit(False)).alias("beat_"), *[F.col(c).cast("double").alias(f"{c}__") for c in [*means, *sums]])
    spans = bars.select(sequence, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    placed = segments.located(rows, spans, sequence, "at_", ["label_", "beat_", *[f"{c}__" for c in [*means, *sums]]], block).filter(F.col("at_") < F.col("span_end"))
    first = F.min(F.when(F.col("beat_"), F.col("at_")))
    votes = placed.groupBy(F.struct(sequence).alias("key_"), F.col("span_start").alias("start"), "label_").agg(F.count(F.lit(1)).alias("n_"), F.count("label_").alias("known_"), F.count_if("beat_").alias("beats_"), first.alias("first_"), *[f(f"{c}__").alias(f"{c}_{n}_") for c in [*means, *sums] for n, f in (("s", F.sum), ("n", F.count))])
    # The rows of a bar's labels, most frequent first.
    whole = votes.groupBy("key_", "start").agg(
        F.min(F.struct((-F.col("n_")).alias("n"), F.col("label_").alias("label"))).alias("top_"),
        F.sum("known_").alias("known_"),
        F.sum("beats_").alias("beats"),
        F.min("first_").alias("first_"),
        *[(F.try_divide(F.sum(f"{c}_s_"), F.sum(f"{c}_n_"))).alias(f"{c}_mean") for c in means],
        *[F.coalesce(F.sum(f"{c}_s_"), F.lit(0.0)).alias(f"{c}_sum") for c in sums],
    )
    all_bars = spans.select(sequence, F.struct(sequence).alias("key_"), "start", "end").join(whole, ["key_", "start"], "left")
    length = F.col("end") - F.col("start")
    partial = F.raise_error(F.concat(F.lit("a bar without all of its frames at "), F.col("start").cast("string"))).cast("long")
    right = F.when((length > 0) & (F.coalesce("known_", F.lit(0)) == length), -F.col("top_.n")).otherwise(partial)
    told = all_bars.withColumn("right_", right)
    return told.select(sequence, "start", "end", F.col("top_.label").alias(label), (length - F.col("right_")).alias("wrong"), (F.col("right_") < length).alias("mixed"), "beats", F.coalesce(F.col("first_") == F.col("start"), F.lit(False)).alias("on_beat"), *[f"{c}_mean" for c in means], *[f"{c}_sum" for c in sums])


def checks(bars: DataFrame, expected: int) -> DataFrame:
    """One row over tokens: frames and those that the bars' labels get wrong, mixed bars, bars that begin
    off the beat, and bars with another number of beats than ``expected``."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return bars.agg(F.count(F.lit(1)).alias("bars"), total(F.col("end") - F.col("start")).alias("frames"), total("wrong").alias("wrong"), F.count_if("mixed").alias("mixed"), F.count_if(~F.col("on_beat")).alias("off_beat"), F.count_if(F.col("beats") != expected).alias("other_beats"))


def span_labels(windows: DataFrame, sequence: str, label: str, order: str, refuse: bool = False) -> DataFrame:
    """(sequence, start, end, label, writers, conflict): the label of each span that several windows name; the last in
    ``order`` (the least label of those) stays. A span with differing labels (null is one of its own) is a conflict, an error with ``refuse``."""
    told = windows.select(F.struct(sequence).alias("key_"), "start", "end", F.col(order).alias("order_"), F.struct(F.col(label).alias("l")).alias("label_"))
    # Of labels in the same place: counted first, so that a span's repeats are one row each.
    each = told.groupBy("key_", "start", "end", "label_").agg(F.max("order_").alias("order_"), F.count(F.lit(1)).alias("n_"))
    last = each.groupBy("key_", "start", "end").agg(F.max("order_").alias("last_"))
    kept = each.join(last, ["key_", "start", "end"]).groupBy("key_", "start", "end").agg(F.min(F.when(F.col("order_").eqNullSafe(F.col("last_")), F.col("label_"))).alias("kept_"), F.sum("n_").alias("writers"), (F.count(F.lit(1)) > 1).alias("conflict"))
    if refuse:
        kept = kept.withColumn("conflict", F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("windows disagree on the span at "), F.col("start").cast("string"))).cast("boolean")).otherwise(F.lit(False)))
    return kept.select(F.col(f"key_.{sequence}").alias(sequence), "start", "end", F.col("kept_.l").alias(label), "writers", "conflict")


def same_grid(released: DataFrame, grid: DataFrame, sequence: str, number: Column) -> DataFrame:
    """(sequence, released, equal, prefix): whether each sequence's released spans (start, end) are the first ones of its grid, bar by bar.
    ``number`` is a span's place in its sequence, on either side; spans beyond the released ones don't matter."""
    side = lambda df, n: df.select(F.struct(sequence).alias("key_"), number.alias("nth_"), F.struct("start", "end").alias(n))
    met = side(released, "mine_").join(side(grid, "theirs_"), ["key_", "nth_"], "left")
    told = met.groupBy("key_").agg(F.count(F.lit(1)).alias("released"), F.count_if(F.col("mine_").eqNullSafe(F.col("theirs_"))).alias("equal"))
    return told.select(F.col(f"key_.{sequence}").alias(sequence), "released", "equal", (F.col("released") == F.col("equal")).alias("prefix"))


def cosines(frames: DataFrame, spans: DataFrame, sequence: str, frame: str, values: list[str], points: int, terms: int) -> DataFrame:
    """(sequence, start, end, shape): each span as a vector: its values resampled to ``points`` places between its
    first and last frame, the first ``terms`` of their orthonormal cosine transform (all columns of a
    term together), and the logarithm of its length.

    Two frames a place are looked up, whatever a span's length, and a term is a weighted sum of them. A span with a null
    or no frame at one of them has a null shape; an empty span as well.
    """
    if not 1 <= terms <= points or points < 2:
        raise ValueError(f"{terms} terms of {points} points")
    scale = lambda k: math.sqrt((2.0 if k else 1.0) / points)
    basis = [[scale(k) * math.cos(math.pi * k * (r + 0.5) / points) for k in range(terms)] for r in range(points)]
    own = spans.select(sequence, F.struct(sequence).alias("key_"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    each = own.filter("start < end").withColumn("r_", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("r_") * (F.col("end") - F.col("start") - 1) / F.lit(points - 1)
    low = F.floor("at_")
    parts = F.array(F.struct(low.alias("k"), (1 - (F.col("at_") - low)).alias("w")), F.struct((low + 1).alias("k"), (F.col("at_") - low).alias("w")))
    wanted = each.withColumn("at_", at).withColumn("part_", F.explode(F.filter(parts, lambda p: p["w"] > 0)))
    wanted = wanted.select("key_", "start", "end", "r_", F.col("part_.w").alias("w_"), (F.col("start") + F.col("part_.k")).alias("frame_"))
    source = frames.select(F.struct(sequence).alias("key_"), F.col(frame).cast("long").alias("frame_"), *[F.col(v).cast("double").alias(f"{v}__") for v in values])
    met = wanted.join(source, ["key_", "frame_"], "left").withColumn("terms_", F.element_at(F.lit(basis), F.col("r_") + 1))
    sums = [F.sum(F.col("w_") * F.col("terms_")[k] * F.col(f"{v}__")) for k in range(terms) for v in values]
    lacking = F.count_if(F.greatest(*[F.col(f"{v}__").isNull() for v in values], F.lit(False)))
    shaped = met.groupBy("key_", "start", "end").agg(F.when(lacking == 0, F.array(*sums, F.log(F.first(F.col("end") - F.col("start")).cast("double")))).alias("shape"))
    return own.join(shaped, ["key_", "start", "end"], "left").select(sequence, "start", "end", "shape")
