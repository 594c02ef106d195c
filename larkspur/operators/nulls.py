"""Null distributions of cuts and events: what is laid out anew keeps the lengths, gaps or numbers.

Draws come from sha256, so that they are the same in any engine. A round's
order is that of the hashes; running sums go by the first digits of the hash
and over their totals, so a long sequence is many tasks. A round of a sequence
is as many rows as the sequence has spans or events: that is the result itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import ranks, timeline
from larkspur.session import staged


def hashed(seed: int, *parts: Column) -> Column:
    """sha256 of "seed:part:..."; a null part is written as null."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)


def number(hash_: Column) -> Column:
    """The first twelve digits of a hash as a number."""
    return F.conv(F.substring(hash_, 1, 12), 16, 10).cast("long")


def _laid(rows: DataFrame, sequence: str, nth: str, length: Column, rounds: int, seed: int, first: Column | None = None) -> DataFrame:
    """Each round's running sums of the lengths in the order of the hashes:
    (key_: sequence and round, sequence, round, offset). Rows where ``first`` holds stand before all others."""
    told = rows.withColumn("length_", length).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    told = told.withColumn("hash_", hashed(seed, F.col("round"), F.col(sequence), F.col(nth)))
    if first is not None:
        told = told.withColumn("hash_", F.when(first, F.lit("")).otherwise(F.col("hash_")))
    placed = told.withColumns({"key_": F.struct(sequence, "round"), "block_": F.conv(F.concat(F.lit("0"), F.substring("hash_", 1, 2)), 16, 10).cast("long")})
    return timeline.running(placed, sequence, F.col("block_"), "hash_", {"offset": ("sum", F.col("length_"))}, keep=True)


def shuffled_spans(spans: DataFrame, sequence: str, start: str, end: str, rounds: int, seed: int = 42) -> DataFrame:
    """(sequence, round, edge): spans of the same lengths in another order, and all
    cuts turned by one draw within what the sequence's spans cover, since equal
    lengths would otherwise stay where they are; the span at the turn is cut in
    two. Both ends are edges. ``spans`` tile each sequence; those that cover nothing give no rows.
    """
    whole = spans.groupBy(F.struct(sequence).alias("of_")).agg(F.min(start).alias("low_"), F.max(end).alias("high_"))
    laid = _laid(spans, sequence, start, (F.col(end) - F.col(start)).cast("long"), rounds, seed)
    both = laid.join(whole, F.struct(sequence) == F.col("of_")).withColumn("span_", F.col("high_") - F.col("low_")).filter("span_ > 0")
    turn = number(hashed(seed, F.lit("turn"), F.col("round"), F.col(sequence))) % F.col("span_")
    # The last one's offset is the whole span, whose cut is none.
    cuts = both.filter("offset < span_").select(sequence, "round", (F.col("low_") + (F.col("offset") + turn) % F.col("span_")).alias("edge"))
    every = whole.filter("high_ > low_").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    ends = every.select(F.col(f"of_.{sequence}").alias(sequence), "round", F.explode(F.array("low_", "high_")).alias("edge"))
    return cuts.union(ends).distinct()


def shuffled_events(events: DataFrame, sequence: str, frame: str, lengths: DataFrame, length: str, rounds: int, seed: int = 42) -> DataFrame:
    """(sequence, round, frame): events with the same gaps in another order, laid
    out from one draw around the sequence's ``length`` frames (one row for each
    sequence in ``lengths``). A sequence of one frame or one event keeps what it
    has. Events of one frame each count; they may fall together.
    """
    numbered = ranks.row_numbers(events.select(sequence, F.col(frame).cast("long").alias("frame__")).withColumn("id_", F.monotonically_increasing_id()), sequence, ["frame__", "id_"], "nth_", timeline.BLOCK)
    gaps = timeline.near(numbered.drop("id_"), sequence, "nth_", 1, lambda w: {"gap_": F.col("frame__") - F.lag("frame__").over(w)})
    # Equal gaps are told apart by their number; its first row is the start.
    laid = _laid(gaps, sequence, "nth_", F.coalesce("gap_", F.lit(0)), rounds, seed, F.col("nth_") == 0)
    sizes = lengths.select(F.struct(sequence).alias("of_"), F.col(length).cast("long").alias("span_")).join(gaps.groupBy(F.struct(sequence).alias("of_")).agg(F.count(F.lit(1)).alias("events_")), "of_")
    both = laid.join(sizes, F.struct(sequence) == F.col("of_"))
    turn = number(hashed(seed, F.lit("turn"), F.col("round"), F.col(sequence))) % F.greatest("span_", F.lit(1))
    fixed = (F.col("span_") <= 1) | (F.col("events_") < 2)
    return both.select(sequence, "round", F.when(fixed, F.col("frame__")).otherwise((F.col("offset") + turn) % F.greatest("span_", F.lit(1))).alias("frame"))


def random_points(lengths: DataFrame, sequence: str, length: str, count: str, draws: int, seed: int = 42) -> DataFrame:
    """(sequence, draw, frame): of each sequence as many different inner frames
    (from 1 to length - 2) as it has ``count``, all if they are fewer: those with
    the least hashes. Counts of 0 and sequences of three frames or fewer give none."""
    fine = lengths.filter((F.col(count) > 0) & (F.col(length) > 3)).select(sequence, F.col(length).alias("n_"), F.col(count).alias("count_"))
    # A long sequence's frames are written out by many tasks.
    parts = fine.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_") / timeline.BLOCK)))).repartition(sequence, "part_")
    low, high = F.greatest(F.col("part_") * timeline.BLOCK, F.lit(1)), F.least((F.col("part_") + 1) * timeline.BLOCK - 1, F.col("n_") - 2)
    frames = parts.filter(low <= high).withColumn("frame", F.explode(F.sequence(low, high)))
    told = frames.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("hash_", hashed(seed, F.col("round"), F.col(sequence), F.col("frame")))
    # Only a long sequence's frames are cut by the first digits of their hashes; another's are one block.
    block = F.when(F.col("n_") > timeline.BLOCK, F.conv(F.substring("hash_", 1, 2), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    placed = told.withColumns({"key_": F.struct(sequence, "round"), "block_": block})
    ranked = timeline.running(placed, sequence, F.col("block_"), "hash_", {"rank_": ("sum", F.lit(1))}, keep=True)
    return ranked.filter("rank_ <= count_").select(sequence, F.col("round").alias("draw"), "frame")


def point_distances(cuts: DataFrame, points: DataFrame, sequence: str, frame: str, by: str) -> DataFrame:
    """(sequence, by, frame, distance): each cut's distance to the nearest point
    of each round ``by`` of its sequence; as-of both ways, no pairs."""
    # Drawn once: the points are asked for three times.
    points = staged(points, "drawn")
    every = points.select(sequence, by).distinct()
    asked = cuts.select(F.struct(sequence).alias("of_"), F.col(frame).cast("long").alias("frame"))
    asked = asked.join(every, F.col("of_") == F.struct(sequence)).select(F.struct(sequence, by).alias("place_"), "frame", F.lit(False).alias("beat_"))
    both = staged(asked.union(points.select(F.struct(sequence, by).alias("place_"), F.col(frame).cast("long").alias("frame"), F.lit(True).alias("beat_"))), "points")
    found = timeline.nearest_events(both.withColumn("key__", F.col("frame")), "place_", F.col("frame"), F.col("beat_"), ~F.col("beat_"), "key__")
    return found.select(F.col(f"place_.{sequence}").alias(sequence), F.col(f"place_.{by}").alias(by), F.col("t").alias("frame"), "distance")


def shift_null(events: DataFrame, mask: DataFrame, lengths: DataFrame, sequence: str, frame: str, length: str, shifts: int, seed: int = 42) -> DataFrame:
    """(sequence, events, observed, null_mean, null_sd, p): the share of a
    sequence's events whose frame is in ``mask`` (sequence, frame), against
    ``shifts`` turns of all its events by draws from 1 to length - 1, one for
    each sequence and round. p has one added to both counts; sequences of one
    frame have no turns (null). Events outside the sequence's length are an error of the caller's."""
    one = events.select(F.struct(sequence).alias("of_"), F.col(frame).cast("long").alias("frame"))
    sized = one.join(lengths.select(F.struct(sequence).alias("of_"), F.col(length).cast("long").alias("n_")), "of_")
    rounds = sized.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(shifts))))
    draw = 1 + number(hashed(seed, F.col("round"), F.col(f"of_.{sequence}"))) % F.greatest(F.col("n_") - 1, F.lit(1))
    turned = rounds.filter((F.col("round") == 0) | (F.col("n_") > 1)).withColumn("frame", F.when(F.col("round") == 0, F.col("frame")).otherwise((F.col("frame") + draw) % F.col("n_")))
    marks = mask.select(F.struct(sequence).alias("of_"), F.col(frame).cast("long").alias("frame"), F.lit(1).alias("hit_")).distinct()
    rates = turned.join(marks, ["of_", "frame"], "left").groupBy("of_", "round").agg(F.count(F.lit(1)).alias("events"), F.round(F.count("hit_") / F.count(F.lit(1)), 9).alias("rate"))
    seen = rates.filter("round = 0").select("of_", "events", F.col("rate").alias("observed"))
    null = rates.filter("round > 0").select("of_", "rate").join(seen.select("of_", "observed"), "of_")
    null = null.groupBy("of_").agg(F.avg("rate").alias("null_mean"), F.stddev_pop("rate").alias("null_sd"), ((F.count_if(F.col("rate") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return seen.join(null, "of_", "left").select(F.col(f"of_.{sequence}").alias(sequence), "events", "observed", "null_mean", "null_sd", "p")
