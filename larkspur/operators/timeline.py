"""Frame and event timelines: runs, windows, votes, nearest events, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larkspur.operators import ranks

#: So many frames of a sequence are one task's at a time.
BLOCK = 65_536

#: A row's sequence, as a struct so that null sequences are equal in joins too, and its block.
PLACE = ["key_", "block_"]

def frames(df: DataFrame, sequence: str, order: list[str], frame: str = "frame", rows: int = BLOCK) -> DataFrame:
    """Number the rows of each sequence from 0. The first column of ``order`` is a number or a time."""
    return ranks.row_numbers(df, sequence, order, frame, rows)


def near(df: DataFrame, sequence: str, frame: str, reach: int, columns: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK, keep: bool = False) -> DataFrame:
    """Add columns over windows of each sequence that reach at most ``reach`` frames either way.

    ``columns`` gets a window ordered by frame. A sequence is cut into blocks of
    frames, and rows near a block's edge are shown to its neighbour too, so a
    long sequence is many tasks. Frames have no repeats. ``keep`` leaves the
    blocks' columns, by which ``running`` then finds the rows in place.
    """
    at = lambda f: F.floor(f / F.lit(block))
    seen = F.array_distinct(F.array(at(F.col(frame)), at(F.col(frame) - reach), at(F.col(frame) + reach)))
    shown = df.drop(*PLACE).withColumn("key_", F.struct(sequence)).withColumn("block_", F.explode(seen)).withColumn("own_", F.col("block_") == at(F.col(frame)))
    window = Window.partitionBy(*PLACE).orderBy(frame)
    return shown.withColumns(columns(window)).filter("own_").drop("own_", *([] if keep else PLACE))


def running(df: DataFrame, sequence: str, block: Column, order: str, columns: dict[str, tuple[str, Column]], downward: bool = False, keep: bool = False) -> DataFrame:
    """Add running "max", "min" or "sum" columns over each sequence's rows up to
    and with each one and its ties in ``order`` (from the last row on where ``downward``).

    ``block`` rises with ``order``: running values within blocks, and over the
    blocks' totals for what stands before each. Nulls are skipped. Rows whose
    blocks were kept stay there.
    """
    of = {"max": F.max, "min": F.min, "sum": F.sum}
    both = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a + b, a, b)}
    way = F.desc if downward else F.asc
    placed = df if set(PLACE) <= set(df.columns) else df.withColumns({"key_": F.struct(sequence), "block_": block})
    wide = placed.withColumns({f"{name}__": c for name, (_, c) in columns.items()})
    totals = wide.groupBy(*PLACE).agg(*[of[how](f"{name}__").alias(f"{name}__t") for name, (how, _) in columns.items()])
    earlier = Window.partitionBy("key_").orderBy(way("block_")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*PLACE, *[of[how](f"{name}__t").over(earlier).alias(f"{name}__b") for name, (how, _) in columns.items()])
    within = Window.partitionBy(*PLACE).orderBy(way(order)).rangeBetween(Window.unboundedPreceding, 0)
    inside = wide.withColumns({f"{name}__": of[how](f"{name}__").over(within) for name, (how, _) in columns.items()})
    found = [both[how](F.col(f"{name}__"), F.col(f"{name}__b")).alias(name) for name, (how, _) in columns.items()]
    # The rows are in place for a merge; totals grow with the sequences, so no broadcast takes them to the driver.
    return inside.join(starts.hint("merge"), PLACE).select(*[c for c in placed.columns if c not in columns and (keep or c not in PLACE)], *found)


def block_of(frame: str, block: int = BLOCK) -> Column:
    """The number of a frame's block."""
    return F.floor(F.col(frame) / F.lit(block))


def runs(df: DataFrame, sequence: str, frame: str, label: str, block: int = BLOCK) -> DataFrame:
    """Maximal runs of equal labels (nulls being equal), half open: start, end, length."""
    fresh = lambda w: F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.lag(frame).over(w) == F.col(frame) - 1), 0).otherwise(1)
    starts = near(df.select(sequence, frame, label), sequence, frame, 1, lambda w: {"new_": fresh(w)}, block, keep=True)
    numbered = running(starts, sequence, block_of(frame, block), frame, {"run": ("sum", F.col("new_"))})
    return numbered.groupBy(sequence, "run").agg(F.first(label).alias(label), F.min(frame).alias("start"), (F.max(frame) + 1).alias("end"), F.count(F.lit(1)).alias("length"))


def windows(lengths: DataFrame, sequence: str, length: str, size: int, stride: int) -> DataFrame:
    """Half-open windows of ``size`` every ``stride`` frames; a sequence shorter than one has none."""
    last = F.col(length) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")))
    return lengths.select(sequence, F.posexplode(starts).alias("window", "start")).withColumn("end", F.col("start") + size)


def in_windows(df: DataFrame, frame: str, size: int, stride: int) -> DataFrame:
    """Every row once per window that covers its frame; no join is needed.
    Adds ``start``; windows may reach beyond the sequence's end."""
    first = F.greatest(F.ceil((F.col(frame) - size + 1) / stride), F.lit(0))
    slots = F.sequence(first.cast("long"), F.floor(F.col(frame) / stride).cast("long"))
    return df.withColumn("start", F.explode(F.transform(slots, lambda i: i * stride)))


def centered_vote(df: DataFrame, sequence: str, frame: str, label: str, half: int, block: int = BLOCK) -> DataFrame:
    """Replace each label by the most frequent one within ``half`` frames; the
    frame's own label wins ties, else the least label."""
    votes, own = F.col("votes_"), F.col(label)
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda x: x["l"].eqNullSafe(v["l"])))).alias("n"), (~v["l"].eqNullSafe(own)).alias("other"), v["l"].alias("l")))
    cast = df.select(sequence, F.col(frame).cast("long").alias(frame), label)
    found = near(cast, sequence, frame, half, lambda w: {"votes_": F.collect_list(F.struct(own.alias("l"))).over(w.rangeBetween(-half, half))}, block)
    return found.select(sequence, frame, label, F.array_min(counted)["l"].alias("voted"))


def nearest_events(df: DataFrame, sequence: str, time: Column, is_beat: Column, is_query: Column, key: str, rows: int = BLOCK) -> DataFrame:
    """As-of in both directions: each query event's nearest beat of its sequence.

    One running maximum forward and one running minimum back over the union, no
    pair join, within ranges of time and over their totals. Beats at the query's own time count. Adds before, after and distance in the unit of
    ``time`` (null without a beat).
    """
    timed = df.select(sequence, key, time.alias("t_"), F.when(is_beat, time).alias("beat_"), is_query.alias("query_"))
    # Sequences that are no longer than a range are not cut: a range a row would be as many totals as rows.
    largest = timed.groupBy(sequence).agg(F.count(F.lit(1)).alias("n_")).agg(F.max("n_")).first()[0] or 0
    ranged = timed.withColumn("range_", F.lit(0) if largest <= rows else ranks.quantile_range(timed, "t_", rows=rows))
    ranged = running(ranged, sequence, F.col("range_"), "t_", {"before": ("max", F.col("beat_"))}, keep=True)
    ranged = running(ranged, sequence, F.col("range_"), "t_", {"after": ("min", F.col("beat_"))}, downward=True)
    gap = F.least(F.col("t_") - F.col("before"), F.col("after") - F.col("t_"))
    return ranged.filter("query_").select(sequence, key, F.col("t_").alias("t"), "before", "after", gap.alias("distance"))


def sessions(df: DataFrame, sequence: str, seconds: Column, gap: float, rows: int = BLOCK) -> DataFrame:
    """Runs of events that are at most ``gap`` apart."""
    timed = df.select(sequence, seconds.alias("s_"))
    ranged = timed.withColumns({"key_": F.struct(sequence), "block_": ranks.quantile_range(timed, "s_", rows=rows)})
    last = ranged.groupBy(*PLACE).agg(F.max("s_").alias("last_"))
    earlier = Window.partitionBy("key_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*PLACE, F.max("last_").over(earlier).alias("last_"))
    stepped = ranged.withColumn("previous_", F.lag("s_").over(Window.partitionBy(*PLACE).orderBy("s_"))).join(last, PLACE)
    fresh = F.when(F.col("s_") - F.coalesce("previous_", "last_") <= gap, 0).otherwise(1)
    numbered = running(stepped.select(*PLACE, sequence, "s_", fresh.alias("new_")), sequence, F.col("block_"), "s_", {"session": ("sum", F.col("new_"))})
    return numbered.groupBy(sequence, "session").agg(F.count(F.lit(1)).alias("events"), F.min("s_").alias("begin_s"), F.max("s_").alias("end_s"))
