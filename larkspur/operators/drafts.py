"""Drafts of a plan from a library of snippets: the nearest in length of another group, resampled; how
much of a plan the library covers; bars that return."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import folds, ranks, timeline
from larkspur.session import staged


def library(runs: DataFrame, label: str, length: str, group: str, filler: Column, least: int = 1) -> DataFrame:
    """The runs that may be taken as snippets: no filler, at least ``least`` long, of a known label and
    group (a null group can't be told to be another's)."""
    return runs.filter(~F.coalesce(filler, F.lit(True)) & (F.col(length) >= least) & F.col(label).isNotNull() & F.col(group).isNotNull())


def _shelf(snippets: DataFrame, label: str, length: str, group: str, order: list[str]) -> DataFrame:
    """One row per label and length: its first snippet, the first of any other group than that one's, and
    the same of the nearest shorter and longer row that is not of one and the same group alone."""
    pick = F.struct(F.struct(*order).alias("p"), F.col("g_").alias("g"))
    known = snippets.select(F.col(label).alias("of_"), F.col(length).cast("long").alias("t_"), F.col(group).alias("g_"), *order)
    firsts = staged(known.groupBy("of_", "t_", "g_").agg(F.min(pick).alias("pick_")), "firsts")
    best = firsts.groupBy("of_", "t_").agg(F.min("pick_").alias("first_"))
    others = firsts.join(best, ["of_", "t_"]).filter(F.col("g_") != F.col("first_.g")).groupBy("of_", "t_").agg(F.min("pick_").alias("second_"))
    rows = staged(best.join(others, ["of_", "t_"], "left"), "shelf")
    numbered = ranks.row_numbers(rows, "of_", "t_", "nth_", timeline.BLOCK).withColumn("sole_", F.when(F.col("second_").isNull(), F.col("first_.g")))
    # Neighbouring lengths that one group alone has form a stretch; beyond it every group finds one.
    same = lambda c: F.coalesce(F.col("sole_") == c, F.lit(False))
    ends = timeline.near(numbered, "of_", "nth_", 1, lambda w: {"from_": F.when(~same(F.lag("sole_").over(w)), F.col("nth_")), "to_": F.when(~same(F.lead("sole_").over(w)), F.col("nth_"))})
    ends = timeline.running(ends, "of_", timeline.block_of("nth_"), "nth_", {"from_": ("max", F.col("from_"))})
    ends = staged(timeline.running(ends, "of_", timeline.block_of("nth_"), "nth_", {"to_": ("min", F.col("to_"))}, downward=True), "stretches")
    row = F.struct("t_", "first_", "second_")
    shorter = ends.select("of_", (F.col("nth_") + 1).alias("from_"), row.alias("shorter_"))
    longer = ends.select("of_", (F.col("nth_") - 1).alias("to_"), row.alias("longer_"))
    return ends.withColumn("here_", row).join(shorter, ["of_", "from_"], "left").join(longer, ["of_", "to_"], "left").select("of_", "t_", "here_", "shorter_", "longer_")


def nearest_outside(slots: DataFrame, snippets: DataFrame, label: str, length: str, group: str, order: list[str]) -> DataFrame:
    """Add ``chosen``, a struct of ``order`` and ``length``: for each slot the snippet of its label that is
    nearest in length and of another group than the slot's; the first in ``order`` of equally near ones.

    Null where there is none, and where the slot's label or group is null. No slot meets
    a label's snippets: of each label and length two of different groups are enough, and as-of
    joins over lengths find the nearest such row either way.
    """
    slots = staged(slots, "slots")
    shelf = staged(_shelf(snippets, label, length, group, order), "shelf")
    asked = slots.filter(F.col(label).isNotNull()).select(F.col(label).alias("of_"), F.col(length).cast("long").alias("t_")).distinct()
    both = asked.withColumn("has_", F.lit(None).cast("long")).unionByName(shelf.select("of_", "t_", F.col("t_").alias("has_")))
    both = timeline.running(both, "of_", timeline.block_of("t_"), "t_", {"low_": ("max", F.col("has_"))})
    both = timeline.running(both, "of_", timeline.block_of("t_"), "t_", {"high_": ("min", F.col("has_"))}, downward=True)
    ends = both.filter("has_ is null").drop("has_")
    low = shelf.select("of_", F.col("t_").alias("low_"), F.array("here_", "shorter_").alias("down_"))
    high = shelf.select("of_", F.col("t_").alias("high_"), F.array("here_", "longer_").alias("up_"))
    found = ends.join(low, ["of_", "low_"], "left").join(high, ["of_", "high_"], "left").select("of_", F.col("t_").alias("asked_"), "down_", "up_")

    def outside(row: Column) -> Column:
        pick = F.when(row["first_"]["g"] != F.col(group), row["first_"]["p"]).when(row["second_"].isNotNull(), row["second_"]["p"])
        gap = F.abs(row["t_"] - F.col(length))
        return F.when(F.col(group).isNotNull() & pick.isNotNull(), F.struct(gap.alias("gap"), pick.alias("p"), row["t_"].alias("t")))

    best = F.least(*[F.coalesce(outside(F.col(side)[0]), outside(F.col(side)[1])) for side in ("down_", "up_")])
    met = slots.join(found, (F.col(label) == F.col("of_")) & (F.col(length) == F.col("asked_")), "left").withColumn("best_", best)
    chosen = F.when(F.col("best_").isNotNull(), F.struct(*[F.col("best_.p")[o].alias(o) for o in order], F.col("best_.t").alias(length)))
    return met.select(*slots.columns, chosen.alias("chosen"))


def _places(length: str) -> list[Column]:
    """The numbers from 0 to a length, exploded in two steps so that no array is long."""
    block = F.lit(timeline.BLOCK).cast("long")
    return [F.explode(F.sequence(F.lit(0).cast("long"), F.col(length) - 1, block)), F.explode(F.sequence(F.col("from_"), F.least(F.col("from_") + block, F.col(length)) - 1))]


def drafted(frames: DataFrame, slots: DataFrame, sequence: str, frame: str, values: list[str]) -> DataFrame:
    """(sequence, frame, mask, values): each slot's frames from its chosen snippet, resampled between its
    first and last frame to the slot's length; zeros with mask 0 where nothing was chosen.

    ``slots`` has sequence, start, length and ``chosen`` (sequence, start, length; null for none). Each
    snippet is resampled once for each length, however many slots take it. A snippet's null value
    leaves the frames between its neighbours null, with mask 1.
    """
    taken = slots.filter("chosen is not null").select(sequence, F.col("start").cast("long").alias("start"), "chosen", F.col("length").cast("long").alias("n_"))
    outer, inner = _places("n_")
    each = taken.select("chosen", "n_").distinct().withColumn("from_", outer).withColumn("j_", inner).drop("from_")
    at = F.when(F.col("n_") > 1, F.col("j_") * (F.col("chosen.length") - 1) / (F.col("n_") - 1)).otherwise(F.lit(0.0))
    low = F.floor("at_")
    parts = F.array(F.struct(low.alias("k"), (1 - (F.col("at_") - low)).alias("w")), F.struct((low + 1).alias("k"), (F.col("at_") - low).alias("w")))
    parts = each.withColumn("at_", at).withColumn("part_", F.explode(F.filter(parts, lambda p: p["w"] > 0)))
    wanted = parts.select("chosen", "n_", "j_", F.col("part_.w").alias("w_"), F.struct(F.col(f"chosen.{sequence}").alias(sequence)).alias("key_"), (F.col("chosen.start") + F.col("part_.k")).alias("frame_"))
    source = frames.select(F.struct(sequence).alias("key_"), F.col(frame).cast("long").alias("frame_"), *[F.col(v).cast("double").alias(f"{v}__") for v in values])
    whole = lambda v: F.when(F.count(f"{v}__") == F.count(F.lit(1)), F.sum(F.col(f"{v}__") * F.col("w_")))
    snippets = wanted.join(source, ["key_", "frame_"]).groupBy("chosen", "n_", "j_").agg(*[whole(v).alias(v) for v in values])
    written = taken.join(snippets, ["chosen", "n_"]).select(F.struct(sequence).alias("key_"), (F.col("start") + F.col("j_")).alias("frame_"), F.lit(1).alias("mask"), *values)
    plan = frames.select(F.struct(sequence).alias("key_"), sequence, F.col(frame).cast("long").alias("frame_"))
    zero = lambda v: F.when(F.col("mask").isNull(), F.lit(0.0)).otherwise(F.col(v)).alias(v)
    return plan.join(written, ["key_", "frame_"], "left").select(sequence, F.col("frame_").alias(frame), F.coalesce("mask", F.lit(0)).alias("mask"), *[zero(v) for v in values])


def coverage(slots: DataFrame, snippets: DataFrame, label: str, length: str, group: str) -> DataFrame:
    """One row: the share of the slots' frames whose label has a snippet of another group, the frames, and
    the labels that lack one for some slot. A slot of a null group is not covered; no frames are a share of 1."""
    groups = snippets.filter(F.col(group).isNotNull()).groupBy(F.col(label).alias("of_")).agg(F.min(group).alias("least_"), F.max(group).alias("most_"))
    own = slots.groupBy(label, group).agg(F.sum(length).alias("n_"))
    told = own.join(groups, F.col(label) == F.col("of_"), "left").withColumn("safe_", F.coalesce((F.col("least_") != F.col(group)) | (F.col("most_") != F.col(group)), F.lit(False)))
    kinds = told.groupBy(label).agg(F.sum("n_").alias("n_"), F.sum(F.when(F.col("safe_"), F.col("n_")).otherwise(0)).alias("safe_"), F.max((~F.col("safe_")).cast("long")).alias("bare_"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = kinds.agg(total("n_").alias("frames"), total("safe_").alias("safe_frames"), total("bare_").alias("bare_labels"))
    return sums.select(F.coalesce(F.try_divide("safe_frames", "frames"), F.lit(1.0)).alias("safe_share"), "frames", "safe_frames", "bare_labels")


def returns(slots: DataFrame, sequence: str, nth: str, length: str, filler: Column, wanted: Column, lags: tuple[int, ...] = (4, 2), band: float = 0.15, slack: float = 2.0, block: int = folds.BLOCK) -> DataFrame:
    """(sequence, nth, lag, source): which slot of its sequence comes back in which.

    Where ``wanted`` holds, the first of ``lags`` whose slot so far back may
    return is taken: it is no filler (and neither is the slot), its length is within
    the larger of ``band`` times the slot's and ``slack`` of it, it is no return itself, and it has not
    returned yet. Null lag and source where none does; null ``wanted`` is false,
    null ``filler`` true. Lags are 2 to 8: which of so many slots before are spent is
    the state of the rule.
    """
    reach = max(lags)
    if not lags or min(lags) < 2 or reach > 8:
        raise ValueError(f"lags must be 2 to 8: {lags}")
    full = slots.select(sequence, F.col(nth).cast("long").alias(nth), F.col(length).alias("length_"), F.coalesce(filler, F.lit(True)).alias("filler_"), F.coalesce(wanted, F.lit(False)).alias("wanted_"))
    close = lambda c: F.abs(c - F.col("length_")) <= F.greatest(F.lit(slack), F.col("length_") * band)
    back = lambda w, k: F.coalesce(~F.lag("filler_", k).over(w) & close(F.lag("length_", k).over(w)), F.lit(False))
    ready = timeline.near(full, sequence, nth, reach, lambda w: {"able_": F.array(*[back(w, k) for k in lags])})

    def rule(table: pa.Table):
        # Bit k - 1 of the state: the slot k before this one can't return any more.
        at_, filler = folds.numbers(table.column("at_")), table.column("filler_").to_numpy()
        able = table.column("able_").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(lags))
        able = able & (table.column("wanted_").to_numpy() & ~filler)[:, None]

        def step(at: np.ndarray, state: np.ndarray):
            taken = np.zeros(state.shape, dtype=np.int64)
            for i, k in enumerate(lags):
                taken = np.where((taken == 0) & able[at, i] & (state >> (k - 1) & 1 == 0), k, taken)
            spent = np.where(taken > 0, state | (1 << np.maximum(taken - 1, 0)), state)
            return (spent << 1 | (filler[at] | (taken > 0))) & ((1 << reach) - 1), taken

        return step, lambda decided: {"lag": pa.array(decided, mask=decided == 0), "source": pa.array(at_ - decided, mask=decided == 0)}

    return folds.folded(ready.withColumn("at_", F.col(nth)), sequence, nth, ["at_", "able_", "filler_", "wanted_"], rule, 1 << reach, (1 << reach) - 1, "lag int, source long", block)
