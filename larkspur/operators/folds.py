"""Left-to-right rules over a sequence, whose state crosses its blocks.

A rule that looks at what it decided before cannot be cut into independent
pieces, but its state is small: one of a fixed number. So each block of a
sequence is run once for every state that may come in, which gives a table of
the states that go out; the tables of a sequence, a few numbers a block, are
followed from the first block to the last; and each block is run again from the
one state that really comes in. Blocks are pieces of fixed size, however long a
sequence is, and the result is the plain rule's. A sequence of one block is run
once, from the state that it begins with.

A task runs many blocks side by side: a step takes the next row of each of them,
so short sequences cost no call of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from larkspur.operators import ranks, timeline
from larkspur.session import staged

#: Rows of a sequence that are one block.
BLOCK = 4_096

#: Rows that a task runs side by side, of as many blocks as they are (one at least).
ROWS = 65_536

#: Rows of some blocks and states by block, shape (states, rows): the states after these rows, and what was decided.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

#: Given the columns of some blocks: the step, and a function from the decisions (a number a row) to the outputs by name.
Rule = Callable[[pa.Table], tuple[Step, Callable[[np.ndarray], dict[str, pa.Array]]]]


def numbers(column: pa.ChunkedArray, none: float = 0) -> np.ndarray:
    """A column as an array, nulls as ``none``."""
    return pc.fill_null(column, none).to_numpy()


def _run(table: pa.Table, rule: Rule, states: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The states that go out of the blocks that begin at rows ``at``, of shape (states,
    blocks) as those that come in; with one state a block the outputs too."""
    step, outputs = rule(table)
    lengths = np.diff(at, append=table.num_rows)
    # The longest blocks first: those that have a next row are always the first ones.
    order = np.argsort(-lengths, kind="stable")
    starts, longest, left = at[order], lengths[order], len(at)
    states, decided = states[:, order].copy(), np.zeros(table.num_rows, dtype=np.int64)
    for t in range(int(longest[0])):
        while longest[left - 1] <= t:
            left -= 1
        rows = starts[:left] + t
        states[:, :left], found = step(rows, states[:, :left])
        if len(states) == 1:
            decided[rows] = found[0]
    out = np.empty_like(states)
    out[:, order] = states
    return out, outputs(decided) if len(states) == 1 else {}


def _blocks(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks of rows that come in order, about ``most`` rows at a time, and where they begin."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        table = pa.Table.from_batches(held)
        at = np.flatnonzero(table.column("nth_").to_numpy() % block == 0)
        # The last block may go on in the next batch.
        ends = [*at[1:].tolist(), *([table.num_rows] if last else [])]
        first = begin = 0
        for i, end in enumerate(ends, 1):
            if end - begin >= most or i == len(ends):
                yield table.slice(begin, end - begin).combine_chunks(), at[first:i] - begin
                first, begin = i, end
        held[:] = table.slice(begin).combine_chunks().to_batches() if begin < table.num_rows else []

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                yield from cut(False)
                rows = sum(x.num_rows for x in held)
    if held:
        yield from cut(True)


def folded(df: DataFrame, sequence: str, nth: str, columns: list[str], rule: Rule, states: int, begin: int, outputs: str, block: int = BLOCK, most: int = ROWS) -> DataFrame:
    """(sequence, nth, outputs): ``rule`` along each sequence in order of ``nth``
    (from 0, without gaps), starting in the state ``begin`` of ``states``."""
    rows = staged(df.select(F.struct(sequence).alias("key_"), F.floor(F.col(nth) / block).alias("block_"), F.col(nth).cast("long").alias("nth_"), *columns), "fold")
    names = [o.strip().split()[0] for o in outputs.split(",")]
    key = rows.schema["key_"].dataType.simpleString()
    kinds = {n: to_arrow_type(t) for n, t in ((f.name, f.dataType) for f in StructType.fromDDL(outputs))}

    def ordered(of: DataFrame) -> DataFrame:
        return of.repartition("key_", "block_").sortWithinPartitions("key_", "block_", "nth_")

    def decided(batches):
        for table, at in _blocks(batches, block, most):
            _, found = _run(table, rule, table.column("begin_").to_numpy()[at][None, :].astype(np.int64), at)
            for b in pa.table({"key_": table.column("key_"), "nth_": table.column("nth_"), **{n: found[n].cast(kinds[n]) for n in names}}).to_batches(10_000):
                yield b

    def run(of: DataFrame) -> DataFrame:
        got = ordered(of).mapInArrow(decided, f"key_ {key}, nth_ long, {outputs}")
        return got.select(F.col(f"key_.{sequence}").alias(sequence), F.col("nth_").alias(nth), *names)

    # Sequences of one block begin in a known state.
    if (rows.agg(F.max("block_")).first()[0] or 0) == 0:
        return run(rows.withColumn("begin_", F.lit(begin)))

    def moves_of(batches):
        for table, at in _blocks(batches, block, max(1, most // states)):
            out, _ = _run(table, rule, np.repeat(np.arange(states)[:, None], len(at), axis=1), at)
            nexts = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * states, pa.int32()), pa.array(out.T.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([table.column(c).take(pa.array(at)).combine_chunks() for c in ("key_", "block_")] + [nexts], names=["key_", "block_", "next_"])

    # Only sequences of several blocks need tables, and of these not the last block.
    ends = rows.groupBy("key_").agg(F.max("block_").alias("last_")).filter("last_ > 0")
    inner = rows.join(ends, "key_").filter("block_ < last_").drop("last_")
    moves = staged(ordered(inner).mapInArrow(moves_of, f"key_ {key}, block_ long, next_ array<int>"), "moves")
    # The state that each block begins with: the tables of the blocks before it, one after another.
    follow = lambda acc, x: F.struct(x["next_"][acc["state"]].alias("state"), F.concat(acc["met"], F.array(x["next_"][acc["state"]])).alias("met"))
    chained = moves.groupBy("key_").agg(F.array_sort(F.collect_list(F.struct("block_", "next_"))).alias("all_"))
    met = F.aggregate("all_", F.struct(F.lit(begin).cast("int").alias("state"), F.expr("cast(array() as array<int>)").alias("met")), follow)["met"]
    entry = chained.select("key_", F.posexplode(met).alias("at_", "begin_")).select("key_", (F.col("at_") + 1).cast("long").alias("block_"), "begin_")
    return run(rows.join(entry, ["key_", "block_"], "left").withColumn("begin_", F.coalesce("begin_", F.lit(begin))))


def snap_cuts(cuts: DataFrame, beats: DataFrame, sequence: str, frame: str, max_snap: int, min_length: int, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """(sequence, nth, cut, snapped, moved, legal): each inner cut of a sequence moves to
    the nearest beat that it may reach, the earlier of two, or with ``weight`` (a
    column of ``beats``) to the nearest of those of most weight.

    ``cuts`` has each sequence's boundaries in one row each, both ends among
    them, which stay. From left to right a cut may move at most ``max_snap``
    frames, to no less than ``min_length`` after where the cut before it went,
    and so that all cuts after it keep that length up to the end. Without a beat
    there it stays as near to its place as the bounds let it, with ``legal``
    false. Boundaries nearer to each other than ``min_length`` are an error.
    """
    numbered = ranks.row_numbers(cuts.select(sequence, F.col(frame).cast("long").alias("cut")), sequence, "cut", "nth", timeline.BLOCK)
    whole = numbered.groupBy(F.struct(sequence).alias("of_")).agg(F.max("cut").alias("last_"), F.max("nth").alias("n_"))
    stepped = timeline.near(numbered, sequence, "nth", 1, lambda w: {"before_": F.lag("cut").over(w)})
    close = F.raise_error(F.concat(F.lit(f"boundaries nearer than {min_length} frames at "), F.col("cut").cast("string")))
    stepped = stepped.withColumn("before_", F.when(F.col("cut") - F.col("before_") < min_length, close.cast("long")).otherwise(F.col("before_")))
    known = stepped.withColumn("of_", F.struct(sequence)).join(whole, "of_").withColumn("room_", F.col("last_") - (F.col("n_") - F.col("nth")) * min_length)
    # The beats within reach of each cut: at most 2 * max_snap + 1 frames.
    heavy = beats.select(F.struct(sequence).alias("of_"), F.col(frame).cast("long").alias("beat_"), (F.col(weight).cast("double") if weight else F.lit(0.0)).alias("weight_"))
    heavy = heavy.groupBy("of_", "beat_").agg(F.max("weight_").alias("weight_"))
    bins = lambda x: F.floor(x / (max_snap + 1))
    told = heavy.withColumn("bin_", F.explode(F.array(bins(F.col("beat_")) - 1, bins(F.col("beat_")), bins(F.col("beat_")) + 1)))
    met = known.select("of_", "nth", "cut", bins(F.col("cut")).alias("bin_")).join(told, ["of_", "bin_"]).filter(F.abs(F.col("beat_") - F.col("cut")) <= max_snap)
    near = met.groupBy("of_", "nth").agg(F.array_sort(F.collect_list(F.struct("beat_", "weight_"))).alias("near_"))
    ready = known.join(near, ["of_", "nth"], "left").select(sequence, "nth", "cut", "before_", "room_", (F.col("nth") == F.col("n_")).alias("end_"), F.col("near_.beat_").alias("beats_"), F.col("near_.weight_").alias("weights_"))

    def rule(table: pa.Table):
        # The state is how far the cut before this one moved, plus max_snap.
        cut, room = (numbers(table.column(c)) for c in ("cut", "room_"))
        before = numbers(table.column("before_"))
        fixed = table.column("before_").is_null().to_numpy() | table.column("end_").to_numpy()
        # Which of the places within reach are beats, and their weights.
        way = np.arange(-max_snap, max_snap + 1)
        beats, weights = (table.column(c).combine_chunks() for c in ("beats_", "weights_"))
        of = pc.list_parent_indices(beats).to_numpy()
        place = beats.flatten().to_numpy() - cut[of] + max_snap
        weight = np.full((len(cut), len(way)), -np.inf)
        has = np.zeros(weight.shape, dtype=bool)
        has[of, place], weight[of, place] = True, numbers(weights.flatten(), -np.inf)

        def step(at: np.ndarray, state: np.ndarray):
            own, stays = cut[at], fixed[at]
            earliest = before[at] + state - max_snap + min_length
            low, high = np.maximum(earliest, own - max_snap), np.minimum(room[at], own + max_snap)
            there = own[:, None] + way
            fine = has[at] & (there >= low[..., None]) & (there <= high[:, None])
            # Most weight first, then the least distance, then the earlier one.
            heaviest = np.where(fine, weight[at], -np.inf).max(axis=-1)
            gap = np.where(fine & (weight[at] >= heaviest[..., None] - 1e-12), np.abs(way), 1 << 60)
            legal = fine.any(axis=-1)
            stay = np.where(high < low, np.maximum(own, earliest), np.clip(own, low, np.maximum(high, low)))
            moved = np.where(stays, 0, np.where(legal, way[gap.argmin(axis=-1)], stay - own))
            return np.clip(moved + max_snap, 0, 2 * max_snap), 2 * moved + (legal | stays)

        def outputs(decided: np.ndarray):
            moved, legal = decided >> 1, decided & 1 == 1
            return {"cut": pa.array(cut), "snapped": pa.array(cut + moved), "moved": pa.array(legal & (moved != 0)), "legal": pa.array(legal)}

        return step, outputs

    return folded(ready, sequence, "nth", ["cut", "before_", "room_", "end_", "beats_", "weights_"], rule, 2 * max_snap + 1, max_snap, "cut long, snapped long, moved boolean, legal boolean", block, min(ROWS, (1 << 21) // (2 * max_snap + 1)))


def apart(places: DataFrame, sequence: str, frame: str, least: int, block: int = BLOCK) -> DataFrame:
    """(sequence, frame) of the places that are taken from left to right, each at
    least ``least`` frames after the one taken before it; the first always is."""
    numbered = ranks.row_numbers(places.select(sequence, F.col(frame).cast("long").alias("at__")), sequence, "at__", "nth", timeline.BLOCK)
    stepped = timeline.near(numbered, sequence, "nth", 1, lambda w: {"gap__": F.coalesce(F.col("at__") - F.lag("at__").over(w), F.lit(least))})

    def rule(table: pa.Table):
        # The state is how far the last taken place is behind the row before this one, at most least.
        gaps = np.minimum(numbers(table.column("gap__")), least)

        def step(at: np.ndarray, state: np.ndarray):
            far = np.minimum(state + gaps[at], least)
            taken = far >= least
            return np.where(taken, 0, far), taken

        return step, lambda decided: {"frame_": table.column("at__").combine_chunks(), "taken_": pa.array(decided == 1)}

    got = folded(stepped, sequence, "nth", ["at__", "gap__"], rule, least + 1, least, "frame_ long, taken_ boolean", block)
    return got.filter("taken_").select(sequence, F.col("frame_").alias(frame))


def _joints(tails: pa.StructArray, left: np.ndarray, heads: pa.StructArray, right: np.ndarray) -> np.ndarray:
    """The cost of each joint, of the candidates ``left`` of one array with those ``right`` of another."""

    def side(of: pa.StructArray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = of.field(name)
        wide = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        return lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(wide) - wide, wide

    sides = [(side(tails, "tail"), left), (side(tails, "tail_velocity"), left), (side(heads, "head"), right), (side(heads, "head_velocity"), right)]
    wide = sides[0][0][2][left]
    if any((own[2][of] != wide).any() for own, of in sides):
        raise ValueError("candidates of a joint have channels of different numbers")
    out = np.empty(len(left))
    for d in np.unique(wide):
        at = np.flatnonzero(wide == d)
        tail, moving, head, going = (own[0][own[1][of[at]][:, None] + np.arange(d)] for own, of in sides)
        out[at] = np.sqrt((tail + moving - head) ** 2 @ np.ones(d)) + np.sqrt((moving - going) ** 2 @ np.ones(d))
    return np.round(out, 9)


def seam_path(slots: DataFrame, sequence: str, nth: str, pool: str, most: int = 64, block: int = BLOCK) -> DataFrame:
    """(sequence, nth, chosen, cost): for each slot of a sequence the candidate that
    joins best to what was chosen for the slot before it.

    ``pool`` is an array of structs (id, head, head_velocity, tail,
    tail_velocity), the last four arrays of numbers of one length, without
    channels that may flip at a joint. The cost of a joint is the distance
    between the tail's pose moved on by its velocity and the head's, plus the
    distance of their velocities, to nine decimals; the lowest wins, ties go to
    the first in the pool, and so does a sequence's first slot, with a null
    cost. A slot without candidates (null or empty) chooses none, and what
    follows it starts anew. A pool of more than ``most`` is an error: the choice
    before it is the state of the rule.
    """
    size = F.coalesce(F.size(pool), F.lit(0))
    large = F.raise_error(F.concat(F.lit(f"a pool of more than {most} candidates: "), size.cast("string")))
    stepped = timeline.near(slots.select(sequence, nth, pool), sequence, nth, 1, lambda w: {"before_": F.lag(pool).over(w)})
    ready = stepped.withColumn("pool_", F.when(size > most, large.cast(slots.schema[pool].dataType)).otherwise(F.col(pool)))

    def rule(table: pa.Table):
        # The state is the number of the candidate chosen before, or most where there is none.
        pools, befores = (table.column(c).combine_chunks() for c in ("pool_", "before_"))
        n, m = (numbers(pc.list_value_length(x)).astype(np.int64) for x in (pools, befores))
        heads, tails = pools.flatten(), befores.flatten()
        # The costs of all joints of a slot stand together: of each candidate before with each candidate.
        begins, heads_at, tails_at = (np.concatenate([[0], np.cumsum(x)]) for x in (n * m, n, m))
        costs = np.empty(begins[-1])
        here = np.flatnonzero(n * m)
        while len(here):
            # About a million joints at a time.
            some = here[: max(1, int(np.searchsorted(begins[here + 1], begins[here[0]] + (1 << 20), side="right")))]
            here = here[len(some) :]
            of = np.repeat(some, (n * m)[some])
            at = np.arange(len(of)) + begins[some[0]]
            i, j = np.divmod(at - begins[of], n[of])
            costs[at] = _joints(tails, tails_at[of] + i, heads, heads_at[of] + j)

        def step(at: np.ndarray, state: np.ndarray):
            fresh, wide = state >= m[at], max(1, int(n[at].max(initial=0)))
            k = np.arange(wide)
            known = (k < n[at][:, None]) & ~fresh[..., None]
            where = np.where(known, (begins[at] + np.where(fresh, 0, state) * n[at])[..., None] + k, 0)
            cost = np.where(known, costs[where] if len(costs) else 0.0, np.inf)
            # A fresh start takes the first.
            pick = np.where(n[at] > 0, cost.argmin(axis=-1), most)
            return pick, np.where(n[at] > 0, np.where(fresh, most, state) * (most + 1) + pick, -1)

        def outputs(decided: np.ndarray):
            before, pick = np.divmod(decided, most + 1)
            none, fresh = decided < 0, before >= most
            chosen = pa.array(np.where(none, 0, heads_at[:-1] + pick), mask=none)
            where = np.where(none | fresh, 0, begins[:-1] + before * n + pick)
            cost = costs[where] if len(costs) else np.zeros(len(where))
            return {"chosen": heads.field("id").take(chosen), "cost": pa.array(cost, mask=none | fresh)}

        return step, outputs

    kind = slots.schema[pool].dataType.elementType["id"].dataType.simpleString()
    return folded(ready, sequence, nth, ["pool_", "before_"], rule, most + 1, most, f"chosen {kind}, cost double", block, max(1, min(ROWS, (1 << 22) // most**2)))
