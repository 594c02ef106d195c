"""Segments of a sequence by the self-similarity of its frames.

A frame is described by its cosine similarities with the frames around it and
by its place; frames are clustered, a change of cluster is a cut, and segments
that are too short are merged. A sequence is cut into blocks; a block sees
``band`` frames on either side of its own, so a long sequence is many tasks and
none holds more than a block with its bands. Of a sequence that is no longer
than the band all frames are compared with each other.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import ranks, timeline
from larkspur.session import staged


@dataclass(frozen=True)
class Rules:
    min_length: int = 8  # frames of a segment
    frames_per_cluster: float = 40.0  # a block has frames / this many clusters, within the next two
    fewest: int = 2
    most: int = 32
    index_weight: float = 1.0  # of the place, against the median step between neighbours' descriptions
    starts: int = 4  # runs of k-means, of which the tightest counts
    seed: int = 42
    block: int = 2_048
    band: int = 1_024


def descriptions(x: np.ndarray, band: int, weight: float) -> np.ndarray:
    """Rows of cosine similarities, 0 beyond the band, and the weighted place."""
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    rows = unit @ unit.T
    n = len(x)
    if n > band + 1:
        rows[np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]) > band] = 0.0
    step = float(np.median(np.linalg.norm(np.diff(rows, axis=0), axis=1))) if n > 1 else 0.0
    place = np.arange(n) / n * (weight * step * n / max(n - 1, 1))
    return np.concatenate([rows, place[:, None]], axis=1)


def _gaps(rows: np.ndarray, squares: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(squares[:, None] - 2 * (rows @ centers.T) + (centers**2).sum(axis=1)[None, :], 0.0)


def clustered(rows: np.ndarray, k: int, starts: int, seed: list[int]) -> np.ndarray:
    """k-means labels: from ``starts`` draws by squared distance, each run until nothing moves; the tightest counts."""
    best = (np.inf, np.zeros(len(rows), dtype=np.int64))
    squares = (rows**2).sum(axis=1)
    for start in range(starts):
        draw = np.random.Generator(np.random.PCG64([*seed, start]))
        centers, near = rows[[draw.integers(len(rows))]], np.full(len(rows), np.inf)
        for _ in range(k - 1):
            near = np.minimum(near, _gaps(rows, squares, centers[-1:])[:, 0])
            total = near.sum()
            pick = np.searchsorted(np.cumsum(near), draw.random() * total, side="right") if total > 0 else draw.integers(len(rows))
            centers = np.concatenate([centers, rows[[min(int(pick), len(rows) - 1)]]])
        labels = None
        for _ in range(100):
            gaps = _gaps(rows, squares, centers)
            now = gaps.argmin(axis=1)
            if labels is not None and (now == labels).all():
                break
            labels = now
            sizes = np.bincount(labels, minlength=k)
            sums = (labels[None, :] == np.arange(k)[:, None]).astype(float) @ rows
            centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
        spread = float(gaps.min(axis=1).sum())
        if spread < best[0] - 1e-9:
            best = (spread, labels)
    return best[1]


def cuts_of(x: np.ndarray, rules: Rules, seed: list[int]) -> np.ndarray:
    """Where the cluster of a frame differs from that of the frame before it."""
    n = len(x)
    if n < 2 * rules.min_length:
        return np.zeros(0, dtype=np.int64)
    k = int(np.clip(round(n / rules.frames_per_cluster), rules.fewest, rules.most))
    labels = clustered(descriptions(x, rules.band, rules.index_weight), min(k, max(2, n // rules.min_length)), rules.starts, seed)
    return np.flatnonzero(labels[1:] != labels[:-1]) + 1


def merge_short(starts: DataFrame, sequence: str, start: str, lengths: DataFrame, length: str, least: int) -> DataFrame:
    """(sequence, start, end): segments of at least ``least`` frames. The shortest
    segment that is too short, the first of equals, goes to its shorter
    neighbour (the one before, if they are equal), again and again; the last one left stays.

    A segment that is shorter than all within two places of it is settled as it
    would be in that order, whatever happens elsewhere. So a block of a sequence's
    segments is merged in that order as far as no segment beyond its ends is asked
    for; the rest is settled in rounds whose blocks begin elsewhere.
    """
    whole = lengths.select(F.struct(sequence).alias("of_"), F.col(length).cast("long").alias("whole_"))
    now = staged(starts.select(sequence, F.col(start).cast("long").alias("start__")).distinct(), "starts")
    before, idle, shift = now.count(), 0, 0
    while True:
        numbered = ranks.row_numbers(now, sequence, "start__", "nth", timeline.BLOCK).withColumn("of_", F.struct(sequence)).join(whole, "of_").drop("of_")
        spans = timeline.near(numbered, sequence, "nth", 1, lambda w: {"first_": F.lag("start__").over(w).isNull(), "last_": F.lead("start__").over(w).isNull(), "end__": F.coalesce(F.lead("start__").over(w), F.col("whole_"))})
        placed = spans.select(F.struct(sequence).alias("key_"), F.floor((F.col("nth") + shift) / MERGED).alias("block_"), "start__", "end__", "first_", "last_")
        key = placed.schema["key_"].dataType.simpleString()

        def settled(table):
            table = table.sort_by("start__")
            column = lambda c: table.column(c).to_pylist()
            at, to = _merged(column("start__"), column("end__"), least, column("first_")[0], column("last_")[-1])
            return pa.table({"key_": pa.array([table.column("key_")[0].as_py()] * len(at), table.schema.field("key_").type), "start_": pa.array(at, pa.int64()), "end_": pa.array(to, pa.int64())})

        found = placed.groupBy("key_", "block_").applyInArrow(settled, f"key_ {key}, start_ long, end_ long")
        told = staged(found.select(F.col(f"key_.{sequence}").alias(sequence), F.col("start_").alias("start"), F.col("end_").alias("end")), "segments")
        left = told.count()
        idle = idle + 1 if left == before else 0
        # Where blocks begin at either place and nothing moves, nothing is left to do.
        if idle == 2:
            return told
        before, shift = left, MERGED // 2 - shift
        now = told.select(sequence, F.col("start").alias("start__"))


#: Segments that one task merges at a time.
MERGED = 65_536


def _merged(starts: list[int], ends: list[int], least: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
    """Short segments merged, the shortest first, the first of equals; one that has a segment
    beyond an open end within two places, or one that waits so, stays."""
    n = len(starts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live, waits = [True] * n, [False] * n
    heap = [(ends[i] - starts[i], starts[i], i) for i in range(n) if ends[i] - starts[i] < least]
    heapq.heapify(heap)
    while heap:
        size, start, i = heapq.heappop(heap)
        if not live[i] or size != ends[i] - starts[i] or start != starts[i]:
            continue
        left, right = before[i], after[i]
        near = [left, before[left] if left >= 0 else -1], [right, after[right] if right < n else n]
        beyond = (not first and -1 in near[0]) or (not last and n in near[1])
        if beyond or any(0 <= j < n and waits[j] for side in near for j in side):
            waits[i] = True
            continue
        if left < 0 and right >= n:
            continue
        # The shorter neighbour takes it, the one before if they are equal.
        if right >= n or (left >= 0 and ends[left] - starts[left] <= ends[right] - starts[right]):
            into, ends[left] = left, ends[i]
        else:
            into, starts[right] = right, starts[i]
        live[i] = False
        if left >= 0:
            after[left] = right
        if right < n:
            before[right] = left
        waits[into] = False
        if ends[into] - starts[into] < least:
            heapq.heappush(heap, (ends[into] - starts[into], starts[into], into))
    kept = [i for i in range(n) if live[i]]
    return [starts[i] for i in kept], [ends[i] for i in kept]


def segments(df: DataFrame, sequence: str, frame: str, vector: str, rules: Rules = Rules()) -> DataFrame:
    """(sequence, start, end): the segments of each sequence, which tile it.

    Frames count from 0 without gaps, vectors have one length in a sequence. A
    sequence shorter than two segments is one. Cuts at a block's edge are told
    by the block of the frame before them, which sees the frames behind it.
    Draws are seeded by the sequence and block, so the result is the same on
    every run; null sequences count as one; an empty table gives no rows.
    """
    at = lambda f: F.floor(f / F.lit(rules.block))
    lengths = df.groupBy(sequence).agg((F.max(frame) + 1).alias("whole_"))
    last = lengths.select(F.struct(sequence).alias("key_"), at(F.col("whole_") - 1).alias("last_"))
    rows = df.select(F.struct(sequence).alias("key_"), F.col(frame).cast("long").alias("frame_"), F.transform(vector, lambda v: v.cast("double")).alias("x_")).join(last, "key_")
    blocks = F.sequence(F.greatest(at(F.col("frame_") - rules.band), F.lit(0)), F.least(at(F.col("frame_") + rules.band), F.col("last_")))
    shown = rows.withColumn("block_", F.explode(blocks))
    key = shown.schema["key_"].dataType.simpleString()

    def cut(table):
        table = table.sort_by("frame_")
        frames, block = table.column("frame_").to_numpy(), table.column("block_")[0].as_py()
        x = np.array(table.column("x_").to_pylist())
        name = str(next(iter(table.column("key_")[0].as_py().values())))
        seed = [rules.seed, int(hashlib.sha256(name.encode()).hexdigest()[:12], 16), block]
        found = frames[cuts_of(x, rules, seed)]
        own = found[(found - 1) // rules.block == block]
        return pa.table({"key_": pa.array([table.column("key_")[0].as_py()] * len(own), table.schema.field("key_").type), "start_": pa.array(own, pa.int64())})

    cuts = shown.groupBy("key_", "block_").applyInArrow(cut, f"key_ {key}, start_ long").select(F.col(f"key_.{sequence}").alias(sequence), "start_")
    starts = cuts.union(lengths.select(sequence, F.lit(0).cast("long").alias("start_")))
    return merge_short(starts, sequence, "start_", lengths, "whole_", rules.min_length)
