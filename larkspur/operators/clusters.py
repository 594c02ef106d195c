"""Clusters of vectors: seeded k-means, merging of centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import retrieval
from larkspur.session import staged

#: Centres that one task merges (their distances take 8 bytes a pair).
MOST_MERGED = 4_096


def nearest(rows: DataFrame, vector: str, centers: DataFrame) -> DataFrame:
    """Add ``assigned`` and ``distance``: the nearest of (label, center), ties by
    label. The centres are broadcast, their number is checked; rows stay where they are."""
    if centers.count() > retrieval.MOST_CENTERS:
        raise ValueError(f"more than {retrieval.MOST_CENTERS} centres")
    all_ = F.broadcast(centers.agg(F.collect_list(F.struct("label", "center")).alias("centers_")))
    each = lambda c: F.struct(F.round(V.squared_distance(F.col(vector), c["center"]), 6).alias("distance"), c["label"].alias("label"))
    met = rows.crossJoin(all_).withColumn("found_", F.array_min(F.transform("centers_", each)))
    return met.select(*rows.columns, F.col("found_.label").alias("assigned"), F.col("found_.distance").alias("distance"))


def squared_seeds(rows: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> list[tuple[object, list[float]]]:
    """(key, vector) of k starting rows, each drawn with a probability in
    proportion to its squared distance from the nearest one before.

    One pass over the rows for each: with u from sha256 of "seed:i:key" (52
    bits), the row with the least -ln(u) / distance wins that race as often as
    its weight says. Rows with no distance win only where there is no other (by
    least u, as the first one does). Fewer than k rows are an error; keys are unique.
    """
    seeds: list[tuple[object, list[float]]] = []
    if (n := rows.count()) < k:
        raise ValueError(f"{n} rows cannot form {k} clusters")
    for i in range(k):
        u = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), F.col(key).cast("string")), 256), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
        centers = rows.sparkSession.createDataFrame([(j, c) for j, (_, c) in enumerate(seeds)], "label int, center array<double>")
        met = nearest(rows, vector, centers) if seeds else rows.withColumn("distance", F.lit(0.0))
        told = met.select(F.col(key).alias("key"), F.col(vector).alias("x"), F.col("distance").alias("d"), u.alias("u"))
        race = F.when(F.col("d") > 0, -F.log("u") / F.col("d"))
        won = told.agg(F.min_by(F.struct("key", "x"), F.struct(F.col("d") <= 0, F.coalesce(race, F.col("u")), "key"))).first()[0]
        seeds.append((won["key"], [float(x) for x in won["x"]]))
    return seeds


#: Distances that a task holds at a time.
TILE = 1 << 18


def _assigned(x: np.ndarray, known: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centre as ``nearest`` tells it: of distances to six decimals,
    added from left to right, the first of equal ones; the first too where a vector lacks a component."""
    out = np.zeros(len(x), dtype=np.int64)
    if x.shape[1] != centers.shape[1]:
        return out
    some = max(1, TILE // len(centers))
    for at in range(0, len(x), some):
        total = np.zeros((len(x[at : at + some]), len(centers)))
        for a, c in zip(x[at : at + some].T, centers.T, strict=True):
            step = a[:, None] - c[None, :]
            total += step * step
        out[at : at + some] = np.round(total, 6).argmin(axis=1)
    out[~known.all(axis=1)] = 0
    return out


def _means(rows: DataFrame, vector: str, centers: list[tuple[int, list[float]]]) -> dict[int, list[float]]:
    """The mean of the vectors nearest to each centre, by label: one pass, in which a task keeps
    one sum and count for each centre and dimension; centres without vectors are not there."""
    if len(centers) > retrieval.MOST_CENTERS:
        raise ValueError(f"more than {retrieval.MOST_CENTERS} centres")
    labels = np.array([i for i, _ in centers], dtype=np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(np.array([c for _, c in centers], dtype=float))

    def summed(batches):
        at = shared.value
        sums, counts = (np.zeros((len(at), at.shape[1])) for _ in range(2))
        for b in batches:
            lists = b.column(0).filter(b.column(0).is_valid())
            wide = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for d in np.unique(wide[wide > 0]):
                flat = lists.filter(pa.array(wide == d)).flatten()
                known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d)
                x = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                if d > sums.shape[1]:
                    sums, counts = (np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in (sums, counts))
                own = _assigned(x, known, at)
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                sums[found, :d] += np.add.reduceat(x[order], first)
                counts[found, :d] += np.add.reduceat(known[order].astype(float), first)
        i, dim = np.nonzero(counts)
        for lo in range(0, len(i), 65_536):
            part = (i[lo : lo + 65_536], dim[lo : lo + 65_536])
            yield pa.RecordBatch.from_arrays([pa.array(labels[part[0]]), pa.array(part[1]), pa.array(sums[part]), pa.array(counts[part])], names=["label", "dim", "total", "n"])

    parts = rows.select(vector).mapInArrow(summed, "label long, dim long, total double, n double")
    found: dict[int, list[float]] = {}
    for r in parts.groupBy("label", "dim").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("label", "dim").collect():
        found.setdefault(r["label"], []).append(r["mean"])
    shared.destroy()
    return found


def kmeans(rows: DataFrame, key: str, vector: str, k: int, rounds: int, seed: int = 42, start: list[list[float]] | None = None) -> DataFrame:
    """(label, center): Lloyd's rounds from ``start``, or the k first rows by sha256 of "seed:key".

    The vectors are written out once, dealt over all tasks. A round assigns them in
    one pass and sums them per centre before the shuffle; when no centre moves any more the rounds end. The centres (k rows)
    go through the driver, so that no plan grows with the rounds. A centre
    without rows starts again at a row farthest from its own. Fewer than k rows
    give as many centres as rows.
    """
    spark = rows.sparkSession
    schema = "label int, center array<double>"
    if start is None:
        first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).limit(k)
        start = [[float(x) for x in r[0]] for r in first.select(vector).collect()]
    centers, before = list(enumerate(start)), None
    kept = staged(rows.select(key, vector).repartition(key), "vectors") if centers else rows
    for _ in range(rounds):
        if not centers or centers == before:
            break
        before = centers
        found = {i: [round(x, 9) for x in mean] for i, mean in _means(kept, vector, centers).items()}
        lost = [i for i, _ in centers if i not in found]
        if lost:
            told = nearest(kept, vector, spark.createDataFrame(centers, schema))
            far = told.orderBy(F.desc("distance"), F.asc(key)).limit(len(lost)).select(vector).collect()
            found |= {i: [float(x) for x in r[0]] for i, r in zip(lost, far, strict=False)}
        centers = sorted(found.items())
    return spark.createDataFrame(centers, schema)


def merge_centers(centers: DataFrame, groups: int) -> DataFrame:
    """(label, merged): centres (label, center, n) merged by Ward's rule until
    ``groups`` are left; of equally cheap pairs the first by least label. Groups
    are numbered from 1 by their least label, as 0 is kept for filler. One task
    takes the table of centres, whose size is checked, never the rows."""
    if centers.count() > MOST_MERGED:
        raise ValueError(f"more than {MOST_MERGED} centres")
    kind = centers.schema["label"].dataType.simpleString()

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("label", ignore_index=True)
        at, size = np.array(table["center"].tolist(), dtype=float), table["n"].to_numpy(dtype=float)
        member = np.arange(len(table))
        cost = (size[:, None] * size / (size[:, None] + size)) * ((at[:, None] - at) ** 2).sum(axis=2)
        cost[np.tril_indices(len(table))] = np.inf
        for _ in range(len(table) - groups):
            i, j = np.unravel_index(cost.argmin(), cost.shape)
            at[i] = (size[i] * at[i] + size[j] * at[j]) / (size[i] + size[j])
            size[i] += size[j]
            member[member == j] = i
            cost[j], cost[:, j] = np.inf, np.inf
            live = np.unique(member)
            live = live[live != i]
            anew = size[i] * size[live] / (size[i] + size[live]) * ((at[i] - at[live]) ** 2).sum(axis=1)
            cost[np.minimum(i, live), np.maximum(i, live)] = anew
        order = {m: g for g, m in enumerate(np.unique(member), 1)}
        return pd.DataFrame({"label": table["label"], "merged": [order[m] for m in member]})

    return centers.select("label", "center", "n", F.lit(0).alias("all_")).groupBy("all_").applyInPandas(fold, f"label {kind}, merged int")


def merge_small(centers: DataFrame, parent: str, least: int) -> DataFrame:
    """(parent, label, merged): centres (parent, label, center, n) with fewer than
    ``least`` rows join their nearest sibling (ties by label), the smallest first
    (ties by label), until none is left or the parent has one. The sibling's
    centre moves by the rows it takes and it keeps its label. One parent's centres,
    not its rows, are one group."""

    def fold(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("label", ignore_index=True)
        at, size = np.array(table["center"].tolist(), dtype=float), table["n"].to_numpy(dtype=float)
        member, live = np.arange(len(table)), list(range(len(table)))
        while len(live) > 1 and (i := min(live, key=lambda k: (size[k], k))) is not None and size[i] < least:
            live.remove(i)
            j = live[int(((at[live] - at[i]) ** 2).sum(axis=1).argmin())]
            at[j] = (size[i] * at[i] + size[j] * at[j]) / (size[i] + size[j])
            size[j] += size[i]
            member[member == i] = j
        return pd.DataFrame({parent: [key[0]] * len(table), "label": table["label"], "merged": table["label"].to_numpy()[member]})

    kind = {c: centers.schema[c].dataType.simpleString() for c in (parent, "label")}
    return centers.select(parent, "label", "center", "n").groupBy(parent).applyInPandas(fold, f"{parent} {kind[parent]}, label {kind['label']}, merged {kind['label']}")
