"""What returns within a sequence, and placement beside pins: planted and random
cases against plain rules, nulls and empty tables, blocks of any size."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import graph, placement, recurrence, splits


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- votes -------------------------------------------------------------------

VOTES = "seq string, w long, p long, r long, s double"


def plain_agreement(votes, least, near_p, near_r):
    out = []
    for seq in {v[0] for v in votes}:
        own = [v for v in votes if v[0] == seq]
        fine = [v for v in own if v[4] is not None and v[4] >= least]
        best = None
        for _, _, p0, r0, _ in fine:
            group = {}
            for _, w, p, r, s in fine:
                if abs(p - p0) <= near_p and abs(r - r0) <= near_r:
                    group[w] = min(group.get(w, (1,)), (-s, p, r)) if w in group else (-s, p, r)
            key = (-len(group), round(sum(x[0] for x in group.values()), 9), p0, r0)
            if best is None or key < best[0]:
                best = (key, group)
        if best is None:
            out.append((seq, 0, None, None, None, False))
        else:
            g = best[1]
            out.append((seq, len(g), statistics.median(x[1] for x in g.values()), statistics.median(x[2] for x in g.values()), round(-sum(x[0] for x in g.values()) / len(g), 6), max(g) == max(v[1] for v in own)))
    return sorted(out, key=str)


def agreed(spark, votes, least=0.9, near_p=4, near_r=1):
    df = recurrence.agreement(spark.createDataFrame(votes, VOTES), "seq", "w", "p", "r", "s", least, near_p, near_r)
    return got(df.withColumn("mean_score", F.round("mean_score", 6)), "seq", "n_agree", "place", "rate", "mean_score", "covers_end")


def test_a_window_that_also_matches_elsewhere_still_votes(spark):
    votes = [("a", 0, 5000, 100, 0.3), ("a", 1, 9000, 100, 0.3), ("a", 2, 17801, 100, 0.974), ("a", 3, -1015, 100, 0.997), ("a", 3, 17800, 100, 0.97), ("b", 0, 1, 1, 0.1), (None, 5, 3, 3, 0.95), (None, 5, 3, 3, None)]
    assert agreed(spark, votes) == plain_agreement(votes, 0.9, 4, 1)
    assert ("a", 2, 17800.5, 100.0, 0.972, True) in agreed(spark, votes)
    assert agreed(spark, votes[:0]) == []


def test_random_votes_agree_like_the_quadratic_rule(spark):
    rng = random.Random(4)
    votes = [(rng.choice(["x", "y", None]), rng.randrange(30), rng.randrange(60), rng.randrange(95, 106), rng.choice([0.5, 0.9, 0.95, rng.random()])) for _ in range(400)]
    votes += [("hot", w % 12, 7, 100, 0.99) for w in range(300)]
    assert agreed(spark, votes) == plain_agreement(votes, 0.9, 4, 1)


# --- novelty and recurrence --------------------------------------------------


def series(spark, sequences):
    rows = [(name, i, float(x)) for name, xs in sequences.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "seq string, frame long, x double")


def plain_novelty(x, length, stride, gap):
    starts = np.arange(0, max(0, len(x) - length + 1), stride)
    if len(x) < 2 * length or len(starts) < 4:
        return None
    block = np.array([x[s : s + length] for s in starts], dtype=float)
    d = np.sqrt(((block[:, None] - block[None]) ** 2).sum(-1))
    far = np.abs(starts[:, None] - starts[None]) >= gap
    nearest = np.where(far, d, np.inf).min(1)
    nearest = nearest[np.isfinite(nearest)]
    if len(nearest) < 2 or not far.any() or d[far].mean() <= 0:
        return None
    return np.median(nearest) / d[far].mean()


@pytest.mark.parametrize("block", [3, 1_024])
def test_novelty_of_tiled_and_independent_sequences(spark, block):
    rng = np.random.default_rng(0)
    tile = rng.normal(size=20)
    sequences = {"tiled": np.tile(tile, 8), "free": rng.normal(size=160), "short": rng.normal(size=7), "flat": np.ones(40), "close": rng.normal(size=12), None: rng.normal(size=50)}
    df = recurrence.novelty(series(spark, sequences), "seq", "frame", "x", 4, 2, 12, block)
    found = {r["seq"]: r["novelty"] for r in df.collect()}
    assert set(found) == set(sequences)
    for name, x in sequences.items():
        want = plain_novelty(x, 4, 2, 12)
        assert (found[name] is None) == (want is None) and (want is None or abs(found[name] - want) < 1e-5), name
    assert found["tiled"] < 0.01 and found["free"] > 0.2
    assert recurrence.novelty(series(spark, {"a": []}), "seq", "frame", "x", 4, 2, 12).count() == 0


@pytest.mark.parametrize("block", [5, 1_024])
def test_recurrence_and_its_quantile_against_numpy(spark, block):
    rng = np.random.default_rng(2)
    sequences = {"a": rng.normal(size=60) * 1000, "b": np.repeat([1.0, 5.0, 1.0], 15), "one": [3.0], None: rng.integers(0, 4, 33).astype(float)}
    df = series(spark, sequences).withColumn("v", F.array("x", F.col("x") / 3))
    blocks = recurrence.packed(df, "seq", "frame", F.col("frame"), "v", F.lit(0), block)
    quantiles = {r["key_"]["seq"]: r["quantile"] for r in recurrence.distance_quantile(blocks, 0.1).collect()}
    found = {(r["seq"], r["frame"]): r["recurrence"] for r in recurrence.event_recurrence(df, "seq", "frame", "v", F.col("frame") % 7 == 0, 15, 0.1, block).collect()}
    count = 0
    for name, x in sequences.items():
        v = np.stack([np.asarray(x), np.asarray(x) / 3], axis=1)
        d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 6)
        pairs = d[np.triu_indices(len(d), k=1)]
        eps = np.quantile(pairs, 0.1) if len(pairs) else 0.0
        assert len(pairs) == 0 or abs(quantiles[name] - eps) < 1e-9
        for i in range(0, len(x), 7):
            far = np.abs(np.arange(len(x)) - i) > 15
            want = (d[i][far] < eps).mean() if far.any() else 0.0
            assert abs(found[name, i] - want) < 1e-9
            count += 1
    assert count == len(found)


@pytest.mark.parametrize("block", [4, 1_024])
def test_contrast_of_equal_and_other_labels(spark, block):
    rng = np.random.default_rng(6)
    rows = [("a", i, rng.normal(size=3).tolist(), rng.choice(["x", "y", None])) for i in range(30)] + [(None, i, [1.0, 0.0, 0.0], "x") for i in range(9)] + [("zero", i, [0.0] * 3, "x") for i in range(3)]
    df = spark.createDataFrame([(s, i, v, None if c is None else str(c)) for s, i, v, c in rows], "seq string, at long, v array<double>, c string")
    for cosine in (False, True):
        found = {r["seq"]: r for r in recurrence.label_contrast(df, "seq", "at", "v", "c", 2, cosine, block).collect()}
        for name in ("a", None, "zero"):
            own = [r for r in rows if r[0] == name]
            same, other = [], []
            for _, i, v, c in own:
                for _, j, w, e in own:
                    if j - i >= 2:
                        norm = np.linalg.norm(v) * np.linalg.norm(w)
                        value = (np.dot(v, w) / norm if norm else 0.0) if cosine else np.linalg.norm(np.subtract(v, w))
                        (same if c is not None and c == e else other).append(value)
            r = found[name]
            assert (r["same_pairs"], r["other_pairs"]) == (len(same), len(other))
            for mean, values in ((r["same_mean"], same), (r["other_mean"], other)):
                assert (mean is None) == (not values) and (not values or abs(mean - np.mean(values)) < 1e-5)
        assert found[None]["identical"] == 28


# --- placement beside pins ---------------------------------------------------

SHARES = {"train": 8, "val": 1, "test": 1}


def plain_components(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u in parent and v in parent:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    return {i: find(i) for i in ids}


def plain_beside_pins(pins, edges, seed=42):
    live, out = dict(pins), {}
    while True:
        of, groups = plain_components(live, edges), {}
        for i, c in of.items():
            groups.setdefault(c, []).append(i)
        gone = [(i, c) for c, m in groups.items() if len({live[i] for i in m} - {None}) > 1 for i in m if live[i] is None]
        if not gone:
            break
        for i, c in gone:
            out[i] = (c, None, "dropped")
            del live[i]
    held, free = {s: 0 for s in SHARES}, []
    for c, m in groups.items():
        sides = {live[i] for i in m} - {None}
        if not sides:
            free.append(c)
        for i in m if sides else ():
            side = live[i] or next(iter(sides))
            held[side] += 1
            out[i] = (c, side, "straddles" if len(sides) > 1 else "pinned" if live[i] else "follows")
    left = {s: SHARES[s] * len(live) - 10 * held[s] for s in SHARES}
    for c in sorted(free, key=lambda c: (-len(groups[c]), hashlib.sha256(f"{seed}:{c}".encode()).hexdigest())):
        side = max(SHARES, key=lambda s: (left[s], s))
        left[side] -= 10 * len(groups[c])
        out |= {i: (c, side, "placed") for i in groups[c]}
    return sorted((i, *v) for i, v in out.items())


def beside(spark, pins, edges, **more):
    v = spark.createDataFrame(list(pins.items()), "id long, pin string")
    e = spark.createDataFrame(edges, "u long, v long")
    df = placement.place_beside_pins(v, e, "id", "pin", SHARES, **more)
    return sorted((tuple(r) for r in df.select("id", "component", "split", "state").collect()), key=lambda r: r[0])


def test_bridges_are_refused_or_dropped_and_pins_never_move(spark):
    pins = {1: "train", 2: "test", 3: None, 4: None, 5: "val", 6: "train", 7: None, 8: None, 9: None, 10: None, 11: "train"}
    edges = [(1, 3), (3, 2), (4, 5), (5, 6), (7, 11), (8, 9), (99, 1), (None, 2)]
    with pytest.raises(ValueError, match="several pinned splits"):
        beside(spark, pins, edges)
    found = beside(spark, pins, edges, drop_bridging=True)
    assert found == plain_beside_pins(pins, edges)
    state = {r[0]: (r[2], r[3]) for r in found}
    assert state[3] == (None, "dropped") and state[4] == (None, "dropped")  # both join two sides
    assert state[5] == ("val", "straddles") and state[6] == ("train", "straddles") and state[7] == ("train", "follows")
    assert all(state[i][0] == p for i, p in pins.items() if p)
    named = {r[0]: r[2] for r in beside(spark, pins, edges, drop_bridging=True, to="train")}
    assert {named[8], named[9], named[10]} == {"train"}


def test_random_graphs_are_placed_like_the_plain_rule(spark):
    rng = random.Random(8)
    pins = {i: rng.choice([None, None, "train", "train", "val", "test"]) for i in range(300)}
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(110)]
    assert beside(spark, pins, edges, drop_bridging=True) == plain_beside_pins(pins, edges)
    assert beside(spark, {}, [], drop_bridging=True) == []
    alone = {i: None for i in range(40)}
    assert beside(spark, alone, []) == plain_beside_pins(alone, [])


def test_components_of_long_paths_and_hubs(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    edges = list(zip(order[:300], order[1:301])) + [(order[300], i) for i in order[301:380]] + [(5, 5), (None, 7)]
    v = spark.createDataFrame([(i,) for i in range(400)], "id long")
    e = spark.createDataFrame(edges, "u long, v long")
    found = {r["id"]: r["component"] for r in graph.components(e, v, "id").collect()}
    assert found == plain_components(range(400), [x for x in edges if None not in x])


def test_held_mass_and_many_places(spark, monkeypatch):
    monkeypatch.setattr(splits, "PLACES", 3)
    df = spark.createDataFrame([(i, 1 + i // 40) for i in range(80)], "g long, m long")
    held = {"train": 500, "val": 0, "test": 3}
    left = {s: SHARES[s] * (120 + 503) - 10 * held[s] for s in SHARES}
    want = {}
    for g, m in sorted(((i, 1 + i // 40) for i in range(80)), key=lambda x: (-x[1], x[0])):
        side = max(SHARES, key=lambda s: (left[s], s))
        want[g], left[side] = side, left[side] - 10 * m
    assert {r["g"]: r["split"] for r in splits.largest_deficit(df, "g", "m", SHARES, held).collect()} == want


# --- bars that sound alike ---------------------------------------------------

BARS = "seq string, bar long, v array<double>, label int, n long"
SOUND = {"A": [1.0, 0.0, 0.1], "B": [0.0, 1.0, 0.1], "C": [0.5, 0.5, 2.0]}


def planned(spark, songs, strength=0.95, block=1_024):
    rows = [(name, i, SOUND[s] if s in SOUND else [0.0] * 3, label, 4) for name, (sections, labels) in songs.items() for i, (s, label) in enumerate(zip(sections, labels, strict=True))]
    out = {}
    for r in recurrence.repeat_plan(spark.createDataFrame(rows, BARS), "seq", "bar", "v", "label", "n", strength, block=block).orderBy("bar").collect():
        out.setdefault(r["seq"], []).append(r["planned"])
    return out


@pytest.mark.parametrize("block", [2, 1_024])
def test_bars_that_sound_alike_get_one_class(spark, block):
    songs = {
        "abab": ("ABABABAB", [1, 2, 3, 4, 5, 6, 7, 8]),
        "weight": ("AAABBBBB", [5, 5, 6, 7, 7, 7, 7, 7]),
        "filler": ("AAAABBBB", [0, 0, 0, 3, 9, 9, 9, 9]),
        "only filler": ("AAB", [0, None, 4]),
        None: ("ABCABCAB", [4, 9, 2, 4, 9, 2, 4, 9]),
        "silent": ("xxA", [1, 2, 3]),
    }
    got = planned(spark, songs, block=block)
    assert got["abab"] == [1, 2] * 4  # ties go to the least class
    assert got["weight"] == [5, 5, 5, 7, 7, 7, 7, 7] and got["filler"] == [3, 3, 3, 3, 9, 9, 9, 9]
    assert got["only filler"] == [0, 0, 4] and got[None] == [4, 9, 2, 4, 9, 2, 4, 9] and got["silent"] == [1, 2, 3]
    assert planned(spark, songs, strength=0.0) == {s: labels for s, (_, labels) in songs.items()}


def test_likeness_is_passed_on_along_chains(spark):
    """Each bar is like the next one only; all of them are one group, in blocks of any size."""
    rows = [("s", i, [float(np.cos(i / 20)), float(np.sin(i / 20))], i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, BARS)
    for block in (4, 1_024):
        assert {r["group"] for r in recurrence.alike(df, "seq", "bar", "v", 0.998, block).collect()} == {0}
        assert len({r["group"] for r in recurrence.alike(df, "seq", "bar", "v", 0.99999, block).collect()}) == 30
