"""Snippets, drafts, coverage, returning bars and spectra against plain rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import drafts, spectra

SLOT = "seq string, start long, length long, label string, grp long"


def slots_of(spark, rows):
    return spark.createDataFrame(rows, SLOT)


def plain_choice(slot, snippets):
    _, _, length, label, group = slot
    fine = [s for s in snippets if s[3] == label and group is not None and s[4] not in (None, group)]
    best = min(fine, key=lambda s: (abs(s[2] - length), s[0], s[1]), default=None) if label is not None else None
    return best and (best[0], best[1], best[2])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_outside_is_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    # Few groups in long stretches of lengths, so that one group alone has many neighbouring lengths.
    group = lambda n: (n // 9) % 2 if rng.random() < 0.9 else rng.choice([0, 1, 2, None])
    rows = []
    for i in range(400):
        n = rng.choice([1, 2, 3, rng.randrange(1, 60)])
        rows.append((f"s{rng.randrange(30):02}", i, n, rng.choice(["a", "b", "c", None]) if i % 50 else "only one group", group(n) if i % 50 else 5))
    runs = slots_of(spark, rows)
    snippets = drafts.library(runs, "label", "length", "grp", F.lit(False), 2)
    kept = [r for r in rows if r[2] >= 2 and r[3] is not None and r[4] is not None]
    assert snippets.count() == len(kept)
    wanted = {r[1]: plain_choice(r, kept) for r in rows}
    got = {r["start"]: r["chosen"] and tuple(r["chosen"]) for r in drafts.nearest_outside(runs, snippets, "label", "length", "grp", ["seq", "start"]).collect()}
    assert got == wanted
    assert any(v is None for v in wanted.values()) and any(v for v in wanted.values())


def test_repeated_slots_stay_and_no_snippets_choose_none(spark):
    runs = slots_of(spark, [("x", 0, 3, "a", 1)] * 3 + [(None, 0, 3, "a", 2)])
    got = drafts.nearest_outside(runs, runs, "label", "length", "grp", ["seq", "start"]).collect()
    assert sorted(str(tuple(r["chosen"])) for r in got) == ["('x', 0, 3)", "(None, 0, 3)", "(None, 0, 3)", "(None, 0, 3)"]
    assert [r["chosen"] for r in drafts.nearest_outside(runs, runs.limit(0), "label", "length", "grp", ["seq", "start"]).collect()] == [None] * 4
    assert drafts.nearest_outside(runs.limit(0), runs, "label", "length", "grp", ["seq", "start"]).count() == 0


def test_drafts_are_resampled_between_their_ends(spark, monkeypatch):
    from larkspur.operators import timeline

    monkeypatch.setattr(timeline, "BLOCK", 4)  # a long run is exploded in two steps
    rng = random.Random(5)
    values = {s: [float(rng.randrange(100)) for _ in range(40)] for s in ("a", "b", None)}
    frames = spark.createDataFrame([(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)], "seq string, frame long, x double")
    plan = [("a", 0, 11, ("b", 3, 7)), ("a", 11, 1, ("b", 20, 5)), ("a", 12, 9, None), ("b", 2, 11, ("b", 3, 7)), (None, 0, 6, (None, 30, 6)), ("b", 30, 4, ("a", 5, 1))]
    slots = spark.createDataFrame(plan, "seq string, start long, length long, chosen struct<seq:string,start:long,length:long>")
    want = {(s, i): (0, 0.0) for s, vs in values.items() for i in range(len(vs))}
    for s, start, n, chosen in plan:
        if chosen:
            part = values[chosen[0]][chosen[1] : chosen[1] + chosen[2]]
            at = np.linspace(0, len(part) - 1, n) if n > 1 else [0.0]
            want |= {(s, start + j): (1, round(float(v), 6)) for j, v in enumerate(np.interp(at, range(len(part)), part))}
    got = drafts.drafted(frames, slots, "seq", "frame", ["x"]).collect()
    assert len(got) == 120
    assert {(r["seq"], r["frame"]): (r["mask"], round(r["x"], 6)) for r in got} == want


def test_coverage_counts_frames_and_bare_labels(spark):
    rows = [("a", 0, 3, "x", 1), ("b", 0, 2, "x", 2), ("c", 0, 5, "y", 1), ("d", 0, 7, "x", None)]
    runs = slots_of(spark, rows)
    got = drafts.coverage(runs, runs, "label", "length", "grp").first()
    assert (got["frames"], got["safe_frames"], got["bare_labels"]) == (17, 5, 2) and abs(got["safe_share"] - 5 / 17) < 1e-12
    none = drafts.coverage(runs.limit(0), runs, "label", "length", "grp").first()
    assert tuple(none) == (1.0, 0, 0, 0)


def plain_returns(lengths, filler, wanted, lags, band, slack):
    returned, used, out = set(), set(), []
    for i, n in enumerate(lengths):
        taken = None
        if wanted[i] and not filler[i]:
            for k in lags:
                j = i - k
                if j >= 0 and not filler[j] and j not in returned and j not in used and abs(lengths[j] - n) <= max(slack, band * n):
                    taken = k
                    used.add(j)
                    returned.add(i)
                    break
        out.append(taken)
    return out


@pytest.mark.parametrize("block", [1, 5, 4_096])
@pytest.mark.parametrize("lags", [(4, 2), (2, 4), (3,), (8, 5, 2)])
def test_returns_are_the_plain_fold(spark, block, lags):
    rng = random.Random(block)
    plans = {s: [(rng.choice([4, 4, 5, 9]), rng.random() < 0.2, rng.random() < 0.7) for _ in range(n)] for s, n in (("a", 40), (None, 23), ("one", 1))}
    slots = spark.createDataFrame([(s, i, *x) for s, xs in plans.items() for i, x in enumerate(xs)], "seq string, nth long, length long, filler boolean, wanted boolean")
    got = {(r["seq"], r["nth"]): (r["lag"], r["source"]) for r in drafts.returns(slots, "seq", "nth", "length", F.col("filler"), F.col("wanted"), lags, 0.15, 0.5, block).collect()}
    want = {}
    for s, xs in plans.items():
        for i, k in enumerate(plain_returns(*zip(*xs, strict=True), lags, 0.15, 0.5)):
            want[s, i] = (k, k and i - k)
    assert got == want
    assert any(k for k, _ in want.values())


def test_returns_refuse_lags_out_of_range(spark):
    slots = spark.createDataFrame([("a", 0, 4)], "seq string, nth long, length long")
    for lags in ((1,), (9,), (4, 1)):
        with pytest.raises(ValueError, match="lags"):
            drafts.returns(slots, "seq", "nth", "length", F.lit(False), F.lit(True), lags)


def test_spectrum_is_numpys_and_finds_a_planted_band(spark):
    t = np.arange(100) / 32.0
    series = {"tone": np.stack([np.sin(2 * np.pi * 4 * t), np.cos(2 * np.pi * 4 * t)], 1), "noise": np.random.default_rng(3).normal(size=(77, 2)), None: np.random.default_rng(4).normal(size=(16, 2)), "short": np.ones((15, 2)), "still": np.ones((40, 2))}
    df = spark.createDataFrame([(s, i, float(x), float(y)) for s, xs in series.items() for i, (x, y) in enumerate(xs)], "seq string, frame long, x double, y double")
    got = {}
    for r in spectra.welch(df, "seq", "frame", ["x", "y"], 16, 32.0).collect():
        got[r["seq"], r["bin"]] = r["power"]
    window = np.hanning(16)
    for s, xs in series.items():
        if len(xs) < 16:
            assert (s, 0) not in got
            continue
        powers = []
        for start in range(0, len(xs) - 15, 8):
            part = xs[start : start + 16]
            powers.append(np.abs(np.fft.rfft((part - part.mean(0)) * window[:, None], axis=0)) ** 2)
        want = np.mean(powers, axis=0).mean(1) / ((window**2).sum() * 32)
        assert np.allclose([got[s, k] for k in range(9)], want)
    share = {r["seq"]: r["share"] for r in spectra.band_share(spectra.welch(df, "seq", "frame", ["x", "y"], 16, 32.0), "seq", 2.0, 8.0).collect()}
    assert share["tone"] > 0.95 and share["still"] == 0.0 and 0 < share["noise"] < 0.8


def test_windows_with_nulls_take_no_part(spark):
    rows = [("a", i, None if i == 3 else float(i % 5)) for i in range(24)]
    got = spectra.welch(spark.createDataFrame(rows, "seq string, frame long, x double"), "seq", "frame", ["x"], 8, 8.0)
    assert {r["windows"] for r in got.collect()} == {4}
    assert spectra.welch(spark.createDataFrame(rows[:5], "seq string, frame long, x double"), "seq", "frame", ["x"], 8, 8.0).count() == 0
