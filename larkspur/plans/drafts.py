"""Queries about drafts from a library of snippets, and spectra of sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import drafts, spectra
from larkspur.plans.registry import query
from larkspur.plans.segments import FRAMES, RUNS, frames, label_runs

_CHOICE = f"""{RUNS}, s AS (SELECT user_id, start, event_type, length FROM runs WHERE event_type <> 'view'), p AS (SELECT * FROM s WHERE length >= 2 AND user_id IS NOT NULL),
m AS (SELECT s.user_id, s.start, p.user_id AS from_user, p.start AS from_start, p.length AS from_length FROM s JOIN p ON p.event_type = s.event_type AND p.user_id % 4 <> s.user_id % 4
QUALIFY row_number() OVER (PARTITION BY s.user_id, s.start ORDER BY abs(p.length - s.length), p.user_id, p.start) = 1)"""


def _slots(spark, sf_dir):
    """Runs of events but views, which are filler, in four groups of users."""
    runs = label_runs(spark, sf_dir).select("user_id", "run", "event_type", "start", "length", (F.col("user_id") % 4).alias("group"))
    return runs.filter("event_type <> 'view'")


def _choice(spark, sf_dir):
    slots = _slots(spark, sf_dir)
    snippets = drafts.library(slots, "event_type", "length", "group", F.lit(False), 2)
    return drafts.nearest_outside(slots, snippets, "event_type", "length", "group", ["user_id", "start"])


@query(f"WITH {_CHOICE} SELECT s.user_id, s.start, event_type, length, from_user, from_start, from_length FROM s LEFT JOIN m ON s.user_id IS NOT DISTINCT FROM m.user_id AND s.start = m.start")
def snippet_choice(spark, sf_dir):
    """For each run the snippet of its type that is nearest in length, of users of another group."""
    return _choice(spark, sf_dir).select("user_id", F.col("start").cast("long").alias("start"), "event_type", "length", F.col("chosen.user_id").alias("from_user"), F.col("chosen.start").cast("long").alias("from_start"), F.col("chosen.length").alias("from_length"))


@query(f"""WITH {_CHOICE}, j AS (SELECT s.user_id, s.start, from_user, from_start, unnest(range(length)) AS j, CASE WHEN length > 1 THEN unnest(range(length)) * (from_length - 1) / (length - 1) ELSE 0.0 END AS pos FROM s JOIN m ON s.user_id IS NOT DISTINCT FROM m.user_id AND s.start = m.start),
d AS (SELECT j.user_id, j.start + j AS frame, sum(f.value * (1 - abs(pos - (f.frame - from_start)))) AS draft FROM j JOIN f ON f.user_id = from_user AND abs(pos - (f.frame - from_start)) < 1 AND f.frame BETWEEN from_start + floor(pos) AND from_start + ceil(pos) GROUP BY 1, 2)
SELECT f.user_id, f.frame, CASE WHEN d.frame IS NULL THEN 0 ELSE 1 END AS mask, round(coalesce(draft, 0), 5) AS draft FROM f LEFT JOIN d ON f.user_id IS NOT DISTINCT FROM d.user_id AND f.frame = d.frame""")
def snippet_drafts(spark, sf_dir):
    """Every event's draft value, from the snippet of its run resampled to the run's length."""
    f = frames(spark, sf_dir)
    got = drafts.drafted(f.select("user_id", "frame", "value"), _choice(spark, sf_dir), "user_id", "frame", ["value"])
    return got.select("user_id", "frame", "mask", F.round("value", 5).alias("draft"))


@query(f"""WITH {RUNS}, s AS (SELECT event_type, user_id, user_id % 4 AS g, length FROM runs WHERE event_type <> 'view'), p AS (SELECT event_type, g FROM s WHERE length >= 4 AND g IS NOT NULL GROUP BY ALL),
k AS (SELECT event_type, length, g IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.event_type = s.event_type AND p.g <> s.g) AS safe FROM s)
SELECT round(sum(CASE WHEN safe THEN length ELSE 0 END) / sum(length), 6) AS safe_share, sum(length)::BIGINT AS frames, sum(CASE WHEN safe THEN length ELSE 0 END)::BIGINT AS safe_frames, count(DISTINCT CASE WHEN NOT safe THEN event_type END) AS bare_labels FROM k""")
def snippet_coverage(spark, sf_dir):
    """How much of the runs a library of runs of four events or more covers from other groups."""
    slots = _slots(spark, sf_dir)
    snippets = drafts.library(slots, "event_type", "length", "group", F.lit(False), 4)
    return drafts.coverage(slots, snippets, "event_type", "length", "group").withColumn("safe_share", F.round("safe_share", 6))


@query(f"""WITH RECURSIVE {RUNS}, x AS (SELECT user_id, row_number() OVER w - 1 AS nth, length, event_type = 'view' AS filler, ('0x' || substr(sha256('7:' || coalesce(user_id::VARCHAR, '') || ':' || (row_number() OVER w - 1)), 1, 8))::BIGINT % 10 < 6 AS wanted FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY start)),
a AS (SELECT user_id, nth, filler, wanted AND NOT filler AND coalesce(NOT lag(filler, 4) OVER w AND abs(lag(length, 4) OVER w - length) <= greatest(0, 0.15 * length), false) AS four, wanted AND NOT filler AND coalesce(NOT lag(filler, 2) OVER w AND abs(lag(length, 2) OVER w - length) <= greatest(0, 0.15 * length), false) AS two FROM x WINDOW w AS (PARTITION BY user_id ORDER BY nth)),
r(user_id, nth, spent, lag) AS (SELECT user_id, -1::BIGINT, [true, true, true, true], NULL::INT FROM a WHERE nth = 0
UNION ALL SELECT user_id, nth, [filler OR k IS NOT NULL, spent[1], spent[2] OR coalesce(k = 2, false), spent[3]], k FROM (SELECT a.user_id, a.nth, filler, spent, CASE WHEN four AND NOT spent[4] THEN 4 WHEN two AND NOT spent[2] THEN 2 END AS k FROM r JOIN a ON a.user_id IS NOT DISTINCT FROM r.user_id AND a.nth = r.nth + 1))
SELECT user_id, nth, lag, nth - lag AS source FROM r WHERE nth >= 0""")
def motif_returns(spark, sf_dir):
    """Runs of equal length that come back four or two runs later, where a draw wants it."""
    runs = label_runs(spark, sf_dir).withColumn("nth", (F.col("run") - 1).cast("long"))
    text = F.concat(F.lit("7:"), F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit(":"), F.col("nth").cast("string"))
    wanted = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 10 < 6
    return drafts.returns(runs, "user_id", "nth", "length", F.col("event_type") == "view", wanted, slack=0.0)


_WELCH = f"""{FRAMES}, w AS (SELECT user_id, frame, value, s AS start, frame - s AS j FROM (SELECT *, unnest(range(greatest(0, (frame - 16 + 8) // 8), frame // 8 + 1)) * 8 AS s FROM f) WHERE frame - s < 16),
g AS (SELECT user_id, start, j, (value - avg(value) OVER v) * (0.5 - 0.5 * cos(2 * pi() * j / 15)) AS x, 0.5 - 0.5 * cos(2 * pi() * j / 15) AS h FROM w WINDOW v AS (PARTITION BY user_id, start) QUALIFY count(*) OVER v = 16),
d AS (SELECT user_id, start, bin, power(sum(x * cos(2 * pi() * bin * j / 16)), 2) + power(sum(x * sin(2 * pi() * bin * j / 16)), 2) AS p, sum(h * h) AS c FROM g, range(9) t(bin) GROUP BY 1, 2, 3),
s AS (SELECT user_id, bin, avg(p / (c * 8)) AS power, count(*) AS windows FROM d GROUP BY 1, 2)"""


@query(f"WITH {_WELCH} SELECT user_id, bin, bin * 0.5::DOUBLE AS frequency, round(power, 4) AS power, windows FROM s")
def value_spectrum(spark, sf_dir):
    """The spectrum of each user's values, eight events being a second, in windows of sixteen."""
    got = spectra.welch(frames(spark, sf_dir), "user_id", "frame", ["value"], 16, 8.0)
    return got.withColumns({"bin": F.col("bin").cast("long"), "power": F.round("power", 4)})


@query(f"WITH {_WELCH} SELECT user_id, round(coalesce(sum(power) FILTER (bin >= 4 AND bin < 7), 0) / greatest(sum(power), 1e-30), 6) AS share FROM s WHERE bin > 0 GROUP BY 1")
def band_power_share(spark, sf_dir):
    """How much of the values' power lies between 2 and 3.5 turns a second."""
    got = spectra.band_share(spectra.welch(frames(spark, sf_dir), "user_id", "frame", ["value"], 16, 8.0), "user_id", 2.0, 3.5)
    return got.withColumn("share", F.round("share", 6))
