"""Queries about bars: tokens and their checks, labels by span, the grid, shapes of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import bars
from larkspur.plans.registry import query
from larkspur.plans.segments import FRAMES, RUNS, frames, label_runs

_BARS = f"""{FRAMES}, x AS (SELECT *, frame // 8 * 8 AS start FROM f WHERE frame // 8 * 8 + 8 <= n),
m AS (SELECT user_id, start, event_type, count(*) AS c FROM x GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY count(*) DESC, event_type) = 1),
b AS (SELECT user_id, start, start + 8 AS "end", avg(value) AS value_mean, sum(event_id % 3)::DOUBLE AS count_sum, count(*) FILTER (event_id % 4 = 0) AS beats, coalesce(min(frame) FILTER (event_id % 4 = 0) = start, false) AS on_beat FROM x GROUP BY 1, 2),
k AS (SELECT b.*, event_type, 8 - c AS wrong, c < 8 AS mixed FROM b JOIN m ON m.user_id IS NOT DISTINCT FROM b.user_id AND m.start = b.start)"""


def _spans(f, size):
    """The whole bars of ``size`` frames of each sequence."""
    return f.groupBy("user_id", F.floor(F.col("frame") / size).alias("bar")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size).select("user_id", "bar", (F.col("bar") * size).alias("start"), ((F.col("bar") + 1) * size).alias("end"))


def _tokens(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("count", F.col("event_id") % 3)
    return bars.tokens(f, _spans(f, 8), "user_id", "frame", "event_type", F.col("event_id") % 4 == 0, ["value"], ["count"])


@query(f'WITH {_BARS} SELECT user_id, start, "end", event_type, wrong, mixed, beats, on_beat, round(value_mean, 5) AS value_mean, count_sum FROM k')
def bar_tokens(spark, sf_dir):
    """Eight events are a bar; every fourth event id is a beat."""
    return _tokens(spark, sf_dir).withColumn("value_mean", F.round("value_mean", 5))


@query(f"WITH {_BARS} SELECT count(*) AS bars, (8 * count(*))::BIGINT AS frames, sum(wrong)::BIGINT AS wrong, count(*) FILTER (mixed) AS mixed, count(*) FILTER (NOT on_beat) AS off_beat, count(*) FILTER (beats <> 2) AS other_beats FROM k")
def bar_token_checks(spark, sf_dir):
    return bars.checks(_tokens(spark, sf_dir), 2)


@query(f"""WITH {FRAMES}, w AS (SELECT user_id, w, frame // 4 * 4 AS start, CASE WHEN max(value) > 100 THEN w % 2 ELSE 2 END AS label FROM (SELECT *, unnest(range(greatest(0, (frame // 4 - 3 + 1)), frame // 4 + 1)) AS w FROM f WHERE frame // 4 * 4 + 4 <= n) GROUP BY 1, 2, 3)
SELECT user_id, start, start + 4 AS "end", arg_max(label, w) AS label, count(*) AS writers, count(DISTINCT label) > 1 AS conflict FROM w GROUP BY 1, 2""")
def bar_span_labels(spark, sf_dir):
    """Bars of four events, named by up to three overlapping windows of three bars; loud bars are named differently by odd windows."""
    f = frames(spark, sf_dir)
    loud = f.groupBy("user_id", F.floor(F.col("frame") / 4).alias("bar")).agg(F.max("value").alias("most"), F.count(F.lit(1)).alias("n")).filter("n = 4")
    named = loud.withColumn("w", F.explode(F.sequence(F.greatest(F.col("bar") - 2, F.lit(0)), F.col("bar"))))
    named = named.select("user_id", (F.col("bar") * 4).alias("start"), (F.col("bar") * 4 + 4).alias("end"), "w", F.when(F.col("most") > 100, F.col("w") % 2).otherwise(2).alias("label"))
    return bars.span_labels(named, "user_id", "label", "w")


@query(f"""WITH {FRAMES}, g AS (SELECT user_id, frame // 8 AS bar, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) = 8),
r AS (SELECT user_id, bar, bar * 8 + CASE WHEN user_id % 5 = 0 AND bar = 3 THEN 1 ELSE 0 END AS start FROM g WHERE bar < 6)
SELECT r.user_id, count(*) AS released, count(*) FILTER (r.start = g.bar * 8) AS equal, count(*) = count(*) FILTER (r.start = g.bar * 8) AS prefix FROM r LEFT JOIN g ON g.user_id IS NOT DISTINCT FROM r.user_id AND g.bar = r.bar GROUP BY 1""")
def bar_grid_prefix(spark, sf_dir):
    """The first six bars of each user against its grid; every fifth user's fourth bar begins one event late."""
    grid = _spans(frames(spark, sf_dir), 8)
    late = F.when((F.col("user_id") % 5 == 0) & (F.col("bar") == 3), 1).otherwise(0)
    return bars.same_grid(grid.filter("bar < 6").withColumn("start", F.col("start") + late), grid, "user_id", F.col("bar"))


@query(f"""WITH {RUNS}, p AS (SELECT user_id, start, stop, r, r * (stop - start - 1) / 7 AS pos FROM runs, range(8) t(r)),
v AS (SELECT p.user_id, p.start, stop, r, sum(f.value * (1 - abs(pos - (f.frame - p.start)))) AS v FROM p JOIN f ON f.user_id IS NOT DISTINCT FROM p.user_id AND f.frame BETWEEN p.start + floor(pos) AND p.start + ceil(pos) GROUP BY ALL)
SELECT user_id, start, stop AS "end", {', '.join(f"round(sum(v * cos(pi() * {k} * (r + 0.5) / 8)) * sqrt({2 if k else 1} / 8.0), 4) + 0.0 AS term_{k}" for k in range(3))}, round(ln(stop - start), 4) AS log_length FROM v GROUP BY 1, 2, 3""")
def run_shapes(spark, sf_dir):
    """Runs of events as vectors: three cosine terms of eight places of their values, and the logarithm of the length."""
    runs = label_runs(spark, sf_dir).select("user_id", "start", "end")
    got = bars.cosines(frames(spark, sf_dir), runs, "user_id", "frame", ["value"], 8, 3)
    return got.select("user_id", "start", "end", *[(F.round(F.col("shape")[k], 4) + 0.0).alias(f"term_{k}") for k in range(3)], F.round(F.col("shape")[3], 4).alias("log_length"))
