"""Queries over the event timelines: series, spans, windows, stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import folds, quantiles, ranks, segments, timeline
from larkspur.plans.registry import query
from larkspur.session import table

FRAMES = "f AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
RUNS = f"""{FRAMES}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS island FROM f),
runs AS (SELECT user_id, event_type, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS length, avg(value) AS mean FROM g GROUP BY user_id, event_type, island)"""
WINDOWED = f"""{FRAMES}, w AS (SELECT user_id, frame, event_type, value, unnest(range(greatest(0, ((frame - 8 + 4) // 4)), frame // 4 + 1)) * 4 AS start FROM f),
o AS (SELECT * FROM w WHERE start <= frame AND frame < start + 8),
v AS (SELECT user_id, start, event_type, count(*) AS votes FROM o GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, start ORDER BY votes DESC, event_type) AS k FROM v) WHERE k = 1)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return timeline.frames(events, "user_id", ["ts", "event_id"]).withColumn("frame", F.col("frame").cast("long"))


def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.runs(frames(spark, sf_dir), "user_id", "frame", "event_type")


#: Values as whole millionths, whose sums are exact in any order.
_MILLIONTHS = "round(value * 1000000)::BIGINT"


def _millionths(value: str):
    return F.round(F.col(value) * 1000000).cast("decimal(18,0)")


def count_if(condition: str):
    return F.sum(F.expr(condition).cast("long"))


@query(f"WITH {RUNS} SELECT user_id, count(*) AS runs, sum((length >= 2)::INT)::BIGINT AS runs_2, sum((length >= 3)::INT)::BIGINT AS runs_3, max(length) AS longest, round(median(length), 4) AS median_length FROM runs GROUP BY 1")
def run_shape(spark, sf_dir):
    return label_runs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), count_if("length >= 2").alias("runs_2"), count_if("length >= 3").alias("runs_3"), F.max("length").alias("longest"), F.round(F.percentile("length", 0.5), 4).alias("median_length"))


@query(f"WITH {FRAMES}, k AS (SELECT user_id, frame, n, unnest(range(-2, 3)) AS d FROM f) SELECT k.user_id, k.frame, round(avg(f.value), 5) AS smooth FROM k JOIN f ON f.user_id = k.user_id AND f.frame = least(greatest(k.frame + d, 0), k.n - 1) GROUP BY 1, 2")
def centered_mean(spark, sf_dir):
    return segments.padded_mean(frames(spark, sf_dir), "user_id", "frame", "value", 2).select("user_id", "frame", F.round("smooth", 5).alias("smooth"))


@query(f"WITH {FRAMES}, m AS (SELECT user_id, frame, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS middle FROM f) SELECT user_id, frame, round(middle, 5) AS middle, round(value / middle, 5) AS spike FROM m")
def rolling_median_spikes(spark, sf_dir):
    m = timeline.near(frames(spark, sf_dir), "user_id", "frame", 3, lambda w: {"middle": F.percentile("value", 0.5).over(w.rowsBetween(-3, 3))})
    return m.select("user_id", "frame", F.round("middle", 5).alias("middle"), F.round(F.try_divide("value", "middle"), 5).alias("spike"))


@query(f"""WITH {FRAMES}, a AS (SELECT user_id, frame, value - lag(value) OVER (PARTITION BY user_id ORDER BY frame) AS d1 FROM f), b AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY frame) AS d2 FROM a),
c AS (SELECT *, d2 - lag(d2) OVER (PARTITION BY user_id ORDER BY frame) AS d3 FROM b) SELECT user_id, round(avg(abs(d1)), 5) AS speed, round(avg(abs(d2)), 5) AS acceleration, round(avg(abs(d3)), 5) AS jerk FROM c GROUP BY 1""")
def motion_differences(spark, sf_dir):
    d = segments.differences(frames(spark, sf_dir), "user_id", "frame", "value", 3)
    return d.groupBy("user_id").agg(*[F.round(F.avg(F.abs(c)), 5).alias(n) for c, n in (("d1", "speed"), ("d2", "acceleration"), ("d3", "jerk"))])


@query(f"""WITH {FRAMES}, d AS (SELECT user_id, frame, abs(value - (lag(value) OVER (PARTITION BY user_id ORDER BY frame) + lead(value) OVER (PARTITION BY user_id ORDER BY frame)) / 2) AS off FROM f),
m AS (SELECT user_id, median(off) AS middle FROM d GROUP BY 1) SELECT user_id, frame, round(off, 5) AS off FROM d JOIN m USING (user_id) WHERE off > 3 * middle""")
def one_frame_outliers(spark, sf_dir):
    off = lambda w: F.abs(F.col("value") - (F.lag("value").over(w) + F.lead("value").over(w)) / 2)
    d = timeline.near(frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"off": off(w)})
    middle = quantiles.linear(d, "user_id", "off", {"middle": 0.5})
    return d.join(middle, "user_id").filter("off > 3 * middle").select("user_id", "frame", F.round("off", 5).alias("off"))


_MINIMA = f"""{FRAMES}, l AS (SELECT user_id, frame, value, lag(value) OVER (PARTITION BY user_id ORDER BY frame) AS p, lead(value) OVER (PARTITION BY user_id ORDER BY frame) AS q, avg(value) OVER (PARTITION BY user_id) AS mu FROM f),
lows AS (SELECT user_id, frame, value FROM l WHERE value < p AND value <= q AND value <= 0.98 * mu)"""


def _lows(spark, sf_dir):
    return segments.minima(frames(spark, sf_dir), "user_id", "frame", "value", 0.98)


@query(f"""WITH {_MINIMA}, c AS (SELECT user_id, list(frame ORDER BY value, frame) AS fs FROM lows GROUP BY 1),
t AS (SELECT user_id, list_reduce(list_transform(fs, lambda x: [x]), lambda a, x: CASE WHEN len(a) < 4 AND len(list_filter(a, lambda k: abs(k - x[1]) < 6)) = 0 THEN list_concat(a, x) ELSE a END) AS taken FROM c)
SELECT user_id, unnest(taken) AS frame FROM t""")
def prominent_minima(spark, sf_dir):
    return segments.apart(_lows(spark, sf_dir), "user_id", "frame", "value", 6, 4)


@query(f"""WITH {_MINIMA}, c AS (SELECT user_id, list({{'f': frame, 'v': value}} ORDER BY frame) AS p FROM lows GROUP BY 1),
t AS (SELECT user_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN x[1].f - a[-1].f >= 4 THEN list_concat(a, x) WHEN x[1].v < a[-1].v THEN list_concat(a[:-2], x) ELSE a END) AS kept FROM c),
u AS (SELECT user_id, unnest(kept) AS k FROM t) SELECT user_id, k.f AS frame, k.v AS value FROM u""")
def accent_minima(spark, sf_dir):
    return segments.merged_points(_lows(spark, sf_dir), "user_id", "frame", "value", 4)


@query(f"WITH {FRAMES} SELECT a.user_id, a.frame, b.value AS shifted FROM f a JOIN f b ON a.user_id = b.user_id AND b.frame = (a.frame + 5) % a.n")
def circular_shift(spark, sf_dir):
    f = frames(spark, sf_dir)
    f = f.join(f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
    moved = f.select("user_id", F.pmod(F.col("frame") - 5, F.col("n")).alias("frame"), F.col("value").alias("shifted"))
    return moved


@query(f"""WITH {FRAMES}, r AS (SELECT user_id, frame, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS rk, (rank() OVER (PARTITION BY user_id ORDER BY value) - 1) / n AS below FROM f)
SELECT user_id, round(corr(rk, frame), 5) AS spearman, round(max(below), 5) AS top_position FROM r GROUP BY 1 HAVING count(*) >= 3""")
def spearman_per_sequence(spark, sf_dir):
    f = frames(spark, sf_dir)
    r = f.join(quantiles.counted(f, "user_id", "value").drop("n"), ["user_id", "value"]).withColumn("rk", F.col("upto") - (F.col("same") - 1) / 2.0)
    n = F.count(F.lit(1))
    return r.groupBy("user_id").agg(n.alias("n"), F.round(F.corr("rk", F.col("frame").cast("double")), 5).alias("spearman"), F.round(F.max(F.col("upto") - F.col("same")) / n, 5).alias("top_position")).filter("n >= 3").drop("n")


@query(f"""WITH {FRAMES}, g AS (SELECT user_id, frame, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY frame)) / 1e6 AS s FROM f), l AS (SELECT *, abs(ln(s) - lag(ln(s)) OVER (PARTITION BY user_id ORDER BY frame)) AS step FROM g WHERE s > 0)
SELECT user_id, round(stddev_pop(ln(s)), 5) AS spread, round(max(s) / min(s), 3) AS widest, round(avg(step), 5) AS mean_step, round(max(step), 5) AS max_step FROM l GROUP BY 1 HAVING count(*) >= 2""")
def stretch_spread(spark, sf_dir):
    """A step is from the last earlier gap that is not none."""
    g = timeline.near(frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"s": (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6})
    gap = F.when(F.col("s") > 0, F.struct("frame", "s"))
    g = timeline.running(g, "user_id", timeline.block_of("frame"), "frame", {"last": ("max", gap)})
    g = timeline.near(g, "user_id", "frame", 1, lambda w: {"before": F.lag("last").over(w)})
    steps = g.filter("s > 0").withColumn("step", F.abs(F.log("s") - F.log("before.s")))
    out = steps.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop(F.log("s")), 5).alias("spread"), F.round(F.max("s") / F.min("s"), 3).alias("widest"), F.round(F.avg("step"), 5).alias("mean_step"), F.round(F.max("step"), 5).alias("max_step"))
    return out.filter("n >= 2").drop("n")


@query(f"""WITH {FRAMES}, b AS (SELECT *, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS seam FROM f), k AS (SELECT *, max(CASE WHEN seam THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM b),
s AS (SELECT user_id, sum(CASE WHEN near = 1 THEN {_MILLIONTHS} END) * count(CASE WHEN near = 0 THEN value END) AS a, sum(CASE WHEN near = 0 THEN {_MILLIONTHS} END) * count(CASE WHEN near = 1 THEN value END) AS b FROM k GROUP BY 1)
SELECT user_id, CASE WHEN b <> 0 THEN sign(a) * sign(b) * ((200000 * abs(a) + abs(b)) // (2 * abs(b))) / 100000 END AS ratio FROM s""")
def seam_ratio(spark, sf_dir):
    """The mean value within a frame of a change of type over the mean of the others: a fraction
    of whole millionths, halves rounded away from zero, so no order of the sums and no engine's rounding decides."""
    f = frames(spark, sf_dir)
    b = timeline.near(f, "user_id", "frame", 1, lambda w: {"seam": F.when(F.col("event_type") != F.lag("event_type").over(w), 1).otherwise(0)})
    k = timeline.near(b, "user_id", "frame", 1, lambda w: {"near": F.max("seam").over(w.rowsBetween(-1, 1))})
    side = lambda near, x: F.when(F.col("near") == near, x)
    sums = k.groupBy("user_id").agg(*[c.alias(f"{name}{near}") for near in (0, 1) for name, c in (("s", F.sum(side(near, _millionths("value")))), ("n", F.count(side(near, F.col("value"))).cast("decimal(10,0)")))])
    a, b = F.col("s1") * F.col("n0"), F.col("s0") * F.col("n1")
    parts = sums.select("user_id", F.signum(a.cast("double") * F.signum(b.cast("double"))).alias("sign"), F.abs(a).cast("decimal(32,0)").alias("a"), F.abs(b).cast("decimal(36,0)").alias("b")).withColumn("b", F.nullif("b", F.lit(0).cast("decimal(36,0)")))
    return parts.select("user_id", (F.col("sign") * F.expr("(200000 * a + b) div (2 * b)") / 100000).alias("ratio"))


@query("""WITH q AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), b AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
d AS (SELECT q.user_id, q.event_id, least(q.t - p.t, n.t - q.t) AS distance FROM q ASOF LEFT JOIN b p ON q.user_id = p.user_id AND q.t >= p.t ASOF LEFT JOIN b n ON q.user_id = n.user_id AND q.t <= n.t)
SELECT user_id, event_id FROM d WHERE coalesce(distance > 3600000000, true)""")
def guarded_events(spark, sf_dir):
    is_type = lambda x: F.col("event_type") == x
    near = timeline.nearest_events(frames(spark, sf_dir), "user_id", F.unix_micros("ts"), is_type("purchase"), is_type("click"), "event_id")
    return near.filter("distance is null or distance > 3600000000").select("user_id", "event_id")


@query(f"""WITH {RUNS}, s AS (SELECT user_id, unnest(range(0, n - 1, 3)) AS start FROM (SELECT DISTINCT user_id, n FROM f) WHERE n > 1), k AS (SELECT s.user_id, s.start, r.start AS run_start, r.stop AS run_stop FROM s ASOF LEFT JOIN runs r ON s.user_id = r.user_id AND s.start >= r.start)
SELECT user_id, start, run_start AS span_start, CASE WHEN run_stop IS NULL THEN 'absent' WHEN start + 2 <= run_stop THEN 'inside' ELSE 'crosses a boundary' END AS verdict FROM k""")
def spans_within_runs(spark, sf_dir):
    lengths = frames(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spans = lengths.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2, F.lit(3).cast("long"))).alias("start"))
    found = segments.located(spans, label_runs(spark, sf_dir), "user_id", "start", [])
    verdict = F.when(F.col("span_end").isNull(), "absent").when(F.col("start") + 2 <= F.col("span_end"), "inside").otherwise("crosses a boundary")
    return found.select("user_id", "start", F.col("span_start").cast("long").alias("span_start"), verdict.alias("verdict"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id, unnest(list_distinct(list_append(range(0, n - 15, 12), n - 16))) AS start FROM n WHERE n >= 16) SELECT user_id, start, start + 16 AS "end" FROM w""")
def snapped_windows(spark, sf_dir):
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return segments.snapped_windows(lengths, "user_id", "n", 16, 12)


def _windowed(spark, sf_dir):
    return timeline.in_windows(frames(spark, sf_dir), "frame", 8, 4)


@query(f"""WITH {WINDOWED}, s AS (SELECT o.user_id, o.frame, m.start, m.event_type FROM o JOIN m USING (user_id, start))
SELECT user_id, frame, arg_min(event_type, start) AS event_type, count(*) AS writers, min(event_type) <> max(event_type) AS conflict FROM s GROUP BY 1, 2""")
def stitched_labels(spark, sf_dir):
    shown = _windowed(spark, sf_dir)
    labels = ranks.majority(shown, ["user_id", "start"], "event_type").drop("votes")
    return segments.stitched(shown.select("user_id", "frame", "start").join(labels, ["user_id", "start"]), "user_id", "frame", "start", "event_type")


@query(f"""WITH {WINDOWED}, a AS (SELECT user_id, start, avg(value) AS mean FROM o GROUP BY 1, 2), s AS (SELECT o.user_id, o.frame, mean, 4.5 - abs(o.frame - start - 3.5) AS w FROM o JOIN a USING (user_id, start))
SELECT user_id, frame, round(sum(mean * w) / sum(w), 5) AS blend FROM s GROUP BY 1, 2""")
def overlap_add(spark, sf_dir):
    shown = _windowed(spark, sf_dir)
    means = shown.groupBy("user_id", "start").agg(F.avg("value").alias("mean"))
    weight = 4.5 - F.abs(F.col("frame") - F.col("start") - 3.5)
    return segments.blended(shown.select("user_id", "frame", "start").join(means, ["user_id", "start"]), "user_id", "frame", "mean", weight).withColumn("blend", F.round("blend", 5))


@query(f"""WITH {WINDOWED}, s AS (SELECT o.user_id, o.frame, m.event_type, count(*) AS votes FROM o JOIN m USING (user_id, start) GROUP BY ALL)
SELECT user_id, frame, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, frame ORDER BY votes DESC, event_type) AS r FROM s) WHERE r = 1""")
def window_vote_fusion(spark, sf_dir):
    shown = _windowed(spark, sf_dir)
    labels = ranks.majority(shown, ["user_id", "start"], "event_type").drop("votes")
    return ranks.majority(shown.select("user_id", "frame", "start").join(labels, ["user_id", "start"]), ["user_id", "frame"], "event_type").drop("votes")


@query(f"""WITH {RUNS} SELECT user_id, sum((start % 4 <> 0)::INT)::BIGINT AS off_grid, sum((length % 4 <> 0)::INT)::BIGINT AS off_length, sum((start // 8 <> (stop - 1) // 8)::INT)::BIGINT AS crossing FROM runs GROUP BY 1""")
def grid_invariants(spark, sf_dir):
    return label_runs(spark, sf_dir).groupBy("user_id").agg(count_if("start % 4 <> 0").alias("off_grid"), count_if("length % 4 <> 0").alias("off_length"), count_if("start div 8 <> (end - 1) div 8").alias("crossing"))


@query(f"""WITH {FRAMES}, b AS (SELECT user_id, frame // 8 AS bar, count(*) AS frames, count(DISTINCT event_type) AS labels FROM f GROUP BY 1, 2)
SELECT user_id, count(*) AS bars, sum((frames = 8)::INT)::BIGINT AS covered, sum((labels > 1)::INT)::BIGINT AS mixed, max(CASE WHEN frames = 8 THEN bar END) + 1 IS NOT DISTINCT FROM nullif(sum((frames = 8)::INT), 0) AS prefix FROM b GROUP BY 1""")
def bar_coverage(spark, sf_dir):
    b = frames(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame") / 8).alias("bar")).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("event_type").alias("labels"))
    covered = count_if("frames = 8")
    prefix = (F.max(F.when(F.col("frames") == 8, F.col("bar"))) + 1).eqNullSafe(F.nullif(covered, F.lit(0)))
    return b.groupBy("user_id").agg(F.count(F.lit(1)).alias("bars"), covered.alias("covered"), count_if("labels > 1").alias("mixed"), prefix.alias("prefix"))


@query(f"WITH {FRAMES} SELECT user_id, frame // 8 AS bar, frame % 8 // 2 AS bin, round(avg(value), 5) AS mean FROM f GROUP BY 1, 2, 3")
def bar_bins(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame") / 8).alias("bar"), F.floor(F.col("frame") % 8 / 2).alias("bin")).agg(F.round(F.avg("value"), 5).alias("mean"))


@query(f"""WITH {RUNS}, b AS (SELECT user_id, start AS pos FROM runs UNION SELECT user_id, unnest(range(0, n, 8)) FROM (SELECT DISTINCT user_id, n FROM f)), n AS (SELECT DISTINCT user_id, n FROM f)
SELECT user_id, pos AS start, lead(pos, 1, n) OVER (PARTITION BY user_id ORDER BY pos) AS "end" FROM b JOIN n USING (user_id)""")
def runs_cut_at_bars(spark, sf_dir):
    """The next cut is at most a bar ahead, and so is the end of a sequence after its last one."""
    turn = lambda w: (F.col("frame") % 8 == 0) | ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))
    f = timeline.near(frames(spark, sf_dir), "user_id", "frame", 8, lambda w: {"cut": turn(w), "stop": F.max("frame").over(w.rowsBetween(0, 7)) + 1})
    cuts = timeline.near(f.filter("cut"), "user_id", "frame", 8, lambda w: {"next": F.lead("frame").over(w)})
    return cuts.select("user_id", F.col("frame").alias("start"), F.coalesce("next", "stop").alias("end"))


@query(f"""WITH {FRAMES}, b AS (SELECT user_id, frame // 4 AS bar, string_agg(event_type, ',' ORDER BY frame) AS content FROM f GROUP BY 1, 2 HAVING count(*) = 4), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, content ORDER BY bar) AS nth FROM b)
SELECT user_id, count(*) AS bars, sum((nth > 1)::INT)::BIGINT AS repeats, count(DISTINCT content) AS contents FROM k GROUP BY 1""")
def repeated_bars(spark, sf_dir):
    b = frames(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame") / 4).alias("bar")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "event_type"))), lambda x: x["event_type"]), ",").alias("content")).filter("n = 4")
    each = b.groupBy("user_id", "content").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("user_id").agg(F.sum("k").alias("bars"), F.sum(F.col("k") - 1).alias("repeats"), F.count(F.lit(1)).alias("contents"))


@query(f"""WITH {FRAMES}, m AS (SELECT user_id, median(value) AS mid, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.1) AS p10 FROM f GROUP BY 1)
SELECT user_id, round(avg((value < 0.25 * mid)::INT), 5) AS held, round(avg((value > 2 * mid)::INT), 5) AS burst, round(max(p90 / p10), 4) AS spread FROM f JOIN m USING (user_id) WHERE mid > 1e-4 AND p10 > 0 GROUP BY 1""")
def hold_and_burst(spark, sf_dir):
    f = frames(spark, sf_dir)
    m = quantiles.linear(f, "user_id", "value", {"p10": 0.1, "mid": 0.5, "p90": 0.9}).filter("mid > 1e-4 and p10 > 0")
    share = lambda c: F.round(F.avg(F.expr(c).cast("int")), 5)
    return f.join(m, "user_id").groupBy("user_id").agg(share("value < 0.25 * mid").alias("held"), share("value > 2 * mid").alias("burst"), F.round(F.max(F.expr("p90 / p10")), 4).alias("spread"))


@query(f"""WITH {FRAMES}, k AS (SELECT user_id, frame, CASE WHEN event_type <> 'error' THEN value END AS v FROM f), a AS (SELECT k.user_id, k.frame, k.v, p.frame AS pf, p.v AS pv, q.frame AS qf, q.v AS qv FROM k ASOF LEFT JOIN (SELECT * FROM k WHERE v IS NOT NULL) p ON k.user_id = p.user_id AND k.frame >= p.frame
ASOF LEFT JOIN (SELECT * FROM k WHERE v IS NOT NULL) q ON k.user_id = q.user_id AND k.frame <= q.frame)
SELECT user_id, frame, round(CASE WHEN v IS NOT NULL THEN v ELSE pv + (qv - pv) * (frame - pf) / (qf - pf) END, 5) AS filled FROM a""")
def gaps_filled(spark, sf_dir):
    known = F.when(F.col("event_type") != "error", F.struct("frame", "value"))
    block = timeline.block_of("frame")
    a = frames(spark, sf_dir).withColumn("k", known)
    a = timeline.running(a, "user_id", block, "frame", {"p": ("max", F.col("k"))})
    a = timeline.running(a, "user_id", block, "frame", {"q": ("min", F.col("k"))}, downward=True)
    between = F.col("p.value") + (F.col("q.value") - F.col("p.value")) * (F.col("frame") - F.col("p.frame")) / F.nullif(F.col("q.frame") - F.col("p.frame"), F.lit(0))
    return a.select("user_id", "frame", F.round(F.coalesce(F.col("k.value"), between), 5).alias("filled"))


@query(f"""WITH {FRAMES}, m AS (SELECT user_id, event_id, event_type, frame, n, min(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS trough, max(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS peak FROM f)
SELECT user_id, event_id, trough, peak FROM m WHERE event_type = 'click' AND frame >= 2 AND frame < n - 2""")
def trough_and_peak(spark, sf_dir):
    around = lambda w: {"after": F.count(F.lit(1)).over(w.rowsBetween(1, 2)), "trough": F.min("value").over(w.rowsBetween(-2, 2)), "peak": F.max("value").over(w.rowsBetween(-2, 0))}
    m = timeline.near(frames(spark, sf_dir), "user_id", "frame", 2, around)
    return m.filter("event_type = 'click' and frame >= 2 and after = 2").select("user_id", "event_id", "trough", "peak")


@query(f"""WITH {RUNS}, e AS (SELECT user_id, min(frame) AS start, max(frame) + 1 AS stop, sum({_MILLIONTHS}) AS s, count(value)::HUGEINT AS m FROM g GROUP BY user_id, event_type, island),
d AS (SELECT *, CASE WHEN abs(s * lag(m) OVER w - lag(s) OVER w * m) < 5000000 * m * lag(m) OVER w THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY start)), k AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY start) AS part FROM d)
SELECT user_id, min(start) AS start, max(stop) AS "end", count(*) AS runs FROM k GROUP BY user_id, part""")
def boundaries_dropped(spark, sf_dir):
    """Neighbouring runs whose means differ by less than 5 are one. Means are compared as
    fractions of whole millionths, so no order of the sums decides a difference of 5."""
    fresh = lambda w: F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(w)), 0).otherwise(1)
    f = timeline.near(frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"new": fresh(w)})
    f = timeline.running(f, "user_id", timeline.block_of("frame"), "frame", {"run": ("sum", F.col("new"))})
    runs = f.groupBy("user_id", "run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.sum(_millionths("value")).alias("s"), F.count("value").cast("decimal(10,0)").alias("m"))
    apart = lambda w: F.abs(F.col("s") * F.lag("m").over(w) - F.lag("s").over(w) * F.col("m"))
    k = timeline.near(runs, "user_id", "run", 1, lambda w: {"cut": F.when((F.lag("m").over(w) > 0) & (F.col("m") > 0) & (apart(w) < F.lit(5_000_000) * F.col("m") * F.lag("m").over(w)), 0).otherwise(1)})
    k = timeline.running(k, "user_id", timeline.block_of("run"), "run", {"part": ("sum", F.col("cut"))})
    return k.groupBy("user_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("runs")).drop("part")


@query(f"""WITH {FRAMES}, s AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS nxt, abs(lead(value) OVER (PARTITION BY user_id ORDER BY frame) - value) AS step FROM f)
SELECT CASE WHEN event_type = 'view' AND nxt = 'view' THEN 'filler' WHEN event_type = 'view' OR nxt = 'view' THEN 'crossing' ELSE 'named' END AS kind, count(*) AS n, round(avg(step), 5) AS mean_step FROM s WHERE nxt IS NOT NULL GROUP BY 1""")
def steps_by_ends(spark, sf_dir):
    s = timeline.near(frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"nxt": F.lead("event_type").over(w), "step": F.abs(F.lead("value").over(w) - F.col("value"))}).filter("nxt is not null")
    kind = F.expr("case when event_type = 'view' and nxt = 'view' then 'filler' when event_type = 'view' or nxt = 'view' then 'crossing' else 'named' end")
    return s.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("step"), 5).alias("mean_step"))


@query(f"""WITH {FRAMES}, l AS (SELECT user_id, frame, value AS x, unnest(range(0, 6)) AS lag FROM f), p AS (SELECT l.user_id, l.lag, corr(l.x, f.value) AS r, count(*) AS n FROM l JOIN f ON f.user_id = l.user_id AND f.frame = l.frame + l.lag GROUP BY 1, 2)
SELECT user_id, lag::INT AS lag, round(r, 5) AS r, n FROM p WHERE n >= 20 AND lag > 0""")
def autocorrelation(spark, sf_dir):
    r = segments.lagged_correlation(frames(spark, sf_dir), "user_id", "frame", "value", "value", 5, 20)
    return r.filter("lag > 0").select("user_id", "lag", F.round("r", 5).alias("r"), "n")


@query(f"""WITH {FRAMES}, y AS (SELECT user_id, frame, value AS x, lag(value) OVER (PARTITION BY user_id ORDER BY frame) AS y FROM f), l AS (SELECT user_id, frame, x, unnest(range(0, 6)) AS lag FROM y), p AS (SELECT l.user_id, l.lag, round(corr(l.x, y.y), 5) AS r, count(*) AS n FROM l JOIN y ON y.user_id = l.user_id AND y.frame = l.frame + l.lag WHERE y.y IS NOT NULL GROUP BY 1, 2)
SELECT user_id, lag::INT AS lag, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, lag) AS k FROM p WHERE n >= 20) WHERE k = 1""")
def best_lag(spark, sf_dir):
    both = timeline.near(frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"y": F.lag("value").over(w)})
    r = segments.lagged_correlation(both, "user_id", "frame", "value", "y", 5, 20).withColumn("r", F.round("r", 5))
    return ranks.first_rows(r, ["user_id"], [F.desc("r"), F.asc("lag")]).select("user_id", "lag", "r")


@query("""WITH a AS (SELECT event_type, 2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000.0 AS phase FROM events) SELECT event_type, count(*) AS n, round(sqrt(avg(cos(phase)) ** 2 + avg(sin(phase)) ** 2), 6) AS resultant, round(atan2(avg(sin(phase)), avg(cos(phase))), 5) AS preferred FROM a GROUP BY 1""")
def phase_resultant(spark, sf_dir):
    phase = F.unix_micros(F.col("ts").cast("timestamp")) % 86_400_000_000 / 86_400_000_000.0 * (2 * F.pi())
    c, s = F.avg(F.cos(phase)), F.avg(F.sin(phase))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(c * c + s * s), 6).alias("resultant"), F.round(F.atan2(s, c), 5).alias("preferred"))


_VALUES = f"{FRAMES}, l AS (SELECT user_id, list(value ORDER BY frame) AS v FROM f GROUP BY 1)"


def _arrays(spark, sf_dir):
    values = F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"])
    return frames(spark, sf_dir).groupBy("user_id").agg(values.alias("v"))


@query(f"""WITH {_VALUES}, p AS (SELECT user_id, v, unnest(range(0, 8)) AS i FROM l), q AS (SELECT *, i * (len(v) - 1) / 7.0 AS place FROM p), r AS (SELECT *, floor(place)::BIGINT AS lo FROM q)
SELECT user_id, i::INT AS i, round(v[lo + 1] * (1 - (place - lo)) + v[least(lo + 1, len(v) - 1) + 1] * (place - lo), 5) AS x FROM r""")
def linear_resample(spark, sf_dir):
    return _arrays(spark, sf_dir).select("user_id", F.posexplode(segments.resampled(F.col("v"), 8)).alias("i", "x")).withColumn("x", F.round("x", 5))


@query("""WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS v, count(*) AS n FROM conversations GROUP BY 1), i AS (SELECT conv_id, v, n, unnest(range(0, 6)) AS i FROM l) SELECT conv_id, string_agg(v[i % n + 1], ',' ORDER BY i) AS tiled, greatest(6 - max(n), 0) AS added FROM i GROUP BY 1""")
def tiled_turns(spark, sf_dir):
    v = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    l = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(v.alias("v"))  # noqa: E741
    return l.select("conv_id", F.array_join(segments.tiled(F.col("v"), 6), ",").alias("tiled"), F.greatest(6 - F.size("v"), F.lit(0)).cast("long").alias("added"))


@query("""WITH c AS (SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations) SELECT conv_id, count(*) AS turns, min(turn) = 0 AND max(turn) = count(*) - 1 AS complete, coalesce(sum((step <= 0)::INT), 0)::BIGINT AS repeats, coalesce(sum((step > 1)::INT), 0)::BIGINT AS gaps FROM c GROUP BY 1""")
def frame_id_validation(spark, sf_dir):
    c = timeline.frames(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])
    c = timeline.near(c, "conv_id", "frame", 1, lambda w: {"step": F.col("turn") - F.lag("turn").over(w)})
    counted = lambda x: F.coalesce(count_if(x), F.lit(0))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), ((F.min("turn") == 0) & (F.max("turn") == F.count(F.lit(1)) - 1)).alias("complete"), counted("step <= 0").alias("repeats"), counted("step > 1").alias("gaps"))


@query(f"WITH {FRAMES}, n AS (SELECT DISTINCT user_id, n FROM f WHERE n >= 12) SELECT user_id, unnest(range(0, n // 12)) AS clip, unnest(range(0, n // 12)) * 12 AS start, unnest(range(0, n // 12)) * 12 + 12 AS \"end\" FROM n")
def whole_clips(spark, sf_dir):
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12")
    clips = lengths.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("n div 12 - 1"))).alias("clip"))
    return clips.withColumn("start", F.col("clip") * 12).withColumn("end", F.col("start") + 12)


@query(f"WITH {FRAMES}, s AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS deviation FROM f GROUP BY 1) SELECT user_id, frame // 16 AS bar, round(avg(value), 7) AS local_mean, round(any_value(mean), 5) AS mean, round(any_value(deviation), 5) AS deviation FROM f JOIN s USING (user_id) GROUP BY 1, 2")
def sequence_moments_by_window(spark, sf_dir):
    f = frames(spark, sf_dir)
    s = f.groupBy("user_id").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("deviation"))
    return f.groupBy("user_id", F.floor(F.col("frame") / 16).alias("bar")).agg(F.round(F.avg("value"), 7).alias("local_mean")).join(s, "user_id")


@query()
def short_runs_merged(spark, sf_dir):
    """A fold in which each merge depends on those before; held against planted cases."""
    return segments.merged_short(label_runs(spark, sf_dir), "user_id", "event_type", 2)


# --- left-to-right rules -----------------------------------------------------

_SNAP = f"""{RUNS}, u AS (SELECT user_id, unnest([0, max(stop)]) AS cut FROM runs GROUP BY 1 UNION SELECT user_id, start FROM runs),
z AS (SELECT user_id, (cut // 6) * 6 AS cut, max(cut) OVER (PARTITION BY user_id) AS last FROM u), b AS (SELECT DISTINCT user_id, cut, last FROM z WHERE cut = 0 OR last - cut >= 3 UNION SELECT user_id, last, last FROM z WHERE last >= 3),
c AS (SELECT *, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY cut)),
t AS (SELECT DISTINCT user_id, frame AS beat, {{0}} AS weight FROM f WHERE event_type = 'error'),
k AS (SELECT c.user_id, nth, n, c.cut, last, list({{{{'b': beat, 'w': weight}}}} ORDER BY beat) FILTER (beat IS NOT NULL) AS near FROM c LEFT JOIN t ON t.user_id = c.user_id AND abs(beat - c.cut) <= 4 GROUP BY ALL),
w AS (SELECT user_id, nth, cut, cut AS snapped, true AS legal FROM k WHERE nth = 0 UNION ALL
SELECT user_id, nth, cut, CASE WHEN nth = n - 1 THEN cut WHEN best IS NOT NULL THEN best.b WHEN high < low THEN greatest(cut, prev + 3) ELSE least(greatest(cut, low), high) END, nth = n - 1 OR best IS NOT NULL FROM (
SELECT *, list_sort(list_transform(list_filter(near, lambda x: x.b >= low AND x.b <= high), lambda x: {{{{'w': -x.w, 'd': abs(x.b - cut), 'b': x.b}}}}))[1] AS best FROM (
SELECT k.*, w.snapped AS prev, greatest(w.snapped + 3, k.cut - 4) AS low, least(last - (n - 1 - k.nth) * 3, k.cut + 4) AS high FROM w JOIN k ON k.user_id = w.user_id AND k.nth = w.nth + 1)))
SELECT user_id, nth, cut, snapped, legal AND snapped <> cut AS moved, legal FROM w"""


def _snapped(spark, sf_dir, weight=None):
    f = frames(spark, sf_dir)
    runs = label_runs(spark, sf_dir)
    ends = runs.groupBy("user_id").agg(F.max("end").alias("last"))
    grid = runs.join(ends, "user_id").select("user_id", (F.floor(F.col("start") / 6) * 6).alias("frame"), "last")
    grid = grid.union(ends.select("user_id", (F.floor(F.col("last") / 6) * 6).alias("frame"), "last"))
    inner = grid.filter("frame = 0 or last - frame >= 3").select("user_id", "frame").union(ends.filter("last >= 3").select("user_id", F.col("last").alias("frame"))).distinct()
    beats = f.filter("event_type = 'error'").select("user_id", "frame", (F.col("event_id") % 3).alias("weight"))
    return folds.snap_cuts(inner, beats, "user_id", "frame", 4, 3, weight)


@query("WITH RECURSIVE " + _SNAP.format("0"))
def snapped_cuts(spark, sf_dir):
    """Boundaries on a grid of six frames move to the nearest error within four frames, three frames apart at least."""
    return _snapped(spark, sf_dir)


@query("WITH RECURSIVE " + _SNAP.format("event_id % 3"))
def snapped_cuts_by_weight(spark, sf_dir):
    """The same, to the errors of most weight within reach."""
    return _snapped(spark, sf_dir, "weight")


@query(f"""WITH RECURSIVE {RUNS}, s AS (SELECT user_id, start, stop, length, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS nth FROM runs),
c AS (SELECT user_id, nth, k, (start + 7 * k) % 11 AS head, (length + k) % 5 AS hv, (stop * 3 + k) % 11 AS tail, (length * 2 + k) % 5 AS tv FROM s, range(0, 4) t(k)),
w AS (SELECT user_id, nth, k AS chosen, NULL::DOUBLE AS cost, tail, tv FROM c WHERE nth = 0 AND k = 0
UNION ALL (SELECT user_id, nth, k, cost, tail, tv FROM (SELECT c.*, round(abs(w.tail + w.tv - c.head)::DOUBLE + abs(w.tv - c.hv)::DOUBLE, 9) AS cost FROM w JOIN c ON c.user_id = w.user_id AND c.nth = w.nth + 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cost, k) = 1))
SELECT user_id, nth, chosen, round(cost, 6) AS cost FROM w""")
def seam_path(spark, sf_dir):
    """Each run as a slot with four variants of its ends as candidates; each choice joins best to the one before."""
    runs = label_runs(spark, sf_dir)
    number = lambda x: F.array(x.cast("double"))
    one = lambda k: F.struct(F.lit(k).alias("id"), number((F.col("start") + 7 * k) % 11).alias("head"), number((F.col("length") + k) % 5).alias("head_velocity"), number((F.col("end") * 3 + k) % 11).alias("tail"), number((F.col("length") * 2 + k) % 5).alias("tail_velocity"))
    slots = runs.select("user_id", (F.col("run") - 1).alias("nth"), F.array(*map(one, range(4))).alias("pool"))
    got = folds.seam_path(slots, "user_id", "nth", "pool", 4)
    return got.select("user_id", "nth", F.col("chosen").cast("long").alias("chosen"), F.round("cost", 6).alias("cost"))
