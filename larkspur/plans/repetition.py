"""Queries about what returns within a sequence: votes, novelty, recurrence, contrast."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import ranks, recurrence, selfsimilarity
from larkspur.plans.registry import query
from larkspur.plans.segments import FRAMES, frames, label_runs
from larkspur.session import table

_VOTES = f"""{FRAMES}, v AS (SELECT user_id, frame // 3 AS w, (event_id * 7) % 40 AS p, 95 + event_id % 11 AS r, value AS s, frame FROM f),
b AS (SELECT user_id, w, p, r, max(s) AS s FROM v WHERE s >= 2 GROUP BY ALL)"""


@query(f"""WITH {_VOTES}, a AS (SELECT DISTINCT user_id, p AS p0, r AS r0 FROM b),
k AS (SELECT b.user_id, p0, r0, w, p, r, s FROM a JOIN b ON a.user_id IS NOT DISTINCT FROM b.user_id AND abs(p - p0) <= 4 AND abs(r - r0) <= 1 QUALIFY row_number() OVER (PARTITION BY b.user_id, p0, r0, w ORDER BY s DESC, p, r) = 1),
g AS (SELECT user_id, p0, r0, count(*) AS n, round(sum(s), 9) AS total, median(p) AS place, median(r) AS rate, min(w) AS lo, max(w) AS hi FROM k GROUP BY ALL),
x AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, total DESC, p0, r0) = 1),
e AS (SELECT user_id, max(w) AS hi FROM v GROUP BY 1)
SELECT e.user_id, coalesce(n, 0) AS n_agree, place, rate, round(total / n, 5) AS mean_score, lo AS first_window, x.hi AS last_window, coalesce(x.hi = e.hi, false) AS covers_end FROM e LEFT JOIN x ON e.user_id IS NOT DISTINCT FROM x.user_id""")
def window_agreement(spark, sf_dir):
    """Each user's largest set of windows that agree on a place and a rate; windows are three events, each a vote."""
    votes = frames(spark, sf_dir).select("user_id", F.floor(F.col("frame") / 3).alias("w"), (F.col("event_id") * 7 % 40).alias("p"), (95 + F.col("event_id") % 11).alias("r"), F.col("value").alias("s"))
    got = recurrence.agreement(votes, "user_id", "w", "p", "r", "s", 2, 4, 1)
    return got.withColumn("mean_score", F.round("mean_score", 5))


@query(f"""WITH {FRAMES}, w AS (SELECT user_id, frame AS pos, list(value) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x, n FROM f),
v AS (SELECT user_id, pos, x FROM w WHERE len(x) = 4 AND pos % 2 = 0),
d AS (SELECT a.user_id, a.pos, round(list_distance(a.x, b.x), 6) AS d FROM v a JOIN v b ON a.user_id IS NOT DISTINCT FROM b.user_id AND abs(a.pos - b.pos) >= 12),
m AS (SELECT user_id, pos, min(d) AS least, sum(d) AS total, count(*) AS k FROM d GROUP BY ALL),
u AS (SELECT user_id, median(least) AS middle, sum(total) / sum(k) AS scale, count(*) AS usable FROM m GROUP BY 1),
s AS (SELECT user_id, any_value(n) AS n FROM f GROUP BY 1), k AS (SELECT user_id, count(*) AS windows FROM v GROUP BY 1)
SELECT s.user_id, coalesce(windows, 0) AS windows, CASE WHEN n >= 8 AND windows >= 4 AND usable >= 2 AND scale > 0 THEN round(middle / scale, 5) END AS novelty
FROM s LEFT JOIN k ON s.user_id IS NOT DISTINCT FROM k.user_id LEFT JOIN u ON s.user_id IS NOT DISTINCT FROM u.user_id""")
def sequence_novelty(spark, sf_dir):
    """How far each user's windows of four events are from the nearest one at least twelve events away."""
    got = recurrence.novelty(frames(spark, sf_dir), "user_id", "frame", "value", 4, 2, 12)
    return got.select("user_id", "windows", F.round("novelty", 5).alias("novelty"))


@query(f"""WITH {FRAMES}, d AS (SELECT a.user_id, a.frame AS i, b.frame AS j, a.event_type = 'purchase' AS event, round(abs(a.value - b.value), 6) AS d FROM f a JOIN f b ON a.user_id IS NOT DISTINCT FROM b.user_id),
e AS (SELECT user_id, quantile_cont(d, 0.1) FILTER (i < j) AS eps FROM d GROUP BY 1)
SELECT d.user_id, i AS frame, round(coalesce(count(*) FILTER (abs(i - j) > 15 AND d < eps) / nullif(count(*) FILTER (abs(i - j) > 15), 0), 0), 6) AS recurrence
FROM d JOIN e ON d.user_id IS NOT DISTINCT FROM e.user_id WHERE event GROUP BY 1, 2""")
def event_recurrence(spark, sf_dir):
    """How often a purchase's value returns more than 15 events away, within the tenth-part quantile of all distances of the user's events."""
    f = frames(spark, sf_dir).select("user_id", "frame", F.array("value").alias("x"), (F.col("event_type") == "purchase").alias("event"))
    got = recurrence.event_recurrence(f, "user_id", "frame", "x", F.col("event"), 15, 0.1)
    return got.select("user_id", "frame", F.round("recurrence", 6).alias("recurrence"))


_CONTRAST = "SELECT {0}, count(*) FILTER (same) AS same_pairs, count(*) FILTER (NOT same) AS other_pairs, round(avg(s) FILTER (same), 5) AS same_mean, round(avg(s) FILTER (NOT same), 5) AS other_mean, count(*) FILTER (same AND d < 1e-6) AS identical FROM p GROUP BY 1"


def _rounded(df):
    return df.withColumns({c: F.round(c, 5) for c in ("same_mean", "other_mean")})


@query(f"""WITH {FRAMES}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS island FROM f),
runs AS (SELECT user_id, event_type, min(frame) AS start, count(*) AS length FROM g GROUP BY user_id, event_type, island),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS at FROM runs),
p AS (SELECT a.user_id, a.event_type = b.event_type AS same, round(sqrt(power(a.length - b.length, 2) + power(a.start % 16 - b.start % 16, 2)), 6) AS d, d AS s FROM x a JOIN x b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.at > a.at),
k AS ({_CONTRAST.format("user_id")}) SELECT u.user_id, coalesce(same_pairs, 0) AS same_pairs, coalesce(other_pairs, 0) AS other_pairs, same_mean, other_mean, coalesce(identical, 0) AS identical FROM (SELECT DISTINCT user_id FROM x) u LEFT JOIN k ON u.user_id IS NOT DISTINCT FROM k.user_id""")
def label_recurrence(spark, sf_dir):
    """Runs of equal and of different labels of one user: mean distances of their shapes, and equal-label pairs alike."""
    runs = label_runs(spark, sf_dir).select("user_id", (F.col("run") - 1).alias("at"), "event_type", F.array(F.col("length").cast("double"), (F.col("start") % 16).cast("double")).alias("x"))
    return _rounded(recurrence.label_contrast(runs, "user_id", "at", "x", "event_type"))


@query(f"""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS at FROM embeddings),
p AS (SELECT a.label, a.vec_id % 3 = b.vec_id % 3 AS same, round(list_distance(a.x, b.x), 6) AS d, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.label IS NOT DISTINCT FROM b.label AND b.at - a.at >= 4) {_CONTRAST.format("label")}""")
def repetition_contrast(spark, sf_dir):
    """Cosine similarity of vectors of one label at least four places apart, of equal and of different classes."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", (F.col("vec_id") % 3).alias("class"))
    placed = ranks.row_numbers(v, "label", "vec_id", "at")
    return _rounded(recurrence.label_contrast(placed, "label", "at", "embedding", "class", 4, cosine=True))


_BARS = f"""{FRAMES}, r AS (SELECT user_id, frame // 4 AS bar, sum((event_type = 'view')::INT) AS a, sum((event_type = 'click')::INT) AS b, sum((event_type NOT IN ('view', 'click'))::INT) AS c, count(*) AS n, max(event_id) % 5 AS label FROM f GROUP BY 1, 2),
x AS (SELECT *, [a::DOUBLE, b::DOUBLE, c::DOUBLE] AS v FROM r),
e AS (SELECT p.user_id, p.bar AS u, q.bar AS w FROM x p JOIN x q ON p.user_id = q.user_id AND round(list_cosine_similarity(p.v, q.v), 9) >= 0.97),
g(user_id, bar, l) AS (SELECT user_id, bar, bar FROM x UNION SELECT e.user_id, e.w, g.l FROM g JOIN e ON e.user_id = g.user_id AND e.u = g.bar WHERE g.l < e.w),
k AS (SELECT user_id, bar, min(l) AS grp FROM g GROUP BY 1, 2),
t AS (SELECT k.user_id, grp, label, sum(n) AS weight FROM k JOIN x ON x.user_id = k.user_id AND x.bar = k.bar GROUP BY ALL),
o AS (SELECT user_id, grp, label AS planned FROM t QUALIFY row_number() OVER (PARTITION BY user_id, grp ORDER BY label = 0, weight DESC, label) = 1)"""


@query(f"WITH RECURSIVE {_BARS} SELECT k.user_id, k.bar, x.label, planned, k.grp AS \"group\" FROM k JOIN x ON x.user_id = k.user_id AND x.bar = k.bar JOIN o ON o.user_id = k.user_id AND o.grp = k.grp")
def music_repeat_plan(spark, sf_dir):
    """Bars of four events that are alike in their mix of types get the label that most of their events carry."""
    f = frames(spark, sf_dir).withColumn("bar", F.floor(F.col("frame") / 4))
    count = lambda c: F.count_if(c).cast("double")
    kind = F.col("event_type")
    bars = f.groupBy("user_id", "bar").agg(F.array(count(kind == "view"), count(kind == "click"), count(~kind.isin("view", "click"))).alias("v"), F.count(F.lit(1)).alias("n"), (F.max("event_id") % 5).alias("label"))
    return recurrence.repeat_plan(bars, "user_id", "bar", "v", "label", "n", 0.97)


@query()
def similarity_segments(spark, sf_dir):
    """Each label's vectors in order of their ids as a sequence, cut where they change; held against the plain rule."""
    placed = ranks.row_numbers(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "frame")
    return selfsimilarity.segments(placed, "label", "frame", "embedding", selfsimilarity.Rules(min_length=4, frames_per_cluster=8.0))
