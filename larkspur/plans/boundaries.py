"""Queries about cuts and about how far plans agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import boundaries
from larkspur.plans.registry import query
from larkspur.plans.segments import FRAMES, frames


@query(f"WITH {FRAMES}, m AS (SELECT user_id, median(value) AS middle FROM f GROUP BY 1) SELECT f.user_id, frame, value FROM f JOIN m ON m.user_id IS NOT DISTINCT FROM f.user_id WHERE value > 60 AND value > 3 * greatest(middle, 1e-6)")
def sudden_values(spark, sf_dir):
    """Values that are large in themselves and for their user."""
    return boundaries.sudden(frames(spark, sf_dir).select("user_id", "frame", "value"), "user_id", "value", 60.0, 3.0)


@query(f"""WITH {FRAMES}, v AS (SELECT *, [value, (event_id % 50)::DOUBLE, 10.0] AS x, event_id % 12 = 0 AND frame >= 2 AND frame <= n - 2 AS cut FROM f),
u AS (SELECT user_id, frame, n, cut, list_transform(x, lambda a: a / (sqrt(list_inner_product(x, x)) + 1e-12)) AS u, max(cut) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM v),
c AS (SELECT user_id, count(*) AS k FROM u WHERE cut GROUP BY 1),
g AS (SELECT u.user_id, frame, k FROM u JOIN c ON c.user_id IS NOT DISTINCT FROM u.user_id WHERE NOT near AND frame >= 2 AND frame < n - 2 QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY sha256('42:' || frame), frame) <= k),
p AS (SELECT user_id, frame AS place, true AS cut FROM u WHERE cut UNION ALL SELECT user_id, frame, false FROM g),
d AS (SELECT p.user_id, place, p.cut, i, sum(u.u[i]) FILTER (u.frame < place) AS a, sum(u.u[i]) FILTER (u.frame >= place) AS b FROM p JOIN u ON u.user_id IS NOT DISTINCT FROM p.user_id AND u.frame BETWEEN place - 2 AND place + 1, range(1, 4) r(i) GROUP BY ALL),
s AS (SELECT user_id, cut, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-12) AS alike FROM d GROUP BY user_id, place, cut),
t AS (SELECT user_id, count(*) FILTER (cut) AS cuts, count(*) FILTER (NOT cut) AS drawn, avg(alike) FILTER (NOT cut) - avg(alike) FILTER (cut) AS contrast FROM s GROUP BY 1)
SELECT w.user_id, coalesce(cuts, 0) AS cuts, coalesce(drawn, 0) AS drawn, round(contrast, 6) AS contrast FROM (SELECT DISTINCT user_id FROM f) w LEFT JOIN t ON t.user_id IS NOT DISTINCT FROM w.user_id""")
def cut_contrast(spark, sf_dir):
    """Every twelfth event id as a cut: how much less alike the two events on either side are than around drawn places."""
    f = frames(spark, sf_dir)
    v = f.select("user_id", "frame", F.array(F.col("value"), (F.col("event_id") % 50).cast("double"), F.lit(10.0)).alias("x"))
    got = boundaries.contrast(v, f.filter("event_id % 12 = 0"), "user_id", "frame", "x", 2)
    return got.withColumn("contrast", F.round("contrast", 6))


@query(f"""WITH {FRAMES}, p AS (SELECT s AS seed, user_id, frame, CASE WHEN (event_id * (s + 3)) % 7 < s THEN 'other' ELSE event_type END AS label FROM f, range(4) r(s) WHERE (user_id + s) % 5 <> 0),
e AS (SELECT a.seed, b.seed AS other, a.user_id, avg((a.label <> b.label)::INT) AS part FROM p a JOIN p b ON a.user_id = b.user_id AND a.frame = b.frame AND a.seed < b.seed GROUP BY ALL)
SELECT seed, other, count(*) AS clips, round(avg(part), 6) AS mean, round(min(part), 6) AS least, round(max(part), 6) AS most FROM e GROUP BY 1, 2""")
def reseed_disagreement(spark, sf_dir):
    """Four plans of each user's events, by seed; a user in five lacks one of them."""
    f = frames(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).filter((F.col("user_id") + F.col("seed")) % 5 != 0)
    label = F.when(F.col("event_id") * (F.col("seed") + 3) % 7 < F.col("seed"), F.lit("other")).otherwise(F.col("event_type"))
    got = boundaries.disagreement(f.withColumn("label", label), "seed", "user_id", "frame", "label")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "least", "most")})
