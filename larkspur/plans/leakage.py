"""Queries that measure whether held-out sequences have a copy among the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import leakage
from larkspur.plans.registry import query
from larkspur.session import table

_LAGS = [-4, -2, 0, 2, 4]

_READINGS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
h AS (SELECT * FROM e WHERE vec_id % 5 = 0 ORDER BY sha256('42:' || vec_id), vec_id LIMIT 200),
q AS (SELECT * FROM e WHERE vec_id % 5 <> 0 ORDER BY sha256('42:' || vec_id), vec_id LIMIT 400),
hf AS (SELECT vec_id, t, v[2 * t + 1] AS x, v[2 * t + 2] AS y FROM h, range(32) r(t)),
qf AS (SELECT b, vec_id, CASE WHEN b = 1 THEN 31 - t ELSE t END AS t, v[2 * t + 1] AS x, v[2 * t + 2] AS y FROM q, range(32) r(t), range(2) s(b)),
d AS (SELECT b, hf.vec_id AS held, qf.vec_id AS other, round(median(sqrt(power(hf.x - qf.x, 2) + power(hf.y - qf.y, 2))), 9) AS d FROM hf JOIN qf ON hf.t = qf.t GROUP BY ALL),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY b, held ORDER BY d, other) <= 5),
l AS (SELECT k.b, held, other, lag, round(median(sqrt(power(hf.x - qf.x, 2) + power(hf.y - qf.y, 2))), 9) AS v FROM k JOIN hf ON hf.vec_id = held, (SELECT unnest([-4, -2, 0, 2, 4]) AS lag), qf WHERE qf.vec_id = other AND qf.b = k.b AND qf.t = hf.t - lag GROUP BY ALL),
m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY b, held ORDER BY v, other, lag) = 1),
p AS (SELECT b, held, CASE WHEN count(*) >= 20 THEN quantile_cont(d, 0.05) END AS low FROM d GROUP BY 1, 2),
o AS (SELECT b, other, CASE WHEN count(*) >= 20 THEN quantile_cont(d, 0.05) END AS low FROM d GROUP BY 1, 2),
z AS (SELECT b AS how, b, held, other, lag, v FROM m UNION ALL SELECT 2, b, held, other, 0, d FROM d WHERE b = 1 QUALIFY row_number() OVER (PARTITION BY held ORDER BY d, other) = 1),
r AS (SELECT how, z.held, z.other, lag, v, p.low AS held_low, o.low AS other_low, greatest(CASE WHEN p.low > 0 THEN v / p.low END, CASE WHEN o.low > 0 THEN v / o.low END) AS ratio FROM z JOIN p ON p.b = z.b AND p.held = z.held JOIN o ON o.b = z.b AND o.other = z.other WHERE p.low IS NOT NULL),
g AS (SELECT a.held AS vec_id, a.other AS nearest, a.v AS distance, a.lag, a.held_low, a.other_low, a.ratio, n.ratio AS null_ratio, w.ratio AS matched_ratio FROM r a LEFT JOIN r n ON n.how = 2 AND n.held = a.held LEFT JOIN r w ON w.how = 1 AND w.held = a.held WHERE a.how = 0)"""


def _readings(spark, sf_dir):
    """Vectors as 32 frames of two numbers; every fifth is held out."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.array(F.get("embedding", 2 * t).cast("double"), F.get("embedding", 2 * t + 1).cast("double")))
    v = table(spark, sf_dir, "embeddings").select("vec_id", pairs.alias("series"))
    return leakage.measured(v.filter("vec_id % 5 = 0"), v.filter("vec_id % 5 <> 0"), "vec_id", "series", _LAGS, (200, 400))


_ROUNDED = ["distance", "held_low", "other_low", "ratio", "null_ratio", "matched_ratio"]


@query(f"WITH {_READINGS} SELECT vec_id, nearest, lag, {', '.join(f'round({c}, 5) AS {c}' for c in _ROUNDED)} FROM g")
def leakage_readings(spark, sf_dir):
    """Each drawn held-out vector's nearest of the drawn others, against its own distances, the other's and the others reversed."""
    return _readings(spark, sf_dir).withColumns({c: F.round(c, 5) for c in _ROUNDED})


@query(f"""WITH {_READINGS}, c AS (SELECT *, vec_id % 2 = 0 AS linked, vec_id % 4 = 0 AS partnered FROM g),
s AS (SELECT count(*) AS checked, count(*) FILTER (partnered) AS positives, median(ratio) FILTER (partnered) AS positive_median, list(ratio ORDER BY ratio) FILTER (NOT linked) AS x FROM c),
t AS (SELECT checked, positives, positive_median, coalesce(len(x), 0) AS negatives, CASE WHEN len(x) >= 10 THEN x[1 + round_even(0.05 * (len(x) - 1), 0)::INT] END AS threshold, x[1 + round_even(0.25 * (len(x) - 1), 0)::INT] AS quarter FROM s)
SELECT checked, round(any_value(threshold), 5) AS threshold, any_value(positives) AS positives, round(any_value(positive_median), 5) AS positive_median, any_value(negatives) AS negatives,
coalesce(any_value(positives >= 5 AND negatives >= 10 AND positive_median < quarter), false) AS controls_separate, count(*) FILTER (ratio < threshold) AS flagged, count(*) FILTER (null_ratio < threshold) AS null_flagged,
count(*) FILTER (ratio < threshold) - count(*) FILTER (null_ratio < threshold) AS excess, count(*) FILTER (ratio < threshold) - count(*) FILTER (matched_ratio < threshold) AS matched_excess,
count(*) FILTER (ratio IS NOT NULL AND matched_ratio IS NOT NULL) AS paired, count(*) FILTER (ratio < matched_ratio) AS closer_than_reversed FROM c, t GROUP BY checked""")
def leakage_report(spark, sf_dir):
    """What is flagged under the unlinked readings' threshold, and beyond the reversed ones; even ids stand for linked ones, every fourth's partner is in the pool."""
    got = leakage.report(_readings(spark, sf_dir), F.col("vec_id") % 2 == 0, F.col("vec_id") % 4 == 0)
    return got.withColumns({c: F.round(c, 5) for c in ("threshold", "positive_median")})
