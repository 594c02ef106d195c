"""Queries about draws: pools, swaps, seeds of clusters, and what chance would give."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import clusters, nulls, pools, stats
from larkspur.plans.registry import query
from larkspur.plans.segments import FRAMES, RUNS, frames, label_runs
from larkspur.session import table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


_POOL = """d AS (SELECT draw, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings, range(1, 13) t(draw) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY sha256('42:' || draw || ':' || vec_id), vec_id) <= 40),
e AS (SELECT draw, vec_id, label, unnest(x) AS x, unnest(range(64)) AS dim FROM d),
z AS (SELECT draw, vec_id, label, dim, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w >= 1e-10 THEN stddev_pop(x) OVER w ELSE 1 END AS z FROM e WINDOW w AS (PARTITION BY draw, dim)),
l AS (SELECT draw, vec_id, label, list(z ORDER BY dim) AS z FROM z GROUP BY ALL),
p AS (SELECT a.draw, a.vec_id AS q, b.vec_id AS c, round(list_distance(a.z[1:32], b.z[1:32]), 9) AS d1, round(list_distance(a.z[33:64], b.z[33:64]), 9) AS d2 FROM l a JOIN l b ON a.draw = b.draw AND a.vec_id <> b.vec_id{0}),
n AS (SELECT draw, q, d2 AS near FROM p QUALIFY row_number() OVER (PARTITION BY draw, q ORDER BY d1, c) = 1),
h AS (SELECT draw, q, count(*) AS candidates, sum((d2 <= near)::INT) <= 3 AS hit FROM p JOIN n USING (draw, q) GROUP BY 1, 2 HAVING count(*) > 3),
r AS (SELECT draw, 100.0 * sum(hit::INT) / count(*) AS r FROM h GROUP BY 1)
SELECT 40 AS pool_size, 12 AS draws, count(*) AS draws_scored, round(avg(r), 2) AS r_mean, round(stddev_pop(r), 2) AS r_std, round(min(r), 2) AS r_min, round(max(r), 2) AS r_max, 7.69 AS chance_r FROM r"""


def _halves(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", "label", F.slice("embedding", 1, 32).alias("one"), F.slice("embedding", 33, 32).alias("two"))


@query(f"WITH {_POOL.format('')}")
def pool_precision(spark, sf_dir):
    """R-precision of the vectors' second halves behind their first, on twelve pools of forty."""
    return pools.precision_at_pool(_halves(spark, sf_dir), "vec_id", "one", "two", 40, 12)


@query(f"WITH {_POOL.format(' AND a.label <> b.label')}")
def pool_precision_across_groups(spark, sf_dir):
    """The same with candidates of other labels only."""
    return pools.precision_at_pool(_halves(spark, sf_dir), "vec_id", "one", "two", 40, 12, group="label")


@query()
def paired_swap_permutation(spark, sf_dir):
    """Whether vectors of even ids are nearer to those of even labels than the vectors after them; held against NumPy with the same draws."""
    v = _vectors(spark, sf_dir)
    arm = v.filter("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("arm"))
    after = v.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("baseline"))
    got = stats.paired_swaps(arm.join(after, "vec_id"), "vec_id", "arm", "baseline", v.filter("label % 2 = 0"), "embedding", 100)
    return got.select(F.round("observed_delta", 6).alias("observed_delta"), F.round("null_sd", 6).alias("null_sd"), "p_one_sided", "permutations")


def _race(i: int) -> str:
    before = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(i))
    d = f"d{i} AS (SELECT e.vec_id, e.x, min(round(list_reduce(list_transform(list_zip(e.x, b.x), lambda p: power(p[1] - p[2], 2)), lambda a, y: a + y), 6)) AS d FROM e, ({before}) b GROUP BY 1, 2)" if i else "d0 AS (SELECT vec_id, x, 0.0 AS d FROM e)"
    u = f"((('0x' || substr(sha256('42:{i}:' || vec_id), 1, 13))::BIGINT + 0.5) / power(2.0, 52))"
    return f"{d}, s{i} AS (SELECT {i} AS label, vec_id, x FROM d{i} ORDER BY d <= 0, CASE WHEN d > 0 THEN -ln({u}) / d ELSE {u} END, vec_id LIMIT 1)"


@query(f"WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), {', '.join(map(_race, range(5)))} SELECT label, vec_id FROM ({' UNION ALL '.join(f'SELECT * FROM s{i}' for i in range(5))})")
def kmeans_seeds(spark, sf_dir):
    """Five starting vectors, each drawn by its squared distance from those before."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    found = clusters.squared_seeds(v, "vec_id", "embedding", 5)
    return spark.createDataFrame([(i, key) for i, (key, _) in enumerate(found)], "label int, vec_id long")


@query()
def kmeans_settled(spark, sf_dir):
    """Each vector's centre of five, from drawn seeds until no centre moves; held against NumPy."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    seeds = clusters.squared_seeds(v, "vec_id", "embedding", 5)
    told = clusters.nearest(v, "embedding", clusters.kmeans(v, "vec_id", "embedding", 5, 100, start=[x for _, x in seeds]))
    return told.select("vec_id", "assigned", F.round("distance", 4).alias("distance"))


_NUMBER = "('0x' || substr(sha256({0}), 1, 12))::BIGINT"


@query(f"""WITH {RUNS}, w AS (SELECT user_id, max(stop) AS span FROM runs GROUP BY 1), r AS (SELECT *, unnest(range(1, 4)) AS round FROM runs),
o AS (SELECT user_id, round, sum(length) OVER (PARTITION BY user_id, round ORDER BY sha256('42:' || round || ':' || user_id || ':' || start)) AS off FROM r)
SELECT user_id, round, (off + {_NUMBER.format("'42:turn:' || round || ':' || user_id")} % span)::BIGINT % span AS edge FROM o JOIN w USING (user_id) WHERE off < span
UNION SELECT user_id, round, unnest([0, span]) FROM w, range(1, 4) t(round)""")
def shuffled_span_edges(spark, sf_dir):
    """Where runs of equal labels would be cut if their lengths came in another order, three rounds."""
    return nulls.shuffled_spans(label_runs(spark, sf_dir), "user_id", "start", "end", 3).select("user_id", F.col("round").cast("long").alias("round"), "edge")


def _lengths(f):
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FRAMES}, e AS (SELECT user_id, frame, n, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS k, coalesce(frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame), 0) AS gap FROM f WHERE event_type = 'purchase'),
r AS (SELECT *, unnest(range(1, 4)) AS round FROM e),
o AS (SELECT *, sum(gap) OVER (PARTITION BY user_id, round ORDER BY CASE WHEN nth = 0 THEN '' ELSE sha256('42:' || round || ':' || user_id || ':' || nth) END) AS off FROM r)
SELECT user_id, round, CASE WHEN n <= 1 OR k < 2 THEN frame ELSE (off + {_NUMBER.format("'42:turn:' || round || ':' || user_id")} % n)::BIGINT % n END AS frame FROM o""")
def shuffled_event_frames(spark, sf_dir):
    """Purchases with their gaps in another order, laid out from a drawn frame, three rounds."""
    f = frames(spark, sf_dir)
    got = nulls.shuffled_events(f.filter("event_type = 'purchase'"), "user_id", "frame", _lengths(f), "n", 3)
    return got.select("user_id", F.col("round").cast("long").alias("round"), "frame")


@query(f"""WITH {RUNS}, s AS (SELECT user_id, any_value(n) AS n, sum((event_type = 'error')::INT) AS k FROM f GROUP BY 1),
q AS (SELECT user_id, k, unnest(range(1, n - 1)) AS frame FROM s WHERE k > 0 AND n > 3), d AS (SELECT *, unnest(range(1, 6)) AS draw FROM q),
t AS (SELECT user_id, draw, frame FROM d QUALIFY row_number() OVER (PARTITION BY user_id, draw ORDER BY sha256('42:' || draw || ':' || user_id || ':' || frame)) <= k),
x AS (SELECT user_id, start AS frame FROM runs WHERE start > 0)
SELECT user_id, draw, x.frame, min(abs(x.frame - t.frame)) AS distance FROM x JOIN t USING (user_id) GROUP BY ALL""")
def random_point_distances(spark, sf_dir):
    """How far the cuts between runs are from as many random frames as there are errors, five draws."""
    f = frames(spark, sf_dir)
    sizes = f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    points = nulls.random_points(sizes, "user_id", "n", "k", 5)
    cuts = label_runs(spark, sf_dir).filter("start > 0").select("user_id", F.col("start").alias("frame"))
    return nulls.point_distances(cuts, points, "user_id", "frame", "draw").select("user_id", F.col("draw").cast("long").alias("draw"), "frame", "distance")


@query(f"""WITH {FRAMES}, m AS (SELECT DISTINCT user_id, (frame + d + n) % n AS frame FROM f, range(-1, 2) t(d) WHERE event_type = 'error'), e AS (SELECT user_id, frame, n, unnest(range(0, 21)) AS round FROM f WHERE event_type = 'purchase'),
t AS (SELECT user_id, round, CASE WHEN round = 0 THEN frame ELSE ((frame + 1 + {_NUMBER.format("'42:' || round || ':' || user_id")} % greatest(n - 1, 1)) % n)::BIGINT END AS frame FROM e WHERE round = 0 OR n > 1),
r AS (SELECT t.user_id, round, count(*) AS events, round(count(m.frame) / count(*), 9) AS rate FROM t LEFT JOIN m ON m.user_id = t.user_id AND m.frame = t.frame GROUP BY 1, 2),
o AS (SELECT user_id, events, rate AS observed FROM r WHERE round = 0),
n AS (SELECT user_id, avg(rate) AS null_mean, stddev_pop(rate) AS null_sd, (sum((rate >= observed)::INT) + 1) / (count(*) + 1) AS p FROM r JOIN o USING (user_id) WHERE round > 0 GROUP BY 1)
SELECT user_id, o.events, observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(p, 6) AS p FROM o LEFT JOIN n USING (user_id)""")
def shift_null(spark, sf_dir):
    """Purchases within a frame of an error, around the user's circle of frames, against twenty turns."""
    f = frames(spark, sf_dir)
    sizes = _lengths(f)
    errors = f.filter("event_type = 'error'").join(sizes, "user_id").withColumn("d", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    mask = errors.select("user_id", F.pmod(F.col("frame") + F.col("d"), F.col("n")).alias("frame"))
    got = nulls.shift_null(f.filter("event_type = 'purchase'"), mask, sizes, "user_id", "frame", "n", 20)
    return got.withColumns({c: F.round(c, 6) for c in ("null_mean", "null_sd", "p")})
