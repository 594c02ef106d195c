"""Queries over pools of candidates, clusters, placements and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import candidates, clusters, graph, placement, ranks, retrieval, splits, timeline, warping
from larkspur.plans.registry import query
from larkspur.plans.segments import FRAMES, RUNS, frames, label_runs
from larkspur.session import table
from larkspur.sources import views

# --- clusters ----------------------------------------------------------------

_ROUND = """d{0} AS (SELECT vec_id, label, round(sum(power(x - mu, 2)), 6) AS d FROM e JOIN c{0} USING (dim) GROUP BY 1, 2),
a{0} AS (SELECT vec_id, label, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM d{0}) WHERE k = 1)"""
_NEXT = "c{1} AS (SELECT a{0}.label, dim, round(avg(x), 9) AS mu FROM e JOIN a{0} USING (vec_id) GROUP BY 1, 2)"
_KMEANS = f"""e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
s AS (SELECT vec_id, (row_number() OVER (ORDER BY sha256('42:' || vec_id)) - 1)::INT AS label FROM embeddings QUALIFY row_number() OVER (ORDER BY sha256('42:' || vec_id)) <= 6),
c0 AS (SELECT label, dim, x AS mu FROM e JOIN s USING (vec_id)), {_ROUND.format(0)}, {_NEXT.format(0, 1)}, {_ROUND.format(1)}, {_NEXT.format(1, 2)}, {_ROUND.format(2)}, {_NEXT.format(2, 3)}, {_ROUND.format(3)}"""


@query(f"WITH {_KMEANS} SELECT vec_id, label AS assigned, round(d, 4) AS distance FROM a3")
def kmeans(spark, sf_dir):
    """Six centres after three rounds, and each row's nearest."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    told = clusters.nearest(v, "embedding", clusters.kmeans(v, "vec_id", "embedding", 6, 3))
    return told.select("vec_id", "assigned", F.round("distance", 4).alias("distance"))


@query()
def merged_centers(spark, sf_dir):
    """The labels' centres merged by Ward's rule to five groups; each merge depends on those before. Held against brute force."""
    return clusters.merge_centers(retrieval.centroids(table(spark, sf_dir, "embeddings"), "embedding", "label"), 5)


@query()
def small_groups_merged(spark, sf_dir):
    """Groups of (label, id modulo 5) with fewer than 12 vectors join their nearest sibling of the same label; held against planted cases."""
    v = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") * 5 + F.col("vec_id") % 5).cast("long").alias("label"))
    c = retrieval.centroids(v, "embedding", "label").withColumn("parent", F.floor(F.col("label") / 5))
    return clusters.merge_small(c, "parent", 12)


# --- placement ---------------------------------------------------------------

_DEFICITS = """WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS mass FROM orders GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY mass DESC, o_custkey) AS rn, sum(mass) OVER () AS total FROM g),
w AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS o_custkey, NULL::BIGINT AS mass, (8 * total)::BIGINT AS a, total::BIGINT AS b, total::BIGINT AS c, '' AS split FROM i WHERE rn = 1
UNION ALL SELECT i.rn, i.o_custkey, i.mass, a - CASE WHEN NOT (b >= a AND b >= c) AND a >= c THEN 10 * i.mass ELSE 0 END, b - CASE WHEN b >= a AND b >= c THEN 10 * i.mass ELSE 0 END, c - CASE WHEN NOT (b >= a AND b >= c) AND a < c THEN 10 * i.mass ELSE 0 END,
CASE WHEN b >= a AND b >= c THEN 'val' WHEN a >= c THEN 'train' ELSE 'test' END FROM w JOIN i ON i.rn = w.rn + 1) SELECT o_custkey, mass, split FROM w WHERE rn > 0"""


@query(_DEFICITS)
def largest_deficit_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.lit(1).alias("one"))
    return splits.largest_deficit(orders, "o_custkey", "one", {"train": 8, "val": 1, "test": 1})


@query("""WITH g AS (SELECT source, sum(n_chars)::BIGINT AS mass FROM documents GROUP BY 1), o AS (SELECT *, mass > 0.08 * sum(mass) OVER () AS oversize, sum(mass) OVER () AS total, sha256('42:' || source) AS h FROM g),
b AS (SELECT *, coalesce(sum(CASE WHEN oversize THEN 0 ELSE mass END) OVER (ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT source, mass, oversize, CASE WHEN oversize THEN 'train' WHEN before * 10 < total THEN 'test' WHEN before * 10 < total * 2 THEN 'val' ELSE 'train' END AS split FROM b""")
def guarded_account_split(spark, sf_dir):
    return splits.guarded_fill(table(spark, sf_dir, "documents").select("source", "n_chars"), "source", "n_chars", {"test": 1, "val": 1}, 10, 0.08)


# --- rules over pools --------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey, o_orderkey, count(*) OVER w AS pool_size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey))
SELECT * FROM r WHERE pool_size <= 2 OR rank <= greatest(2, ceil(pool_size * 0.25))""")
def pool_best_share(spark, sf_dir):
    return candidates.best_share(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey", 0.25).select("o_custkey", "o_orderkey", "pool_size", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {RUNS}, e AS (SELECT user_id, event_type, start, round(mean, 6) AS energy FROM runs), q AS (SELECT event_type, quantile_cont(energy, 0.2) AS floor FROM e GROUP BY 1) SELECT user_id, event_type, start, energy FROM e JOIN q USING (event_type) WHERE energy >= floor""")
def energy_floor(spark, sf_dir):
    """Runs whose mean is not under the fifth of their class."""
    f, r = frames(spark, sf_dir), label_runs(spark, sf_dir).select("user_id", "event_type", "start")
    begun = f.join(r.select("user_id", F.col("start").alias("frame"), "start"), ["user_id", "frame"], "left")
    begun = timeline.running(begun, "user_id", timeline.block_of("frame"), "frame", {"start": ("max", F.col("start"))})
    energy = begun.groupBy("user_id", "event_type", "start").agg(F.round(F.avg("value"), 6).alias("energy"))
    return candidates.above_floor(energy, "event_type", "energy", 0.2).select("user_id", "event_type", F.col("start").cast("long").alias("start"), "energy")


@query("""WITH b AS (SELECT p_size AS pool, floor(abs(p_retailprice - 1500) / 100)::BIGINT AS cost, p_partkey AS ordinal, sha256('9:' || p_size || ':' || p_partkey) AS salt FROM part), m AS (SELECT pool, min(cost) AS cost FROM b GROUP BY 1)
SELECT pool, b.cost, count(*) AS tied, min(ordinal) AS by_index, min_by(ordinal, salt) AS by_salt FROM b JOIN m USING (pool) WHERE b.cost = m.cost GROUP BY 1, 2""")
def retrieval_tie_break(spark, sf_dir):
    cost = F.floor(F.abs(F.col("p_retailprice") - 1500) / 100)
    return candidates.first_of_tied(table(spark, sf_dir, "part").select(F.col("p_size").alias("pool"), cost.alias("cost"), F.col("p_partkey").alias("ordinal")), "pool", "cost", "ordinal", 9)


@query(f"""WITH {RUNS}, k AS (SELECT event_type, max(length) AS longest FROM runs WHERE user_id % 2 = 0 GROUP BY 1) SELECT user_id, start, runs.event_type, length, longest, round(length / longest, 6) AS stretch, length > longest AS stretched FROM runs LEFT JOIN k USING (event_type) WHERE user_id % 2 = 1""")
def stretch_gate(spark, sf_dir):
    """Runs of odd users as slots, those of even users as candidates."""
    r = label_runs(spark, sf_dir)
    told = candidates.stretch_report(r.filter("user_id % 2 = 1"), r.filter("user_id % 2 = 0"), "event_type", "length")
    return told.select("user_id", "start", "event_type", "length", "longest", F.round("stretch", 6).alias("stretch"), "stretched")


@query(f"""WITH {FRAMES}, d AS (SELECT user_id, frame, round(abs(value - lag(value, 1, value) OVER (PARTITION BY user_id ORDER BY frame)), 6) AS novelty FROM f), v AS (SELECT user_id, list(novelty ORDER BY novelty) FILTER (novelty IS NOT NULL) AS v FROM d GROUP BY 1), q AS (SELECT user_id, v[1 + 7 * (len(v) - 1) // 10] AS cut FROM v),
h AS (SELECT d.user_id, coalesce(list(frame ORDER BY frame) FILTER (novelty > cut), []) AS p FROM d JOIN q ON d.user_id IS NOT DISTINCT FROM q.user_id GROUP BY 1),
t AS (SELECT user_id, list_reduce(list_concat([[0::BIGINT]], list_transform(p, lambda x: [x])), lambda a, x: CASE WHEN x[1] - a[-1] >= 8 THEN list_concat(a, x) ELSE a END) AS s FROM h) SELECT user_id, unnest(s) AS frame FROM t""")
def phrase_starts(spark, sf_dir):
    """Above the 0.7-quantile is above the value at place floor(7 * (n - 1) / 10), in the query and its SQL."""
    before = lambda w: F.when(F.lag("frame").over(w).isNull(), F.col("value")).otherwise(F.lag("value").over(w))
    d = timeline.near(frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"novelty": F.round(F.abs(F.col("value") - before(w)), 6)})
    return candidates.phrase_starts(d, "user_id", "frame", "novelty", 0.7, 8)


@query(f"""WITH {FRAMES}, b AS (SELECT user_id, frame // 8 AS bar, round(avg(value), 6) AS loudness FROM f GROUP BY 1, 2) SELECT user_id, bar, loudness, round((row_number() OVER (PARTITION BY user_id ORDER BY loudness, bar) - 0.5) / count(*) OVER (PARTITION BY user_id), 6) AS target FROM b""")
def energy_follow(spark, sf_dir):
    """Each bar's place in the order of loudness within its sequence."""
    b = frames(spark, sf_dir).groupBy("user_id", F.floor(F.col("frame") / 8).alias("bar")).agg(F.round(F.avg("value"), 6).alias("loudness"))
    n = b.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    placed = ranks.row_numbers(b, "user_id", ["loudness", "bar"], "at", timeline.BLOCK).join(n, "user_id")
    return placed.select("user_id", "bar", "loudness", F.round((F.col("at") + 0.5) / F.col("n"), 6).alias("target"))


@query(f"""WITH {RUNS}, k AS (SELECT *, lead(event_type) OVER w AS next_type, lead(length) OVER w AS next_length FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY start)) SELECT user_id, start, event_type, length, next_type, next_length, abs(next_length - length) <= greatest(2, 0.15 * length) AS continues FROM k WHERE next_length IS NOT NULL""")
def continue_source(spark, sf_dir):
    """The part of the same recording that follows, and whether its length is near enough."""
    k = timeline.near(label_runs(spark, sf_dir), "user_id", "run", 1, lambda w: {"next_type": F.lead("event_type").over(w), "next_length": F.lead("length").over(w)}).filter("next_length is not null")
    return k.select("user_id", "start", "event_type", "length", "next_type", "next_length", (F.abs(F.col("next_length") - F.col("length")) <= F.greatest(F.lit(2.0), F.col("length") * 0.15)).alias("continues"))


@query(f"""WITH {FRAMES}, b AS (SELECT user_id, event_type, epoch_us(ts) AS t, max(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY frame) AS p, min(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM f)
SELECT user_id, count(*) AS steps, round(coalesce(avg(CASE WHEN q > p THEN cos(2 * pi() * ((t - p) / (q - p))) END), 0), 6) AS score FROM b WHERE event_type = 'click' GROUP BY 1""")
def step_lock(spark, sf_dir):
    """Clicks as steps, views as beats: 1 on the beat, -1 half a beat off, 0 where no step lies between beats."""
    beat = F.when(F.col("event_type") == "view", F.unix_micros("ts"))
    f = frames(spark, sf_dir).withColumn("t", F.unix_micros("ts")).withColumn("beat", beat)
    f = timeline.running(f, "user_id", timeline.block_of("frame"), "frame", {"p": ("max", F.col("beat"))})
    f = timeline.running(f, "user_id", timeline.block_of("frame"), "frame", {"q": ("min", F.col("beat"))}, downward=True)
    score = F.avg(F.when(F.col("q") > F.col("p"), F.cos(2 * F.pi() * ((F.col("t") - F.col("p")) / (F.col("q") - F.col("p"))))))
    return f.filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))


# --- sequences ---------------------------------------------------------------


@query("""WITH d AS (SELECT vec_id, embedding, ('0x' || substr(sha256('3:' || vec_id), 1, 8))::BIGINT % 49 AS start FROM embeddings) SELECT vec_id, start, round(list_sum(list_transform(embedding[start + 1:start + 16], lambda x: x::DOUBLE)), 6) AS random_sum, round(list_sum(list_transform(embedding[25:40], lambda x: x::DOUBLE)), 6) AS centre_sum FROM d""")
def cropped_sequences(spark, sf_dir):
    """Sixteen elements from a start drawn by id, the same at any position, and from the centre."""
    start = F.conv(F.substring(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 49
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    d = table(spark, sf_dir, "embeddings").withColumn("start", start)
    return d.select("vec_id", "start", total(F.slice("embedding", F.col("start").cast("int") + 1, F.lit(16))).alias("random_sum"), total(F.slice("embedding", 25, 16)).alias("centre_sum"))


@query("""WITH l AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v FROM conversations GROUP BY 1), m AS (SELECT *, max(len(v)) OVER (PARTITION BY conv_id // 16) AS w FROM l)
SELECT conv_id, w AS width, list_sum(v)::BIGINT AS total, len(v) AS real, (w - len(v)) AS padding FROM m""")
def padded_batches(spark, sf_dir):
    """Batches of sixteen conversations padded to the longest, with a mask; sums prove both."""
    length = F.struct("turn", F.length("text").cast("long").alias("n"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(length)), lambda s: s["n"]).alias("v"))
    batch = F.floor(F.col("conv_id") / 16)
    widths = c.groupBy(batch.alias("batch")).agg(F.max(F.size("v")).alias("width"))
    p = c.withColumn("batch", batch).join(widths, "batch")
    p = p.withColumn("padded", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.col("width") - F.size("v"))))
    p = p.withColumn("mask", F.transform(F.sequence(F.lit(1), F.size("padded")), lambda i: i > F.size("v")))
    masked = F.size(F.filter("mask", lambda x: x)).cast("long")
    return p.select("conv_id", F.size("padded").cast("long").alias("width"), F.aggregate("padded", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), (F.size("mask") - masked).alias("real"), masked.alias("padding"))


@query(f"WITH {FRAMES} SELECT user_id, frame, event_type FROM f")
def labels_expanded(spark, sf_dir):
    """Runs laid out again as one label per frame: the round trip gives the frames."""
    r = label_runs(spark, sf_dir)
    return r.select("user_id", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("frame"), "event_type")


@query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, vec_id % 7 + 1 AS shift FROM embeddings), p AS (SELECT vec_id, v[1:32] AS a, list_concat(v[shift + 1:32], v[33:32 + shift]) AS b FROM w)
SELECT vec_id, list_min(list_filter(range(1, 32), lambda s: len(list_filter(range(s + 1, 33), lambda i: abs(a[i] - b[i - s]) > 1e-6)) = 0)) AS stride FROM p""")
def detected_stride(spark, sf_dir):
    """Two windows of one series, vec_id % 7 + 1 apart; the shift is found from their values alone."""
    v = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    b = F.slice("v", (F.col("vec_id") % 7 + 2).cast("int"), F.lit(32))
    return v.select("vec_id", warping.detected_stride(F.slice("v", 1, 32), b, 1e-6).cast("long").alias("stride"))


@query()
def warped_halves(spark, sf_dir):
    """Each vector's first half warped onto its second; held against brute force, as each step depends on those before."""
    v = table(spark, sf_dir, "embeddings")
    got = v.select("vec_id", warping.warped(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("w"))
    return got.select("vec_id", F.size("w.pairs").alias("pairs"), F.round("w.cost", 5).alias("cost"))


_ANCHORS = f"""{FRAMES}, b AS (SELECT user_id, frame, max(CASE WHEN event_type = 'view' THEN frame END) OVER (PARTITION BY user_id ORDER BY frame) AS p, min(CASE WHEN event_type = 'view' THEN frame END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM f),
n AS (SELECT user_id, frame AS t, CASE WHEN q IS NULL OR frame - p <= q - frame THEN p ELSE q END AS s FROM b WHERE frame % 8 = 0 AND (p IS NOT NULL OR q IS NOT NULL)),
c AS (SELECT user_id, list({{'s': s, 't': t}} ORDER BY t) AS p FROM n GROUP BY 1),
k AS (SELECT user_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN x[1].s > a[-1].s AND x[1].t > a[-1].t AND x[1].t - a[-1].t <= 1.6 * (x[1].s - a[-1].s) AND x[1].s - a[-1].s <= 1.6 * (x[1].t - a[-1].t) THEN list_concat(a, x) ELSE a END) AS kept FROM c)"""


@query(f"""WITH {_ANCHORS}, u AS (SELECT user_id, kept[i].s AS s, kept[i].t AS t, kept[i + 1].s AS s2, kept[i + 1].t AS t2 FROM (SELECT user_id, kept, unnest(range(1, len(kept))) AS i FROM k))
SELECT f.user_id, f.frame, round(s + (f.frame - t) * (s2 - s) / (t2 - t), 6) AS source FROM f JOIN u ON u.user_id = f.user_id AND ((f.frame >= t AND f.frame < t2) OR (f.frame = t2 AND NOT EXISTS (SELECT 1 FROM u v WHERE v.user_id = f.user_id AND v.t = f.frame)))""")
def warped_to_anchors(spark, sf_dir):
    """Every eighth frame is drawn to its nearest view (the earlier of equals); frames between kept anchors are placed linearly."""
    f = frames(spark, sf_dir)
    view = F.when(F.col("event_type") == "view", F.col("frame"))
    b = timeline.running(f, "user_id", timeline.block_of("frame"), "frame", {"p": ("max", view)})
    b = timeline.running(b, "user_id", timeline.block_of("frame"), "frame", {"q": ("min", view)}, downward=True)
    near = F.when(F.col("q").isNull() | (F.col("frame") - F.col("p") <= F.col("q") - F.col("frame")), F.col("p")).otherwise(F.col("q"))
    n = b.filter("frame % 8 = 0").select("user_id", near.alias("s"), F.col("frame").alias("t")).filter("s is not null")
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("t", "s"))), lambda x: F.struct(x["s"].alias("s"), x["t"].alias("t")))
    kept = n.groupBy("user_id").agg(sorted_.alias("all")).select("user_id", warping.anchor_pairs(F.col("all"), 1.6).alias("kept"))
    told = f.select("user_id", "frame").join(kept, "user_id")
    return told.select("user_id", "frame", F.round(warping.through_anchors(F.col("kept"), F.col("frame")), 6).alias("source")).filter("source is not null")


# --- SQL ---------------------------------------------------------------------


@query("""SELECT n_name, count(*) AS orders, round(avg(('0x' || substr(sha256('7:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0), 8) AS mean_draw, sum(greatest(0, least(o_orderkey + 40, 900) - greatest(o_orderkey, 100)))::BIGINT AS overlap, max(lpad((o_custkey // 60)::VARCHAR, greatest(2, length((o_custkey // 60)::VARCHAR))::INT, '0') || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0')) AS last_time
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def sql_surface(spark, sf_dir):
    """The same by SQL text over the registered views and functions."""
    views.register(spark, sf_dir)
    return spark.sql(
        "SELECT n_name, count(*) AS orders, round(avg(hash_share('7', cast(o_orderkey as string))), 8) AS mean_draw, sum(overlap(o_orderkey, o_orderkey + 40, 100, 900)) AS overlap, max(mm_ss(o_custkey)) AS last_time "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    )


# --- pinned placement --------------------------------------------------------

_TIES = """h AS (SELECT doc_id, sha256(text) AS g FROM documents UNION ALL SELECT doc_id, source || ':' || lang || ':' || (n_chars // 500) FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL),
e AS (SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY g) AS u, doc_id AS v FROM h WHERE g IS NOT NULL) WHERE u <> v),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
p AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN sha256('7:' || (source || ':' || lang || ':' || (n_chars // 500))) < 'c' THEN 'train' WHEN sha256('7:' || (source || ':' || lang || ':' || (n_chars // 500))) < 'e' THEN 'val' ELSE 'test' END END AS pin FROM documents)"""
_LABELS = "r{0}(id, l) AS (SELECT doc_id, doc_id FROM {1} UNION SELECT b.v, r.l FROM r{0} r JOIN b ON b.u = r.id JOIN {1} x ON x.doc_id = b.v WHERE r.l < b.v), c{0} AS (SELECT id AS doc_id, min(l) AS component FROM r{0} GROUP BY 1)"


def _pinned_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.concat(F.col("source"), F.lit(":"), F.col("lang"), F.lit(":"), F.floor(F.col("n_chars") / 500).cast("string"))
    keyed = d.select("doc_id", F.sha2("text", 256).alias("hash"), kind.alias("kind"))
    at = F.sha2(F.concat(F.lit("7:"), "kind"), 256)
    side = F.when(at < "c", "train").when(at < "e", "val").otherwise("test")
    return keyed.withColumn("pin", F.when(F.col("doc_id") % 3 != 0, side)), graph.star_edges(keyed, "doc_id", ["hash", "kind"])


@query(f"""WITH RECURSIVE {_TIES}, {_LABELS.format(1, "p")},
bad AS (SELECT component FROM c1 JOIN p USING (doc_id) GROUP BY 1 HAVING min(pin) <> max(pin) AND count(*) > count(pin)),
gone AS (SELECT doc_id, component FROM c1 JOIN p USING (doc_id) JOIN bad USING (component) WHERE pin IS NULL),
p2 AS (SELECT * FROM p ANTI JOIN gone USING (doc_id)), {_LABELS.format(2, "p2")},
s AS (SELECT component, count(*) AS size, count(pin) AS pins, min(pin) AS lo, max(pin) AS hi FROM c2 JOIN p2 USING (doc_id) GROUP BY 1),
t AS (SELECT count(*) * 8 - 10 * sum((split = 'train')::INT) AS train, count(*) - 10 * sum((split = 'val')::INT) AS val, count(*) - 10 * sum((split = 'test')::INT) AS test FROM (SELECT coalesce(pin, CASE WHEN lo = hi THEN lo END) AS split FROM c2 JOIN p2 USING (doc_id) JOIN s USING (component))),
i AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, sha256('42:' || component)) AS rn FROM s WHERE pins = 0),
w AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS component, train::BIGINT AS a, val::BIGINT AS v, test::BIGINT AS c, '' AS split FROM t
UNION ALL SELECT i.rn, i.component, a - CASE WHEN NOT (v >= a AND v >= c) AND a >= c THEN 10 * size ELSE 0 END, v - CASE WHEN v >= a AND v >= c THEN 10 * size ELSE 0 END, c - CASE WHEN NOT (v >= a AND v >= c) AND a < c THEN 10 * size ELSE 0 END,
CASE WHEN v >= a AND v >= c THEN 'val' WHEN a >= c THEN 'train' ELSE 'test' END FROM w JOIN i ON i.rn = w.rn + 1)
SELECT doc_id, component, coalesce(pin, lo, w.split) AS split, CASE WHEN lo <> hi THEN 'straddles' WHEN pin IS NOT NULL THEN 'pinned' WHEN lo IS NOT NULL THEN 'follows' ELSE 'placed' END AS state
FROM c2 JOIN p2 USING (doc_id) JOIN s USING (component) LEFT JOIN w USING (component) UNION ALL SELECT doc_id, component, NULL, 'dropped' FROM gone""")
def documents_beside_pins(spark, sf_dir):
    """New documents beside pinned ones: components by equal text or kind follow
    their pins, bridging ones are left out, free ones go by the largest deficit."""
    docs, edges = _pinned_documents(spark, sf_dir)
    return placement.place_beside_pins(docs, edges, "doc_id", "pin", {"train": 8, "val": 1, "test": 1}, drop_bridging=True)
