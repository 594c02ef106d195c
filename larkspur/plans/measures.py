"""Queries that measure: distributions, classification, neighbours, null models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import quantiles, ranks, retrieval, stats, strips, timeline
from larkspur.plans.registry import query
from larkspur.session import staged, table

_SQ = "list_sum(list_transform(range(1, 65), lambda i: power(q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE, 2)))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * r.embedding[i]::DOUBLE))"
_PAIRS = f"p AS (SELECT q.vec_id AS query_id, q.label AS query_label, r.vec_id AS row_id, r.label, round({_SQ}, 6) AS d2 FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)"
_ALL_PAIRS = _PAIRS.replace(" WHERE q.vec_id % 100 = 0", "")
_DIMS = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings)"
_CENTERS = "c AS (SELECT label, dim, avg(x) AS mu FROM e GROUP BY 1, 2)"
_FAR = f"{_DIMS}, {_CENTERS}, d AS (SELECT vec_id, e.label, c.label AS center, round(sum(power(x - mu, 2)), 6) AS distance FROM e JOIN c USING (dim) GROUP BY 1, 2, 3)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries (ids divisible by 100) against all other rows."""
    v = _vectors(spark, sf_dir)
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("qv"))
    met = retrieval.against(q, v.select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("rv"))).filter("query_id <> row_id")
    return met.withColumn("d2", F.round(V.squared_distance(F.col("qv"), F.col("rv")), 6))


# --- distributions -----------------------------------------------------------


@query("SELECT dim::INT AS dim, round(v / sum(v) OVER (), 7) AS share FROM (SELECT dim, var_pop(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings) GROUP BY 1)")
def energy_share(spark, sf_dir):
    v = retrieval.moments(_vectors(spark, sf_dir), "embedding").select("dim", (F.col("deviation") * F.col("deviation")).alias("v"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("v").alias("all")))).select("dim", F.round(F.col("v") / F.col("all"), 7).alias("share"))


@query(f"WITH {_DIMS} SELECT dim::INT AS dim, round(quantile_cont(x, 0.01), 6) AS low, round(quantile_cont(x, 0.99), 6) AS high FROM e GROUP BY 1")
def percentile_refit(spark, sf_dir):
    each = _vectors(spark, sf_dir).select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    q = quantiles.linear(each, "dim", "x", {"low": 0.01, "high": 0.99})
    return q.select("dim", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH b AS (SELECT floor(log2(greatest(n_chars, 1)))::BIGINT AS bucket, sum((lang = 'en')::INT) AS a, sum((lang = 'de')::INT) AS b FROM documents GROUP BY 1), s AS (SELECT bucket, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM b)
SELECT count(*) AS buckets, round(sum(abs(p - q)) / 2, 6) AS total_variation, round(sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END), 6) AS kl_bits FROM s""")
def total_variation(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy(F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).alias("bucket")).agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "de").alias("b"))
    all_ = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    s = counts.crossJoin(F.broadcast(all_)).select((F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))
    kl = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.log2(F.col("p") / F.col("q"))).otherwise(0.0)
    return s.agg(F.count(F.lit(1)).alias("buckets"), F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 6).alias("total_variation"), F.round(F.sum(kl), 6).alias("kl_bits"))


@query("""WITH m AS (SELECT 'quantity' AS metric, l_quantity AS x FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem)
SELECT metric, round(quantile_cont(x, 0.05), 4) AS p05, round(median(x), 4) AS median, round(quantile_cont(x, 0.95), 4) AS p95, max(x) AS top, count(x) AS n, (count(*) - count(x))::BIGINT AS missing FROM m GROUP BY 1""")
def metric_quantiles(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot([], ["quantity", "discount", "tax"], "metric", "x")
    q = m.groupBy("metric").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.max("x").alias("top"), F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"))
    return q.select("metric", *[F.round(F.expr(f"q[{i}]"), 4).alias(c) for i, c in enumerate(("p05", "median", "p95"))], "top", "n", "missing")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT count(*) AS groups, round(avg(m), 4) AS over_groups, round(sum(m * n) / sum(n), 4) AS by_size, round(avg(CASE WHEN n > 1 THEN m END), 4) AS without_single FROM g""")
def means_over_groups(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("m"), 4).alias("over_groups"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 4).alias("by_size"), F.round(F.avg(F.when(F.col("n") > 1, F.col("m"))), 4).alias("without_single"))


@query("""WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS top_share, arg_min(source, (-n, source)) AS top_source FROM g GROUP BY 1""")
def largest_group_share(spark, sf_dir):
    g = _docs(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("lang").agg(F.sum("n").alias("all"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("top_source")).withColumnRenamed("all", "n")


@query("""WITH g AS (SELECT event_type, count(DISTINCT CASE WHEN user_id % 5 <> 0 THEN user_id END) AS support, count(*) AS n FROM events GROUP BY 1) SELECT event_type, support, n, round(sum(CASE WHEN support > 1 THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS safe_share FROM g""")
def class_support(spark, sf_dir):
    train = F.when(F.col("user_id") % 5 != 0, F.col("user_id"))
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct(train).alias("support"), F.count(F.lit(1)).alias("n"))
    all_ = g.agg(F.round(F.sum(F.when(F.col("support") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("safe_share"))
    return g.crossJoin(F.broadcast(all_))


@query("""WITH c AS (SELECT turn // 2 AS bucket, count(*) AS n FROM conversations WHERE turn IS NOT NULL GROUP BY 1), k AS (SELECT unnest(range(0, (SELECT max(bucket) FROM c)::BIGINT + 1)) AS bucket) SELECT bucket, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (bucket)""")
def bincount(spark, sf_dir):
    """Turns by twos, empty buckets among them, up to the last one that the data have."""
    c = table(spark, sf_dir, "conversations").filter("turn is not null").groupBy(F.floor(F.col("turn") / 2).alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
    every = c.agg(F.max("bucket").alias("last")).filter("last is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    return every.join(c, "bucket", "left").select("bucket", F.coalesce("k", F.lit(0)).alias("n"))


@query("""SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END), 7) AS click, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 7) AS purchase, round(avg(CASE WHEN event_type = 'view' THEN value END), 7) AS view FROM events GROUP BY 1""")
def scores_by_arm(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.round(F.avg("value"), 7))


@query("""WITH x AS (SELECT source, count(*) AS n, avg(n_chars) AS mean, count(DISTINCT lang) AS langs FROM documents GROUP BY 1), c AS (SELECT source, 'size' AS criterion, n::DOUBLE AS value, n >= 10 AS passed FROM x UNION ALL SELECT source, 'mean', round(mean, 3), mean BETWEEN 500 AND 5000 FROM x UNION ALL SELECT source, 'langs', langs::DOUBLE, langs >= 2 FROM x)
SELECT *, bool_and(passed) OVER (PARTITION BY source) AS overall FROM c""")
def criteria_verdicts(spark, sf_dir):
    x = _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"), F.count_distinct("lang").alias("langs"))
    row = lambda name, value, ok: F.struct(F.lit(name).alias("criterion"), value.cast("double").alias("value"), ok.alias("passed"))
    all_ = F.array(row("size", F.col("n"), F.col("n") >= 10), row("mean", F.round("mean", 3), F.col("mean").between(500, 5000)), row("langs", F.col("langs"), F.col("langs") >= 2))
    c = x.select("source", all_.alias("c"), F.forall(all_, lambda r: r["passed"]).alias("overall"))
    return c.select("source", F.explode("c").alias("c"), "overall").select("source", "c.*", "overall")


@query("""WITH a AS (SELECT user_id, event_type, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS x, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS y FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS shared, round(avg(abs(x - y) / greatest(abs(x), abs(y))), 6) AS band, round(max(abs(x - y)), 4) AS widest FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def noise_band(spark, sf_dir):
    half = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    a = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(half(0).alias("x"), half(1).alias("y")).filter("x is not null and y is not null")
    gap = F.abs(F.col("x") - F.col("y"))
    return a.groupBy("event_type").agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg(F.try_divide(gap, F.greatest(F.abs("x"), F.abs("y")))), 6).alias("band"), F.round(F.max(gap), 4).alias("widest"))


@query("""WITH s AS (SELECT o_orderpriority AS class, o_totalprice AS x FROM orders), m AS (SELECT class, avg(x) AS mu FROM s GROUP BY 1) SELECT class, count(*) AS n, round(stddev_pop(x - mu), 4) AS within FROM s JOIN m USING (class) GROUP BY 1""")
def group_centred(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("x"))
    m = s.groupBy("class").agg(F.avg("x").alias("mu"))
    return s.join(F.broadcast(m), "class").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop(F.col("x") - F.col("mu")), 4).alias("within"))


@query("""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, stddev_pop(l_quantity) + 1e-8 AS sx FROM lineitem), z AS (SELECT (l_quantity - mx) / sx AS x, l_extendedprice - my AS y, my FROM lineitem, m)
SELECT round(sum(x * y) / (sum(x * x) + 1), 4) AS slope, round(any_value(my), 4) AS intercept, count(*) AS n FROM z""")
def ridge_regression(spark, sf_dir):
    """Standardised x and an unpenalised intercept, from sufficient statistics."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    s = li.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.stddev_pop("x").alias("sd"), F.avg("y").alias("my"))
    sd = F.col("sd") + 1e-8
    return s.select(F.round(F.col("n") * F.col("xy") / sd / (F.col("n") * F.col("xx") / (sd * sd) + 1), 4).alias("slope"), F.round("my", 4).alias("intercept"), "n")


# --- classes, neighbours, retrieval ------------------------------------------


@query(f"WITH {_FAR}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, center) AS k FROM d) WHERE k = 1), n AS (SELECT label, center AS assigned, count(*) AS n FROM a GROUP BY 1, 2) SELECT label, assigned, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM n")
def confusion_matrix(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a = retrieval.assign(v, "vec_id", "embedding", retrieval.centroids(v, "embedding", "label"), "label").join(v.select("vec_id", "label"), "vec_id")
    return stats.confusion(a, "label", "assigned").withColumn("share", F.round("share", 6))


@query(f"WITH {_FAR}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, center) AS k FROM d) WHERE k = 1), s AS (SELECT label, count(*) AS n, sum((label = center)::INT) AS hits FROM a GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(hits) / sum(n), 6) AS accuracy, round(max(n) / sum(n), 6) AS majority, round(sum(power(n, 2)) / power(sum(n), 2), 6) AS chance FROM s")
def accuracy_and_baselines(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a = retrieval.assign(v, "vec_id", "embedding", retrieval.centroids(v, "embedding", "label"), "label").join(v.select("vec_id", "label"), "vec_id")
    s = a.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("label") == F.col("assigned")).alias("hits"))
    n = F.sum("c")
    return s.agg(n.alias("n"), F.round(F.sum("hits") / n, 6).alias("accuracy"), F.round(F.max("c") / n, 6).alias("majority"), F.round(F.sum(F.col("c") * F.col("c")) / (n * n), 6).alias("chance"))


@query(f"WITH {_FAR}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, center) AS k FROM d) SELECT vec_id, max(CASE WHEN k = 1 THEN center END) AS assigned, round(max(CASE WHEN k = 2 THEN distance END) - max(CASE WHEN k = 1 THEN distance END), 5) AS margin FROM r GROUP BY 1")
def top_two_margin(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    d = retrieval.distances(v, "vec_id", "embedding", retrieval.centroids(v, "embedding", "label"), "label")
    return d.select("vec_id", F.expr("found[0].label").alias("assigned"), F.round(F.expr("found[1].distance - found[0].distance"), 5).alias("margin"))


@query(f"WITH {_FAR} SELECT label, vec_id AS medoid, distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS k FROM d WHERE label = center) WHERE k = 1")
def medoids(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    far = v.join(F.broadcast(retrieval.centroids(v, "embedding", "label").select("label", "center")), "label").withColumn("distance", F.round(V.squared_distance(F.col("embedding"), F.col("center")), 6))
    return far.groupBy("label").agg(F.min(F.struct("distance", "vec_id")).alias("m")).select("label", F.col("m.vec_id").alias("medoid"), "m.distance")


@query(f"WITH {_ALL_PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, row_id) AS k FROM p), s AS (SELECT count(*) AS n, label FROM embeddings GROUP BY label) SELECT count(DISTINCT query_id) AS queries, round(avg((label = query_label)::INT), 6) AS same, (SELECT round(sum(power(n, 2)) / power(sum(n), 2), 6) FROM s) AS chance FROM t WHERE k <= 5")
def neighbour_class_share(spark, sf_dir):
    """The share of every row's five nearest that have its label, against chance."""
    top = strips.nearest(_vectors(spark, sf_dir), "vec_id", "embedding", "label", 5)
    seen = top.agg(F.count_distinct("query_id").alias("queries"), F.round(F.avg(F.when(~F.isnan("mark") & ~F.isnan("query_mark"), (F.col("mark") == F.col("query_mark")).cast("int"))), 6).alias("same"))
    sizes = _vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return seen.crossJoin(F.broadcast(sizes.agg(F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("chance"))))


@query(f"""WITH {_PAIRS}, c AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(abs(q.embedding[1]::DOUBLE - r.embedding[1]::DOUBLE), 8) AS first FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, row_id) AS k FROM c) WHERE k = 1), s AS (SELECT p.query_id, p.d2 AS star FROM p JOIN n USING (query_id, row_id)) SELECT s.query_id, sum((p.d2 <= star)::INT)::BIGINT AS rank FROM s JOIN p USING (query_id) GROUP BY 1""")
def rank_of_other_space(spark, sf_dir):
    """The rank that the nearest row of one space has in another, ties against it: two passes over the pairs."""
    v = _vectors(spark, sf_dir)
    q = v.filter("vec_id % 100 = 0")

    def first(tiles):
        for t in tiles:
            gap = np.where(t.own, np.inf, np.round(np.abs(t.queries[0][:, None] - t.rows[0][None, :]), 8))
            near = np.where(gap == gap.min(axis=1)[:, None], t.row[None, :], np.iinfo(np.int64).max).argmin(axis=1)
            met = np.isfinite(gap[np.arange(len(near)), near])
            squared = np.zeros(len(near))
            for x, y in zip(t.queries, t.rows, strict=True):
                squared += (x - y[near]) * (x - y[near])
            yield pa.RecordBatch.from_pydict({"vec_id": t.query[met], "first": gap[np.arange(len(near)), near][met], "row_id": t.row[near][met], "d2": np.round(squared, 6)[met]})

    met = retrieval.tiled(q, v, "vec_id", "embedding", "label", first, "vec_id long, first double, row_id long, d2 double")
    star = staged(met.groupBy("vec_id").agg(F.min(F.struct("first", "row_id", "d2")).alias("s")).select("vec_id", F.col("s.d2").alias("extra")), "stars")

    def counted(tiles):
        counts: dict[int, tuple] = {}
        for t in tiles:
            n = ((t.squared <= t.query_marks[:, 1, None]) & ~t.own).sum(axis=1)
            counts[int(t.query[0])] = (t.query, n + counts.get(int(t.query[0]), (None, 0))[1])
        for query, n in counts.values():
            yield pa.RecordBatch.from_pydict({"query_id": query, "n": n.astype(np.int64)})

    ranks = retrieval.tiled(q, v, "vec_id", "embedding", "label", counted, "query_id long, n long", extra=star)
    return ranks.groupBy("query_id").agg(F.sum("n").alias("rank"))


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, round(avg(sqrt(d2)), 6) AS diversity FROM p")
def diversity(spark, sf_dir):
    """Mean Euclidean distance of the stated queries to all other rows."""
    v = _vectors(spark, sf_dir)

    def measure(tiles):
        n, total = 0, 0.0
        for t in tiles:
            n, total = n + int((~t.own).sum()), total + float(np.sqrt(t.squared)[~t.own].sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    sums = retrieval.tiled(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding", "label", measure, "n long, total double")
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(F.try_divide(F.sum("total"), F.sum("n")), 6).alias("diversity"))


@query(f"WITH {_PAIRS}, g AS (SELECT label, count(*) AS pairs, avg(sqrt(d2)) AS m FROM p WHERE label = query_label GROUP BY 1) SELECT count(*) AS groups, round(avg(m), 6) AS over_groups, round(sum(m * pairs) / sum(pairs), 6) AS over_pairs FROM g")
def multimodality(spark, sf_dir):
    """Mean distance within labels, of the stated queries to all rows: averaged over groups and over pairs."""
    g = _pairs(spark, sf_dir).filter("label = query_label").groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.sqrt("d2")).alias("m"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("m"), 6).alias("over_groups"), F.round(F.sum(F.col("m") * F.col("pairs")) / F.sum("pairs"), 6).alias("over_pairs"))


@query(f"""WITH {_ALL_PAIRS}, t AS (SELECT quantile_cont(-d2, 0.95) AS cut FROM p WHERE label <> query_label) SELECT round(-any_value(cut), 5) AS threshold, round(avg(CASE WHEN label = query_label THEN (-d2 >= cut)::INT END), 6) AS recall, round(avg(CASE WHEN label <> query_label THEN (-d2 >= cut)::INT END), 6) AS false_rate FROM p, t""")
def operating_point(spark, sf_dir):
    """The distance within which 5 % of the pairs of different labels are, and the share of those of equal labels there."""
    # The 0.95-quantile of the negative distances.
    found = strips.operating_point(_vectors(spark, sf_dir).filter("label is not null"), "vec_id", "embedding", "label", 0.95)
    if found is None:
        return spark.createDataFrame([(None, None, None)], "threshold double, recall double, false_rate double")
    cut, sums = found
    share = lambda c: F.round(F.try_divide(F.sum(f"{c}_hit"), F.sum(c)), 6)
    return sums.agg(F.round(F.lit(cut), 5).alias("threshold"), share("same").alias("recall"), share("other").alias("false_rate"))


@query(f"WITH p AS (SELECT q.vec_id AS a, r.vec_id AS b, q.label AS la, r.label AS lb, round({_DOT} / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(r.embedding, lambda x: x::DOUBLE * x))), 6) AS cosine FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) SELECT a, b, cosine FROM p WHERE cosine >= 0.2 AND la = lb")
def blocked_candidates(spark, sf_dir):
    """Pairs above a cosine within one class, of the stated queries."""
    v = _vectors(spark, sf_dir)
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("qv"))
    met = retrieval.against(q, v.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("rv"))).filter("a <> b and la = lb")
    return met.select("a", "b", F.round(V.cosine(F.col("qv"), F.col("rv")), 6).alias("cosine")).filter("cosine >= 0.2")


@query(f"WITH {_DIMS}, {_CENTERS}, n AS (SELECT label, sqrt(sum(mu * mu)) AS norm FROM c GROUP BY 1) SELECT a.label AS left_label, b.label AS right_label, round(sum(a.mu * b.mu) / (any_value(na.norm) * any_value(nb.norm)), 6) AS cosine FROM c a JOIN c b USING (dim) JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2")
def class_compatibility(spark, sf_dir):
    """Cosine of every two class means, zero for a zero mean (the pairs are of classes, not rows)."""
    c = retrieval.centroids(_vectors(spark, sf_dir), "embedding", "label").select("label", "center")
    both = retrieval.against(c.select(F.col("label").alias("left_label"), F.col("center").alias("x")), c.select(F.col("label").alias("right_label"), F.col("center").alias("y")))
    return both.select("left_label", "right_label", F.round(F.coalesce(V.cosine(F.col("x"), F.col("y")), F.lit(0.0)), 6).alias("cosine"))


@query(f"WITH {_DIMS}, m AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM e GROUP BY 1), s AS (SELECT vec_id, 2 * (x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END - 1 AS y, x, lo, hi FROM e JOIN m USING (dim)) SELECT vec_id, round(avg(y), 6) AS mean_scaled, round(min(y), 6) AS low_scaled, round(max(abs(lo + (y + 1) / 2 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END - x)), 6) AS inverse_error FROM s GROUP BY 1")
def minmax_and_inverse(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    m = retrieval.moments(v, "embedding").select("dim", "low", F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0).alias("range"))
    s = v.select("vec_id", F.posexplode("embedding").alias("dim", "x")).join(F.broadcast(m), "dim").withColumn("x", F.col("x").cast("double")).withColumn("y", 2 * (F.col("x") - F.col("low")) / F.col("range") - 1)
    back = F.abs(F.col("low") + (F.col("y") + 1) / 2 * F.col("range") - F.col("x"))
    return s.groupBy("vec_id").agg(F.round(F.avg("y"), 6).alias("mean_scaled"), F.round(F.min("y"), 6).alias("low_scaled"), F.round(F.max(back), 6).alias("inverse_error"))


@query("SELECT count(*) AS n, sum((list_bool_and(list_transform(embedding, lambda x: isfinite(x))))::INT)::BIGINT AS finite FROM embeddings")
def finite_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(V.finite(F.col("embedding"))).alias("finite"))


@query()
def frechet_distance(spark, sf_dir):
    """Of the vectors of even and odd labels; the root of a matrix is beyond SQL, so it is held against NumPy."""
    v = _vectors(spark, sf_dir)
    d = stats.frechet(v.filter("label % 2 = 0"), v.filter("label % 2 = 1"), "embedding")
    return d.select(F.round("frechet", 6).alias("frechet"))


# --- ranks -------------------------------------------------------------------


@query("""WITH x AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM x GROUP BY 1), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
u AS (SELECT sum(p * below + p * q / 2) AS u, sum(p)::BIGINT AS n1, sum(q)::BIGINT AS n2 FROM b) SELECT n1 AS positives, n2 AS negatives, round(u, 1) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6) AS z FROM u""")
def mann_whitney(spark, sf_dir):
    x = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    a = stats.rank_auc(x, "n_chars", F.col("quality") == 1, digits=None)
    n1, n2 = F.col("positives"), F.col("negatives")
    u = F.col("auc") * n1 * n2
    return a.select("positives", "negatives", F.round(u, 1).alias("u"), F.round((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 6).alias("z"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F') SELECT o.o_orderkey, s.r AS rank FROM orders o LEFT JOIN s USING (o_orderkey)""")
def rank_among_survivors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = ranks.row_numbers(o.filter("o_orderstatus <> 'F'"), "o_custkey", ["o_totalprice", "o_orderkey"], "at", timeline.BLOCK)
    return o.select("o_orderkey").join(s.select("o_orderkey", (F.col("at") + 1).alias("rank")), "o_orderkey", "left")


@query("""WITH p AS (SELECT source, avg(quality) AS q, avg(n_chars) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b FROM p) SELECT count(*) AS parts, round(corr(a, b), 6) AS spearman FROM r""")
def order_agreement(spark, sf_dir):
    """Spearman of two scores over sources; ranks from counts of smaller and equal scores, so few rows per source."""
    p = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("q"), F.avg("n_chars").alias("n"))
    r = ranks.mean_ranks(ranks.mean_ranks(p, "q", "a"), "n", "b")
    return r.agg(F.count(F.lit(1)).alias("parts"), F.round(F.corr("a", "b"), 6).alias("spearman"))
