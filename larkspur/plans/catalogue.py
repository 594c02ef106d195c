"""All queries of the library, by name, with the DuckDB SQL of those that SQL can express.

The driver's tables stand in for the domain's: documents are recordings with
contents, sources and languages; orders and lineitems are sources and their
sequences; events are a timeline per user; embeddings are segment vectors
with classes; labels are acceptance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import vectors as V
from larkspur.operators import contracts, graph, quantiles, ranks, retrieval, splits, stats, strips, timeline
from larkspur.plans import artifacts, bars, boundaries, controls, drafts, leakage, measures, nulls, planning, records, repetition, segments  # noqa: F401  they register their queries
from larkspur.plans.registry import oracle_sql, queries, query  # noqa: F401
from larkspur.session import shared_folder, table
from larkspur.streaming import events as streaming

_SPLIT = """r AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents),
s AS (SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a split and the hash of their text, which is all that the ranks' exchanges carry of it."""
    hashed = _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("hash"))
    return splits.rank_split(hashed, "doc_id")


# --- splits and leakage -------------------------------------------------------


@query(f"""WITH {_SPLIT} SELECT sha256(text) AS content_sha256, count(*) AS members, min(doc_id) AS first_id,
count(DISTINCT split) AS n_splits, count(DISTINCT split) > 1 AS cross_split_collision FROM s GROUP BY 1 HAVING count(*) > 1""")
def cross_split_duplicates(spark, sf_dir):
    return splits.duplicate_groups(_split_docs(spark, sf_dir), "doc_id", "hash", "split", hashed=True)


@query("SELECT sha256(text) AS content_sha256, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return splits.duplicate_groups(_docs(spark, sf_dir), "doc_id", "text")


@query(f"WITH {_SPLIT} SELECT doc_id, split FROM s")
def stable_hash_split(spark, sf_dir):
    return _split_docs(spark, sf_dir).select("doc_id", "split")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def genre_rank_split(spark, sf_dir):
    return splits.rank_split(_docs(spark, sf_dir), "doc_id", by=["lang"]).select("doc_id", "lang", "split")


_FILL = """g AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS mass, count(*) AS members FROM documents GROUP BY 1),
f AS (SELECT *, coalesce(sum(mass) OVER (ORDER BY mass DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(mass) OVER () AS total FROM g)"""


@query(f"""WITH {_FILL} SELECT source, mass, members, CASE WHEN before < total * 0.8 THEN 'train' WHEN before < total * 0.9 THEN 'val' ELSE 'test' END AS split FROM f""")
def account_greedy_split(spark, sf_dir):
    return splits.group_fill_split(_docs(spark, sf_dir), "source", "n_chars")


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS mass, count(DISTINCT sha256(text)) AS contents FROM s GROUP BY 1")
def split_summary(spark, sf_dir):
    s = _split_docs(spark, sf_dir).withColumnRenamed("hash", "h")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("mass"), F.count_distinct("h").alias("contents"))


@query(f"WITH {_SPLIT}, k AS (SELECT DISTINCT split, source FROM s) SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM k a JOIN k b USING (source) WHERE a.split < b.split GROUP BY 1, 2")
def shared_sources_between_splits(spark, sf_dir):
    return splits.shared_between(_split_docs(spark, sf_dir), "source")


@query(f"""WITH {_SPLIT}, k AS (SELECT split, 'source' AS key, source AS value FROM s UNION ALL SELECT split, 'hash', sha256(text) FROM s)
SELECT key, value, count(DISTINCT split) AS n_splits, count(*) AS members FROM k GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def group_spans_splits(spark, sf_dir):
    return splits.spanning_groups(_split_docs(spark, sf_dir), ["source", "hash"])


# --- contracts ---------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_violations(spark, sf_dir):
    return contracts.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, count(*) AS rows FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def fk_orphans(spark, sf_dir):
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return contracts.orphans(table(spark, sf_dir, "lineitem"), finished, "l_orderkey", "o_orderkey")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus IS DISTINCT FROM s THEN 'status' END, CASE WHEN d IS DISTINCT FROM od THEN 'day' END) AS differing
FROM (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS od FROM orders) JOIN
(SELECT l_orderkey, max(l_linestatus) AS s, strftime(min(l_shipdate), '%Y-%m-%d') AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderstatus IS DISTINCT FROM s OR d IS DISTINCT FROM od""")
def fk_attribute_disagreement(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), day("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"), day(F.min("l_shipdate")).alias("day"))
    return contracts.disagreements(orders, lines, ["o_orderkey"], ["status", "day"])


def _qc(spark, sf_dir):
    joined = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [("missing_label", F.col("quality").isNull()), ("not_accepted", F.col("quality") != 1), ("toxic", F.col("toxic") == 1), ("too_short", F.col("n_chars") < 400)]
    return joined, rules


@query("""SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'missing_label' WHEN quality <> 1 THEN 'not_accepted'
WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 400 THEN 'too_short' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def qc_reasons(spark, sf_dir):
    df, rules = _qc(spark, sf_dir)
    return contracts.first_reason(df, rules).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'missing_label' END, CASE WHEN quality <> 1 THEN 'not_accepted' END,
CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 400 THEN 'too_short' END) AS reasons FROM documents LEFT JOIN labels USING (doc_id)""")
def qc_all_reasons(spark, sf_dir):
    return contracts.all_reasons(*_qc(spark, sf_dir)).select("doc_id", "reasons")


@query("SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND n_chars >= 400")
def accepted_documents(spark, sf_dir):
    df, rules = _qc(spark, sf_dir)
    return contracts.first_reason(df, rules).filter("reason is null").select("doc_id", "source")


@query(r"""SELECT CASE WHEN a IS NULL THEN 'only right' WHEN b IS NULL THEN 'only left' WHEN h = g THEN 'same' ELSE 'differs' END AS verdict, count(*) AS rows
FROM (SELECT doc_id AS a, sha256(text) AS h FROM documents) FULL JOIN (SELECT doc_id AS b, sha256(regexp_replace(text, '[0-9]+', '#', 'g')) AS g FROM documents SEMI JOIN labels USING (doc_id)) ON a = b GROUP BY 1""")
def census_diff(spark, sf_dir):
    """All documents against the version of the labelled ones in which numbers are masked."""
    d = _docs(spark, sf_dir)
    masked = d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    left = d.select("doc_id", F.sha2("text", 256).alias("h"))
    right = masked.select("doc_id", F.sha2(F.regexp_replace("text", "[0-9]+", "#"), 256).alias("h"))
    return contracts.compared(left, right, "doc_id", "h")


# --- timelines ---------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _frames(spark, sf_dir):
    return timeline.frames(_events(spark, sf_dir), "user_id", ["ts", "event_id"])


_FRAMES = "f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
_RUNS = f"""{_FRAMES}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS island FROM f),
runs AS (SELECT user_id, event_type, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS length FROM g GROUP BY user_id, event_type, island)"""


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event_per_user(spark, sf_dir):
    return ranks.first_rows(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {_RUNS} SELECT user_id, event_type, start, stop AS "end", length FROM runs""")
def label_runs(spark, sf_dir):
    return timeline.runs(_frames(spark, sf_dir), "user_id", "frame", "event_type").select("user_id", "event_type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "length")


@query(f"WITH {_RUNS} SELECT user_id, event_type, max(length) AS longest FROM runs GROUP BY 1, 2")
def longest_hold(spark, sf_dir):
    return timeline.runs(_frames(spark, sf_dir), "user_id", "frame", "event_type").groupBy("user_id", "event_type").agg(F.max("length").alias("longest"))


@query(f"WITH {_RUNS} SELECT user_id, count(*) AS runs, sum(length)::BIGINT AS frames, round((count(*) - 1) / sum(length), 6) AS change_rate FROM runs GROUP BY 1")
def change_rate(spark, sf_dir):
    runs = timeline.runs(_frames(spark, sf_dir), "user_id", "frame", "event_type")
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("length").alias("frames"), F.round((F.count(F.lit(1)) - 1) / F.sum("length"), 6).alias("change_rate"))


@query("""WITH f AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame FROM conversations),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY conv_id, role ORDER BY frame) AS island FROM f),
r AS (SELECT conv_id, role, count(*) AS length FROM g GROUP BY conv_id, role, island)
SELECT conv_id, count(*) AS runs, max(length) AS longest, round(avg(length), 6) AS mean_length FROM r GROUP BY 1""")
def bar_shape(spark, sf_dir):
    turns = timeline.frames(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])
    return timeline.runs(turns, "conv_id", "frame", "role").groupBy("conv_id").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean_length"))


@query(f"""WITH {_FRAMES}, c AS (SELECT user_id, frame // 8 AS bar, event_type, count(*) AS votes FROM f GROUP BY ALL)
SELECT user_id, bar, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bar ORDER BY votes DESC, event_type) AS n FROM c) WHERE n = 1""")
def majority_label_per_window(spark, sf_dir):
    bars = _frames(spark, sf_dir).withColumn("bar", F.floor(F.col("frame") / 8))
    return ranks.majority(bars, ["user_id", "bar"], "event_type")


@query(f"""WITH {_FRAMES}, v AS (SELECT a.user_id, a.frame, a.event_type, b.event_type AS vote, count(*) AS votes FROM f a JOIN f b ON a.user_id = b.user_id AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 GROUP BY ALL)
SELECT user_id, frame, event_type, vote AS voted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, frame ORDER BY votes DESC, (vote = event_type)::INT DESC, vote) AS n FROM v) WHERE n = 1""")
def centered_vote(spark, sf_dir):
    return timeline.centered_vote(_frames(spark, sf_dir).withColumn("frame", F.col("frame").cast("long")), "user_id", "frame", "event_type", 2)


_LENGTHS = "n AS (SELECT user_id, count(*) AS frames FROM events GROUP BY 1)"


def _lengths(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))


@query(f"""WITH {_LENGTHS}, w AS (SELECT user_id, unnest(range(0, frames - 15, 16)) AS start FROM n WHERE frames >= 16) SELECT user_id, (start // 16)::INT AS "window", start, start + 16 AS "end" FROM w""")
def fixed_windows(spark, sf_dir):
    return timeline.windows(_lengths(spark, sf_dir), "user_id", "frames", 16, 16)


@query(f"""WITH {_LENGTHS}, w AS (SELECT user_id, unnest(range(0, frames - 15, 4)) AS start FROM n WHERE frames >= 16) SELECT user_id, (start // 4)::INT AS "window", start, start + 16 AS "end" FROM w""")
def sliding_windows(spark, sf_dir):
    return timeline.windows(_lengths(spark, sf_dir), "user_id", "frames", 16, 4)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    w = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 3600 THEN 0 ELSE 1 END AS fresh FROM e),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS events, min(s) AS begin_s, max(s) AS end_s FROM k GROUP BY 1, 2""")
def sessions(spark, sf_dir):
    return timeline.sessions(_events(spark, sf_dir), "user_id", F.unix_micros("ts") / 1e6, 3600.0)


@query(f"""WITH {_FRAMES}, w AS (SELECT user_id, frame, event_type, unnest(range(greatest(0, ((frame - 8 + 4) // 4)), frame // 4 + 1)) * 4 AS start FROM f WHERE frame >= 0),
v AS (SELECT user_id, start, event_type, count(*) AS votes FROM w WHERE start <= frame AND frame < start + 8 GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, start ORDER BY votes DESC, event_type) AS n FROM v) WHERE n = 1),
p AS (SELECT a.user_id, a.start, a.event_type AS x, b.event_type AS y FROM m a JOIN m b ON a.user_id = b.user_id AND b.start = a.start + 4)
SELECT user_id, count(*) AS overlaps, sum((x <> y)::INT)::BIGINT AS conflicts FROM p GROUP BY 1""")
def stitch_conflicts(spark, sf_dir):
    shown = timeline.in_windows(_frames(spark, sf_dir), "frame", 8, 4)
    labels = ranks.majority(shown, ["user_id", "start"], "event_type")
    pairs = timeline.near(labels, "user_id", "start", 4, lambda w: {"y": F.lead("event_type").over(w)}).filter("y is not null")
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("overlaps"), F.sum((F.col("event_type") != F.col("y")).cast("long")).alias("conflicts"))


@query(f"""WITH {_FRAMES}, w AS (SELECT user_id, frame // 8 AS bar, count(DISTINCT event_type) AS labels, count(*) AS frames, max(cnt) AS top FROM (SELECT *, count(*) OVER (PARTITION BY user_id, frame // 8, event_type) AS cnt FROM f) GROUP BY 1, 2)
SELECT user_id, bar, labels, frames, round(top / frames, 6) AS agreement FROM w""")
def window_label_agreement(spark, sf_dir):
    bars = _frames(spark, sf_dir).withColumn("bar", F.floor(F.col("frame") / 8)).groupBy("user_id", "bar", "event_type").agg(F.count(F.lit(1)).alias("c"))
    return bars.groupBy("user_id", "bar").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("frames"), F.round(F.max("c") / F.sum("c"), 6).alias("agreement"))


_NEAR = """q AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), b AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
near AS (SELECT q.user_id, q.event_id, q.t, p.t AS before, n.t AS after FROM q ASOF LEFT JOIN b p ON q.user_id = p.user_id AND q.t >= p.t ASOF LEFT JOIN b n ON q.user_id = n.user_id AND q.t <= n.t),
d AS (SELECT *, least(t - before, after - t) AS distance FROM near)"""


def _near(spark, sf_dir):
    is_type = lambda x: F.col("event_type") == x
    return timeline.nearest_events(_events(spark, sf_dir), "user_id", F.unix_micros("ts"), is_type("view"), is_type("click"), "event_id")


@query(f"WITH {_NEAR} SELECT user_id, event_id, t, before, after, distance FROM d")
def nearest_beat(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"WITH {_NEAR} SELECT user_id, count(*) AS beats, round(avg(exp(-power(distance / 6e8, 2) / 2)), 6) AS score FROM d WHERE distance IS NOT NULL GROUP BY 1")
def beat_alignment_score(spark, sf_dir):
    near = _near(spark, sf_dir).filter("distance is not null")
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("beats"), F.round(F.avg(F.exp(-F.pow(F.col("distance") / 6e8, 2) / 2)), 6).alias("score"))


@query(f"WITH {_NEAR} SELECT user_id, count(*) AS n, sum((distance <= 1800000000)::INT)::BIGINT AS hits, round(avg((distance <= 1800000000)::INT), 6) AS hit_rate FROM d WHERE distance IS NOT NULL GROUP BY 1")
def hit_rate(spark, sf_dir):
    near = _near(spark, sf_dir).filter("distance is not null").withColumn("hit", (F.col("distance") <= 1_800_000_000).cast("long"))
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query(f"WITH {_NEAR} SELECT user_id, event_id, round((t - before) / (after - before), 6) AS phase FROM d WHERE before IS NOT NULL AND after > before")
def beat_phase(spark, sf_dir):
    inside = _near(spark, sf_dir).filter("before is not null and after > before")
    return inside.select("user_id", "event_id", F.round((F.col("t") - F.col("before")) / (F.col("after") - F.col("before")), 6).alias("phase"))


@query(f"WITH {_NEAR} SELECT LEAST(floor((t - before) / (after - before) * 8), 7)::BIGINT AS bin, count(*) AS n FROM d WHERE before IS NOT NULL AND after > before GROUP BY 1")
def beat_phase_profile(spark, sf_dir):
    inside = _near(spark, sf_dir).filter("before is not null and after > before")
    bin_ = F.least(F.floor((F.col("t") - F.col("before")) / (F.col("after") - F.col("before")) * 8), F.lit(7)).cast("long")
    return inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FRAMES} SELECT user_id, event_id, frame FROM f WHERE frame % 4 = 0")
def every_kth_event(spark, sf_dir):
    return _frames(spark, sf_dir).filter("frame % 4 = 0").select("user_id", "event_id", F.col("frame").cast("long").alias("frame"))


@query(f"""WITH {_FRAMES}, p AS (SELECT user_id, frame % 4 AS phase, round(sum(value), 4) AS strength FROM f GROUP BY 1, 2)
SELECT user_id, phase, strength FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, phase) AS n FROM p) WHERE n = 1""")
def best_phase(spark, sf_dir):
    p = _frames(spark, sf_dir).withColumn("phase", (F.col("frame") % 4).cast("long")).groupBy("user_id", "phase").agg(F.round(F.sum("value"), 4).alias("strength"))
    return ranks.first_rows(p, ["user_id"], [F.desc("strength"), F.asc("phase")])


@query(f"""WITH {_FRAMES}, g AS (SELECT user_id, frame, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY frame) AS d, lead(value) OVER (PARTITION BY user_id ORDER BY frame) - value AS e FROM f)
SELECT user_id, frame, value FROM g WHERE d > 0 AND e < 0""")
def accent_frames(spark, sf_dir):
    sides = lambda w: {"d": F.col("value") - F.lag("value").over(w), "e": F.lead("value").over(w) - F.col("value")}
    g = timeline.near(_frames(spark, sf_dir), "user_id", "frame", 1, sides)
    return g.filter("d > 0 and e < 0").select("user_id", F.col("frame").cast("long").alias("frame"), "value")


@query(f"""WITH {_FRAMES}, g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY frame) AS gap FROM f)
SELECT user_id, count(gap) AS gaps, max(gap) AS longest, sum(CASE WHEN gap > 86400000000 THEN 1 ELSE 0 END)::BIGINT AS breaks FROM g GROUP BY 1""")
def gap_summary(spark, sf_dir):
    g = timeline.near(_frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"gap": F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)})
    return g.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.max("gap").alias("longest"), F.sum(F.when(F.col("gap") > 86_400_000_000, 1).otherwise(0)).alias("breaks"))


@query(f"""WITH {_FRAMES}, t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS b FROM f)
SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS p FROM t WHERE b IS NOT NULL GROUP BY a, b""")
def transitions(spark, sf_dir):
    t = timeline.near(_frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"b": F.lead("event_type").over(w)}).filter("b is not null")
    counts = t.groupBy(F.col("event_type").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))


# --- vectors -----------------------------------------------------------------


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


_DIMS = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings)"


@query(f"WITH {_DIMS} SELECT dim::INT AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(min(x), 6) AS low, round(max(x), 6) AS high, count(*) AS n FROM e GROUP BY 1")
def dimension_moments(spark, sf_dir):
    m = retrieval.moments(_vectors(spark, sf_dir), "embedding")
    return m.select("dim", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "low", "high")], "n")


@query(f"""WITH {_DIMS}, m AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM e GROUP BY 1)
SELECT vec_id, round(sum(abs((x - mu) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END)), 4) AS l1, round(sum(power((x - mu) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END, 2)), 4) AS l2 FROM e JOIN m USING (dim) GROUP BY 1""")
def zscore_embeddings(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    m = retrieval.moments(df, "embedding").withColumn("sd", F.when(F.col("deviation") < 1e-9, 1.0).otherwise(F.col("deviation")))
    each = df.select("vec_id", F.posexplode("embedding").alias("dim", "x")).join(m.select("dim", "mean", "sd"), "dim").withColumn("z", (F.col("x").cast("double") - F.col("mean")) / F.col("sd"))
    return each.groupBy("vec_id").agg(F.round(F.sum(F.abs("z")), 4).alias("l1"), F.round(F.sum(F.col("z") * F.col("z")), 4).alias("l2"))


@query(f"""WITH {_DIMS}, m AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM e GROUP BY 1) SELECT vec_id, round(avg((x - lo) / (hi - lo)), 6) AS mean_scaled, round(max((x - lo) / (hi - lo)), 6) AS top_scaled FROM e JOIN m USING (dim) WHERE hi > lo GROUP BY 1""")
def minmax_embeddings(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    m = retrieval.moments(df, "embedding").filter("high > low").select("dim", "low", "high")
    s = df.select("vec_id", F.posexplode("embedding").alias("dim", "x")).join(m, "dim").withColumn("s", (F.col("x").cast("double") - F.col("low")) / (F.col("high") - F.col("low")))
    return s.groupBy("vec_id").agg(F.round(F.avg("s"), 6).alias("mean_scaled"), F.round(F.max("s"), 6).alias("top_scaled"))


_CENTERS = "c AS (SELECT label, dim, avg(x) AS mu FROM e GROUP BY 1, 2)"
_ASSIGNED = f"""{_DIMS}, {_CENTERS}, d AS (SELECT vec_id, e.label, c.label AS assigned, round(sum(power(x - mu, 2)), 6) AS distance FROM e JOIN c USING (dim) GROUP BY 1, 2, 3),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, assigned) AS n FROM d) WHERE n = 1)"""


@query(f"WITH {_DIMS}, {_CENTERS} SELECT label, round(sqrt(sum(mu * mu)), 6) AS center_norm, round(sum(mu), 6) AS center_sum FROM c GROUP BY 1")
def label_centroids(spark, sf_dir):
    c = retrieval.centroids(_vectors(spark, sf_dir), "embedding", "label")
    return c.select("label", F.round(V.norm(F.col("center")), 6).alias("center_norm"), F.round(V.total(F.col("center")), 6).alias("center_sum"))


def _assigned(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return retrieval.assign(df, "vec_id", "embedding", retrieval.centroids(df, "embedding", "label"), "label")


@query(f"WITH {_ASSIGNED} SELECT vec_id, assigned, distance FROM a")
def nearest_centroid(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query(f"WITH {_ASSIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY assigned ORDER BY distance) AS k, count(*) OVER (PARTITION BY assigned) AS n2 FROM a), t AS (SELECT assigned, max(distance) AS cut FROM r WHERE k <= ceil(n2 * 0.9) GROUP BY 1) SELECT assigned, cut, sum((distance <= cut)::INT)::BIGINT AS accepted, count(*) AS n FROM a JOIN t USING (assigned) GROUP BY 1, 2")
def accept_by_quantile(spark, sf_dir):
    """The cut is found from counts per distance, so a label's rows are not sorted together."""
    counts = quantiles.counted(_assigned(spark, sf_dir), "assigned", "distance")
    reached = F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(0.9)), F.struct(F.col("distance").alias("cut"), F.col("upto").alias("accepted")))
    return counts.groupBy("assigned").agg(F.min(reached).alias("r"), F.max("n").alias("n")).select("assigned", "r.cut", "r.accepted", "n")


@query(f"WITH {_ASSIGNED}, k AS (SELECT assigned, label, count(*) AS n FROM a GROUP BY 1, 2) SELECT assigned, max(n) AS largest, sum(n)::BIGINT AS members, round(max(n) / sum(n), 6) AS purity FROM k GROUP BY 1")
def purity(spark, sf_dir):
    k = _assigned(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id").groupBy("assigned", "label").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("assigned").agg(F.max("n").alias("largest"), F.sum("n").alias("members"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


_TOP = """p AS (SELECT q.vec_id AS query_id, q.label AS query_label, r.vec_id AS row_id, r.label, round(list_sum(list_transform(range(1, 65), lambda i: power(q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE, 2))), 6) AS distance
FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM p)"""


#: The same with every row as a query.
_ALL_TOP = _TOP.replace(" WHERE q.vec_id % 100 = 0", "")


def _neighbours(spark, sf_dir, k, every=True):
    """The k nearest other rows of every row, or of ids divisible by 100."""
    df = _vectors(spark, sf_dir)
    near = strips.nearest(df, "vec_id", "embedding", "label", k) if every else retrieval.nearest(df.filter("vec_id % 100 = 0"), df, "vec_id", "embedding", "label", k)
    label = lambda c: F.nanvl(c, F.lit(None).cast("double")).cast("int")
    return near.select("query_id", label(F.col("query_mark")).alias("query_label"), "row_id", label(F.col("mark")).alias("label"), "distance", "rank")


@query(f"WITH {_ALL_TOP} SELECT query_id, row_id, distance, rank FROM t WHERE rank <= 10")
def topk_neighbours(spark, sf_dir):
    return _neighbours(spark, sf_dir, 10).select("query_id", "row_id", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ALL_TOP} SELECT query_id, query_label, max((rank <= 1 AND label = query_label)::INT) AS hit_1, max((rank <= 5 AND label = query_label)::INT) AS hit_5, max((label = query_label)::INT) AS hit_10 FROM t WHERE rank <= 10 GROUP BY 1, 2")
def r_precision(spark, sf_dir):
    same = F.col("label") == F.col("query_label")
    hit = lambda k: F.max(((F.col("rank") <= k) & same).cast("int")).alias(f"hit_{k}")
    return _neighbours(spark, sf_dir, 10).groupBy("query_id", "query_label").agg(hit(1), hit(5), hit(10))


@query(f"WITH {_TOP} SELECT query_id, distance AS novelty FROM t WHERE rank = 1")
def novelty(spark, sf_dir):
    return _neighbours(spark, sf_dir, 1, every=False).select("query_id", F.col("distance").alias("novelty"))


@query(f"WITH {_DIMS}, s AS (SELECT dim, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM e GROUP BY 1) SELECT max(n) AS n, round(sqrt(sum(2 * (n * q - s * s)) / (max(n) * (max(n) - 1))), 6) AS diversity FROM s")
def rms_spread(spark, sf_dir):
    """Root mean squared distance of all pairs, from sums (no pair is formed).

    Not the reference's diversity, which is the mean distance and never larger.
    """
    e = _vectors(spark, sf_dir).select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    s = e.groupBy("dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    return s.agg(F.max("n").alias("n"), F.round(F.sqrt(F.sum(2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s"))) / (F.max("n") * (F.max("n") - 1))), 6).alias("diversity"))


@query(f"WITH {_DIMS}, s AS (SELECT label, dim, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM e GROUP BY 1, 2) SELECT label, max(n) AS n, round(sqrt(sum(2 * (n * q - s * s)) / (max(n) * (max(n) - 1))), 5) AS spread FROM s GROUP BY 1 HAVING max(n) > 1")
def rms_spread_by_label(spark, sf_dir):
    """Root mean squared distance of the pairs of each label; not the reference's multimodality."""
    e = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    s = e.groupBy("label", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    out = s.groupBy("label").agg(F.max("n").alias("n"), F.sum(2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s"))).alias("w"))
    return out.filter("n > 1").select("label", "n", F.round(F.sqrt(F.col("w") / (F.col("n") * (F.col("n") - 1))), 5).alias("spread"))


# --- statistics --------------------------------------------------------------


@query("""WITH x AS (SELECT n_chars AS s, toxic AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM x GROUP BY 1),
b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives, round(sum(p * below + p * q / 2) / (sum(p) * sum(q)), 6) AS auc FROM b""")
def rank_auc(spark, sf_dir):
    x = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.rank_auc(x, "n_chars", F.col("toxic") == 1)


@query("""WITH c AS (SELECT source, sum((lang = 'en')::INT) AS a, sum((lang = 'fr')::INT) AS b FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1),
p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c), m AS (SELECT *, (p + q) / 2 AS m FROM p)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / m) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) / 2 ELSE 0 END), 6) AS js_bits, count(*) AS "values" FROM m""")
def js_divergence(spark, sf_dir):
    return stats.js_divergence(_docs(spark, sf_dir), "lang", "source", "en", "fr")


@query("""WITH e AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS x, avg(CASE WHEN event_type = 'view' THEN value END) AS y FROM events GROUP BY 1),
w AS (SELECT sum((x > y)::INT)::BIGINT AS wins, sum((x < y)::INT)::BIGINT AS losses, sum((x = y)::INT)::BIGINT AS ties FROM e),
t AS (SELECT *, wins + losses AS n, unnest(range(greatest(wins, losses), wins + losses + 1)) AS k FROM w)
SELECT wins, losses, ties, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 9) AS p FROM t GROUP BY ALL""")
def sign_test(spark, sf_dir):
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    users = _events(spark, sf_dir).groupBy("user_id").agg(mean("click").alias("x"), mean("view").alias("y"))
    return stats.sign_test(users, F.col("x"), F.col("y"))


@query("""WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS k, count(*) OVER () AS n FROM documents)
SELECT q AS rule, n_chars AS quantile, n FROM r JOIN (VALUES ('nearest', 0.95), ('ceil', 0.95)) v(q, f) ON k = CASE WHEN q = 'ceil' THEN ceil(f * n) ELSE round_even(f * (n - 1), 0) + 1 END""")
def nearest_rank_quantile(spark, sf_dir):
    d = _docs(spark, sf_dir)
    one = lambda rule: ranks.ranked_quantile(d, "n_chars", 0.95, rule).select(F.lit(rule).alias("rule"), "quantile", "n")
    return one("nearest").union(one("ceil"))


@query("SELECT source, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90 FROM documents GROUP BY 1")
def linear_quantiles(spark, sf_dir):
    found = quantiles.linear(_docs(spark, sf_dir), "source", "n_chars", {"p50": 0.5, "p90": 0.9})
    return found.select("source", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


@query("SELECT floor(log2(greatest(n_chars, 1)))::BIGINT AS bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS mass FROM documents GROUP BY 1")
def bucket_histogram(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("mass"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS mass, grouping(lang)::INT AS no_lang, grouping(source)::INT AS no_source FROM documents GROUP BY CUBE (lang, source)")
def grouping_sets_population(spark, sf_dir):
    return _docs(spark, sf_dir).cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("mass"), F.grouping("lang").cast("int").alias("no_lang"), F.grouping("source").cast("int").alias("no_source"))


@query("SELECT source, round(corr(n_chars, length(text)), 6) AS r, round(covar_samp(n_chars, doc_id), 3) AS cov FROM documents GROUP BY 1")
def correlations(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.round(F.corr("n_chars", F.length("text")), 6).alias("r"), F.round(F.covar_samp("n_chars", "doc_id"), 3).alias("cov"))


_USERS = "u AS (SELECT user_id, avg(value) AS x, (user_id % 3 = 0)::INT AS g FROM events GROUP BY 1)"


def _users(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("x"))


@query(f"""WITH {_USERS}, r AS (SELECT *, unnest(range(0, 101)) AS round FROM u), k AS (SELECT sum(g) AS k FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY ('0x' || substr(sha256('42:' || round || ':' || user_id), 1, 8))::BIGINT, user_id) AS nth FROM r),
d AS (SELECT round, round(abs(avg(CASE WHEN h THEN x END) - avg(CASE WHEN NOT h THEN x END)), 9) AS d FROM (SELECT *, CASE WHEN round = 0 THEN g = 1 ELSE nth <= k END AS h FROM n, k) GROUP BY 1)
SELECT round(max(s.d), 6) AS difference, round((sum((d.d >= s.d)::INT) + 1) / 101, 6) AS p_value FROM d, (SELECT d FROM d WHERE round = 0) s WHERE round > 0""")
def permutation_p(spark, sf_dir):
    return stats.permutation_p(_users(spark, sf_dir), "user_id", "x", F.col("user_id") % 3 == 0)


@query(f"""WITH {_USERS}, i AS (SELECT x, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM u), d AS (SELECT i.i, n, unnest(range(1, 101)) AS round FROM i),
t AS (SELECT round, ('0x' || substr(sha256('42:' || round || ':' || i), 1, 8))::BIGINT % n AS i FROM d), m AS (SELECT round, avg(x) AS m FROM t JOIN i USING (i) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS rounds FROM m""")
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap_mean(_users(spark, sf_dir), "user_id", "x")


@query()
def approx_distinct(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("texts"), F.approx_count_distinct("source", 0.02).alias("sources"))


# --- graph -------------------------------------------------------------------

_EDGES = """h AS (SELECT doc_id, sha256(text) AS g FROM documents UNION ALL SELECT doc_id, source || ':' || lang || ':' || (n_chars // 500) FROM documents),
e AS (SELECT min(doc_id) OVER (PARTITION BY g) AS u, doc_id AS v FROM h)"""


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), r(id, l) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.v, r.l FROM r JOIN b ON b.u = r.id WHERE r.l < b.v)
SELECT id AS doc_id, min(l) AS component FROM r GROUP BY 1""")
def same_source_components(spark, sf_dir):
    d = _docs(spark, sf_dir)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    keyed = d.select("doc_id", F.sha2("text", 256).alias("hash"), F.concat_ws(":", "source", "lang", F.floor(F.col("n_chars") / 500).cast("string")).alias("kind"))
    return graph.components(graph.star_edges(keyed, "doc_id", ["hash", "kind"]), keyed, "doc_id")




@query("""WITH s AS (SELECT DISTINCT source, lang FROM documents), n AS (SELECT count(DISTINCT lang) AS n FROM documents)
SELECT source, count(*) AS langs FROM s GROUP BY 1 HAVING count(*) = (SELECT n FROM n)""")
def complete_groups(spark, sf_dir):
    d = _docs(spark, sf_dir).select("source", "lang").distinct()
    every = d.agg(F.count_distinct("lang").alias("n_all"))
    return d.groupBy("source").agg(F.count("lang").alias("langs")).join(every, F.col("langs") == F.col("n_all")).select("source", "langs")


# --- strings, sets, joins ----------------------------------------------------


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0")
def benchmark_contamination(spark, sf_dir):
    """Items contained in documents. The inner words of an item are whole words
    of a document that contains it, so the hash of its second to fourth word is
    joined with all runs of three words, and what meets is checked whole. Only
    items without four such words are compared with every document."""
    words = lambda c: F.split(c, r"\s+")
    items = table(spark, sf_dir, "benchmark").filter("length(text) > 0").select("item_id", F.col("text").alias("item"), words("text").alias("w"))
    keyed = items.filter("size(w) >= 5").select("item_id", "item", F.xxhash64(F.slice("w", 2, 3)).alias("key"))
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    runs = docs.select("doc_id", words("text").alias("w")).filter("size(w) >= 3")
    keys = runs.select("doc_id", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - 2), i -> xxhash64(slice(w, i, 3)))"))).alias("key"))
    near = keys.join(keyed, "key").select("doc_id", "item_id", "item").distinct()
    found = near.join(docs, "doc_id").filter(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    short = items.filter("size(w) < 5").select("item_id", "item")
    if short.isEmpty():
        return found
    return found.union(docs.join(short, F.contains("text", F.col("item"))).select("doc_id", "item_id"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(part("^([a-zA-Z]+)://")).alias("scheme"), F.lower(part("^[a-zA-Z]+://([^/?#]+)")).alias("host"), part("^[a-zA-Z]+://[^/?#]+([^?#]*)").alias("path"), part(r"\?([^#]*)").alias("query"))


@query("SELECT c_custkey, regexp_extract(c_name, '^([^#]*)', 1) AS prefix, regexp_replace(c_name, '^[^#]*#', '') AS tail, length(c_name) AS width FROM customer")
def id_parse(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "^([^#]*)", 1).alias("prefix"), F.regexp_replace("c_name", "^[^#]*#", "").alias("tail"), F.length("c_name").cast("long").alias("width"))


@query("SELECT (json_extract_string(props, '$.k')::INT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"] % 10
    return _events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'documents only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def set_ops_keys(spark, sf_dir):
    a, b = _docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda side, df: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count("both", a.intersect(b)).union(count("documents only", a.exceptAll(b))).union(count("either", a.union(b).distinct()))


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def account_population(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def sequence_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""WITH k AS (SELECT source, doc_id, dense_rank() OVER (ORDER BY source) AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS m FROM documents),
n AS (SELECT max(g) AS n FROM k), s AS (SELECT g, count(*) AS size FROM k GROUP BY 1)
SELECT a.doc_id, b.doc_id AS donor FROM k a JOIN n ON true JOIN s ON s.g = a.g % n + 1 JOIN k b ON b.g = a.g % n + 1 AND b.m = a.m % s.size""")
def donor_assignment(spark, sf_dir):
    """Each source's documents receive those of the next source, by rank modulo its size."""
    d = _docs(spark, sf_dir).select("source", "doc_id")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("size")).withColumn("g", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")))
    sizes = sizes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    k = ranks.row_numbers(d, "source", "doc_id", "m")
    to = sizes.alias("x").join(sizes.alias("y"), F.col("y.g") == F.col("x.g") % F.col("x.n") + 1).select(F.col("x.source").alias("source"), F.col("y.source").alias("from"), F.col("y.size").alias("donors"))
    want = k.join(to, "source").select("doc_id", "from", (F.col("m") % F.col("donors")).alias("m"))
    return want.join(k.select(F.col("source").alias("from"), "m", F.col("doc_id").alias("donor")), ["from", "m"]).select("doc_id", "donor")


# --- streaming ---------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS begin_ts, count(*) AS events, round(sum(value), 4) AS value FROM k GROUP BY user_id, s""")
def streaming_sessions(spark, sf_dir):
    got = streaming.drained_sessions(streaming.stream(spark, sf_dir, "events"))
    return got.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("begin_ts"), "events", F.round("value", 4).alias("value"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def streaming_distinct(spark, sf_dir):
    seen = streaming.stream(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return streaming.drained(seen).groupBy("user_id").agg(F.count(F.lit(1)).alias("kinds"))
