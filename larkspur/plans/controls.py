"""Queries over intervals, cohorts, controls and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import controls, intervals, quantiles, ranks, stats, timeline
from larkspur.plans.registry import query
from larkspur.plans.segments import FRAMES, RUNS, frames, label_runs
from larkspur.session import table

_DRAW = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"
_HELD = "substr(sha256('42:' || doc_id), 1, 1) < '4'"

# --- intervals ---------------------------------------------------------------


@query(f"""WITH {RUNS}, w AS (SELECT user_id, unnest(range(0, n, 24)) AS start, n FROM (SELECT DISTINCT user_id, n FROM f)), b AS (SELECT user_id, start, least(start + 24, n) AS stop FROM w)
SELECT user_id, r.start, r.event_type, b.start AS window_start, least(r.stop, b.stop) - greatest(r.start, b.start) AS overlap FROM runs r JOIN b USING (user_id) WHERE r.start < b.stop AND b.start < r.stop""")
def interval_join(spark, sf_dir):
    """Runs of labels with the windows that they overlap."""
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    windows = lengths.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(24).cast("long"))).alias("start"), "n")
    windows = windows.select("user_id", "start", F.least(F.col("start") + 24, F.col("n")).alias("end"))
    met = intervals.overlapping(label_runs(spark, sf_dir).select("user_id", "event_type", "start", "end"), windows, "user_id", 64)
    return met.select("user_id", "start", "event_type", F.col("right_start").alias("window_start"), "overlap")


@query(f"""WITH {RUNS} SELECT user_id, sum(length)::BIGINT AS frames, round(sum(CASE WHEN length >= 2 AND event_type <> 'error' THEN length ELSE 0 END) / sum(length), 6) AS retained,
sum((event_type = 'error')::INT)::BIGINT AS errors, sum((event_type <> 'error' AND length < 2)::INT)::BIGINT AS short FROM runs GROUP BY 1""")
def retained_share(spark, sf_dir):
    """Frames of kept runs over all, and how many runs go for which reason."""
    r = label_runs(spark, sf_dir)
    total, count = (lambda c: F.sum(F.expr(c))), (lambda c: F.sum(F.expr(c).cast("long")))
    kept = F.round(total("case when length >= 2 and event_type <> 'error' then length else 0 end") / F.sum("length"), 6)
    return r.groupBy("user_id").agg(F.sum("length").alias("frames"), kept.alias("retained"), count("event_type = 'error'").alias("errors"), count("event_type <> 'error' and length < 2").alias("short"))


@query(f"""WITH {FRAMES}, m AS (SELECT user_id, median(value) AS mid FROM events GROUP BY 1), l AS (SELECT user_id, frame // 16 AS bar, frame, value < 0.5 * mid AS low FROM f JOIN m USING (user_id)),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, bar, low ORDER BY frame) AS island FROM l), r AS (SELECT user_id, bar, low, count(*) AS length FROM g GROUP BY user_id, bar, low, island)
SELECT user_id, bar, max(CASE WHEN low THEN length ELSE 0 END) AS longest, max(CASE WHEN low THEN length ELSE 0 END) >= 3 AS holds FROM r GROUP BY 1, 2""")
def windows_with_hold(spark, sf_dir):
    """Whether a window of sixteen frames has three in a row under half the sequence's median."""
    f = frames(spark, sf_dir)
    mid = quantiles.linear(f, "user_id", "value", {"mid": 0.5})
    low = f.join(mid, "user_id").select(F.struct("user_id", F.floor(F.col("frame") / 16).alias("bar")).alias("w"), "frame", (F.col("value") < 0.5 * F.col("mid")).alias("low"))
    longest = F.max(F.when(F.col("low"), F.col("length")).otherwise(0))
    return timeline.runs(low, "w", "frame", "low").groupBy("w").agg(longest.alias("longest")).select("w.user_id", "w.bar", "longest", (F.col("longest") >= 3).alias("holds"))


@query(f"WITH {FRAMES} SELECT user_id, frame, round(quantile_cont(value, 0.1) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 5) AS p10 FROM f")
def rolling_percentile(spark, sf_dir):
    """Centred and cut short at the edges."""
    p = timeline.near(frames(spark, sf_dir), "user_id", "frame", 5, lambda w: {"p10": F.percentile("value", 0.1).over(w.rowsBetween(-5, 5))})
    return p.select("user_id", "frame", F.round("p10", 5).alias("p10"))


@query("""WITH c AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'click'), q AS (SELECT user_id, quantile_cont(value, 0.3) AS cut FROM c GROUP BY 1) SELECT user_id, event_id, value FROM c JOIN q USING (user_id) WHERE value <= cut OR cut IS NULL""")
def deep_events(spark, sf_dir):
    """Clicks at or under the 0.3 quantile of their sequence's clicks; all of them where it has none."""
    c = table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", "event_id", "value")
    return c.join(quantiles.linear(c, "user_id", "value", {"cut": 0.3}), "user_id", "left").filter("value <= cut or cut is null").drop("cut")


@query(f"""WITH {FRAMES}, d AS (SELECT round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)), 6) AS step FROM f), r AS (SELECT step, row_number() OVER (ORDER BY step) AS k, count(*) OVER () AS n FROM d WHERE step IS NOT NULL)
SELECT step AS threshold, n FROM r WHERE k = ceil(0.995 * n)""")
def tail_threshold(spark, sf_dir):
    """The step that half a percent of all steps exceed, over all sequences."""
    d = timeline.near(frames(spark, sf_dir), "user_id", "frame", 1, lambda w: {"step": F.round(F.abs(F.col("value") - F.lag("value").over(w)), 6)})
    return ranks.ranked_quantile(d, "step", 0.995, "ceil").select(F.col("quantile").alias("threshold"), "n")


# --- cohorts -----------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, sha256(text) AS h, {_HELD} AS held FROM documents WHERE text IS NOT NULL), t AS (SELECT h, count(*) AS twins, min(doc_id) AS first_twin FROM d WHERE NOT held GROUP BY 1) SELECT doc_id, twins, first_twin FROM d JOIN t USING (h) WHERE held""")
def twin_cohort(spark, sf_dir):
    """Held-out documents with a copy in train; copies are counted before they are met."""
    held = F.substring(F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256), 1, 1) < "4"
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), held.alias("held"))
    t = d.filter("not held").groupBy("h").agg(F.count(F.lit(1)).alias("twins"), F.min("doc_id").alias("first_twin"))
    return d.filter("held").join(t, "h").select("doc_id", "twins", "first_twin")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL), n AS (SELECT h, min(quality) AS given, count(quality) AS donors FROM d GROUP BY 1 HAVING count(DISTINCT quality) = 1) SELECT doc_id, given, donors FROM d JOIN n USING (h) WHERE quality IS NULL""")
def name_propagation(spark, sf_dir):
    """A label for documents without one from their copies, if those agree."""
    named = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h")).join(named, "doc_id", "left")
    n = d.groupBy("h").agg(F.min("quality").alias("given"), F.max("quality").alias("most"), F.count("quality").alias("donors")).filter("given = most").drop("most")
    return d.filter("quality is null").join(n, "h").select("doc_id", "given", "donors")


@query(f"""WITH {FRAMES}, p AS (SELECT a.user_id, d, avg((a.event_type = b.event_type)::INT) AS agreement, count(*) AS n FROM f a, (VALUES (1), (7)) v(d), f b WHERE b.user_id = a.user_id + d AND b.frame = a.frame + 3 GROUP BY 1, 2)
SELECT CASE d WHEN 1 THEN 'pair' ELSE 'control' END AS kind, count(*) AS pairs, round(avg(agreement), 6) AS agreement FROM p WHERE n >= 20 GROUP BY 1""")
def agreement_at_lag(spark, sf_dir):
    """Frames of paired sequences at their known lag, and of control pairs; twenty must overlap."""
    f = frames(spark, sf_dir).select("user_id", "frame", "event_type")
    at = f.withColumn("d", F.explode(F.array(F.lit(1), F.lit(7)))).select("user_id", "d", (F.col("user_id") + F.col("d")).alias("other"), (F.col("frame") + 3).alias("at"), "event_type")
    b = f.select(F.col("user_id").alias("other"), F.col("frame").alias("at"), F.col("event_type").alias("told"))
    p = at.join(b, ["other", "at"]).groupBy("user_id", "d").agg(F.avg((F.col("event_type") == F.col("told")).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n")).filter("n >= 20")
    return p.groupBy(F.when(F.col("d") == 1, "pair").otherwise("control").alias("kind")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("agreement"), 6).alias("agreement"))


@query("""WITH h AS (SELECT user_id, event_type, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2), u AS (SELECT user_id, event_type, c / sqrt(sum(c * c) OVER (PARTITION BY user_id)) AS x FROM h), n AS (SELECT count(DISTINCT user_id) AS n FROM u),
p AS (SELECT a.user_id, b.user_id AS other, sum(a.x * b.x) AS cosine FROM u a JOIN u b ON a.event_type = b.event_type AND a.user_id < b.user_id GROUP BY 1, 2) SELECT round(1 - sum(cosine) / (any_value(n) * (any_value(n) - 1) / 2), 6) AS novelty, any_value(n) AS sequences FROM p, n""")
def histogram_novelty(spark, sf_dir):
    """One minus the mean cosine of all pairs of label histograms, from the sum of unit vectors: no pair is met."""
    h = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norms = h.groupBy("user_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    sums = h.join(norms, "user_id").groupBy("event_type").agg(F.sum(F.col("c") / F.col("norm")).alias("s"))
    n = norms.agg(F.count(F.lit(1)).alias("n"))
    pairs = (F.sum(F.col("s") * F.col("s")) - F.max("n")) / (F.max("n") * (F.max("n") - 1))
    return sums.crossJoin(F.broadcast(n)).agg(F.round(1 - pairs, 6).alias("novelty"), F.max("n").alias("sequences"))


_GRAMS = "chained AS (SELECT user_id, start, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_type, 3) OVER w AS d FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY start)), x AS (SELECT user_id, start, unnest([a || ',' || b, a || ',' || b || ',' || c, a || ',' || b || ',' || c || ',' || d]) AS chain, unnest([2, 3, 4]) AS reach FROM chained)"


@query(f"""WITH {RUNS}, {_GRAMS}, c AS (SELECT chain, count(*) AS candidates, min({{'user_id': user_id, 'start': start}}) AS first FROM x WHERE user_id % 2 = 0 AND chain IS NOT NULL GROUP BY 1),
m AS (SELECT x.user_id, x.start, reach, candidates, first FROM x JOIN c USING (chain) WHERE x.user_id % 2 = 1)
SELECT user_id, start, reach::INT AS reach, candidates, first.user_id AS source, first.start AS source_start FROM m QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY reach DESC) = 1""")
def phrase_chains(spark, sf_dir):
    """For each part of odd users the candidates of even users that carry most of the parts that follow, two to four; candidates are counted by chain before they are met."""
    label = lambda w: {"labels": F.array("event_type", *[F.lead("event_type", k).over(w) for k in (1, 2, 3)])}
    g = timeline.near(label_runs(spark, sf_dir), "user_id", "run", 3, label)
    x = g.select("user_id", "start", F.col("labels"), F.explode(F.array(*[F.lit(k) for k in (2, 3, 4)])).alias("reach"))
    x = x.withColumn("chain", F.slice("labels", F.lit(1), F.col("reach"))).filter(F.forall("chain", lambda c: c.isNotNull())).select("user_id", "start", "reach", F.array_join("chain", ",").alias("chain"))
    c = x.filter("user_id % 2 = 0").groupBy("chain").agg(F.count(F.lit(1)).alias("candidates"), F.min(F.struct("user_id", "start")).alias("first"))
    m = x.filter("user_id % 2 = 1").join(c, "chain").groupBy("user_id", "start").agg(F.max(F.struct("reach", "candidates", "first")).alias("m"))
    return m.select("user_id", "start", "m.reach", "m.candidates", F.col("m.first.user_id").alias("source"), F.col("m.first.start").alias("source_start"))


# --- controls ----------------------------------------------------------------


@query("WITH u AS (SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sha256('5:' || user_id), user_id) AS k, count(*) OVER () AS n FROM u) SELECT a.user_id, b.user_id AS partner, round(abs(a.mean - b.mean), 5) AS error FROM r a JOIN r b ON b.k = a.k % a.n + 1")
def derangement_null(spark, sf_dir):
    """The error of each sequence against another's truth."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    p = controls.deranged(u, "user_id", 5).join(u, "user_id").join(u.select(F.col("user_id").alias("partner"), F.col("mean").alias("truth")), "partner")
    return p.select("user_id", "partner", F.round(F.abs(F.col("mean") - F.col("truth")), 5).alias("error"))


@query("WITH s AS (SELECT source, row_number() OVER (ORDER BY source, doc_id) AS k FROM documents), r AS (SELECT doc_id, source, row_number() OVER (ORDER BY sha256('6:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, r.source, s.source AS shuffled FROM r JOIN s USING (k)")
def shuffled_membership(spark, sf_dir):
    """Sources of the same sizes with documents drawn anew."""
    return controls.shuffled_groups(table(spark, sf_dir, "documents"), "doc_id", "source", 6)


@query(f"""WITH {RUNS}, c AS (SELECT event_type, count(*) AS k FROM runs GROUP BY 1), w AS (SELECT event_type AS redrawn, sum(k) OVER (ORDER BY event_type) AS upto, sum(k) OVER (ORDER BY event_type) - k AS below, sum(k) OVER () AS n FROM c)
SELECT user_id, start, event_type, redrawn FROM runs JOIN w ON floor({_DRAW.format("'8:' || user_id || ':' || start")} * n / 4294967296.0) >= below AND floor({_DRAW.format("'8:' || user_id || ':' || start")} * n / 4294967296.0) < upto""")
def relabelled_runs(spark, sf_dir):
    """The same segmentation with labels drawn by their shares."""
    r = label_runs(spark, sf_dir).select("user_id", "start", "event_type")
    return controls.redrawn(r, ["user_id", "start"], "event_type", 8)


_PAIRS = f"""s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) > 1), g AS (SELECT source, size, row_number() OVER (ORDER BY source) - 1 AS g, count(*) OVER () AS groups FROM s),
m AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS m FROM documents), w AS (SELECT d.doc_id AS draw, g.source, size, {_DRAW.format("'3:' || d.doc_id || ':left'")} % size AS a, {_DRAW.format("'3:' || d.doc_id || ':right'")} % (size - 1) AS b
FROM documents d JOIN g ON g.g = {_DRAW.format("'3:' || d.doc_id || ':group'")} % groups), p AS (SELECT draw, w.source, x.doc_id AS "left", y.doc_id AS "right", x.lang AS lx, y.lang AS ly FROM w JOIN m x ON x.source = w.source AND x.m = a JOIN m y ON y.source = w.source AND y.m = (a + 1 + b) % size)"""


def _pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return controls.stratified_pairs(d.select("doc_id", "source"), "doc_id", "source", d.select(F.col("doc_id").alias("draw")), "draw", 3)


@query(f'WITH {_PAIRS} SELECT draw, source, "left", "right" FROM p')
def stratified_pairs(spark, sf_dir):
    """One pair within a source per document, the source drawn first."""
    return _pairs(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT source, count(*) AS pairs, round(avg((lx = ly)::INT), 6) AS agreement FROM p GROUP BY 1")
def caption_agreement(spark, sf_dir):
    """How often the two of a pair have one language, by source."""
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    p = _pairs(spark, sf_dir).join(lang.select(F.col("doc_id").alias("left"), F.col("lang").alias("x")), "left").join(lang.select(F.col("doc_id").alias("right"), F.col("lang").alias("y")), "right")
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("agreement"))


@query(f"""WITH q AS (SELECT o_orderkey, o_totalprice AS s, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders), c AS (SELECT s AS cut FROM q WHERE k = ceil(0.75 * n)),
l AS (SELECT level, s, (s >= cut) <> ({_DRAW.format("'4:' || o_orderkey || ':' || level")} * 100 >= level * 4294967296) AS y FROM q, c, (VALUES (100), (90), (70), (50)) v(level)), r AS (SELECT level, y, rank() OVER (PARTITION BY level ORDER BY s) + (count(*) OVER (PARTITION BY level, s) - 1) / 2.0 AS rk FROM l)
SELECT level, sum(y::INT)::BIGINT AS positives, round((sum(CASE WHEN y THEN rk ELSE 0 END) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * sum((NOT y)::INT)), 5) AS auc FROM r GROUP BY 1""")
def label_noise_auc(spark, sf_dir):
    """AUC of an oracle by quantile where labels are right with a known share: what a measure can reach."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("s"))
    cut = ranks.ranked_quantile(o, "s", 0.75, "ceil").select(F.col("quantile").alias("cut"))
    known, out = o.crossJoin(F.broadcast(cut)), None
    for level in (100, 90, 70, 50):
        flipped = controls.draw(4, F.col("o_orderkey"), F.lit(level)) * 100 >= F.lit(level * 2**32)
        noisy = known.withColumn("y", (F.col("s") >= F.col("cut")) != flipped)
        auc = stats.rank_auc(noisy, "s", F.col("y"), 5).select(F.lit(level).alias("level"), "positives", "auc")
        out = auc if out is None else out.union(auc)
    return out


@query(f"""WITH {RUNS}, k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) AS run, count(*) OVER (PARTITION BY user_id) AS n, mean FROM runs), a AS (SELECT x.user_id, quantile_cont(abs(x.mean - y.mean), 0.5) AS adjacent FROM k x JOIN k y ON x.user_id = y.user_id AND y.run = x.run + 1 GROUP BY 1),
r AS (SELECT x.user_id, quantile_cont(abs(x.mean - y.mean), 0.5) AS random FROM k x JOIN k y ON x.user_id = y.user_id AND y.run = (x.run + 1 + {_DRAW.format("'2:' || x.user_id || ':' || x.run")} % (x.n - 3)) % x.n + 1 WHERE x.n > 3 GROUP BY 1) SELECT user_id, round(adjacent / random, 4) AS ratio FROM a JOIN r USING (user_id)""")
def adjacent_against_random(spark, sf_dir):
    """Median distance of neighbouring runs over that of runs with one drawn among those that are no neighbours, ends being neighbours too."""
    begun = label_runs(spark, sf_dir).select("user_id", "run", F.col("start").alias("frame"))
    f = frames(spark, sf_dir).select("user_id", "frame", "value").join(begun, ["user_id", "frame"], "left")
    f = timeline.running(f, "user_id", timeline.block_of("frame"), "frame", {"run": ("max", F.col("run"))})
    k = f.groupBy("user_id", "run").agg(F.avg("value").alias("mean"))
    off = lambda other: F.percentile(F.abs(F.col("mean") - F.col(other)), 0.5)
    a = timeline.near(k, "user_id", "run", 1, lambda w: {"next": F.lead("mean").over(w)}).groupBy("user_id").agg(off("next").alias("adjacent"))
    n = k.groupBy("user_id").agg(F.max("run").alias("n")).filter("n > 3")
    to = (F.col("run") + 1 + controls.draw(2, F.col("user_id"), F.col("run")) % (F.col("n") - 3)) % F.col("n") + 1
    r = k.join(n, "user_id").select("user_id", to.alias("run"), F.col("mean").alias("x")).join(k, ["user_id", "run"]).groupBy("user_id").agg(off("x").alias("random"))
    return a.join(r, "user_id").select("user_id", F.round(F.try_divide("adjacent", "random"), 4).alias("ratio"))


# --- gates -------------------------------------------------------------------


@query("SELECT source, count(DISTINCT lang) AS contracts, count(DISTINCT lang) > 1 AS refused FROM documents GROUP BY 1")
def mixed_contracts(spark, sf_dir):
    """A source whose documents have more than one language is refused."""
    n = F.count_distinct("lang")
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("contracts"), (n > 1).alias("refused"))


@query(f"""WITH d AS (SELECT source, CASE WHEN {_HELD} THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1, 2), w AS (SELECT source, split FROM (SELECT DISTINCT source FROM documents), (VALUES ('train'), ('val'), ('test')) v(split))
SELECT w.source, w.split, coalesce(n, 0) AS n, n IS NULL AS refused FROM w LEFT JOIN d ON d.split = w.split AND d.source IS NOT DISTINCT FROM w.source""")
def split_gates(spark, sf_dir):
    """Documents per source in each split that must have some."""
    held = F.substring(F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256), 1, 1) < "4"
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.when(~held, 1)).alias("train"), F.lit(0).cast("long").alias("val"), F.count(F.when(held, 1)).alias("test"))
    return d.unpivot("source", ["train", "val", "test"], "split", "n").withColumn("refused", F.col("n") == 0)


@query("""WITH a AS (SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN value END) AS base, avg(CASE WHEN user_id % 2 = 1 THEN value END) AS arm FROM events GROUP BY 1) SELECT event_type, round((base - arm) / base, 5) AS loss, round((base - arm) / base, 5) > 0.02 AS failed FROM a""")
def tradeoff_gate(spark, sf_dir):
    """An arm may lose at most a fiftieth of the baseline's mean."""
    arm = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    loss = F.round(F.try_divide(arm(0) - arm(1), arm(0)), 5)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(loss.alias("loss"), (loss > 0.02).alias("failed"))
