"""Quality rules: robust multivariate outliers per language and source.

Each text gives counts of its words, symbols, repeated lines and repeated
passages; too few words, or too many of them in repeated passages, fail at
once. The counts also give a vector of five transformed shares. For every
language and source the minimum covariance determinant is estimated: from three
robust starts, concentration steps keep the half of the rows that lies nearest
by Mahalanobis distance and estimate its mean and covariance again until they
settle, and the start of the least determinant counts; so outliers cannot hide
themselves unless they are about half of a group. Each language and all rows
together are estimated in the same way, and an estimate of n rows is drawn to
that of the wider set with the weight of 20 rows, so that few rows decide
little, by one law for all sizes. A text far from its group's estimate is
rejected.

Everything is built of SQL functions. Groups are only ever summed (means,
covariances, approximate quantiles), so one may hold any share of the rows;
estimates are one small row per group, staged in the shared folder each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: The transformed statistics, with the least standard deviation that counts:
#: what varies less than this within good texts is not evidence.
VECTOR = {"word_length": 0.15, "symbols": 0.05, "capitals": 0.05, "repeats": 0.1, "dup_lines": 0.1}
#: Share of the rows that concentration steps keep (the floors above stand for
#: the few rows more that a covariance needs), the factor by which the covariance
#: of the nearest half of normal rows is too small (0.5 over the chance that the
#: square of seven variables is below MEDIAN), and the fall of the logarithm of
#: the determinant below which a start has settled.
KEPT_SHARE, CONSISTENCY, SETTLED = 0.5, 1.9122, 0.01
#: Squared distance beyond which a text is rejected: of five normal variables, one in 10**5.
CUTOFF = 30.86
#: Median of the squared length of five standard normal variables.
MEDIAN = 4.351
#: Rows for which the estimate of the wider set counts; and what all rows are
#: drawn to, the deviations of a set of which nothing is known.
DRAW, WIDE = 20, {"word_length": 0.4, "symbols": 0.3, "capitals": 0.2, "repeats": 0.3, "dup_lines": 0.3}
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

_SPACE = r"[\\x20\\x09-\\x0D]+"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(words: str) -> Column:
    """Words in runs of eight that occur twice or more in the array ``words``."""
    hashes = f"transform({words}, w -> xxhash64(w))"
    runs = f"transform(sequence(1, size(hs) - {WINDOW - 1}), i -> xxhash64(slice(hs, i, {WINDOW})))"
    ranked = "array_sort(transform(rs, (h, i) -> named_struct('h', h, 'i', i)))"
    again = "filter(ps, (p, j) -> (j > 0 and ps[j - 1].h = p.h) or (j < size(ps) - 1 and ps[j + 1].h = p.h))"
    places = f"array_sort(transform({again}, p -> p.i))"
    covered = f"aggregate({places}, named_struct('last', -{WINDOW}, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last)), a -> a.n)"
    counted = _let("rs", runs, f"if(size(array_distinct(rs)) = size(rs), 0L, {_let('ps', ranked, covered)})")
    return F.expr(f"if(size({words}) < {WINDOW}, 0L, {_let('hs', hashes, counted)})")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and the vector; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("text_", text)
    rows = rows.withColumn("words_", F.expr(f"filter(split(text_, '{_SPACE}'), w -> w != '')"))
    rows = rows.withColumn("lines_", F.expr(r"filter(split(text_, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    rows = rows.withColumns(
        {
            "n_words": F.size("words_").cast("long"),
            "word_chars": F.expr("aggregate(words_, 0L, (a, w) -> a + length(w))"),
            "n_symbols": (F.length("text_") - F.length(F.translate("text_", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "n_repeat_words": repeated_words("words_"),
            "n_lines_": F.size("lines_"),
            "n_echoes_": F.expr("size(filter(words_, (w, i) -> i > 0 and w = words_[i - 1]))"),
            "n_capitals_": F.length(F.regexp_replace("text_", r"[^\p{Lu}]+", "")),
        }
    )
    many = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
            "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / many),
            "symbols": F.log1p(F.col("n_symbols") / many),
            "capitals": F.col("n_capitals_") / F.greatest(F.col("word_chars"), F.lit(1)),
            "repeats": F.greatest("n_repeat_words", "n_echoes_") / many,
            "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines_"), F.lit(1)),
        }
    )
    return rows.drop("text_", "words_", "lines_", "n_lines_", "n_capitals_", "n_echoes_")


def _cell(*keys: str) -> Column:
    """The name of a set of rows: of all, of an outer group or of a group."""
    return F.to_json(F.array(*[F.col(k).cast("string") for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("[]")


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by the groups' Cholesky factors."""
    names = list(VECTOR)
    rows = rows.join(estimate, "cell")
    parts = []
    for i, x in enumerate(names):
        y = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        rows = rows.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
        parts.append(F.col(f"y_{i}") * F.col(f"y_{i}"))
    return rows.withColumn("d2", sum(parts[1:], parts[0])).drop(*[f"y_{i}" for i in range(len(names))])


def _factors(estimate: DataFrame, times: float = 1.0) -> DataFrame:
    """Cholesky factors l_i_j of so many times the covariances c_i_j, with the
    floors added, and ``log_det``, the logarithm of their determinant."""
    for i, floor in enumerate(VECTOR.values()):
        for j in range(i + 1):
            v = times * F.coalesce(F.col(f"c_{j}_{i}"), F.lit(0.0)) + (F.lit(floor * floor) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            estimate = estimate.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l_{j}_{j}"))
    logs = [2 * F.log(f"l_{i}_{i}") for i in range(len(VECTOR))]
    return estimate.withColumn("log_det", sum(logs[1:], logs[0]))


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates per cell, none moved far by less than half of the
    rows: medians with absolute deviations, the shortest halves, and medians
    with the correlations of bounded (tanh) values."""
    names, steps = list(VECTOR), 20
    near = rows.groupBy("cell").agg(*[F.percentile_approx(x, [k / steps for k in range(steps + 1)], 10_000).alias(f"q_{i}") for i, x in enumerate(names)])
    half = lambda i: F.array_min(F.array(*[F.struct((F.col(f"q_{i}")[k + steps // 2] - F.col(f"q_{i}")[k]).alias("w"), ((F.col(f"q_{i}")[k + steps // 2] + F.col(f"q_{i}")[k]) / 2).alias("m")) for k in range(steps // 2 + 1)]))
    middle = near.select("cell", *[F.col(f"q_{i}")[steps // 2].alias(f"m_{i}") for i in range(len(names))], *[half(i).alias(f"h_{i}") for i in range(len(names))])
    # One small row per cell, as a table of known size: the rows need not be shuffled to it.
    middle = stage(middle.repartition(1), "middle")
    away = rows.join(middle, "cell").groupBy("cell").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"s_{i}") for i, x in enumerate(names)])
    spread = stage(middle.join(away.select("cell", *[(1.4826 * F.col(f"s_{i}")).alias(f"s_{i}") for i in range(len(names))]), "cell").repartition(1), "spread")
    bound = [F.tanh((F.col(x) - F.col(f"m_{i}")) / F.greatest(F.col(f"s_{i}"), F.lit(floor))) for i, (x, floor) in enumerate(VECTOR.items())]
    pairs = [(j, i) for i in range(len(names)) for j in range(i)]
    # Not corr(), which divides by the deviation of a constant.
    likeness = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    alike = rows.join(spread, "cell").groupBy("cell").agg(*[likeness(bound[j], bound[i]).alias(f"r_{j}_{i}") for j, i in pairs])
    both = spread.join(alike, "cell")

    def start(number: int, mean, deviation, correlation) -> DataFrame:
        own = [(deviation(i) * deviation(i) if i == j else correlation(j, i) * deviation(i) * deviation(j)).alias(f"c_{j}_{i}") for i in range(len(names)) for j in range(i + 1)]
        return both.select("cell", F.lit(number).alias("start"), *[mean(i).alias(f"m_{i}") for i in range(len(names))], *own)

    median, mad, none = (lambda i: F.col(f"m_{i}")), (lambda i: F.col(f"s_{i}")), (lambda j, i: F.lit(0.0))
    found = start(0, median, mad, none)
    found = found.union(start(1, lambda i: F.col(f"h_{i}.m"), lambda i: F.col(f"h_{i}.w") / 1.349, none))
    return _factors(found.union(start(2, median, mad, lambda j, i: F.coalesce(F.col(f"r_{j}_{i}"), F.lit(0.0)))))


def _concentrated(far: DataFrame) -> DataFrame:
    """Estimates of the nearest half per cell and start; rows tied at the cut
    count with the part of them that fills it, so copies can't swell it."""
    names = list(VECTOR)
    cut = far.groupBy("cell", "start").agg(F.percentile_approx("d2", KEPT_SHARE, 10_000).alias("cut"))
    rows = far.join(stage(cut.repartition(1), "cuts"), ["cell", "start"])
    pairs = [(j, i) for i in range(len(names)) for j in range(i + 1)]
    values = {"n": F.lit(1.0)} | {f"m_{i}": F.col(x) for i, x in enumerate(names)} | {f"c_{j}_{i}": F.col(names[j]) * F.col(names[i]) for j, i in pairs}
    sums = [F.coalesce(F.sum(F.when(at, v)), F.lit(0.0)).alias(f"{part}_{k}") for part, at in (("in", F.col("d2") < F.col("cut")), ("tied", F.col("d2") == F.col("cut"))) for k, v in values.items()]
    got = rows.groupBy("cell", "start").agg(F.count(F.lit(1)).alias("n"), *sums)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (KEPT_SHARE * F.col("n") - F.col("in_n")) / F.col("tied_n")))
    got = got.withColumn("part_", part).withColumn("kept_", F.col("in_n") + F.col("part_") * F.col("tied_n"))
    mean = {k: (F.col(f"in_{k}") + F.col("part_") * F.col(f"tied_{k}")) / F.col("kept_") for k in values}
    moments = [mean[f"m_{i}"].alias(f"m_{i}") for i in range(len(names))] + [(mean[f"c_{j}_{i}"] - mean[f"m_{j}"] * mean[f"m_{i}"]).alias(f"c_{j}_{i}") for j, i in pairs]
    return _factors(got.select("cell", "start", *moments), CONSISTENCY)


def _shrunk(own: DataFrame, wider: DataFrame) -> DataFrame:
    """Estimates ``own`` (with ``wider``, a cell's name) drawn to those of the wider cells by their sizes."""
    names = list(VECTOR)
    both = own.join(wider.select(F.col("cell").alias("wider"), *[F.col(c).alias(f"w{c}") for c in wider.columns if c.startswith(("m_", "c_", "scale"))]), "wider")
    part = F.col("n") / (F.col("n") + DRAW)
    mixed = lambda c: part * F.col(c) + (1 - part) * F.col(f"w{c}")
    apart = lambda i: F.col(f"m_{i}") - F.col(f"wm_{i}")
    means = [mixed(f"m_{i}").alias(f"m_{i}") for i in range(len(names))]
    spreads = [(mixed(f"c_{j}_{i}") + part * (1 - part) * apart(j) * apart(i)).alias(f"c_{j}_{i}") for i in range(len(names)) for j in range(i + 1)]
    return both.select("cell", *means, *spreads, mixed("scale").alias("scale"))


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """One row per cell: mean m_i and covariance c_i_j of its estimate (for
    normal rows; without the floors), ``log_det`` of its nearest half, ``scale``,
    by which its squared distances are too large, and its rows ``n``."""
    names = list(VECTOR)
    # One row per cell and start, in one file: footers of many files would hide how small it is.
    estimate = stage(_starts(rows).withColumn("least", F.lit(float("inf"))).repartition(1), "mcd")
    while True:
        far = _distance(rows, estimate).select("cell", "start", "d2", *names)
        now = _concentrated(far).join(estimate.select("cell", "start", F.col("least").alias("was")), ["cell", "start"])
        estimate = stage(now.withColumn("least", F.least("was", "log_det")).repartition(1), "mcd")
        # Each further step needs a fall of this much below all before, so there is an end.
        if estimate.filter(f"log_det < was - {SETTLED}").isEmpty():
            break
        estimate = estimate.drop("was")
    kept = [c for c in estimate.columns if c.startswith(("m_", "l_", "c_"))]
    best = estimate.groupBy("cell").agg(F.min(F.struct("log_det", "start", *kept)).alias("b")).select("cell", "b.log_det", *[F.col(f"b.{c}").alias(c) for c in kept])
    best = stage(best.repartition(1), "best")
    scale = _distance(rows, best).groupBy("cell").agg(F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 10_000) / MEDIAN).alias("scale"), F.count(F.lit(1)).alias("n"))
    found = best.join(scale, "cell").select("cell", *[F.col(f"m_{i}") for i in range(len(names))], *[(CONSISTENCY * F.col(f"c_{j}_{i}")).alias(f"c_{j}_{i}") for i in range(len(names)) for j in range(i + 1)], "log_det", "scale", "n")
    return stage(found.repartition(1), "estimates")


def estimates(good: DataFrame, outer: str, inner: str) -> DataFrame:
    """One row per group that ``good`` has, by its cell: m_i, factors l_i_j and scale."""
    cells = [_cell(), _cell(outer), _cell(outer, inner)]
    rows = stage(good.select(F.explode(F.array(*cells)).alias("cell"), *VECTOR), "grouped")
    own = minimum_covariance(rows)
    groups = stage(good.select(*[c.alias(n) for c, n in zip(cells, ("all", "outer", "group"), strict=True)]).distinct().repartition(1), "cells")
    top = own.join(groups.select(F.col("all").alias("cell")).distinct(), "cell").withColumn("wider", F.col("cell"))
    unknown = [F.lit(WIDE[x] ** 2 if i == j else 0.0).alias(f"c_{j}_{i}") for i, x in enumerate(VECTOR) for j in range(i + 1)]
    found = _shrunk(top, top.select("cell", *[f"m_{i}" for i in range(len(VECTOR))], *unknown, F.lit(1.0).alias("scale")))
    for level, wider in (("outer", "all"), ("group", "outer")):
        names = groups.select(F.col(level).alias("cell"), F.col(wider).alias("wider")).distinct()
        found = _shrunk(own.join(names, "cell"), found)
    return stage(_factors(found).drop("log_det", *[c for c in found.columns if c.startswith("c_")]).repartition(1), "estimate")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def verdicts(docs: DataFrame, outer: str = "lang", inner: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Statistics and verdicts of all rows of ``docs``: ``row``, a struct of the
    columns ``keep``, whose names can't clash with others, the counts,
    base_failed, distance (squared, scaled) and kept.

    A null text has no words and fails, as does an empty one. Estimates use
    only rows that pass the base rules; null languages or sources are groups of
    their own; repeated rows are judged alike; an empty table gives no rows.
    """
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("row"), "text", F.col(outer).cast("string").alias("outer_"), F.col(inner).cast("string").alias("inner_"))
    measured = stage(statistics(read).select("row", *COUNTS, *VECTOR, "outer_", "inner_"), "statistics")
    good = measured.filter("not base_failed")
    far = _distance(good.withColumn("cell", _cell("outer_", "inner_")), estimates(good, "outer_", "inner_"))
    judged = far.withColumn("distance", F.col("d2") / F.col("scale")).withColumn("kept", F.col("distance") <= CUTOFF)
    failed = measured.filter("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    out = ["row", *COUNTS, "distance", "kept"]
    return judged.select(*out).unionByName(failed.select(*out))


def judge(docs: DataFrame, outer: str = "lang", inner: str = "source", keep: list[str] | None = None) -> DataFrame:
    """:func:`verdicts` with the columns ``keep`` as they are; of these, ones
    with the name of a result are left out for it."""
    found = verdicts(docs, outer, inner, keep)
    own = [F.col(f"row.`{c}`").alias(c) for c in keep or ["doc_id"] if c not in (*COUNTS, "distance", "kept")]
    return found.select(*own, *COUNTS, "distance", "kept")


def judged_documents(docs: DataFrame) -> DataFrame:
    return judge(docs)
