"""Queries over files: the given tables are written in the formats that the
sources read, into the folder that executors share, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.operators import ranks
from larkspur.plans.registry import query
from larkspur.session import shared_folder, table
from larkspur.sources import files


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, source, n_chars, count(*) OVER () AS numbered FROM documents")
def manifest_lines(spark, sf_dir):
    """Documents as strict JSON lines; ``numbered`` counts the lines with a number of their own in their file."""
    path = _folder(spark, "manifest")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").write.option("ignoreNullFields", "false").json(path)
    got = files.read_objects(spark, path, "doc_id long, lang string, source string, n_chars long")
    numbered = got.select("file", "line").distinct().agg(F.count(F.lit(1)).alias("numbered"))
    return got.drop("file", "line").crossJoin(F.broadcast(numbered))


def _arrays(spark, sf_dir, column):
    v = table(spark, sf_dir, "embeddings").filter("label is not null")
    placed = ranks.row_numbers(v.select("label", "vec_id", column.alias("x")), "label", "vec_id", "nth")
    path = _folder(spark, "arrays")
    files.write_arrays(placed, "label", "nth", "x", path, 100)
    return files.read_arrays(spark, path, 16 << 10)


@query("""WITH p AS (SELECT label, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth FROM embeddings WHERE label IS NOT NULL)
SELECT label || '-' || lpad((nth // 100)::VARCHAR, 5, '0') AS stem, nth % 100 AS row, round(list_sum(x), 6) AS total, len(x) AS width FROM p""")
def array_rows(spark, sf_dir):
    """The vectors of each label as .npy files of a hundred rows, read back in parts of 16 KB."""
    got = _arrays(spark, sf_dir, F.col("embedding"))
    return got.select("stem", "row", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("values").cast("long").alias("width"))


@query("""WITH p AS (SELECT label, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth FROM embeddings WHERE label IS NOT NULL)
SELECT label || '-' || lpad((nth // 100)::VARCHAR, 5, '0') AS stem, count(*) AS rows, round(sum(list_inner_product(x[1:32], x[33:64])), 5) AS product FROM p GROUP BY 1""")
def aligned_arrays(spark, sf_dir):
    """Both halves of the vectors and the whole in files of their own, side by side again."""
    both = files.aligned(one=_arrays(spark, sf_dir, F.slice("embedding", 1, 32)), two=_arrays(spark, sf_dir, F.slice("embedding", 33, 32)), whole=_arrays(spark, sf_dir, F.col("embedding")))
    product = F.aggregate(F.zip_with("one", "two", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return both.groupBy("stem").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(product), 5).alias("product"))


@query("""SELECT source AS stem, round(avg(length(text)) / nullif(avg(n_chars), 0), 6) AS ratio, NULL::DOUBLE AS absent FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def report_ratios(spark, sf_dir):
    """One JSON report a source, and the ratio of two of its numbers by dotted paths; a path without a number gives null."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    report = F.to_json(F.struct(F.struct(F.struct(F.avg(F.length("text")).alias("mean")).alias("size")).alias("summary"), F.struct(F.struct(F.avg("n_chars").alias("mean")).alias("size"), F.lit("1.5").alias("text")).alias("ground_truth")))
    path = _folder(spark, "reports")
    d.groupBy("source").agg(report.alias("value")).write.partitionBy("source").text(path)
    got = files.read_reports(spark, path)
    name = F.regexp_extract("file", "source=([^/]+)/", 1)
    ratio = F.try_divide(files.dig(F.col("report"), "summary.size.mean"), files.dig(F.col("report"), "ground_truth.size.mean"))
    return got.select(name.alias("stem"), F.round(ratio, 6).alias("ratio"), files.dig(F.col("report"), "ground_truth.text").alias("absent"))


@query("""WITH d AS (SELECT doc_id // 50 AS block, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT block, octet_length(encode(t)) AS length, sha256(t) AS sha256, octet_length(encode(t)) || ':' || sha256(t) AS identity FROM d""")
def file_hashes(spark, sf_dir):
    """Texts of fifty documents a file, and each file's length and hash of its bytes."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.floor(F.col("doc_id") / 50).alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    path = _folder(spark, "texts")
    d.repartition("block").sortWithinPartitions("block", "doc_id").select("block", "value").write.partitionBy("block").text(path)
    got = files.content_hashes(files.listing(spark, path, "*.txt"))
    return got.select(F.regexp_extract("path", "block=([^/]+)/", 1).cast("long").alias("block"), "length", "sha256", "identity")
