"""The SQL surface: the tables as views, the library's functions by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from larkspur.session import TABLES, table

#: Name, parameters, result and body of each function; all stay within Catalyst.
FUNCTIONS = (
    ("overlap", "a BIGINT, b BIGINT, c BIGINT, d BIGINT", "BIGINT", "greatest(0L, least(b, d) - greatest(a, c))"),
    ("phase", "t DOUBLE, before DOUBLE, after DOUBLE", "DOUBLE", "try_divide(t - before, after - before)"),
    ("upload_key", "id STRING", "STRING", "element_at(split(id, ':'), -1)"),
    ("hash_share", "seed STRING, id STRING", "DOUBLE", "cast(conv(substring(sha2(concat(seed, ':', id), 256), 1, 8), 16, 10) as double) / 4294967296.0"),
    ("mm_ss", "seconds BIGINT", "STRING", "concat(lpad(cast(seconds div 60 as string), greatest(2, length(cast(seconds div 60 as string))), '0'), ':', lpad(cast(seconds % 60 as string), 2, '0'))"),
)


def register(spark: SparkSession, sf_dir: str) -> None:
    """Make every given table a temporary view and every function a temporary SQL function."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
