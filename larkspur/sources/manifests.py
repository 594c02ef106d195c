"""Manifests: JSON lines, strict or tolerant, and canonical sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows with their file, and the lines that could not be read."""
    known = StructType([*schema.fields]).add("corrupt_", StringType())
    rows = spark.read.schema(known).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_").json(path).withColumn("file_", F.input_file_name())
    # Spark refuses to read the corrupt column alone, so both parts keep a column of the schema.
    good, bad = rows.filter("corrupt_ is null").drop("corrupt_"), rows.filter("corrupt_ is not null")
    return good, bad.select("file_", F.col("corrupt_").alias("line"), F.col(schema.fieldNames()[0]))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Of an append-only manifest the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), at).alias("r")).select(key, "r.*")


def write_canonical(df: DataFrame, path: str, key: str) -> None:
    """Columns and rows in order; an existing target is refused."""
    df.select(*sorted(df.columns)).repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").json(path)


def listing(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Files under a folder with sizes and times; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(path)
    return files.select("path", "length", "modificationTime", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"))
