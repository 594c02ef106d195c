"""Sharding: a two-pass external shuffle under the law of equal row counts.

Pass one scatters the records by a seeded hash into buckets small enough for
memory; the exchange between the passes is on disk. Pass two takes one bucket
at a time, puts its rows in a Fisher-Yates order seeded by bucket, and writes
it. Buckets one after another make a uniform shuffle of all records; position p
in it goes to shard p mod n, slot p div n, so counts differ by one at most and
slots have no gaps. What stands before a bucket comes from a table of counts,
summed in two levels; no bucket's count passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from .shared import shared_dir, stage


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def external_shuffle(
    docs: DataFrame, n_shards: int = 8, seed: int = 42, bucket_bytes: int = 16 << 20, name: str = "shards"
) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, written as
    Parquet files by shard in the shared folder and read back.

    ``docs`` has doc_id and text; its columns are kept whatever their names, but
    one named shard or slot is replaced. Scattering hashes the doc_id and text, so any
    number of equal texts, and rows of one id, spread; a null id counts as a
    value, and only rows equal in both stay in one bucket. Nulls and empty
    texts are records of size 1; repeated rows each keep a slot of their own;
    an empty table gives no rows.
    """
    docs = docs.drop("shard", "slot")
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    total = docs.agg(F.sum(record_size(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    # The caller's row as a struct: its names meet none of these.
    order = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")).alias("order")
    bucketed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.pmod(hashed, F.lit(buckets)).cast("int").alias("bucket"), order)
    counts = stage(bucketed.groupBy("bucket").count().withColumn("group", F.floor(F.col("bucket") / 4096)), "counts")
    earlier = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    of_groups = counts.groupBy("group").agg(F.sum("count").alias("n"))
    of_groups = of_groups.select("group", F.coalesce(F.sum("n").over(earlier(F.lit(0), "group")), F.lit(0)).alias("base_"))
    starts = counts.withColumn("within_", F.coalesce(F.sum("count").over(earlier("group", "bucket")), F.lit(0))).join(of_groups, "group")
    starts = stage(starts.select("bucket", (F.col("base_") + F.col("within_")).alias("before_")).coalesce(1 + buckets // 2**20), "starts")
    schema = docs.withColumn("shard", F.lit(0).cast("int")).withColumn("slot", F.lit(0).cast("long")).schema

    def shuffled(batches):
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        held.clear()
        bucket, before = rows.column("bucket").to_numpy(), rows.column("before_").to_numpy()
        # Arrival order depends on the exchange; the row's hash does not.
        order = np.lexsort((rows.column("order").to_numpy(), bucket))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            b = int(bucket[part[0]])
            part = part[np.random.Generator(np.random.PCG64([seed, b])).permutation(len(part))]
            at = before[part[0]] + np.arange(len(part), dtype=np.int64)
            shard, slot = (at % n_shards).astype(np.int32), at // n_shards
            for lo in range(0, len(part), 1024):
                out = pa.Table.from_struct_array(rows.column("row").take(part[lo : lo + 1024]))
                out = out.append_column("shard", pa.array(shard[lo : lo + 1024], pa.int32())).append_column("slot", pa.array(slot[lo : lo + 1024], pa.int64()))
                yield from out.to_batches()

    # The table of buckets is broadcast while it is small.
    scattered = bucketed.join(starts, "bucket").repartitionById(buckets, F.col("bucket"))
    path = f"{shared_dir(docs.sparkSession)}/larkspur/{name}-{_unique()}"
    scattered.mapInArrow(shuffled, schema).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    read = docs.sparkSession.read.schema(schema).parquet(path)
    return read.withColumn("shard", F.col("shard").cast(IntegerType())).withColumn("slot", F.col("slot").cast(LongType()))


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex


def sharded_documents(docs: DataFrame, n_shards: int = 8, seed: int = 42) -> DataFrame:
    """The digest of :func:`external_shuffle` over documents."""
    placed = external_shuffle(docs.select("doc_id", "text"), n_shards, seed)
    return placed.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
