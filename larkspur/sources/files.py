"""Files as tables: lines with their numbers, lists, JSON objects, arrays, hashes.

Listings come from Spark, which reads no contents for them; files are opened in
tasks, a large one by several of them where its format allows. Paths are those
of any file system that Spark and Arrow both know.
"""

from __future__ import annotations

import ast
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import staged


def listing(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(path, length, stem) of the files under a folder, whatever their depth; Spark leaves out empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(path)
    return files.select("path", "length", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"))


def _opened(path: str):
    """A file opened for reading at any place."""
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


# --- lines -------------------------------------------------------------------


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): all lines with their numbers from 1 in their file. Large
    files are read in pieces; what stands before a piece comes from the pieces' counts."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"))
    read = staged(read, "lines")  # ids would change if pieces were read anew
    counts = read.groupBy("file", "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "piece").orderBy("id"))
    return read.withColumn("own", own).join(starts, ["file", "piece"]).select("file", (F.col("own") + F.col("before")).alias("line"), "value")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: (the schema's columns, file, line). A line that is no JSON
    or no object is an error that names its file and number, as is a value that
    does not fit the schema; blank lines are skipped, but counted."""
    told = lines(spark, path).filter(F.trim("value") != "")
    value = F.expr("try_parse_json(value)")
    where = F.concat(F.col("file"), F.lit(" line "), F.col("line").cast("string"))
    kind = F.schema_of_variant(value)
    checked = (
        F.when(value.isNull(), F.raise_error(F.concat(where, F.lit(" is not JSON"))).cast("string"))
        .when(~kind.startswith("OBJECT"), F.raise_error(F.concat(where, F.lit(" must be a JSON object"))).cast("string"))
        .otherwise(F.col("value"))
    )
    return told.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("row"), "file", "line").select("row.*", "file", "line")


def read_list(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """(file, at, name): the names that list files hold, in any of three forms: one
    a line; a JSON array; or a JSON object, by its "stale" lists of ``stage`` or
    its "clips" (names, rows with a "clip", or an object's keys in order). An
    object without the stage, rows without a clip, and other objects are errors.
    A list file is read whole by one task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    plain = F.filter(F.transform(F.split("value", r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    names = "array<string>"
    parsed = F.from_json("value", "struct<stale: map<string, array<string>>, clips: string>")
    wrong = lambda text: F.raise_error(F.concat(F.col("file"), F.lit(f": {text}"))).cast(names)
    stale, clips = F.col("p.stale"), F.col("p.clips")
    rows = F.from_json(clips, "array<struct<clip: string>>")
    of_clips = (
        F.when(clips.startswith("{"), F.array_sort(F.map_keys(F.from_json(clips, "map<string, string>"))))
        .when(F.get_json_object("value", "$.clips[0]").startswith("{"), F.when(F.exists(rows, lambda r: r["clip"].isNull()), wrong("rows without a clip")).otherwise(F.transform(rows, lambda r: r["clip"])))
        .otherwise(F.from_json(clips, names))
    )
    of_object = (
        F.when(stale.isNotNull(), F.coalesce(F.try_element_at(stale, F.lit(stage)), wrong(f"an audit that did not cover {stage}")))
        .when(clips.isNotNull(), of_clips)
        .otherwise(wrong("neither stale names nor clips"))
    )
    begin = F.substring(F.ltrim("value"), 1, 1)
    found = F.when(begin == "[", F.coalesce(F.from_json("value", names), wrong("no list of names"))).when(begin == "{", of_object).otherwise(plain)
    return whole.withColumn("p", F.when(begin == "{", parsed)).select("file", F.posexplode(found).alias("at", "name"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, stem, report): one JSON object a file, as a variant; anything else is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    value = F.expr("try_parse_json(value)")
    fine = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    bad = F.raise_error(F.concat(F.col("file"), F.lit(" is no JSON object"))).cast("string")
    return whole.withColumn("value", F.when(fine, F.col("value")).otherwise(bad)).select("file", F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.expr("parse_json(value)").alias("report"))


def dig(report: Column, path: str) -> Column:
    """The number at a dotted path; null where there is none, or no number."""
    at = F.try_variant_get(report, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")
    return F.when(F.schema_of_variant(at).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(at, "$", "double"))


# --- arrays ------------------------------------------------------------------


def write_arrays(df: DataFrame, name: str, order: str, vector: str, path: str, rows: int = 65_536) -> None:
    """Vectors as ``.npy`` files in ``path``: <name>-<block>.npy has up to ``rows``
    rows of float64, by ``order`` (which counts a name's rows from 0). A new
    folder only; tasks write beside the name and rename, so a repeated task does no harm."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        raise ValueError(f"{path} is there")
    system.create_dir(at, recursive=True)

    def write(table):
        table = table.sort_by("nth_")
        x = np.array(table.column("x_").to_pylist(), dtype="<f8")
        head = repr({"descr": "<f8", "fortran_order": False, "shape": x.shape})
        head += " " * (-(len(head) + 11) % 64) + "\n"
        own = f"{table.column('name_')[0].as_py()}-{table.column('block_')[0].as_py():05d}.npy"
        target, to = fs.FileSystem.from_uri(path)
        draft = f"{to}/.{own}.{hashlib.sha256(str(np.random.default_rng().integers(1 << 62)).encode()).hexdigest()[:12]}"
        with target.open_output_stream(draft) as out:
            out.write(b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + x.tobytes())
        target.move(draft, f"{to}/{own}")
        return pa.table({"file": [own]})

    placed = df.select(F.col(name).cast("string").alias("name_"), F.floor(F.col(order) / rows).cast("int").alias("block_"), F.col(order).cast("long").alias("nth_"), F.transform(vector, lambda v: v.cast("double")).alias("x_"))
    placed.groupBy("name_", "block_").applyInArrow(write, "file string").count()


def _header(handle) -> tuple[np.dtype, tuple[int, ...], int]:
    """Kind, shape and first byte of the numbers of a ``.npy`` file."""
    start = handle.read(12)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    wide = start[6] > 1
    size = struct.unpack("<I", start[8:12])[0] if wide else struct.unpack("<H", start[8:10])[0]
    begin = 12 if wide else 10
    handle.seek(begin)
    told = ast.literal_eval(bytes(handle.read(size)).decode("latin1"))
    kind = np.dtype(told["descr"])
    if kind.hasobject or told["fortran_order"] or kind.kind not in "iufb":
        raise ValueError(f"an array of {told['descr']}, {'by columns' if told['fortran_order'] else 'by rows'}: only numbers by rows are read")
    return kind, tuple(told["shape"]), begin + size


def read_arrays(spark: SparkSession, path: str, part: int = 32 << 20) -> DataFrame:
    """(stem, row, values): the rows of all ``.npy`` files under a folder as doubles;
    further dimensions are laid out flat. A file is read in parts of ``part``
    bytes by as many tasks, each seeking to the rows that begin in its own."""
    files = listing(spark, path, "*.npy")
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / part)))).repartition("path", "part")

    def read(batches):
        for b in batches:
            for file, stem, nth in zip(b.column("path").to_pylist(), b.column("stem").to_pylist(), b.column("part").to_pylist(), strict=True):
                with _opened(file) as handle:
                    kind, shape, begin = _header(handle)
                    count, width = (shape or (1,))[0], int(np.prod(shape[1:], dtype=np.int64))
                    size = max(1, width * kind.itemsize)
                    first = lambda at: min(count, max(0, -(-(at - begin) // size)))  # noqa: B023, E731
                    low, high = first(nth * part), first((nth + 1) * part)
                    handle.seek(begin + low * size)
                    for lo in range(low, high, 4_096):
                        n = min(4_096, high - lo)
                        data = handle.read(n * width * kind.itemsize)
                        if len(data) < n * width * kind.itemsize:
                            raise ValueError(f"{file} ends before its {count} rows")
                        x = np.frombuffer(data, dtype=kind).astype(np.float64)
                        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                        yield pa.RecordBatch.from_arrays([pa.array([stem] * n), pa.array(np.arange(lo, lo + n, dtype=np.int64)), pa.ListArray.from_arrays(offsets, pa.array(x))], names=["stem", "row", "values"])

    return parts.select("path", "stem", "part").mapInArrow(read, "stem string, row long, values array<double>")


def aligned(**sides: DataFrame) -> DataFrame:
    """(stem, row, one column for each side): arrays of the same stems and rows side
    by side. A stem that a side lacks, or has with another number of rows, is an error."""
    names = list(sides)
    counts = None
    for name, df in sides.items():
        own = df.groupBy("stem").agg(F.count(F.lit(1)).alias(name))
        counts = own if counts is None else counts.join(own, "stem", "full")
    odd = counts.filter(~F.coalesce(F.array_min(F.array(*names)) == F.array_max(F.array(*names)), F.lit(False)) | F.exists(F.array(*names), lambda n: n.isNull()))
    if some := odd.orderBy("stem").limit(3).collect():
        raise ValueError(f"sides differ: {[r.asDict() for r in some]}")
    out = None
    for name, df in sides.items():
        own = df.select("stem", "row", F.col("values").alias(name))
        out = own if out is None else out.join(own, ["stem", "row"])
    return out


# --- hashes ------------------------------------------------------------------


def content_hashes(files: DataFrame, head: int | None = None) -> DataFrame:
    """Add ``sha256`` of each file's bytes, read in pieces of a megabyte, and
    ``identity``: the length and the hash, or with ``head`` that of the first
    ``head`` bytes alone, of which no more are read (then ``sha256`` is null)."""
    schema = files.withColumn("sha256", F.lit(None).cast("string")).withColumn("identity", F.lit("")).schema

    def hashed(batches):
        for b in batches:
            whole, names = [], []
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                digest, left = hashlib.sha256(), length if head is None else min(head, length)
                with _opened(path) as handle:
                    while left > 0 and (data := handle.read(min(left, 1 << 20))):
                        digest.update(data)
                        left -= len(data)
                whole.append(digest.hexdigest() if head is None else None)
                names.append(f"{length}:{digest.hexdigest()}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole, pa.string()), pa.array(names, pa.string())], names=[*b.schema.names, "sha256", "identity"])

    return files.repartition(F.col("path")).mapInArrow(hashed, schema)
