"""File sources and sinks (S01-S04, S09-S22, S26-S29): Parquet, id arrays, tar shards, embeddings, JSON, results."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators.reshard import group_members
from quarrykit.session import ship

#: Fixed value: shard files are eight digits and an ending.
SHARD_GLOB = "[0-9]" * 8


def metadata(spark: SparkSession, folder: str, columns: list[str], metric: str | None = None, substring: bool = False) -> DataFrame:
    """Chosen columns of a folder's shard files, with caption under one name.

    metric: the side files {shard}_{metric}.parquet; with `substring` also those whose name only ends in it, as a looser match would find.
    """
    glob = f"{SHARD_GLOB}.parquet" if metric is None else f"*_{metric}.parquet" if substring else f"{SHARD_GLOB}_{metric}.parquet"
    out = spark.read.option("pathGlobFilter", glob).parquet(folder)
    if "caption" in columns and "caption" not in out.columns and "text" in out.columns:
        out = out.withColumnRenamed("text", "caption")
    return out.select(*columns)


def write_uids(uids: DataFrame, path: str) -> None:
    """The sorted id table, as Parquet in its order."""
    uids.write.mode("errorifexists").parquet(path)


def read_npy_uids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of .npy files (by their magic bytes) or of raw arrays of two unsigned 64-bit numbers; duplicates and order are kept by `at`."""
    ship(spark)
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("uid", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pair = np.dtype([("hi", "<u8"), ("lo", "<u8")])
                array = np.load(io.BytesIO(body)).view(pair) if body[:6] == b"\x93NUMPY" else np.frombuffer(body, pair)
                array = array.ravel()
                for a in range(0, len(array), 100_000):
                    part = array[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array([f"{int(h):016x}{int(x):016x}" for h, x in zip(part["hi"], part["lo"], strict=True)])], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, at long, uid string")


def read_tar_members(spark: SparkSession, path: str) -> DataFrame:
    """Url, at, name, data of regular members; a broken archive gives what can be read before the fault."""
    ship(spark)
    schema = pa.schema([("url", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                try:
                    with tarfile.open(fileobj=io.BytesIO(body)) as archive:
                        for member in archive:
                            if member.isreg():
                                data = archive.extractfile(member).read()
                                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((url, at, member.name, data), schema, strict=True)], schema=schema)
                                at += 1
                except (tarfile.TarError, EOFError, OSError):
                    continue

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "url string, at long, name string, data binary")


def read_tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """Url, key, parts (suffix -> bytes), and the uid of the json part."""
    samples = group_members(read_tar_members(spark, path))
    return samples.withColumn("uid", F.get_json_object(F.try_element_at("parts", F.lit("json")).cast("string"), "$.uid"))


def write_tar_shards(samples: DataFrame, folder: str) -> DataFrame:
    """(shard, at, key, parts) -> one {shard:08d}.tar a shard, as binary rows in Parquet under `folder`, and (shard, successes).

    A shard is one group, which the shard's size limit bounds. The file bodies are a table,
    so a lost executor only repeats its shards and no half-written file is left.
    """
    ship(samples.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        body = io.BytesIO()
        with tarfile.open(fileobj=body, mode="w") as archive:
            for r in rows:
                for suffix, data in r["parts"]:
                    info = tarfile.TarInfo(f"{r['key']}.{suffix}")
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
        return pa.table({"shard": [rows[0]["shard"]], "name": [f"{rows[0]['shard']:08d}.tar"], "successes": [len(rows)], "body": pa.array([body.getvalue()], pa.binary())})

    out = samples.select(F.col("shard").cast("long").alias("shard"), F.col("at").cast("long").alias("at"), "key", "parts").groupBy("shard").applyInArrow(run, "shard long, name string, successes long, body binary")
    out.write.mode("errorifexists").parquet(folder)
    return samples.sparkSession.read.parquet(folder).select("shard", "successes")


def read_embeddings(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Path, row, embedding of one array of .npz files; the row number is the join key to the metadata."""
    ship(spark)
    schema = pa.schema([("path", pa.string()), ("row", pa.int64()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix = np.load(io.BytesIO(body))[key].astype(np.float32)
                for a in range(0, len(matrix), 4096):
                    part = matrix[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(list(part), schema.field("embedding").type)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, embedding array<float>")


def shard_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Shard, size from the *_stats.json files that exist; the listing decides, so a gap in the numbers loses nothing."""
    rows = spark.read.option("pathGlobFilter", "*_stats.json").schema("successes long").json(folder)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)_stats\.json$", 1).alias("shard"), F.col("successes").alias("size"))


def read_json(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """JSON lines, or with `array` files that hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a CSV without header, as id."""
    return spark.read.schema("id string").csv(path)


def read_packed(spark: SparkSession, roots: str, schema: str) -> DataFrame:
    """Packed sequences under several roots, separated by colons."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*packed.json").option("multiLine", True).json(roots.split(":"))


def write_results(results: DataFrame, folder: str) -> None:
    """Results by rank; an existing folder is an error."""
    results.write.mode("errorifexists").partitionBy("rank").json(folder)


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> bool:
    """One JSON row, unless the path exists; says whether it was written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return False
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").write.text(path)
    return True


def verified(files: DataFrame, sha256: DataFrame) -> DataFrame:
    """(path, content) whose digest is the expected one of (path, sha256)."""
    return files.join(sha256, "path").where(F.sha2("content", 256) == F.col("sha256")).drop("sha256")
