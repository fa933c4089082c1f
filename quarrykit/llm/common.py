"""Shared pieces: words, vectorised hashing, Arrow batches, shared-folder tables.

A *word* is a run of characters outside space and ``\\t``..``\\r``; null texts have
no words.  All hashing is by fixed constants, so any executor computes the same
value for the same bytes.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.session import ship

#: Fixed value: the pattern of a word, in the syntax shared by Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker turns into numpy arrays at a time.
CHUNK_BYTES = 1 << 18
#: Bytes up to which a stored table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_U = np.uint64


# --------------------------------------------------------------------- Spark side


def n_words(text: Column) -> Column:
    """Number of words of a text, on the JVM; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one made here, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quarrykit-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/quarrykit/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files of what has been written go once the driver's garbage is collected.
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value; those of an array by its length and the fields of an element."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        fields = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
        return F.coalesce(F.size(name), F.lit(0)) * (8 + 8 * fields) + 16
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast only if the sum of its rows' bytes is shown to be small."""
    size = df.agg(F.sum(sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(16)))).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------- Arrow side


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about `size` bytes of the text column, with its values as bytes (null: empty)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start, total, texts = 0, 0, []
        for i, value in enumerate(batch.column(at).cast(pa.large_binary())):
            raw = value.as_py() or b""
            texts.append(raw)
            total += len(raw) + 1
            if total >= size:
                yield batch.slice(start, i + 1 - start), texts
                start, total, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with this package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(rows: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


# --------------------------------------------------------------------- numpy side


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply, three rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; kept for the worker's life up to 16 M."""
    up, down = _power["up"], _power["down"]
    if len(up) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if size <= 1 << 24:
            _power["up"], _power["down"] = up, down
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial hash of data[i:j] times base**i."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [starts, ends), by content alone."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words of several texts at once: doc (index of the text), hash, start and end in the joined bytes."""

    def __init__(self, texts: list[bytes], lower: bool):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = _LOWER[data] if lower else data
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(lens)))
        inside = ~_SPACE[self.data]
        step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            step = np.concatenate(([0], step))
        self.start, self.end = step[0::2], step[1::2]
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end) if len(step) else np.zeros(0, np.uint64)
        #: words of text i are at bounds[i]:bounds[i + 1]
        self.bounds = np.searchsorted(self.start, self.first)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of a text's k-word shingles; of fewer words the whole sequence as one; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = hashes[: n - width + 1].copy()
    for i in range(1, width):
        out = out * _U(0xFF51AFD7ED558CCD) + hashes[i : n - width + 1 + i]
    return np.unique(mix(out + _U(width)))


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed longs, of an array of hashes: equal arrays only give equal ones."""
    n = np.arange(1, len(values) + 1, dtype=np.uint64)
    a, b = (int(mix(values + n * _U(c)).sum(dtype=np.uint64)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
    return a - ((a >> 63) << 64), b - ((b >> 63) << 64)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
