"""Shared helpers: table access, shared-folder staging, size-checked broadcast, vectorised word hashing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Text bytes that one vectorised step works on; a longer document is its own step.
STEP_BYTES = 4 << 20
#: Rows and bytes of text up to which a counted table may be broadcast: some tens of MB in the driver.
SMALL_ROWS, SMALL_BYTES = 300_000, 16 << 20
#: Bytes of a record batch on its way to a Python worker, or one row; Spark's own bound is 64 MB, and executor and worker hold a batch several times.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="veridex-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, label: str, compression: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridex-{label}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._veridex_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_veridex_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether df is counted to hold at most max_rows rows and, in its text and binary columns, at most max_bytes."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    size = sum(wide, F.lit(0).cast("long"))
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Marks df, a table of scalar columns, for broadcast if it is small; else it joins by a shuffle."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def bound_batches(spark: SparkSession) -> None:
    """Lets the session's record batches end at BATCH_BYTES, also those of frames that run later; a lower bound of its own stays.

    Every row still goes to the workers, in more batches.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sweep(spark: SparkSession) -> None:
    """Lets Python and the JVM drop what nothing refers to any more, so that Spark removes its shuffle files and broadcasts too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- words of whole texts, vectorised -------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> _S30)) * _K2
    x = (x ^ (x >> _S27)) * _K3
    return x ^ (x >> _S31)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n, first = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[first : first + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges [i, j) of documents with at most limit bytes each, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte lengths, and per document the index of its first word (n + 1 entries); A-Z count as a-z."""
    data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[:1] = True
    np.logical_not(solid[:-1], out=before[1:])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:] = True
    np.logical_not(solid[1:], out=after[:-1])
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    length = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    h = length.astype(np.uint64) * _K1
    live, at = np.arange(len(starts)), starts
    while len(live):
        left = ends[live] - at
        bits = (np.minimum(left, 8) * 8).astype(np.uint64)
        part = eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits))
        h[live] = mix(h[live] ^ part) + _K1
        more = left > 8
        live, at = live[more], at[more] + 8
    return h, length, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles in order, and each document's first one; fewer words than size make one shingle."""
    h, _, first = words(data, offsets)
    count = np.diff(first)
    out_count = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    out_first = np.concatenate([[0], np.cumsum(out_count)])
    doc = np.repeat(np.arange(len(count)), out_count)
    at = first[doc] + (np.arange(out_first[-1]) - out_first[doc])
    span = np.minimum(count[doc], size)
    s = span.astype(np.uint64)
    last = len(h) - 1
    for k in range(size):
        nxt = mix((s ^ h[np.minimum(at + k, last)]) * _K1) + np.uint64(k + 1) if last >= 0 else s
        s = np.where(span > k, nxt, s)
    return s, out_first
