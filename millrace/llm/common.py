"""Shared pieces: staged tables in the cluster's shared folder, and vectorised text hashing.

Texts are handled as the UTF-8 bytes of Arrow columns, so that one numpy pass serves a whole
chunk of documents. Chunks are bounded by bytes (a longer document is a chunk of its own).
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: The multipliers of the public splitmix64 finaliser, and an odd base for polynomial hashes.
MIX_1, MIX_2, BASE = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 18


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, for texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, as in tests on one machine, one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/millrace/" in path:
                jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are done."""
    gc.collect()
    spark._jvm.System.gc()


#: What an operator keeps in a worker from one task to the next.
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """The state of this key, made where the worker has none; trimmed functions that don't name the key drop it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def trimmed(run: Callable[[Iterator], Iterator], keep: str | None = None) -> Callable[[Iterator], Iterator]:
    """The same function for mapInArrow, which gives freed memory back at its end, for workers live on; of what they keep, only the named state outlives its start."""

    def trimming(batches: Iterator) -> Iterator:
        for key in [k for k in _KEPT if k != keep]:
            del _KEPT[key]
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
                trim.malloc_trim(0)

    return trimming


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over a uint64 array."""
    x = x ^ (x >> U64(30))
    x *= MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges, both ends included."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators, in lower-cased text, of words of ASCII digits, letters and any other script.
NOT_WORD = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SPACES = byte_table((0x20, 0x20), (0x09, 0x0D))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows; null texts count as empty."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(array):
        return
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (never across documents), and the index of each document's first word."""
    return runs(~separators[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the runs of bytes that are inside a word."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; in pieces of about CHUNK_BYTES, so that a long text takes little more than its hashes."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    cuts = [0, *(np.flatnonzero(np.diff(starts // CHUNK_BYTES)) + 1).tolist(), len(starts)]
    return np.concatenate([_word_hashes(lowered, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])


def _word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (lowered[np.repeat(starts, lengths) + within].astype(U64) + U64(1)) * powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(values, first) + lengths.astype(U64) * BASE)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes, by the run's first word; runs across documents are for the caller to skip."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    weights, out = powers(n + 1, MIX_1)[1:], np.zeros(m, dtype=U64)
    for k in range(n):
        out += hashes[k : k + m] * weights[k]
    return mixed(out)


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size; exact for files, and very large where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, part_bytes: int, least: int) -> int:
    """Parts of about part_bytes of input each; where the size is unknown, as many as Spark shuffles to."""
    size = size_bytes(df)
    known = -(-size // part_bytes) if size < 1 << 56 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(known, 1 << 20))
