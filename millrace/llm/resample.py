"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words and word pairs fall into hash buckets. Their number follows the corpus as its distinct n-grams do, by the square root of
the bytes of its texts (``bucket_count``: ``LEAST_BUCKETS`` up to 1 GB, 33 million for 100 TB), so the same rows have the same buckets however they are
stored. The raw model counts the buckets over all
documents; the target model over documents labelled good (at most ``MAX_TARGET`` of them, the first
by a hash of doc_id; a documented bound of the fit). A document's log importance weight is the sum over its
n-grams of the target's log probability less the raw text's. Adding Gumbel noise and keeping the k
greatest keys samples k documents without replacement, in proportion to their weights. The noise
comes from a hash of doc_id, text and the seed, so the sample is reproducible. The log ratios, 4 bytes a bucket, reach tasks as a broadcast variable, once an executor.

A text of any length is counted and weighed whole, in pieces. k is ``share`` of all documents; by default the share of good ones among the labelled. The k-th key
is found exactly, by counting keys in ever finer ranges. Documents that tie with it are all selected.

Null and empty texts have weight 0. Identical rows have equal keys. Without good labels both
models are the raw one and all weights are 0. Only doc_id and text, and the labels' doc_id and
quality, are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, SPACES, drop_staged, gram_hashes, staged, text_chunks, tuned, word_hashes, words

LEAST_BUCKETS, FLUSH = 1 << 16, 2_000_000
MAX_TARGET = 20_000
SEED = 17


def bucket_count(docs: DataFrame) -> int:
    """The least power of two that isn't below twice the square root of the texts' bytes."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(2 * math.sqrt(size + 1))))


def buckets(data: np.ndarray, offsets: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word and each pair of neighbours, and the document each belongs to."""
    lowered = LOWER[data]
    starts, ends, first = words(data, offsets, SPACES)
    hashes = word_hashes(lowered, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = gram_hashes(hashes, 2)
    same = doc[1:] == doc[:-1]
    return (np.concatenate([hashes, pairs[same]]) % np.uint64(number)).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def bucket_counts(docs: DataFrame, target_ids: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, raw, target: the counts of both models. The table of target ids is bounded and broadcast."""
    rows = docs.select("doc_id", "text").join(F.broadcast(target_ids.withColumn("target", F.lit(True))), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            # The lowest bit tells the target.
            keys, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            own = keys & 1
            return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(times.astype(np.int64)), pa.array(times * own)], ["bucket", "raw", "target"])

        for batch in batches:
            target = np.asarray(batch.column("target").fill_null(False).to_pylist(), dtype=np.int64)
            for a, b, data, offsets in text_chunks(batch):
                found, doc = buckets(data, offsets, n_buckets)
                held.append(2 * found + target[a:b][doc])
                size += len(found)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        yield flush()

    counted = rows.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    return staged(counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "buckets")


def log_ratio(counts: DataFrame, n_buckets: int, smoothing: float = 1.0) -> np.ndarray:
    """Of each bucket, the target's log probability less the raw one's; without a target, 0. One number a bucket reaches the driver."""
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target:
        return np.zeros(n_buckets, np.float32)
    shift = math.log(raw + smoothing * n_buckets) - math.log(target + smoothing * n_buckets)
    ratio = F.log(F.col("target") + smoothing) - F.log(F.col("raw") + smoothing) + F.lit(shift)
    out = np.full(n_buckets, shift, np.float32)
    for part in counts.select(F.col("bucket").cast("int").alias("bucket"), ratio.cast("float").alias("ratio")).toArrow().to_batches():
        out[part.column("bucket").to_numpy()] = part.column("ratio").to_numpy()
    return out


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, noise_key (a hash for the noise), n_grams, log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            total, number = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for a, b, data, offsets in text_chunks(batch):
                found, doc = buckets(data, offsets, len(ratio))
                total[a:b] = np.bincount(doc, weights=ratio[found], minlength=b - a)
                number[a:b] = np.bincount(doc, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("noise_key"), pa.array(number), pa.array(total)], ["doc_id", "noise_key", "n_grams", "log_weight"])

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(SEED)).alias("noise_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, noise_key long, n_grams long, log_weight double")


def kth_greatest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th greatest value of a double column, exactly, by counting values in ever finer ranges; 4096 rows a round reach the driver."""
    if k <= 0:
        return None
    low, high, count = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not count:
        return None
    k = min(k, count)
    # The k-th greatest lies between low and high, which are values; ``above`` values are greater than high.
    above = 0
    while low < high:
        width = (high - low) / 4096
        place = F.when(F.lit(width > 0), F.least(F.floor((F.col(column) - low) / (width or 1.0)), F.lit(4095))).otherwise((F.col(column) > low).cast("long"))
        ranges = df.where(F.col(column).between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: -r.place):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, max_target: int = MAX_TARGET, n_buckets: int | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key, selected for every document."""
    tuned(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if share is None:
        share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    ids = [r.doc_id for r in known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id").collect()]
    target = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    n_buckets = n_buckets or bucket_count(docs)
    counts = bucket_counts(docs, target, n_buckets)
    ratio = log_ratio(counts, n_buckets)
    drop_staged(counts)
    uniform = (F.pmod(F.col("noise_key"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    scored = staged(log_weights(docs, ratio).select("doc_id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key")), "resample")
    bound = kth_greatest(scored, "key", round(share * scored.count()))
    return scored.withColumn("selected", F.lit(False) if bound is None else F.col("key") >= F.lit(float(bound)))
