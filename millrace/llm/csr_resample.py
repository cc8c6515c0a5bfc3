"""Importance resampling towards a target distribution, over a persisted sparse matrix of documents by buckets.

Features are all runs of one to ``LONGEST`` consecutive words, joined by a space; a feature's bucket is the crc32 of its bytes modulo ``N_BUCKETS``
(a parameter of the model, at every size of corpus). The counts are written once to the shared folder as CSR blocks: each row of that table
is a block of documents with its row pointers, columns and counts. Column sums of the corpus's and of the
target's matrix are the two distributions; a bucket's gain is the logarithm of the target's share over the corpus's, in thousandths, rounded down. Weights
are the product of the matrix and the vector of gains. So texts are read once, and both passes over the matrix read numbers only.

The buckets' sums reach the driver, N_BUCKETS rows however large the corpus, and the gains go to tasks in the
function (80 KB). A text of any length is counted whole, in slices of words. crc32 is a linear code, so that of a run of words follows from those of
its words: the first is carried over the others' lengths by a table, which is done for all runs of a chunk at once.

A document's score is its weight plus Gumbel noise from a hash of doc_id. Of the documents with ``MIN_WORDS`` words or more, the greatest scores are
drawn without replacement, ties to smaller doc_id. They are ranked by ranges of the order, so no task holds all of them.

Null and empty texts have no features, and weight 0. Repeated rows count each time and are drawn each on its own. A null doc_id has the noise of
the text "null" and comes before all others of its score. An empty target leaves its sums 0, an empty corpus gives no rows. Columns other than doc_id and text
aren't read; of the target only text is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import LOWER, NOT_WORD, drop_staged, shared_path, staged, text_chunks, trimmed, tuned, words
from millrace.llm.order import numbered

N_BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, SHARE, SEED = 20, 0.05, "42"
SLICE, TABLED = 1 << 18, 48
#: Readers hold a row group's rows at once, 100 at least, so blocks are of little text (or one document) and groups small.
BLOCK_BYTES, ROW_GROUP = 1 << 15, 4 << 20


def _byte_table() -> np.ndarray:
    """Fixed rule: the table of the reflected CRC-32 polynomial, a byte at a time."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: byte k of a checksum, of value b, carried over n zero bytes; the carried checksum is the exclusive or over k."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(TABLED):
        out[n + 1] = BYTE[out[n] & 0xFF] ^ (out[n] >> 8)
    return out


SHIFT = _shift_tables().reshape(-1)


def carried(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of crc32(a + b) that comes from crc32(a), where b has n bytes: crc32(a + b) is this, xor crc32(b)."""
    out, left = crc.copy(), n.astype(np.int64)
    while True:
        step = np.minimum(left, TABLED)
        base = step * 1024
        out = SHIFT[base + (out & 0xFF)] ^ SHIFT[base + 256 + (out >> 8 & 0xFF)] ^ SHIFT[base + 512 + (out >> 16 & 0xFF)] ^ SHIFT[base + 768 + (out >> 24)]
        left = left - step
        if not left.any():
            return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word: all words a byte at a time, the longest ones by zlib."""
    sizes = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(sizes <= TABLED)
    order = short[np.argsort(-sizes[short], kind="stable")]
    # Words by falling length: at step k those with more than k bytes come first.
    at, n = starts[order], np.searchsorted(-sizes[order], -np.arange(TABLED), side="left")
    state = out[order]
    for k in range(TABLED):
        m = n[k]
        if not m:
            break
        state[:m] = BYTE[(state[:m] ^ data[at[:m] + k]) & 0xFF] ^ (state[:m] >> 8)
    out[order] = ~state
    for k in np.flatnonzero(sizes > TABLED):
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


SPACE = np.uint32(zlib.crc32(b" "))


def features(crc: np.ndarray, size: np.ndarray, doc: np.ndarray, new: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each run of words; with ``new``, only runs that end at that word or later."""
    kept = [crc[new:]], [doc[new:]]
    run, spaced = crc, carried(np.full(len(crc), SPACE), size) ^ crc
    for longer in range(1, LONGEST):
        # The run that ends a word earlier, a space and the word.
        run = carried(run[: len(run) - 1], size[longer:] + 1) ^ spaced[longer:] if len(run) > 1 else crc[:0]
        first = max(new - longer, 0)
        same = doc[: len(doc) - longer] == doc[longer:] if len(doc) > longer else np.zeros(0, bool)
        same[:first] = False
        kept[0].append(run[same])
        kept[1].append(doc[longer:][same])
    return np.concatenate(kept[0]) % np.uint32(N_BUCKETS), np.concatenate(kept[1])


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """One lowered text in pieces that end between words."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not NOT_WORD[data[end]]:
            further = np.flatnonzero(NOT_WORD[data[end : end + SLICE]])
            end = end + int(further[0]) if len(further) else min(end + SLICE, len(data))
        yield data[at:end]
        at = end


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, row pointers, columns, counts) of a chunk of texts."""
    n = len(offsets) - 1
    if n == 1 and len(data) > SLICE:
        # One long text: its row is dense.
        total, n_words, crc, size = np.zeros(N_BUCKETS, np.int64), 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for part in _slices(data):
            part = LOWER[part]
            starts, ends, _ = words(part, np.array([0, len(part)]), NOT_WORD)
            carry = len(crc)
            crc, size = np.concatenate([crc, word_crcs(part, starts, ends)]), np.concatenate([size, ends - starts])
            bucket, _ = features(crc, size, np.zeros(len(crc), np.int64), carry)
            total += np.bincount(bucket, minlength=N_BUCKETS)
            n_words += len(starts)
            crc, size = crc[1 - LONGEST :], size[1 - LONGEST :]
        columns = np.flatnonzero(total)
        return np.array([n_words]), np.array([0, len(columns)]), columns, total[columns]
    lowered = LOWER[data]
    starts, ends, first = words(lowered, offsets, NOT_WORD)
    n_words = np.diff(first)
    bucket, doc = features(word_crcs(lowered, starts, ends), ends - starts, np.repeat(np.arange(n), n_words))
    cells, counts = np.unique(doc * N_BUCKETS + bucket, return_counts=True)
    return n_words, np.searchsorted(cells, np.arange(n + 1) * N_BUCKETS), cells % N_BUCKETS, counts


BLOCK = "n_words array<long>, row_ends array<int>, columns array<int>, counts array<int>"


def matrix(texts: DataFrame, name: str, keys: bool = True) -> DataFrame:
    """The persisted matrix: a row for each block of documents, with doc_ids, words of each, row pointers (without the leading 0), columns and counts."""
    tuned(texts.sparkSession)
    spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType if keys else None
    ids = to_arrow_type(kind) if keys else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id") if keys else None
            for a, b, data, offsets in text_chunks(batch, limit=BLOCK_BYTES):
                n_words, pointers, columns, counts = counted(data, offsets)
                own = doc_ids[a:b] if keys else pa.array([], ids)
                cells = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((n_words, pa.int64()), (pointers[1:], pa.int32()))]
                wide = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in (columns, counts)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *cells, *wide], ["doc_ids", "n_words", "row_ends", "columns", "counts"])

    schema = f"doc_ids array<{kind.simpleString() if keys else 'long'}>, {BLOCK}"
    path = shared_path(spark, name)
    read = texts.select(*(["doc_id"] if keys else []), "text")
    read.mapInArrow(trimmed(run), schema).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(schema).parquet(path)


def column_sums(blocks: DataFrame) -> np.ndarray:
    """Sums over all documents, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_BUCKETS, np.int64)
        for batch in batches:
            for columns, counts in zip(batch.column("columns"), batch.column("counts")):
                np.add.at(total, columns.values.to_numpy(), counts.values.to_numpy())
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    sums = blocks.select("columns", "counts").mapInArrow(trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N_BUCKETS, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1.0) * (s.sum() + N_BUCKETS) / ((s + 1.0) * (t.sum() + N_BUCKETS))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains."""
    kind = blocks.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, n_words, ends, columns, counts in zip(*[batch.column(c) for c in ("doc_ids", "n_words", "row_ends", "columns", "counts")]):
                counts = counts.values.to_numpy().astype(np.int64)
                bounds = np.concatenate([[0], ends.values.to_numpy()])
                sums = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (counts, counts * gain[columns.values.to_numpy()])]
                yield pa.RecordBatch.from_arrays([doc_ids.values, n_words.values, *[pa.array(np.diff(x)) for x in sums]], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(trimmed(run), f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share_of: tuple[int, int] = (5, 100), min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every document; rank from 1 for the drawn ones, else null. share_of: drawn, of how many."""
    blocks, wanted = matrix(docs, "csr"), matrix(target, "csr-target", keys=False)
    gain = gains(column_sums(blocks), column_sums(wanted))
    scored = staged(weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "csr-scored")
    drop_staged(blocks, wanted)
    able = scored.where(F.col("n_words") >= min_words)
    k = able.count() * share_of[0] // share_of[1]
    drawn = numbered(able, [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_features"), F.col("n_words")], None, "csr-order")
    rank = F.when(F.col("place") < k, F.col("place") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return drawn.select(*columns, rank).unionByName(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))
