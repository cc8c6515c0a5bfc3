"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its lines that aren't blank. Round k has, for each suffix of each
sequence, the rank of its first 2^k lines among all such runs (a suffix array to that depth). The next
round ranks the pairs (rank at i, rank at i + 2^k): distinct pairs are dealt out by range and sorted, and
a pair's place in this global order is its rank, so that no group of equal suffixes meets in one
task. Suffixes that no other suffix equals have no longer repeats and drop out.

A run counts from ``min_chars`` characters on, line breaks aside, whatever its number of lines. A maximal
repeated run is the union of its shortest windows of min_chars characters: for each line, the one that
begins and the one that ends with it (where the run leaves no room for the former, the one that ends with
the run has the line). These alone are looked up. A window of n lines, 2^k < n < 2^(k+1), is told by the ranks
of its first and its last 2^k lines; doubling ends when no suffix left has a longer window.

A run's first copy, by doc_id (null first), then text hash
and line, stays; the lines of every later copy are deleted, also where copies lie in one document or overlap.
Blank lines stay. A text of which only blanks would remain becomes empty.

The first 2^k lines of suffixes of one rank are equal: such a rank is an interval of the suffix array whose longest
common prefix has 2^k lines at least, and a pair of ranks one of a window's lines. The array is sorted as deep as windows go.

Null texts stay null and empty texts empty. Identical rows (doc_id and text) are one document here: each
gets the same result. All other columns, whatever their names, are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import drop_staged, staged, trimmed, tuned

MIN_CHARS = 50
KEYS = ("doc_id", "text_key")


def shortest(chars: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of the shortest windows of min_chars characters that begin or end with each line, by first line."""
    total, n = np.concatenate([[0], np.cumsum(chars)]), len(chars)
    at, counts = np.arange(n), np.diff(offsets)
    begin, end = np.repeat(offsets[:-1], counts), np.repeat(offsets[1:], counts)
    stop = np.maximum(np.searchsorted(total, total[:-1] + min_chars), at + 1)
    start = np.minimum(np.searchsorted(total, total[1:] - min_chars, side="right") - 1, at)
    ahead, behind = stop <= end, start >= begin
    pairs = np.unique(np.stack([np.concatenate([at[ahead], start[behind]]), np.concatenate([(stop - at)[ahead], (at + 1 - start)[behind]])]), axis=1)
    return pairs[0], pairs[1]


def sequences(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that isn't blank: its document, its place among them, two hashes and the sizes of the windows to look up from it."""
    lines = docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("text_key"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    hashed = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.length(x).cast("long").alias("chars"))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("text_key long, at int, a long, b long, sizes array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lines")
            offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            a, b, chars = lists.flatten().flatten()
            starts, sizes = shortest(chars.to_numpy(), offsets, min_chars)
            row = np.repeat(np.arange(len(lists)), np.diff(offsets))
            bounds = np.searchsorted(starts, np.arange(len(row) + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(bounds), pa.array(sizes.astype(np.int32)))
            places = pa.array((np.arange(len(row)) - offsets[row]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)), places, a, b, own], schema.names)

    tuned(docs.sparkSession)
    return lines.select(*KEYS, F.transform("lines", hashed).alias("lines")).mapInArrow(trimmed(run), schema)


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """a, b, size, rank, first: the pairs of more than one window, by their place in the global order, with the first window of each."""
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text_key", "at"))
    pairs = rows.groupBy("a", "b", "size").agg(first.alias("first"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text_key", "at")).alias("last"))
    repeated = pairs.where("first <> last").drop("last")
    ordered = repeated.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())
    return staged(ordered, name)


def repeats(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_key, at, size: every shortest window of min_chars characters that stands earlier too."""
    rows, size, found, levels = sequences(docs, min_chars).withColumn("size", F.lit(1)), 1, [], []
    while True:
        ranks = _ranked(rows, f"ranks{size}")
        level = staged(rows.join(ranks, ["a", "b", "size"]).dropDuplicates([*KEYS, "at", "size"]).select(*KEYS, "at", "size", "sizes", "rank", "first"), f"suffixes{size}")
        drop_staged(ranks)
        levels.append(level)
        later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("at") == F.col("first.at")))
        found.append(level.where(later & F.array_contains("sizes", F.col("size"))).select(*KEYS, "at", "size"))
        suffixes = level.where(F.col("size") == size)
        if suffixes.where(F.array_max("sizes") > size).isEmpty():
            every = staged(reduce(DataFrame.unionByName, found), "repeats")
            drop_staged(*levels)
            return every
        ahead = F.first("rank").over(Window.partitionBy(*KEYS).orderBy("at").rangeBetween(size, size))
        pairs = suffixes.select(*KEYS, "at", "sizes", F.col("rank").alias("a"), ahead.alias("b"), F.lit(2 * size).alias("size")).where("b IS NOT NULL")
        between = F.explode(F.filter("sizes", lambda x: (x > size) & (x < 2 * size)))
        wanted = suffixes.select(*KEYS, "at", "sizes", F.col("rank").alias("a"), between.alias("size")).alias("w")
        ends = suffixes.select(*KEYS, "at", "rank").alias("e")
        same = F.col("w.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("w.text_key") == F.col("e.text_key")) & (F.col("w.at") + F.col("w.size") - size == F.col("e.at"))
        rows = pairs.unionByName(wanted.join(ends, same).select("w.*", F.col("e.rank").alias("b")))
        size *= 2


def later_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, runs: first line and number of lines, among the lines that aren't blank, of each window to delete."""
    return repeats(docs, min_chars).groupBy(*KEYS).agg(F.collect_list(F.struct("at", "size")).alias("runs"))


def covered(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sorted places that windows cover, each once however many windows overlap there."""
    ends = at + size
    if not len(at):
        return ends
    depth = np.bincount(at, minlength=int(ends.max()) + 1) - np.bincount(ends, minlength=int(ends.max()) + 1)
    return np.flatnonzero(np.cumsum(depth))


def _places(runs: pa.ListScalar) -> list[int]:
    if runs.values is None:
        return []
    at, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in runs.values.flatten())
    return covered(at, size).tolist()


def without(text: str, removed: list[int]) -> tuple[str, int]:
    """The text without the lines at these places among those that aren't blank, and the number of the latter."""
    gone, kept, place = set(removed), [], 0
    for line in text.split("\n"):
        if line.strip(" "):
            place += 1
            if place - 1 in gone:
                continue
        kept.append(line)
    return ("\n".join(kept) if any(x.strip(" ") for x in kept) or not gone else ""), place


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with later copies taken out of text, and n_lines and n_removed_lines beside (in place of columns of these names)."""
    # The lists are the hashed side, so that texts are dealt out but not sorted.
    runs = later_runs(docs, min_chars).hint("shuffle_hash").alias("r")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")).alias("d")
    both = keyed.join(runs, F.col("d.id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.text_key")), "left").select("d.row", "r.runs")
    fields = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_removed_lines")]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed_lines", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            names = [rows.type.field(k).name for k in range(rows.type.num_fields)]
            columns = dict(zip(names, rows.flatten()))
            lists = [_places(x) for x in batch.column("runs")]
            done = [(None, 0) if t is None else without(t, r) for t, r in zip(columns["text"].to_pylist(), lists)]
            columns["text"] = pa.array([t for t, _ in done], columns["text"].type)
            columns |= {"n_lines": pa.array([n for _, n in done], pa.int64()), "n_removed_lines": pa.array([len(x) for x in lists], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema.names)

    tuned(docs.sparkSession)
    return both.mapInArrow(trimmed(run), schema)


def oracle(min_chars: int = MIN_CHARS) -> str:
    """The same by grouping the texts of the shortest runs of min_chars characters that begin or end with each line, of any number of lines."""
    return f"""
WITH d AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS f FROM documents),
l AS (SELECT doc_id, pos, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS after, length(line) AS n FROM (SELECT doc_id, unnest(f) AS line, generate_subscripts(f, 1) AS pos FROM d)),
e AS (SELECT doc_id, pos, after, (after - n)::BIGINT AS before, (after - n + {min_chars})::BIGINT AS least, (after - {min_chars})::BIGINT AS most FROM l),
w AS (SELECT a.doc_id, a.pos AS i, b.pos AS j FROM e a ASOF JOIN e b ON a.doc_id = b.doc_id AND a.least <= b.after
  UNION SELECT a.doc_id, b.pos, a.pos FROM e a ASOF JOIN e b ON a.doc_id = b.doc_id AND a.most >= b.before),
g AS (SELECT doc_id, i, j, min({{'d': doc_id, 'i': i}}) OVER (PARTITION BY f[i:j]) AS first FROM w JOIN d USING (doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) - 1 AS place FROM g WHERE first.d <> doc_id OR first.i <> i),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
x AS (SELECT doc_id, line, nr, CASE WHEN trim(line) <> '' THEN count(*) FILTER (trim(line) <> '') OVER (PARTITION BY doc_id ORDER BY nr) - 1 END AS place
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents)),
k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY nr) AS text FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.place = r.place WHERE r.place IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(f)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed_lines,
  sha256(CASE WHEN n.n IS NOT NULL AND trim(replace(coalesce(k.text, ''), chr(10), '')) = '' THEN '' ELSE coalesce(k.text, '') END) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id"""
