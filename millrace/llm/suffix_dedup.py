"""Suffix-array dedup: bytes of a later document that a 50-byte string of an earlier one covers are removed.

Sorting all suffixes of a corpus would move many times its size, so suffixes are sampled by content
first. Each 50-byte window has an anchor, the k-mer of least hash in it (the leftmost of equals), and
neighbouring windows with one anchor form a block; equal windows have equal k-mers at equal offsets, wherever
they stand. Then, in two exchanges:

1. each task sorts its blocks by anchor into a run for each part, of hashes only. Equal blocks of one
   task go as one row (the least doc_id); a part merges its runs. Anchors of one document are done with.
   Blocks equal to one of a smaller doc_id are covered. Where blocks of one anchor differ, as at the ends of
   a repeated passage, their texts must be compared;
2. for these, tasks sort the suffixes from the anchor on into front-coded runs (length of the common
   prefix with the entry before, and the rest), with the bytes left of the anchor and the document's place.
   A part merges its runs by a loser tree of strings that carries each contender's common prefix with the
   last winner, so that known prefixes are never compared again, and it yields neighbours' common prefixes.
   Suffixes with a common prefix of an anchor's length form an interval of the suffix array, within
   which windows are compared and the smallest doc_id of each is found.

Blocks are identified by 40 bits of the anchor's hash, those its part stands for, and 48 bits of their own.

Null texts count as empty. A null doc_id is neither smaller nor greater than another: such rows stay whole and are
no source. A text of any length is worked on in slices of ``SLICE`` bytes. Rows of one doc_id never remove each other's bytes, be their texts equal or not. Only doc_id and
text are read; other columns are handed on by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import BASE, U64, drop_staged, mixed, parts_for, powers, staged, text_chunks, tuned

WINDOW, K = 50, 20
SPAN = WINDOW - K + 1  # k-mers of a window
FLUSH_ROWS, PART_BYTES, LEAST_PARTS, SLICE = 400_000, 4 << 20, 64, 1 << 20
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
LONGEST = (1 << 24) - 1
_POWERS: dict[str, np.ndarray] = {}


def _cached(name: str, n: int, base: np.uint64) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        _POWERS[name] = powers(max(n, 1 << 18), base)
    return _POWERS[name][:n]


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, start, number of windows, the anchor's offset, the anchor's hash and the block's, of each block."""
    n = len(data)
    if n < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(U64), none.astype(U64)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * _cached("up", n, BASE), out=sums[1:])
    down = _cached("down", n, INVERSE)
    kmers = mixed((sums[K:] - sums[:-K]) * down[: n - K + 1])
    # The upper bits order k-mers, and the lower 24 are the place; chunks of more bytes keep both apart.
    bits = U64(24 if n < 1 << 24 else 36)
    least = (kmers >> bits << bits) | np.arange(len(kmers), dtype=U64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: n - WINDOW + 1], least[SPAN - width : SPAN - width + n - WINDOW + 1])
    sizes = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    anchor = (least[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.concatenate([first, [len(anchor)]]))
    start, anchor, doc = at[first], anchor[first], doc[first]
    off = anchor - start
    ends = start + count + WINDOW - 1
    own = mixed((sums[ends] - sums[start]) * down[start] + (off * 64 + count).astype(U64) * INVERSE)
    # Anchors are least hashes; hashed again they spread evenly over the parts.
    return doc, start - offsets[doc], count, off, mixed(kmers[anchor] ^ BASE), own


def sliced_blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The same; a document of over SLICE bytes in slices of so many windows, which bounds memory. A block at a cut is two, and those are compared as any that differ."""
    if len(offsets) != 2 or len(data) <= SLICE:
        yield blocks(data, offsets)
        return
    for at in range(0, len(data) - WINDOW + 1, SLICE):
        part = data[at : at + SLICE + WINDOW - 1]
        doc, start, *rest = blocks(part, np.array([0, len(part)]))
        yield doc, start + at, *rest


def _planes(x: np.ndarray, size: int) -> bytes:
    """The lowest bytes of integers, a plane for each byte, so that zeros lie together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8)[:, :size].T.tobytes()


def _unplaned(data: bytes, at: int, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T
    return out.view(np.int64).ravel()


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)


#: doc, variant, start, count, offset, anchor (40 bits), block (48 bits)
FIELDS = 7


def packed(columns: list[np.ndarray]) -> bytes:
    """Rows as planes of bytes."""
    base = int(columns[0].min())
    columns = [columns[0] - base, *columns[1:]]
    widths = [_width(c) for c in columns]
    return struct.pack("<qq7B", len(columns[0]), base, *widths) + b"".join(_planes(c.astype(np.int64), w) for c, w in zip(columns, widths))


def unpacked(data: bytes) -> list[np.ndarray]:
    n, base, *widths = struct.unpack_from("<qq7B", data)
    at, out = struct.calcsize("<qq7B"), []
    for w in widths:
        out.append(_unplaned(data, at, n, w))
        at += n * w
    out[0] += base
    return out


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A start and a length in one integer; for lengths up to LONGEST."""
    return (start << 24) | size


def _split_parts(anchor: np.ndarray, parts: int) -> np.ndarray:
    return ((anchor >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)


def _runs(parts: int):
    """Sorted runs of blocks, one for each part and flush, and what the task itself finds to be covered."""

    def flush(rows: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        doc, variant, start, count, off, anchor, own = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((doc, own, anchor))
        doc, variant, start, count, off, anchor, own = (c[order] for c in (doc, variant, start, count, off, anchor, own))
        same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (own[1:] == own[:-1])])
        least = doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))]
        covered = doc > least
        if covered.any():
            # What isn't compared any more travels as merged spans.
            merged = merge(doc[covered], variant[covered], start[covered], start[covered] + count[covered] + WINDOW - 1)
            keep = [(d, v, s, np.minimum(e - s, LONGEST)) for d, v, s, e in [merged]]
            d, v, s, size = keep[0]
            zero = np.zeros(len(d), dtype=np.int64)
            yield int(anchor[0] % U64(parts)), 1, packed([d, v, s, size, zero, zero, zero])
        left = [c[~covered] for c in (doc, variant, start, count, off, (anchor >> U64(24)).astype(np.int64), (own >> U64(16)).astype(np.int64))]
        part = _split_parts(anchor[~covered], parts)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(part[a]), 0, packed([c[a:b] for c in left])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            held, total = [], 0
            for x in flush(rows) if rows else ():
                held.append(x)
                total += len(x[2])
                if total > 8 << 20:
                    yield batch_of(held)
                    held, total = [], 0
            if held:
                yield batch_of(held)
            rows.clear()
            size = 0

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            variants = batch.column("variant").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, data, offsets in text_chunks(batch):
                for doc, start, count, off, anchor, own in sliced_blocks(data, offsets):
                    if len(doc):
                        rows.append([ids[a + doc], variants[a + doc], start, count, off, anchor, own])
                        size += len(doc)
                    if size >= FLUSH_ROWS:
                        yield from out()
        yield from out()

    def batch_of(rows: list) -> pa.RecordBatch:
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["part", "kind", "run"])

    return run


def merge(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal spans, of LONGEST at most, of each document."""
    order = np.lexsort((start, variant, doc))
    doc, variant, start, end = doc[order], variant[order], start[order], end[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])])
    group = np.cumsum(new)
    # Ends so far within a document: groups are lifted apart so that one running maximum serves all.
    lift = group * (int(end.max(initial=0)) + 1)
    far = np.maximum.accumulate(end + lift) - lift
    begins = new.copy()
    begins[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(begins)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    out = doc[first], variant[first], start[first], far[last]
    while (out[3] - out[2] > LONGEST).any():
        long = out[3] - out[2] > LONGEST
        rest = [c[long] for c in out]
        rest[2] = rest[2] + LONGEST
        out = tuple(np.concatenate([np.where(long, out[2] + LONGEST, c) if k == 3 else c, r]) for k, (c, r) in enumerate(zip(out, rest)))
    return out


#: Kinds of phase one's results.
COVERED, OPEN = 0, 1
FOUND = "doc_id long, variant int, kind int, span long"


def _found(doc, variant, kind: int, span) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.asarray(variant, dtype=np.int32)), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(span, pa.int64())], ["doc_id", "variant", "kind", "span"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The runs, by kind, of one part after the other; batches are sorted by part."""
    now, held = None, ([], [])
    for batch in batches:
        for part, kind, run in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("run")):
            if part != now and (held[0] or held[1]):
                yield held
                held = ([], [])
            now = part
            held[kind].append(run.as_py())
    if held[0] or held[1]:
        yield held


def _merge_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for runs, done in _by_part(batches):
        for x in done:
            doc, variant, start, size, *_ = unpacked(x)
            yield _found(doc, variant, COVERED, spans(start, size))
        if not runs:
            continue
        doc, variant, start, count, off, anchor, own = (np.concatenate(c) for c in zip(*map(unpacked, runs)))
        order = np.lexsort((doc, own, anchor))
        doc, variant, start, count, off, anchor, own = (c[order] for c in (doc, variant, start, count, off, anchor, own))
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(doc)]]))
        spread = lambda x: np.repeat(x, sizes)
        shared = spread(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
        differ = spread(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first))
        same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (own[1:] == own[:-1])])
        covered = doc > doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))]
        yield _found(doc[covered], variant[covered], COVERED, spans(start[covered], count[covered] + WINDOW - 1))
        left = shared & differ & ~covered
        yield _found(doc[left], variant[left], OPEN, (start[left] << 16) | (count[left] << 8) | off[left])


def front_coded(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, bytes left of it, doc, variant, start): each suffix as common prefix and rest."""
    out, before = [struct.pack("<q", len(entries))], b""
    for suffix, left, doc, variant, start in sorted(entries):
        lcp = common(before, suffix, 0)
        out.append(struct.pack("<BBBqiq", lcp, len(suffix) - lcp, len(left), doc, variant, start) + suffix[lcp:] + left)
        before = suffix
    return b"".join(out)


def decoded(data: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the entry before, suffix, (left, doc, variant, start)) in order."""
    size = struct.calcsize("<BBBqiq")
    (n,), at, before = struct.unpack_from("<q", data), 8, b""
    for _ in range(n):
        lcp, rest, left, doc, variant, start = struct.unpack_from("<BBBqiq", data, at)
        at += size
        before = before[:lcp] + data[at : at + rest]
        at += rest
        yield lcp, before, (data[at : at + left], doc, variant, start)
        at += left


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes are known to be equal."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted runs. Each contender knows its common prefix with the last winner.

    Of two contenders the one with the longer known prefix is the smaller, without looking at a
    byte; only equal ones are compared, from there on, and the loser remembers what was found.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, tuple]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.now: list[tuple[int, bytes, tuple] | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.lcp = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of two runs; the loser stays at the node."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            win, lose = (b, a) if x is None else (a, b)
        elif self.lcp[a] != self.lcp[b]:
            win, lose = (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        else:
            h = common(x[1], y[1], self.lcp[a])
            win, lose = (a, b) if x[1][h:] <= y[1][h:] else (b, a)
            self.lcp[lose] = h
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        """(common prefix with the one before, suffix, what belongs to it), in order."""
        while (found := self.now[self.winner]) is not None:
            w = self.winner
            yield self.lcp[w], found[1], found[2]
            self.now[w] = next(self.runs[w], None)
            self.lcp[w] = self.now[w][0] if self.now[w] is not None else 0
            node = (w + self.size) // 2
            while node:
                w = self._play(node, self.losers[node], w)
                node //= 2
            self.winner = w


def _interval(entries: list[tuple[bytes, tuple]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, variant, start, end) of the windows of an interval that a smaller doc_id has too."""
    if len({x[1][1] for x in entries}) < 2:
        return
    least: dict[bytes, int] = {}
    for suffix, (left, doc, _, _) in entries:
        block = left + suffix
        for o in range(len(block) - WINDOW + 1):
            w = block[o : o + WINDOW]
            if least.get(w, doc) >= doc:
                least[w] = doc
    for suffix, (left, doc, variant, start) in entries:
        block, began = left + suffix, None
        n = len(block) - WINDOW + 1
        for o in range(n + 1):
            hit = o < n and least[block[o : o + WINDOW]] < doc
            if hit and began is None:
                began = o
            elif not hit and began is not None:
                yield doc, variant, start + began, start + o - 1 + WINDOW
                began = None


def _merge_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for runs, _ in _by_part(batches):
        out, held = [], []
        for lcp, suffix, rest in LoserTree([decoded(r) for r in runs]):
            if lcp < K:
                out.extend(_interval(held))
                held = []
            held.append((suffix, rest))
        out.extend(_interval(held))
        if out:
            doc, variant, start, end = (np.array(c, dtype=np.int64) for c in zip(*out))
            yield _found(doc, variant, COVERED, spans(start, end - start))


def _suffix_runs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_part: dict[int, list] = {}
            for doc, variant, text, open_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "text", "open"))):
                data = text.encode()
                for x in open_:
                    start, count, off = x >> 16, (x >> 8) & 255, x & 255
                    block = data[start : start + count + WINDOW - 1]
                    part = int.from_bytes(hashlib.blake2b(block[off : off + K], digest_size=4).digest(), "little") % parts
                    by_part.setdefault(part, []).append((block[off:], block[:off], doc, variant, start))
            if by_part:
                yield pa.RecordBatch.from_arrays([pa.array(list(by_part), pa.int32()), pa.array([0] * len(by_part), pa.int32()), pa.array([front_coded(x) for x in by_part.values()], pa.binary())], ["part", "kind", "run"])

    return run


def _exchanged(runs: DataFrame, parts: int) -> DataFrame:
    return runs.repartition(parts, "part").sortWithinPartitions("part")


def covered_spans(docs: DataFrame) -> DataFrame:
    """doc_id, variant, covered: the packed spans to remove. docs: doc_id long, variant int, text."""
    parts = parts_for(docs, PART_BYTES, LEAST_PARTS)
    runs = docs.select("doc_id", "variant", "text").mapInArrow(_runs(parts), "part int, kind int, run binary")
    found = staged(_exchanged(runs, parts).mapInArrow(_merge_hashes, FOUND), "blocks")
    open_ = found.where(F.col("kind") == OPEN).groupBy("doc_id", "variant").agg(F.collect_list("span").alias("open"))
    rows = docs.join(open_, ["doc_id", "variant"]).select("doc_id", "variant", "text", "open")
    suffixes = rows.mapInArrow(_suffix_runs(parts), "part int, kind int, run binary")
    more = staged(_exchanged(suffixes, parts).mapInArrow(_merge_suffixes, FOUND), "windows")
    every = found.where(F.col("kind") == COVERED).unionByName(more)
    return every.groupBy("doc_id", "variant").agg(F.collect_list("span").alias("covered"))


def with_variants(docs: DataFrame) -> DataFrame:
    """id, variant, text: rows with doc_id, numbering the different texts of one doc_id from 0."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    clashes = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).where("low <> high").select("doc_id")
    if clashes.isEmpty():
        return rows.withColumn("variant", F.lit(0))
    texts = rows.join(clashes, "doc_id").select("doc_id", F.xxhash64("text").alias("key")).groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return rows.join(texts, "doc_id", "left").select("doc_id", "text", F.coalesce(F.array_position("keys", F.xxhash64("text")).cast("int"), F.lit(0)).alias("variant"))


def kept(text: str | None, packed_spans: list[int] | None) -> tuple[bytes, int, int, int]:
    """The bytes that stay, and n_bytes, n_removed and n_spans."""
    data = (text or "").encode()
    out, at, removed, number = [], 0, 0, 0
    reach = -1
    for span in sorted(packed_spans or ()):
        start, end = span >> 24, (span >> 24) + (span & LONGEST)
        if start > reach:
            number += 1
            out.append(data[max(at, 0) : start])
            removed += end - start
            reach = end
        elif end > reach:
            removed += end - reach
            reach = end
        at = reach
    out.append(data[at:])
    return b"".join(out), len(data), removed, number


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = with_variants(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept(t, c) for t, c in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist())]
            numbers = [pa.array([d[k] for d in done], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array([hashlib.sha256(d[0]).hexdigest() for d in done])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans_of = covered_spans(rows)
    joined = rows.join(spans_of, ["doc_id", "variant"], "left").select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "covered")
    alone = docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("covered"))
    return joined.unionByName(alone).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the spans taken out; what isn't UTF-8 after a cut within a character is replaced."""
    tuned(docs.sparkSession)
    rows = with_variants(docs)
    spans_of = covered_spans(rows)
    keyed = rows.select("doc_id", "variant", F.xxhash64("text").alias("key")).distinct().join(spans_of, ["doc_id", "variant"]).select(F.col("doc_id").alias("d"), "key", "covered")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    joined = row.join(keyed, (F.col("id") == F.col("d")) & (F.col("text_key") == F.col("key")), "left").select("row", "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            names = [rows.type.field(k).name for k in range(rows.type.num_fields)]
            columns = dict(zip(names, rows.flatten()))
            texts = [None if t is None else t if not c else kept(t, c)[0].decode("utf-8", "replace") for t, c in zip(columns["text"].to_pylist(), batch.column("covered").to_pylist())]
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))


def oracle() -> str:
    """The same by the smallest doc_id of every window, on hexadecimal digits."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, {2 * WINDOW}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {WINDOW - 1})) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{WINDOW + 1}) + {WINDOW} AS new FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
o AS (SELECT k.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""
