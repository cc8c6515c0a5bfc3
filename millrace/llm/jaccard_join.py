"""N-gram Jaccard join: candidates by prefix filter, compared in signature trees.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets form a
class, and one set of each class goes on. Two sets of n and m shingles link when 100 * |A and B| >= 80 *
|A or B|; then they share one of each other's n - ceil(0.8 n) + 1 first shingles in any common order.
The order puts shingles that a task found in many documents last, by hash otherwise. So only sets that share
a prefix shingle are compared:

1. each set is compared with up to three of the least and greatest sets (pivots) of its shingles' groups,
   which links copies of one text in about as many comparisons as there are copies;
2. groups that still fall in several components are put in signature trees: leaves are runs of sets
   by size, inner nodes hold the OR and the AND of their bitmaps and their size range. A traversal of
   two nodes at a time prunes pairs whose sizes, or whose greatest possible overlap, can't link, and pairs
   within one component. A first traversal, on coarse bitmaps, tells the sets that have a possible partner, and
   a second, on finer bitmaps of these, those that still have one; only their shingles are fetched, and a third
   compares whole sets, merges components as it goes and tells the links that merged some. So neither tells pairs: a task's answer is as long as its input at most.

Groups of one pivot are one group. A group of over ``BLOCK`` sets or ``VERIFY`` shingles is dealt out as pairs of
blocks, which are runs of sizes (``BAND`` apart: only neighbours can link) and fingerprints; blocks within the group's
largest component need not meet.

Links are verified on whole sets, so results are exact but for collisions of 64-bit hashes.
Components come from distributed star contraction. To the driver go hot shingles, at most ``MAX_HOT`` and for the order
and the split of their groups alone (any other stands in fewer than one of MAX_HOT of the entries, so its group
needs no split), and a bitmap of the documents to fetch, of ``FILTER_BITS``; where more than ``LISTED`` are wanted, a join fetches them.

A document with fewer than 5 words has its whole sequence as one shingle; null and empty texts have none and
link with nothing. Rows with one doc_id are one node, identical or not: whatever one of them links with, all
do. A null doc_id gives a null component_id and takes no part. Only doc_id and text are read. Of a long text
only its word hashes are held, about 30 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BASE, LOWER, SPACES, drop_staged, gram_hashes, mixed, parts_for, release, staged, text_chunks, trimmed, tuned, word_hashes, words
from millrace.llm.components import components

N, BLOCK, LEAF, FAN, LEAST_BITS, FINE = 5, 512, 16, 4, 512, 8
MAX_HOT, LOCAL_HOT, FLUSH = 1_000_000, 3, 4_000_000
FILTER_BITS, LISTED = 1 << 23, 1 << 20
BAND = 1.3  # over 1 / 0.8, so that sets that link are in one band or in neighbours
SALTS, FLUSH_ENTRIES, PART_BYTES, LEAST_PARTS, VERIFY = 64, 500_000, 4 << 20, 64, 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document."""
    lowered = LOWER[data]
    starts, ends, first = words(data, offsets, SPACES)
    hashes = word_hashes(lowered, starts, ends)
    grams = gram_hashes(hashes, N)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= N:
            yield np.unique(grams[a : b - N + 1])
        else:
            yield gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def fingerprint(tokens: np.ndarray) -> int:
    """A hash of the set."""
    parts = np.append(mixed(tokens ^ BASE), np.array([len(tokens)], dtype=np.uint64) * BASE)
    return int(mixed(parts.sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def signature(tokens: np.ndarray, times: int = 1) -> np.ndarray:
    """A bitmap of the set, of the least power of two of bits that isn't below its size (LEAST_BITS at least), times a power of two, as uint64 words."""
    bits = times * max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length())
    out = np.zeros(bits, dtype=bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A bitmap OR-ed down to a smaller power of two of words; equal to that size's own."""
    while bitmap.shape[-1] > size:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp, bitmap of each document; rows with n = -1 hold shingles that many of a task's documents have."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pile: list[np.ndarray] = []
        size = 0
        id_type = None

        def hot() -> pa.RecordBatch:
            tokens = np.concatenate(pile) if pile else np.zeros(0, dtype=np.uint64)
            pile.clear()
            tokens.sort()  # in place: np.unique would hold some seven times as much
            late = LOCAL_HOT - 1
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:-late] != tokens[: -late - 1]]) & (tokens[late:] == tokens[:-late])) if len(tokens) > late else np.zeros(0, dtype=np.int64)
            times = np.searchsorted(tokens, tokens[starts], side="right") - starts
            many = np.stack([tokens[starts].view(np.int64), times], axis=1)
            return pa.RecordBatch.from_arrays([pa.nulls(1, id_type or pa.int64()), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([many.tolist()], pa.list_(pa.list_(pa.int64())))], names)

        names = ["doc_id", "n", "fp", "bitmap", "hot"]
        for batch in batches:
            id_type = batch.column("doc_id").type
            n, fp, maps = [], [], []
            for _, _, data, offsets in text_chunks(batch):
                for tokens in shingle_sets(data, offsets):
                    n.append(len(tokens))
                    fp.append(fingerprint(tokens) if len(tokens) else 0)
                    maps.append(signature(tokens).tobytes() if len(tokens) else None)
                    if len(tokens) and fp[-1] not in seen:
                        seen.add(fp[-1])
                        pile.append(tokens)
                        size += len(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(len(n), pa.list_(pa.list_(pa.int64())))], names)
            if size >= FLUSH:
                yield hot()
                size = 0
        if id_type is not None:
            yield hot()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind.simpleString()}, n int, fp long, bitmap binary, hot array<array<long>>")


def _runs(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """part, run: the prefix shingles of each set, once a task, packed by the part that their hash falls in.

    ``hot`` is bounded by MAX_HOT. A hot shingle's sets are spread over SALTS parts by their fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in held])
            fps = np.repeat(np.array([f for _, f in held], dtype=np.int64), [len(t) for t, _ in held])
            salt = np.where(_among(tokens, hot), (fps % SALTS).astype(np.uint64), np.uint64(0))
            part = (mixed(tokens ^ (salt * BASE)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            tokens, fps, part = tokens[order], fps[order], part[order]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            blobs = [tokens[x:y].tobytes() + fps[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "run"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                for tokens in shingle_sets(data, offsets):
                    if not len(tokens) or (fp := fingerprint(tokens)) in seen:
                        continue
                    seen.add(fp)
                    p = prefix_size(len(tokens))
                    if len(hot):
                        late = _among(tokens, hot)
                        tokens = np.concatenate([tokens[~late][:p], tokens[late][:p]])
                    held.append((tokens[:p].copy(), fp))
                    size += p
            if size >= FLUSH_ENTRIES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(trimmed(run), "part int, run binary")


def _among(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(len(tokens), dtype=bool)


def _shared(runs: DataFrame, hot: np.ndarray) -> DataFrame:
    """token, fp, pivot, other, is_hot: sets that share a prefix shingle, with the least and the greatest of them; of a hot one, those in one part."""

    def groups(blobs: list[bytes]) -> pa.RecordBatch:
        pairs = [np.frombuffer(b, dtype=np.uint64).reshape(2, -1) for b in blobs]
        tokens, fps = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]).view(np.int64)
        order = np.lexsort((fps, tokens))
        tokens, fps = tokens[order], fps[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (fps[1:] != fps[:-1])])
        tokens, fps = tokens[new], fps[new]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(tokens)]]))
        is_hot = _among(tokens, hot)
        keep = (np.repeat(sizes, sizes) > 1) | is_hot
        low, high = np.repeat(fps[first], sizes), np.repeat(fps[first + sizes - 1], sizes)
        columns = (tokens.view(np.int64), fps, low, high, is_hot)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["token", "fp", "pivot", "other", "is_hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist()):
                if part != now and held:
                    yield groups(held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield groups(held)

    return runs.mapInArrow(trimmed(run), "token long, fp long, pivot long, other long, is_hot boolean")


def _bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with those that the column ``bit`` names: what reaches the driver is bounded, whatever the number of ids."""
    words = ids.select((F.col("bit") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sets(docs: DataFrame, wanted: DataFrame, fine: bool = False) -> DataFrame:
    """fp, n, body (the shingles) of the sets in ``wanted`` (cid, fp), where cid is a document of the class; and of some others. Repeated rows give a set more than once.

    Where ``fine``, their finer bitmaps as bitmap, in place of body.

    A bitmap of hashed cids tells tasks which documents to take, so that no text is shuffled. Where cids would fill it,
    the documents are joined. Joins on fp leave other sets out.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int").alias("bit")
    docs = docs.where("doc_id IS NOT NULL")
    listed = wanted.count() <= LISTED
    bitmap = np.packbits(_bits(wanted.select(bit("cid")))) if listed else None
    if not listed:
        docs = docs.join(wanted.select(F.col("cid").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bitmap).astype(bool) if listed else None
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_chunks(batch.filter(pa.array(known[batch.column("bit").to_numpy()])) if listed else batch):
                for tokens in shingle_sets(data, offsets):
                    if len(tokens) and (fp := fingerprint(tokens)) not in seen:
                        seen.add(fp)
                        rows.append((fp, len(tokens), (signature(tokens, FINE) if fine else tokens).tobytes()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["fp", "n", name])

    name = "bitmap" if fine else "body"
    return docs.select(bit("doc_id"), "text").mapInArrow(trimmed(run), f"fp long, n int, {name} binary")


def _possible(n: np.ndarray, m: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m can link when ``missing`` shingles of the two are known to be in one only."""
    return 9 * ((n + m - missing) // 2) >= 4 * (n + m)


def _pairs_possible(pairs: DataFrame) -> DataFrame:
    """pivot, fp of the pairs (with n, m, bitmaps p, q) that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, p, q in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "p", "q"))):
                x, y = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                size = min(len(x), len(y))
                keep.append(bool(_possible(n, m, int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))))
            yield batch.select(["pivot", "fp"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.where("5 * least(n, m) >= 4 * greatest(n, m)")
    return near.select("pivot", "fp", "n", "m", "p", "q").mapInArrow(run, "pivot long, fp long")


def _star_links(docs: DataFrame, classes: DataFrame, stars: DataFrame) -> DataFrame:
    """a, b: the pairs (pivot, fp) that link. A pivot's set goes to each block of its partners, which pass by it one at a time."""
    wanted = stars.select("fp").unionByName(stars.select(F.col("pivot").alias("fp"))).distinct().join(classes.select("fp", "cid"), "fp")
    sets = staged(_sets(docs, staged(wanted, "wanted")), "sets")
    blocks = staged(stars.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    block = F.pmod("fp", "blocks").cast("int").alias("block")
    members = stars.join(blocks, "pivot").select("pivot", block, "fp").join(sets, "fp").select("pivot", "block", F.lit(1).alias("kind"), "fp", "body")
    pivots = blocks.join(sets, F.col("pivot") == F.col("fp")).select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "fp", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out = []
            for pivot, kind, fp, body in zip(*(batch.column(c).to_pylist() for c in ("pivot", "kind", "fp", "body"))):
                tokens = np.frombuffer(body, dtype=np.uint64)
                if kind == 0:
                    now, held = pivot, tokens
                elif now != pivot:
                    raise RuntimeError(f"no set of pivot {pivot}")
                elif _links(held, tokens):
                    out.append((pivot, fp))
            yield _pair_batch(out)

    dealt = pivots.unionByName(members).repartition("pivot", "block").sortWithinPartitions("pivot", "block", "kind")
    links = staged(dealt.mapInArrow(trimmed(run), "a long, b long"), "links")
    drop_staged(sets, blocks)
    release(docs.sparkSession)
    return links


def _links(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a), len(b)
    return 5 * min(n, m) >= 4 * max(n, m) and 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (n + m)


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


class Node:
    """A node of a signature tree over rows [start, end)."""

    def __init__(self, start: int, end: int, below: list[Node], n: np.ndarray, any_of: np.ndarray, all_of: np.ndarray):
        self.start, self.end, self.below = start, end, below
        self.least, self.most = int(n[start:end].min()), int(n[start:end].max())
        self.any_of, self.all_of = any_of, all_of

    def of(self, values: np.ndarray) -> np.ndarray:
        return values[self.start : self.end]


def tree(n: np.ndarray, bitmaps: np.ndarray) -> Node:
    level = [Node(s, min(s + LEAF, len(n)), [], n, np.bitwise_or.reduce(bitmaps[s : s + LEAF]), np.bitwise_and.reduce(bitmaps[s : s + LEAF])) for s in range(0, len(n), LEAF)]
    while len(level) > 1:
        groups = [level[k : k + FAN] for k in range(0, len(level), FAN)]
        level = [Node(g[0].start, g[-1].end, g, n, np.bitwise_or.reduce([x.any_of for x in g]), np.bitwise_and.reduce([x.all_of for x in g])) for g in groups]
    return level[0]


def traverse(n: np.ndarray, parts: np.ndarray, bitmaps: np.ndarray, blocks: np.ndarray, one: bool, done: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different components that may link; of different blocks unless ``one``. Rows are in order of size.

    The caller may merge ``parts``, or mark rows as ``done`` (pairs of two such are of no interest), while it reads.
    """

    def leaves(xs: int, xe: int, ys: int, ye: int, same: bool) -> Iterator[tuple[int, int]]:
        i, j = np.repeat(np.arange(xs, xe), ye - ys), np.tile(np.arange(ys, ye), xe - xs)
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (parts[i] != parts[j]) & (5 * small >= 4 * large)
        if same:
            ok &= i < j
        if not one:
            ok &= blocks[i] != blocks[j]
        if done is not None:
            ok &= ~(done[i] & done[j])
        i, j = i[ok], j[ok]
        if len(i):
            differing = np.bitwise_count(bitmaps[i] ^ bitmaps[j]).sum(axis=1, dtype=np.int64)
            good = _possible(n[i], n[j], differing)
            yield from zip(i[good].tolist(), j[good].tolist())

    if len(n) <= LEAF:
        yield from leaves(0, len(n), 0, len(n), True)
        return
    root = tree(n, bitmaps)
    todo = [(root, root)]
    while todo:
        x, y = todo.pop()
        if 5 * x.most < 4 * y.least or 5 * y.most < 4 * x.least:
            continue
        p, q = x.of(parts), y.of(parts)
        if (p == q[0]).all() and (q == q[0]).all():
            continue
        if done is not None and x.of(done).all() and y.of(done).all():
            continue
        # Each bit of all of one side's sets that none of the other has stands for a shingle outside the overlap.
        missing = int(np.bitwise_count(x.all_of & ~y.any_of).sum()), int(np.bitwise_count(y.all_of & ~x.any_of).sum())
        overlap = min(x.most - missing[0], y.most - missing[1])
        if 9 * overlap < 4 * (x.least + y.least):
            continue
        if x.below or y.below:
            left, right = x.below or [x], y.below or [y]
            todo += [(a, b) for k, a in enumerate(left) for b in (right[k:] if x is y else right)]
        else:
            yield from leaves(x.start, x.end, y.start, y.end, x is y)


def _by_size(n: np.ndarray, maps: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose bitmaps are of one size or its double, with the bitmaps folded to that size; sets that link differ by one doubling at most."""
    sizes = np.array([len(m) for m in maps])
    for size in np.unique(sizes):
        here = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        if len(here) > 1:
            yield here, np.stack([folded(maps[k], size) for k in here])


def with_partner(n: np.ndarray, parts: np.ndarray, blocks: np.ndarray, maps: list[np.ndarray], one: bool) -> np.ndarray:
    """Whether each row has a possible partner. Rows are in order of size."""
    found = np.zeros(len(n), dtype=bool)
    for here, bits in _by_size(n, maps):
        done = found[here]
        for i, j in traverse(n[here], parts[here], bits, blocks[here], one, done):
            done[i] = done[j] = True
        found[here] |= done
    return found


def merging_links(n: np.ndarray, parts: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], one: bool) -> list[tuple[int, int]]:
    """Pairs of rows that link and connect all components that links connect. Rows are in order of size."""
    _, parts = np.unique(parts, return_inverse=True)
    out = []
    for here, bits in _by_size(n, [signature(s, FINE) for s in sets]):
        own = parts[here]
        for i, j in traverse(n[here], own, bits, blocks[here], one):
            a, b = here[i], here[j]
            if parts[a] != parts[b] and _links(sets[a], sets[b]):
                out.append((int(a), int(b)))
                parts[parts == parts[b]] = parts[a]
                own[:] = parts[here]
    return out


KEYS = ["pivot", "x", "y"]


def _each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """The groups (pivot, x, y) of sorted batches, those that end with each batch together."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, now]) if held is not None else now).combine_chunks()
        keys = [table.column(c).to_numpy() for c in KEYS]
        new = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        yield [table.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:])]
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield [held]


def _ordered(table: pa.Table, body: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], bool]:
    """fp, n, part, block and bodies of a group by size, each fp once, and whether it is one block."""
    fp, n, part, block = (table.column(c).to_numpy() for c in ("fp", "n", "part", "block"))
    _, first = np.unique(fp, return_index=True)
    order = first[np.argsort(n[first], kind="stable")]
    column = table.column(body)
    one = table.column("x")[0].as_py() == table.column("y")[0].as_py()
    return fp[order], n[order].astype(np.int64), part[order], block[order], [np.frombuffer(column[int(k)].as_py(), dtype=np.uint64) for k in order], one


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def _possible_rows(rows: DataFrame) -> DataFrame:
    """pivot, x, y, block, fp, part of the rows (with n and bitmap) that have a possible partner in their group."""
    names = [*KEYS, "block", "fp", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables in _each_group(batches):
            out = []
            for table in tables:
                parts = table.column("part").to_numpy()
                if len(parts) < 2 or (parts == parts[0]).all():
                    continue
                fp, n, part, block, maps, one = _ordered(table, "bitmap")
                if (5 * n[:-1] >= 4 * n[1:]).any() and (found := with_partner(n, part, block, maps, one)).any():
                    k = int(found.sum())
                    out.append([np.full(k, table.column(c)[0].as_py()) for c in KEYS] + [block[found], fp[found], part[found]])
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return _dealt(rows).select(*KEYS, "block", "fp", "n", "part", "bitmap").mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in names))


def _group_links(rows: DataFrame) -> DataFrame:
    """a, b: links that merge components, of each group of rows (with n and body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables in _each_group(batches):
            out = []
            for table in tables:
                if table.num_rows > 1:
                    fp, n, part, block, sets, one = _ordered(table, "body")
                    out += [(int(fp[i]), int(fp[j])) for i, j in merging_links(n, part, block, sets, one)]
            yield _pair_batch(out)

    return _dealt(rows).select(*KEYS, "block", "fp", "n", "part", "body").mapInArrow(trimmed(run), "a long, b long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """pivot, x, y, block, fp, part: each row (pivot, fp, part, n) once for each pair of blocks that it is to be compared in."""
    by_part = rows.groupBy("pivot", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = by_part.groupBy("pivot").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("total"), F.sum("s").alias("weight"))
    whole = (F.col("total") <= BLOCK) & (F.col("weight") <= VERIFY)
    band = F.when(whole, F.lit(0)).otherwise(F.floor(F.log("n") / F.log(F.lit(BAND)))).cast("int").alias("band")
    rest = F.when(whole | (F.col("part") != F.col("main")), F.lit(1)).otherwise(F.lit(0)).alias("rest")
    rows = rows.join(sizes, "pivot").select("pivot", "fp", "part", "n", band, rest)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / VERIFY)).cast("int").alias("blocks")
    # A group has a cell for each band of sizes, twice: some 160 at most.
    cells = rows.groupBy("pivot", "band", "rest").agg(blocks).groupBy("pivot").agg(F.collect_list(F.struct("band", "rest", "blocks")).alias("cells"))
    code = lambda band, rest, block: (band * 2 + rest).cast("long") * F.lit(1 << 32) + block.cast("long")
    own = F.element_at(F.filter("cells", lambda c: (c["band"] == F.col("band")) & (c["rest"] == F.col("rest"))), 1)["blocks"]
    near = F.filter("cells", lambda c: (F.abs(c["band"] - F.col("band")) <= 1) & ((c["rest"] == 1) | (F.col("rest") == 1)))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: code(c["band"], c["rest"], b))))
    rows = rows.join(cells, "pivot").select("pivot", "fp", "part", code(F.col("band"), F.col("rest"), F.pmod("fp", own)).alias("block"), F.explode(others).alias("with"))
    return rows.select("pivot", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "fp", "part")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    spark = tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kept = sized = staged(_sizes(docs), "sizes")
    tokens = sized.where("n = -1").select(F.explode("hot").alias("t")).groupBy(F.col("t")[0].alias("token")).agg(F.sum(F.col("t")[1]).alias("times")).orderBy(F.desc("times"), "token").limit(MAX_HOT)
    hot = np.sort(tokens.select("token").toArrow().column("token").to_numpy().view(np.uint64))
    sized = sized.where("n >= 0").drop("hot")
    known = sized.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(known.groupBy("fp").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap")), "classes")
    sized = sized.drop("bitmap")

    parts = parts_for(docs, PART_BYTES, LEAST_PARTS)
    runs = _runs(docs.where("doc_id IS NOT NULL"), hot, parts).repartition(parts, "part").sortWithinPartitions("part")
    found = staged(_shared(runs, hot), "shared")
    release(spark)
    ends = found.where("is_hot").groupBy("token").agg(F.min("pivot").alias("pivot"), F.max("other").alias("other")).where("pivot <> other")
    hot_rows = found.where("is_hot").select("token", "fp").distinct().join(ends, "token").select("token", "fp", "pivot", "other")
    shared = staged(found.where("NOT is_hot").select("token", "fp", "pivot", "other").unionByName(hot_rows), "groups")
    drop_staged(found)
    # Up to three of a set's pivots; what they don't connect is for the second phase.
    few = shared.groupBy("fp").agg(F.array(F.min("pivot"), F.max("pivot"), F.max("other")).alias("ends"))
    stars = few.select(F.explode("ends").alias("pivot"), "fp").where("pivot <> fp").distinct()
    p = classes.select(F.col("fp").alias("pivot"), "n", F.col("bitmap").alias("p"))
    q = classes.select("fp", F.col("n").alias("m"), F.col("bitmap").alias("q"))
    stars = staged(_pairs_possible(stars.join(p, "pivot").join(q, "fp")), "stars")
    links = _star_links(docs, classes, stars)
    drop_staged(stars)

    # Second phase: groups that fall in several components.
    first = staged(components(links), "components")
    rows = staged(shared.select("token", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", F.coalesce("component", "fp").alias("part")), "parts")
    drop_staged(shared, first)
    several = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("fp").alias("pivot")).where("low <> high").select("token", "pivot")
    groups = staged(rows.join(several, "token").select("pivot", "fp", "part").distinct().join(classes.select("fp", "n"), "fp"), "rows")
    blocks = _in_blocks(groups).join(classes.select("fp", "n", "bitmap"), "fp")
    found = staged(_possible_rows(blocks), "possible")
    drop_staged(rows, groups)
    release(spark)
    wanted = lambda rows: staged(rows.select("fp").distinct().join(classes.select("fp", "cid"), "fp"), "wanted")
    coarse = wanted(found)
    maps = staged(_sets(docs, coarse, fine=True), "maps")
    fine = staged(_possible_rows(found.join(maps, "fp")), "fine")
    drop_staged(found, coarse, maps)
    few = wanted(fine)
    sets = staged(_sets(docs, few), "sets")
    more = staged(_group_links(fine.join(sets, "fp")), "more")
    drop_staged(fine, few, sets)
    release(spark)
    # Rows of one doc_id are one node: their classes are linked by the least of them.
    least = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    own = known.select("doc_id", F.col("fp").alias("b")).join(least, "doc_id").where("a <> b").select("a", "b").distinct()
    final = components(links.unionByName(more).unionByName(own))

    # The least doc_id of each class, then of each component, then back.
    labelled = classes.join(final.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "cid", F.coalesce("component", "fp").alias("part"))
    least = labelled.groupBy("part").agg(F.min("cid").alias("component_id"))
    named = labelled.join(least, "part").select("fp", "component_id")
    # By doc_id, for a row without shingles is of its doc_id's node too.
    nodes = known.select("doc_id", "fp").join(named, "fp").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sized.join(nodes, "doc_id", "left")
    done = staged(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "linked")
    drop_staged(kept, classes, links, more)
    return done


def oracle() -> str:
    """The same by an inverted index over all shingles and a recursive closure."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * n >= 80 * (na + nb - n)),
t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON s.doc_id = m.a"""
