"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders: a number is a token that starts with a digit (points and
commas between digits belong to it), a unit one of ``UNITS``, a name a capitalised token that doesn't begin
a sentence or line. Other tokens are lower-cased (A-Z). A character from U+0800 on (scripts without spaces are
there) is a token of its own. The windows of ``WINDOW`` template tokens of every
benchmark item, at least half of them literal, are hashed and joined with those of every document; an
item of ``SHORTEST`` to 8 tokens is one window, and shorter or literal-poor items have none. A matching window must also be slot consistent: along one alignment of
document and item, each slot value of the item stands for one value of the document and the other
way round. A document leaks an item when consistent windows along its alignments cover at least
``COVERAGE`` of the item's windows: ``exact`` if all slot values are equal, else ``reparameterised``.

Beside that, windows of unmasked tokens (with ``SYMBOLS`` as tokens too, so that the operators of a formula count)
are joined as they stand, for every item, however short or rich in slots. A document also leaks an item, as
``exact``, when these cover ``COVERAGE`` of the item's windows, or when one consecutive match has ``VERBATIM`` words,
whatever its share of the item; a character of its own counts as half a word and a symbol as none. n_windows and
coverage then tell of these windows. So a document that holds a whole item always leaks it, even an item of one word.

An item needs a share of its windows, so a document that leaks it has one of its rarest windows (by the items that have
them), as many as the share leaves room for, or one of each run of ``CHAIN`` windows that a long verbatim match must hold.
Only these lead from a document to items, so that a stem that many items share leads to none of them unless it is itself a leak.

Items of one text are one item: its least item_id, with ``n_items``, the number of the benchmark's rows that have it. Their
windows go to all tasks in blocks of ``MAX_WINDOWS``, so what is sent is bounded however large the
benchmark is. Null and empty texts on either side match nothing. Repeated rows of documents are reported each.
Of the benchmark only item_id and text are read, of documents doc_id and text. A text of any length is matched whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import LOWER, NOT_WORD, byte_table, gram_hashes, mixed, runs, text_chunks, trimmed, tuned, word_hashes

WINDOW, COVERAGE, MAX_WINDOWS, SHORTEST, VERBATIM = 8, 0.5, 500_000, 4, 13
CHAIN = VERBATIM - WINDOW + 1
# Common units of measure, time and money.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces "
    "ml cl l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees mph kmh km/h"
).split()
DIGITS, CAPITALS, ENDS = byte_table((48, 57)), byte_table((65, 90)), byte_table((10, 10), (13, 13), (33, 33), (46, 46), (63, 63))
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"+-*/=<>^%()[]{}|&~#@$\\", dtype=np.uint8))
LITERAL, NUMBER, UNIT, NAME = range(4)
PLACEHOLDERS = mixed(np.arange(4, dtype=np.uint64) + np.uint64(1000))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    starts, ends, _ = runs(data != 32, np.array([0, len(data)]))
    return np.unique(word_hashes(data, starts, ends))


UNIT_HASHES = _unit_hashes()


def tokens(data: np.ndarray, offsets: np.ndarray, symbols: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the tokens, and each document's first token."""
    lowered = LOWER[data]
    inside = ~NOT_WORD[lowered]
    if len(data) > 2:
        digit = DIGITS[data]
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    alone = data[heads] >= 0xE0
    if symbols:
        own = SYMBOLS[data]
        inside |= own
        alone |= own[heads]
    after = np.concatenate([[False], alone[:-1]]) if len(alone) else alone
    starts, ends, _ = runs(inside, np.union1d(offsets, heads[alone | after]))
    return lowered, starts, ends, np.searchsorted(starts, offsets)


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, slot values, kinds, and each document's first token."""
    lowered, starts, ends, first = tokens(data, offsets, False)
    values = word_hashes(lowered, starts, ends)
    kinds = np.full(len(starts), LITERAL, dtype=np.int8)
    if len(starts):
        stops = np.concatenate([[0], np.cumsum(ENDS[data])])
        before = np.concatenate([[0], ends[:-1]])
        opens = stops[starts] > stops[before]
        opens[first[:-1][first[:-1] < len(starts)]] = True
        second = np.minimum(starts + 1, ends - 1)
        title = CAPITALS[data[starts]] & ((ends - starts == 1) | ~CAPITALS[data[second]])
        kinds[title & ~opens] = NAME
        kinds[np.isin(values, UNIT_HASHES)] = UNIT
        kinds[DIGITS[data[starts]]] = NUMBER
    return np.where(kinds == LITERAL, values, PLACEHOLDERS[kinds]), values, kinds, first


def windows(hashes: np.ndarray, kinds: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n tokens with enough literals, and their first tokens; none crosses documents."""
    grams = gram_hashes(hashes, n)
    if not len(grams):
        return grams, np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    m = len(grams)
    good = np.flatnonzero((doc[:m] == doc[n - 1 : n - 1 + m]) & (2 * (literal[n : n + m] - literal[:m]) >= n))
    return grams[good], good


def unmasked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens, twice the words each counts for, and each document's first token."""
    lowered, starts, ends, first = tokens(data, offsets, True)
    head = data[starts]
    return word_hashes(lowered, starts, ends), np.where(SYMBOLS[head], 0, np.where(head >= 0xE0, 1, 2)), first


class Item:
    def __init__(self, item_id: int, text: str | None, n_items: int = 1):
        self.n_items = n_items
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        self.item_id = item_id
        hashes, self.values, self.kinds, first = template(data, np.array([0, len(data)]))
        self.n = min(WINDOW, len(hashes))
        self.grams, self.places = windows(hashes, self.kinds, first, self.n) if self.n >= SHORTEST else (hashes[:0], np.zeros(0, dtype=np.int64))
        plain, counts, _ = unmasked(data, np.array([0, len(data)]))
        self.plain_n = min(WINDOW, len(plain))
        self.plain = gram_hashes(plain, self.plain_n) if self.plain_n else plain
        self.words = np.concatenate([[0], np.cumsum(counts)])
        worded = self.words[self.plain_n :] > self.words[: len(self.words) - self.plain_n]
        self.plain_places = np.flatnonzero(worded) if worded.any() else np.arange(len(self.plain))

    def longest(self, places: list[int]) -> float:
        """Words of the longest run of consecutive windows among these, in order."""
        cuts = np.flatnonzero(np.diff(places) > 1)
        a, b = np.take(places, [0, *(cuts + 1)]), np.take(places, [*cuts, -1])
        return float((self.words[b + self.plain_n] - self.words[a]).max() / 2)


class Windows:
    """The windows of one size of a block's items: where each stands, and which lead to an item."""

    def __init__(self, entries: list[tuple[int, np.ndarray, np.ndarray, bool]], coverage: float):
        self.where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, grams, places, _ in entries:
            for h, p in zip(grams.tolist(), places.tolist()):
                self.where[h].append((k, p))
        self.own = {k: list(zip(grams.tolist(), places.tolist())) for k, grams, places, _ in entries}
        leads = defaultdict(set)
        for k, grams, places, chained in entries:
            order = sorted(range(len(grams)), key=lambda n: (len(self.where[int(grams[n])]), n))
            # coverage * len windows are needed at least; all but one less may be missing.
            chosen = set(order[: len(grams) - max(1, int(np.ceil(coverage * len(grams) - 1e-9))) + 1])
            if chained:
                rank = {n: r for r, n in enumerate(order)}
                chosen |= {min(range(n, n + CHAIN), key=rank.get) for n in range(len(grams) - CHAIN + 1)}
            for n in chosen:
                leads[int(grams[n])].add(k)
        self.leads = {h: sorted(ks) for h, ks in leads.items()}
        self.known = np.array(sorted(self.where), dtype=np.uint64)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(self, grams: np.ndarray, at: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, dict[int, list[int]]]]:
        """(document, item, {shift: the item's windows}) for the items that a document's windows lead to; at has the first token of each of grams."""
        maybe = np.flatnonzero(self.seen[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        hit = maybe[self.known[place] == grams[maybe]]
        token = at[hit]
        docs = np.searchsorted(first, token, side="right") - 1
        edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]])) if len(docs) else []
        for a, b in zip(edges[:-1], edges[1:]):
            stands = defaultdict(list)
            for h, t in zip(grams[hit[a:b]].tolist(), token[a:b].tolist()):
                stands[h].append(t)
            for k in sorted({k for h in stands for k in self.leads.get(h, ())}):
                found = defaultdict(list)
                for h, p in self.own[k]:
                    for t in stands.get(h, ()):
                        found[t - p].append(p)
                yield int(docs[a]), k, found


class Index:
    """The windows of one block of items."""

    def __init__(self, items: list[Item], coverage: float = COVERAGE):
        self.items, self.coverage = items, coverage
        # Only whole windows chain: a shorter item's one window is all of it.
        self.by_size = self._tables([(x.n, x.grams, x.places, False) for x in items], coverage)
        self.plain_by_size = self._tables([(x.plain_n, x.plain[x.plain_places], x.plain_places, True) for x in items], coverage)

    @staticmethod
    def _tables(items: list[tuple[int, np.ndarray, np.ndarray, bool]], coverage: float) -> dict[int, Windows]:
        sizes = {n for n, grams, *_ in items if len(grams)}
        return {size: Windows([(k, grams, places, chained) for k, (n, grams, places, chained) in enumerate(items) if n == size], coverage) for size in sizes}

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float, str]]:
        """(document, item id, n_items, windows, coverage, kind) of a chunk of documents."""
        hashes, values, kinds, first = template(data, offsets)
        out = {}
        for n, table in self.by_size.items():
            for doc, k, alignments in table.matches(*windows(hashes, kinds, first, n), first):
                item, covered, same = self.items[k], set(), True
                for shift, places in sorted(alignments.items(), key=lambda x: (-len(x[1]), x[0])):
                    good, equal = consistent(item, values, shift, places)
                    same = same and (equal or set(good) <= covered)
                    covered.update(good)
                share = len(covered) / len(item.grams)
                if share >= self.coverage:
                    out[doc, k] = (doc, item.item_id, item.n_items, len(covered), share, "exact" if same else "reparameterised")
        for (doc, k), found in self._verbatim(data, offsets).items():
            out.setdefault((doc, k), (doc, self.items[k].item_id, self.items[k].n_items, *found, "exact"))
        return list(out.values())

    def _verbatim(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, float]]:
        """Windows and coverage, by document and item, of verbatim matches that are long or cover enough of the item."""
        plain, _, first = unmasked(data, offsets)
        out = {}
        for n, table in self.plain_by_size.items():
            grams = gram_hashes(plain, n)
            doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            at = np.flatnonzero(doc_of[: len(grams)] == doc_of[n - 1 : n - 1 + len(grams)])
            for doc, k, alignments in table.matches(grams[at], at, first):
                item, covered = self.items[k], {p for places in alignments.values() for p in places}
                share = len(covered) / len(item.plain_places)
                if share >= self.coverage or any(item.longest(sorted(places)) >= VERBATIM for places in alignments.values()):
                    out[doc, k] = len(covered), share
        return out


def consistent(item: Item, values: np.ndarray, shift: int, places: list[int]) -> tuple[list[int], bool]:
    """The windows along an alignment that keep one value for each slot value, in order; whether all values are equal."""
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    good, equal = [], True
    for p in sorted(places):
        slots = [(int(item.values[t]), int(values[t + shift])) for t in range(p, p + item.n) if item.kinds[t] != LITERAL]
        if all(there.get(a, b) == b and back.get(b, a) == a for a, b in slots) and len(dict(slots)) == len(set(slots)) == len({b for _, b in slots}):
            there.update(slots)
            back.update((b, a) for a, b in slots)
            good.append(p)
            equal = equal and all(a == b for a, b in slots)
    return good, equal


def _blocks(benchmark: DataFrame, coverage: float) -> Iterator[Index]:
    """The benchmark's different texts, streamed through the driver in blocks of bounded size."""
    items, total = [], 0
    texts = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    for r in texts.toLocalIterator():
        items.append(Item(r.item_id, r.text, r.n_items))
        total += len(items[-1].grams) + len(items[-1].plain)
        if total >= MAX_WINDOWS:
            yield Index(items, coverage)
            items, total = [], 0
    if items:
        yield Index(items, coverage)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_items, n_windows, coverage, kind: a row for each document and item (text) that it leaks."""
    spark = tuned(docs.sparkSession)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = T.StructType.fromDDL(f"doc_id {kinds[0]}, item_id {kinds[1]}, n_items long, n_windows int, coverage double, kind string")
    out = spark.createDataFrame([], schema)

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = (pa.int64() if kinds[1] == "bigint" else None, pa.int64(), pa.int32(), pa.float64(), pa.string())
            for batch in batches:
                found = [(a + doc, *rest) for a, _, data, offsets in text_chunks(batch) for doc, *rest in index.leaks(data, offsets)]
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate(types))], schema.names)

        return run

    for index in _blocks(benchmark, coverage):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(trimmed(finder(index)), schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows, with all their columns, that leak no item."""
    tuned(docs.sparkSession)

    def cleaner(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {a + leak[0] for a, _, data, offsets in text_chunks(batch) for leak in index.leaks(data, offsets)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        return run

    for index in _blocks(benchmark, coverage):
        docs = docs.mapInArrow(trimmed(cleaner(index)), docs.schema)
    return docs
