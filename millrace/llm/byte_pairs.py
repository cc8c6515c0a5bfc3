"""Byte-level BPE: encoding by a hierarchical-bitmap rank queue, and decoding.

A text is split by the tokenizer's pattern into pre-tokens. In each, neighbouring pieces whose joined bytes are in the
vocabulary can merge, least rank first, leftmost first among equal ranks. The pairs wait in a rank queue: each
rank has a bucket of positions of a linked list of pieces, and a bitmap of three levels (64 bits a word) tells by find-first-set which
rank is next, so an entry goes in and out in constant time, however long the pre-token is. A merge
doesn't take the pairs that it ends out of their buckets; they are skipped when they come up, for their position has another pair by then.

One queue serves many pre-tokens at once: their lists lie side by side and have no pair in common, so a bucket has the
positions of one rank in all of them, and is merged as arrays (or one by one, where it has few). Merging a bucket at once is
merging its positions from left to right, unless a merge makes a pair of lower rank: in such a pre-token only the
first position is merged, and the others go back. A rank's joined bytes are shorter than those of any pair that its merges make,
so nothing else enters a bucket while it is being merged.

Texts are encoded whole, in blocks of pre-tokens. A worker remembers the ids of short pre-tokens (``REMEMBERED`` of them, then afresh); the others of a block go
through the queue, each once. Vocabulary files hold lines of base64 bytes and rank; their path must be readable where the tasks run. Every
single byte must be a piece.

Null and empty texts have no ids and decode to no bytes. Rows, also repeated ones, are encoded on their own, and null doc_ids stay. Other
columns aren't read. A null list of ids decodes to no bytes; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from millrace.llm.common import kept, trimmed, tuned

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
REMEMBERED, SHORT = 400_000, 32
BLOCK, LONG_TEXT, FEW, BATCH = 1_000_000, 1 << 20, 6, 4 << 20
NONE = -1


class RankQueue:
    """Positions by rank, least rank first; ranks are below 64 ** 3."""

    def __init__(self) -> None:
        # Bits of word w of one level tell which words below it, 64 w to 64 w + 63, aren't empty.
        self.top, self.middle, self.low = 0, [0] * 64, [0] * 4096
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, positions: int | np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Position by position, but those without a rank."""
        there = ranks != NONE
        ranks, positions = ranks[there], positions[there]
        if len(ranks) <= FEW:
            for rank, at in zip(ranks.tolist(), positions.tolist()):
                self.push(rank, at)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(changes(ranks))
        ends = [*starts[1:].tolist(), len(ranks)]
        for rank, a, b in zip(ranks[starts].tolist(), starts.tolist(), ends):
            self.push(rank, positions[a:b] if b - a > 1 else int(positions[a]))

    def least(self) -> int:
        """The least rank with entries, or NONE."""
        if not self.top:
            return NONE
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list:
        """The rank's bucket, which leaves the queue: positions and arrays of them."""
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.middle[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.middle[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        return self.buckets.pop(rank)


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value isn't that before it."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


@cache
def newer_characters() -> tuple[regex.Pattern, int]:
    """Letters and numbers of the splitting module's Unicode version that the tiktoken library's doesn't have yet, where they are signs; and the first of them."""
    known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes((b,)): b for b in range(256)}, special_tokens={})
    every = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    # What the pattern doesn't match leaves no ids.
    codes = sorted(map(ord, set(every) - set(known.decode(known.encode_ordinary("".join(every))))))
    runs = [[c, c] for c in codes[:1]]
    for c in codes[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]" if runs else r"(?!)"), codes[0] if runs else 0x110000


#: Any sign will do for them, of one character.
SIGN = chr(0xE000)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.pattern, self.ranks = regex.compile(pattern), ranks
        self.newer, self.first_newer = newer_characters()
        missing = [b for b in range(256) if bytes((b,)) not in ranks]
        if missing or max(ranks.values()) >= 64**3:
            raise ValueError(f"{len(missing)} bytes aren't pieces; the greatest rank is {max(ranks.values())}")
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        # Of two neighbours, the left one's id times ``width`` plus the right one's leads to the rank of the two.
        self.width, self.pairs = max(ranks.values()) + 2, {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        keys = sorted(self.pairs)
        self.keys, self.values = np.array([*keys, 1 << 62], np.int64), np.array([*map(self.pairs.get, keys), NONE], np.int32)
        self.queue = RankQueue()
        self.memory: dict[str, bytes] = {}

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks that neighbours merge to, or NONE."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], np.int32(NONE))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and the number of each word's."""
        sizes = np.array([len(w) for w in words], np.int64)
        lists = Lists(self, np.frombuffer(b"".join(words), np.uint8), sizes)
        whole = np.array([self.ranks.get(w, NONE) for w in words], np.int32)
        return lists.merged(whole)

    def _split(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
        """Number of the text and some of its pre-tokens; of each text once at least, of a long one as they come."""
        for k, text in enumerate(texts):
            text = text or ""
            # Few texts reach the first of them, and the greatest character is told at once.
            odd = not text.isascii() and np.frombuffer(text.encode("utf-32-le"), np.uint32).max() >= self.first_newer and self.newer.search(text)
            if odd or len(text) > LONG_TEXT:
                plain = self.newer.sub(SIGN, text) if odd else text
                words = (text[m.start() : m.end()] for m in self.pattern.finditer(plain))
                while some := list(islice(words, BLOCK)):
                    yield k, some
            else:
                yield k, self.pattern.findall(text)

    def ids(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text, in order; pre-tokens are looked up a block at a time."""
        block, size, parts, of = [], 0, [], 0
        for last, item in chain(((False, x) for x in self._split(texts)), ((True, None),)):
            if item:
                block.append(item)
                size += len(item[1])
            if block and (last or size >= BLOCK):
                for (k, _), found in zip(block, self._looked_up([words for _, words in block])):
                    if k != of:
                        yield np.concatenate(parts)
                        parts, of = [], k
                    parts.append(found)
                block, size = [], 0
        if parts:
            yield np.concatenate(parts)

    def _looked_up(self, block: list[list[str]]) -> list[np.ndarray]:
        new = [w for w in set().union(*block) if w not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list(set().union(*block))
        ids, counts = self.encode_words([w.encode() for w in new])
        flat, ends = ids.tobytes(), np.cumsum(4 * counts).tolist()
        # Ids are held as bytes, which take little and are joined at once.
        self.memory.update(zip(new, (flat[a:b] for a, b in zip([0, *ends], ends))))
        of = self.memory.__getitem__
        found = [np.frombuffer(b"".join(map(of, words)), np.int32) for words in block]
        for word in new:
            if len(word) > SHORT:
                del self.memory[word]
        return found


class Lists:
    """The linked lists of many words' pieces, side by side. A piece is where its first byte is; the place after the last byte ends every list."""

    def __init__(self, encoder: Encoder, data: np.ndarray, sizes: np.ndarray):
        n = len(data)
        self.encoder, self.queue, self.n = encoder, encoder.queue, n
        self.starts = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.id = np.append(encoder.byte[data], np.int32(encoder.width - 1))
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        filled = sizes > 0
        self.after[(self.starts + sizes)[filled] - 1] = n
        self.before[self.starts[filled]] = n
        self.rank = encoder.joined(self.id, self.id[self.after.clip(max=n)])
        self.rank[n] = NONE

    def merged(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word; words that are pieces as a whole stay one."""
        queue, n = self.queue, self.n
        known = np.repeat(whole != NONE, self.sizes)
        self.rank[:n][known] = NONE
        queue.push_all(self.rank[:n], np.arange(n, dtype=np.int32))
        views = tuple(memoryview(x) for x in (self.id, self.after, self.before, self.rank))
        while (rank := queue.least()) != NONE:
            bucket = queue.take(rank)
            if len(bucket) <= FEW and all(type(at) is int for at in bucket):
                self._few(rank, sorted(bucket), *views)
            else:
                at = np.sort(np.concatenate([np.atleast_1d(np.asarray(x, np.int32)) for x in bucket]))
                self._many(rank, at[changes(at)])
        heads = self.id[:n] != NONE
        ids = self.id[:n].copy()
        word = np.repeat(np.arange(len(whole)), self.sizes)
        heads[known] = False
        first = self.starts[(whole != NONE) & (self.sizes > 0)]
        heads[first], ids[first] = True, whole[whole != NONE]
        return ids[heads], np.bincount(word[heads], minlength=len(whole))

    def _few(self, rank: int, positions: list[int], ids: memoryview, after: memoryview, before: memoryview, ranks: memoryview) -> None:
        """From left to right; a merge that makes a lower rank sends the rest back."""
        pairs, width, queue, n = self.encoder.pairs, self.encoder.width, self.queue, self.n
        for k, at in enumerate(positions):
            if ranks[at] != rank:
                continue  # stale
            gone = after[at]
            right, left = after[gone], before[at]
            ids[at], after[at], ranks[gone], ids[gone], ranks[at] = rank, right, NONE, NONE, NONE
            lower = False
            if right != n:
                before[right] = at
                new = ranks[at] = pairs.get(rank * width + ids[right], NONE)
                if new != NONE:
                    queue.push(new, at)
                    lower = new < rank
            if left != n:
                new = ranks[left] = pairs.get(ids[left] * width + rank, NONE)
                if new != NONE:
                    queue.push(new, left)
                    lower = lower or new < rank
            if lower:
                for later in positions[k + 1 :]:
                    queue.push(rank, later)
                return

    def _many(self, rank: int, at: np.ndarray) -> None:
        """All at once: of pairs that overlap every second one, from the left."""
        encoder, n = self.encoder, self.n
        at = at[self.rank[at] == rank]  # the others are stale
        if not len(at):
            return
        every = at
        begins = np.append(True, self.after[at[:-1]] != at[1:])
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        gone = self.after[at]
        right, left = self.after[gone], self.before[at]
        # What the merges make, one by one from the left: the piece before may be merged by then, the one behind isn't.
        own = np.full(len(at), rank, np.int32)
        behind = encoder.joined(own, self.id[right])
        ahead = encoder.joined(np.where(np.append(False, right[:-1] == at[1:]), own, self.id[left]), own)
        lower = ((behind != NONE) & (behind < rank)) | ((ahead != NONE) & (ahead < rank))
        if lower.any():
            word = np.searchsorted(self.starts, at, side="right")
            go = changes(word) | ~np.isin(word, word[lower])
            at = at[go]
            gone, own = self.after[at], own[: len(at)]
            right, left = self.after[gone], self.before[at]
            back = np.setdiff1d(every, np.concatenate([at, gone]))
            if len(back):
                self.queue.push(rank, back)
        self.id[at], self.id[gone], self.rank[gone] = rank, NONE, NONE
        self.after[at], self.before[right] = right, at
        self.id[n] = encoder.width - 1
        left = self.before[at]
        ranks = encoder.joined(own, self.id[right]), encoder.joined(self.id[left], own)
        self.rank[at] = ranks[0]
        self.rank[left] = ranks[1]
        self.rank[n] = NONE
        inner = left != n
        self.queue.push_all(np.concatenate([ranks[0], ranks[1][inner]]), np.concatenate([at, left[inner]]))


class Decoder:
    """Bytes of all pieces as one array, so that ids are looked up a block at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = {rank: piece for piece, rank in ranks.items()}
        self.sizes = np.full(max(pieces) + 1, -1, dtype=np.int64)
        for rank, piece in pieces.items():
            self.sizes[rank] = len(piece)
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)
        self.data = np.frombuffer(b"".join(pieces[r] for r in sorted(pieces)), dtype=np.uint8)

    def bytes(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK]
            if part.min() < 0 or part.max() >= len(self.sizes) or self.sizes[part].min() < 0:
                raise ValueError("an id outside the vocabulary")
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.data[np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - sizes), sizes)].tobytes())
        return b"".join(out)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH bytes or a little more, so that many pre-tokens share a queue."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, n_tokens."""
    key = f"byte_pairs {path} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(key, lambda: Encoder(read_ranks(path), pattern))
        for batch in gathered(batches):
            found = list(encoder.ids(text.as_py() for text in batch.column("text")))
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(np.diff(ends), pa.int64())], ["doc_id", "ids", "n_tokens"])

    tuned(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run, key), f"doc_id {kind}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """The same rows with ``decoded``, the bytes that their ids stand for."""
    key = f"byte_pairs decoder {path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept(key, lambda: Decoder(read_ranks(path)))
        for batch in batches:
            ids = batch.column("ids")
            decoded = pa.array([decoder.bytes(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    tuned(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(trimmed(run, key), f"{fields}, decoded binary")
