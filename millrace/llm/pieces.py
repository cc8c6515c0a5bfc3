"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice of a text has a node at each character boundary and an edge for each piece. For a
unigram model an edge weighs its piece's score. For a BPE model the model's own result is wanted,
so an edge is allowed after the piece before it only where merging the two pieces' characters gives
just these two pieces; a sequence in which all neighbours agree is the model's encoding, and each
node keeps one back-pointer either way. Only the last ``longest piece`` nodes can start another edge;
whenever the back-pointer paths of these all meet in one boundary, the ids before it are committed
and their nodes dropped. A boundary that no piece of the vocabulary crosses (white space, for common
models) is such a meeting point for every text, so what lies between two of them is encoded once
and remembered.

A null text counts as empty; empty texts have no ids. Characters outside the vocabulary become byte
pieces where the model has them and else the unknown id. Decoding gives the text again exactly,
except that U+2581, the model's own mark for a space, comes back as a space, and unknown ids do as
U+2047 between spaces; ``exact`` tells. Identical rows get identical results; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import kept, trimmed, tuned

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED = 200_000  # segments in each of two generations that a worker keeps


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces with scores and kinds. Only the identity normaliser is supported."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = UNIGRAM, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.scores = {p: pieces[i][1] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        # Boundaries that no piece crosses: before a space mark after another character, and after a run of letters.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        letter = re.compile(r"[^\W\d_]")
        self.odd = {a for p in self.ids for a, b in zip(p, p[1:]) if letter.match(a) and not letter.match(b)}
        self.odd |= {a for p in self.ids for a, b in zip(p, p[1:]) if b in self.odd and letter.match(a)}
        self.letters_end = not any(a not in self.odd and letter.match(a) and (b in self.odd or not letter.match(b)) for p in self.ids for a, b in zip(p, p[1:]))
        self.surface = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces
        ]

    @classmethod
    def from_bytes(cls, data: bytes) -> PieceModel:
        pieces, kind, prefix = [], UNIGRAM, True
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                x = dict(_fields(value))
                prefix = bool(x.get(3, 1))
                if x.get(2) or x.get(4, 1):
                    raise ValueError("only models with the identity normaliser, which keeps all spaces, are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, kind, prefix)


class Encoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.size = len(model.pieces)
        # Each node maps a character to the next node and the id of the piece that ends there.
        self.trie: dict = {}
        for piece, i in model.ids.items():
            node = self.trie
            for k, c in enumerate(piece):
                below, known = node.get(c, ({}, None))
                node[c] = (below, i if k == len(piece) - 1 else known)
                node = below
        # Letters, without the few that some piece has before another character.
        odd = re.escape("".join(sorted(model.odd)))
        letter, other = rf"[^\W\d_{odd}]", rf"(?:[^\w{SPACE}]|[\d_{odd}])"
        words = rf"{SPACE}*{other}*{letter}+|{SPACE}*{other}+|{SPACE}+"
        self.pattern = re.compile(words if model.letters_end else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best pair of neighbours is merged, the leftmost of equals, until none is a piece."""
        parts, scores = list(text), self.model.scores
        while True:
            found = [(-scores[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in scores]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def agree(self, a: int, b: int) -> bool:
        """Whether two pieces are the encoding of their characters."""
        key = a * self.size + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 4 * REMEMBERED:
                self.pairs.clear()
            left, right = self.model.pieces[a][0], self.model.pieces[b][0]
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def lattice(self, text: str) -> Iterator[str]:
        """The pieces of the best path, each yielded as soon as all surviving paths run through it."""
        model, longest, trie = self.model, self.model.longest, self.trie
        unigram, pairs, size = model.kind == UNIGRAM, self.pairs, self.size
        n = len(text)
        # At each node: where its last piece starts, that piece's id (-1: outside the vocabulary), the path's score.
        start, last, total = {0: 0}, {0: -1}, {0: 0.0}
        committed = 0
        for i in range(n):
            before, node = last[i], trie
            if text[i] not in trie or trie[text[i]][1] is None:
                j, score = i + 1, total[i] + model.floor
                if j not in start or (unigram and score > total[j]):
                    start[j], last[j], total[j] = i, -1, score
            for j in range(i, n):
                found = node.get(text[j])
                if found is None:
                    break
                node, piece = found
                if piece is None:
                    continue
                j += 1
                if unigram:
                    score = total[i] + model.pieces[piece][1]
                    if j not in start or score > total[j]:
                        start[j], last[j], total[j] = i, piece, score
                elif j not in start:
                    ok = before < 0 or pairs.get(before * size + piece)
                    if ok is None:
                        ok = self.agree(before, piece)
                    if ok:
                        start[j], last[j], total[j] = i, piece, 0.0
            # Behind the window only back-pointers are held, until they are committed.
            del last[i], total[i]
            if i and i % (2 * longest) == 0:
                alive = {j for j in range(i + 1, i + longest + 1) if j in start}
                while len(alive) > 1:
                    top = max(alive)
                    alive.remove(top)
                    alive.add(start[top] if top > committed else committed)
                meet = alive.pop()
                if meet > committed:
                    yield from self.path(text, start, committed, meet)
                    for k in range(committed, meet):
                        start.pop(k, None)
                    committed = meet
        yield from self.path(text, start, committed, n)

    @staticmethod
    def path(text: str, start, first: int, end: int) -> list[str]:
        out = []
        while end > first:
            out.append(text[start[end] : end])
            end = start[end]
        return out[::-1]

    def short(self, text: str) -> list[str]:
        """The same for a text of a few pieces' length, where nothing is committed before its end."""
        model, pairs, size, trie = self.model, self.pairs, self.size, self.trie
        if model.kind == UNIGRAM:
            return list(self.lattice(text))
        n = len(text)
        start, last = [-1] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            before, node, j = last[i], trie, i
            for c in text[i:]:
                found = node.get(c)
                if found is None:
                    break
                node, piece = found
                j += 1
                if piece is not None and start[j] < 0 and (before < 0 or (ok := pairs.get(before * size + piece)) or (ok is None and self.agree(before, piece))):
                    start[j], last[j] = i, piece
            if start[i + 1] < 0 and (text[i] not in trie or trie[text[i]][1] is None):
                start[i + 1] = i
        return self.path(text, start, 0, n)

    def segment(self, text: str) -> bytes:
        """Ids."""
        model, ids = self.model, array("i")
        for piece in self.short(text) if len(text) <= 4 * model.longest else self.lattice(text):
            if piece in model.ids:
                ids.append(model.ids[piece])
            elif model.bytes:
                ids.extend(model.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                ids.append(model.unknown)
        return ids.tobytes()

    def remembered(self, word: str) -> bytes:
        """A segment's result; of two generations of segments the older goes when the younger is full."""
        found = self.older.get(word) or self.segment(word)
        if len(word) <= 64:
            if len(self.segments) >= REMEMBERED:
                self.older, self.segments = self.segments, {}
            self.segments[word] = found
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, bool]:
        """Ids, and whether decoding them, as a whole, gives the text again."""
        if not text:
            return np.zeros(0, dtype=np.int32), True
        marked = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.model.splits:
            ids = self.segment(marked)
        else:
            get, out = self.segments.get, []
            for word in self.pattern.findall(marked):
                found = get(word)
                if found is None:
                    found = self.remembered(word)
                    get = self.segments.get
                out.append(found)
            ids = b"".join(out)
        ids = np.frombuffer(ids, dtype=np.int32)
        return ids, self.decode(ids.tolist()) == text

    def decode(self, ids) -> str:
        text = b"".join(map(self.model.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def model_key(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encoder(data: bytes) -> Encoder:
    """One encoder for each model and worker, so that segments are remembered across tasks."""
    return kept(model_key(data), lambda: Encoder(PieceModel.from_bytes(data)))


def encode(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids, n_ids, and exact: whether the text decoded from the row's ids is the text again."""
    with open(model_path, "rb") as file:  # a parameter file of the driver, bounded by the vocabulary
        data = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(data)
        for batch in batches:
            ids, exact = [], []
            for text in batch.column("text").to_pylist():
                found, same = coder.encode(text)
                ids.append(found)
                exact.append(same)
            sizes = np.array([len(x) for x in ids], dtype=np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(sizes), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_ids", "exact"])

    tuned(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run, model_key(data)), f"doc_id {kind}, ids array<int>, n_ids int, exact boolean")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, text from ids; null ids give an empty text."""
    with open(model_path, "rb") as file:
        data = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(data)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    tuned(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run, model_key(data)), f"doc_id {kind}, text string")
