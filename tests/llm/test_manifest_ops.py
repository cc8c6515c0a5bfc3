"""The Merkle manifest, byte-level BPE and the sparse resampler against brute force and the tiktoken library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millrace.llm import byte_pairs, csr_resample, merkle, queries
from tests.llm.helpers import corpus, docs, lowered
from tests.oracle import SF

ROWS = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, place int, nodes int, block string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def _path(levels, k):
    out = []
    for nodes in levels[:-1]:
        run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
        out.append((run[: k % 16], run[k % 16 + 1 :]))
        k //= 16
    return out


def manifest(rows):
    """By whole lists: rows are (doc_id, source, lang, n_chars, text)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    by = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = H(*map(field, (doc_id, source, lang, n_chars, text)))
        held = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            held = H(*map(field, (doc_id, source, lang, n_chars, None if text is None else lowered(text))))
        by.setdefault(source, []).append((doc_id, leaf, held))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: _climb([x[1] for x in by[s]]) for s in sources}
    top, out = _climb([trees[s][-1][0] for s in sources]), []
    for j, s in enumerate(sources):
        for k, (doc_id, leaf, node) in enumerate(by[s]):
            path = _path(trees[s], k) + _path(top, j)
            for before, after in path:
                node = H(*before, node, *after)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H(*[x for a, b in path for x in a + b]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def _manifest(df, height=merkle.HEIGHT):
    return sorted([tuple(r) for r in merkle.manifest(df, merkle.lowered_text(), merkle.chosen(), height).collect()], key=repr)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_equals_brute_force(spark, height):
    rng = random.Random(height)
    rows = [(rng.randrange(2000), rng.choice(["a"] * 6 + ["b", "é", "", "A", None]), rng.choice(["en", None]), k, rng.choice(["Ab C", "", None, "é日本", "x" * 50])) for k in range(700)]
    rows += [(k, f"s{k}", "en", 1, "One") for k in range(40)] + [(None, "a", None, None, None)] * 2 + [rows[0]] * 3 + [(9, "a", "en", 300_000, "Long " * 60_000)]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], ROWS)
    assert _manifest(df, height) == manifest(rows)


def test_manifest_of_a_whole_table(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted([tuple(r) for r in queries.op11_merkle(spark, SF).collect()], key=repr)
    assert found == manifest(rows)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "a", None, 2, "Ab", *[None] * 5)], ROWS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == H()


@pytest.mark.parametrize("n, height", [(1, 0), (2, 1), (16, 1), (17, 2), (250, 2), (4096, 3), (3001, 3)])
def test_traversal_keeps_few_digests(n, height):
    leaves = [H(str(k)) for k in range(n)]
    levels, walk = _climb(leaves), merkle.Traversal(leaves, height)
    assert walk.root() == levels[-1][0]
    for k, path in enumerate(walk.paths()):
        assert [(run[:p], run[p + 1 :]) for p, run in path] == _path(levels, k)
        assert all(len(run) <= 16 for run in walk.existing) and all(len(nodes) <= 16 for run in walk.desired for nodes in run.stack)


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(byte_pairs.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.Encoder(byte_pairs.read_ranks(byte_pairs.RANKS))


ODD = ["it's  we'll \n\n x's\t'tis 'S <|endoftext|>", " ", "   ", "\r\n\t ", "a" * 5000, "ab" * 3000 + "c", "日本語" * 500, "🙂👍🏽 ½ ² Ⅷ ١٢٣", "\x00\x1c\x85 x", "é" * 40, "don't'll've" * 20]


def test_byte_pairs_equal_the_library(spark, library):
    texts = corpus(5) + ODD
    df = docs(spark, texts)
    found = {r.doc_id: r for r in byte_pairs.decode(byte_pairs.encode(df)).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        assert found[k].ids == library.encode_ordinary(text or "") and found[k].n_tokens == len(found[k].ids)
        assert bytes(found[k].decoded) == (text or "").encode()


def test_byte_pairs_query(spark, library):
    found = {r.doc_id: r for r in queries.op12_byte_pairs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].ids_sha256 == H(" ".join(map(str, ids)))
        assert found[r.doc_id].decoded_sha256 == H(r.text or "")


def test_long_pre_tokens_equal_the_library(encoder, library):
    rng = random.Random(3)
    words = ["a" * 100_000, "".join(rng.choice("etaoinshr") for _ in range(100_000)), "日" * 20_000]
    ids, sizes = encoder.encode_words([w.encode() for w in words])
    ends = np.cumsum(sizes)
    for word, a, b in zip(words, ends - sizes, ends):
        assert ids[a:b].tolist() == library.encode_ordinary(word)


def test_every_character_splits_as_in_the_library(encoder, library):
    for first in range(0, 0x34000, 0x1000):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)}'s" for c in range(first, first + 0x1000) if not 0xD800 <= c < 0xE000)
        assert next(encoder.ids([text])).tolist() == library.encode_ordinary(text)


def test_blocks_of_one_text_join(encoder, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "LONG_TEXT", 50)
    monkeypatch.setattr(byte_pairs, "BLOCK", 7)
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 20)
    texts = corpus(8, 20) + ODD
    assert [x.tolist() for x in encoder.ids(texts)] == [library.encode_ordinary(t or "") for t in texts]


@pytest.mark.parametrize("few", [0, 2, 6])
def test_queue_follows_ranks_in_any_vocabulary(few, monkeypatch):
    """Ranks in no order of merges, so that merges make lower ranks; against looking for the least pair each time."""
    monkeypatch.setattr(byte_pairs, "FEW", few)
    rng = random.Random(few)
    for _ in range(60):
        known = {bytes((b,)) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 60))}
        order = sorted(known)
        rng.shuffle(order)
        ranks = {piece: k for k, piece in enumerate(order)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) for _ in range(30)] + [b"a" * rng.randint(1, 30)]
        ids, sizes = byte_pairs.Encoder(ranks).encode_words(words)
        at = 0
        for word, n in zip(words, sizes):
            parts = [bytes((b,)) for b in word]
            while word not in ranks and (pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]):
                k = min(pairs)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert ids[at : at + n].tolist() == ([ranks[word]] if word in ranks else [ranks[p] for p in parts])
            at += n


def test_byte_pairs_odd_inputs(spark):
    assert byte_pairs.decode(byte_pairs.encode(docs(spark, []))).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_pairs.decode(nulls).first().decoded) == b""
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_pairs.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()
    with pytest.raises(ValueError, match="aren't pieces"):
        byte_pairs.Encoder({b"a": 0})


# Sparse resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    found = WORD.findall(lowered(text))
    return len(found), Counter(zlib.crc32(" ".join(found[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(found) - n + 1))


def resampled(rows, target):
    counted, s, t = [(i, *_features(text)) for i, text in rows], Counter(), Counter()
    for _, _, c in counted:
        s.update(c)
    for text in target:
        t.update(_features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    out = []
    for i, n, c in counted:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(H(f"42:{'null' if i is None else i}")[:8], 16)
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in out], key=repr)


def _resampled(df, target):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in csr_resample.resample(df, target).collect()], key=repr)


def test_resampling_equals_brute_force(spark):
    texts = corpus(11, 150)
    rows = list(enumerate(texts)) + [(None, texts[0])] * 2 + [(3, texts[3])] * 3 + [(1000, "Long text, of " * 30_000 + "é" * 70_000 + " end"), (1001, "x" * 600_000)]
    target = [texts[5], None, "", "one two three " * 10]
    df = docs(spark, rows)
    assert _resampled(df, spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")) == resampled(rows, target)
    assert _resampled(df, spark.createDataFrame([], "item_id long, text string")) == resampled(rows, [])


def test_resampling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in queries.op13_csr_resample(spark, SF).collect()], key=repr)
    assert found == resampled(rows, target)
    assert csr_resample.resample(docs(spark, []), spark.createDataFrame([], "text string")).count() == 0


def test_checksums_of_runs_follow_from_words():
    rng = random.Random(2)
    for _ in range(60):
        found = [bytes(rng.choice(b"abcxyz\xc3\xa9") for _ in range(rng.choice([1, 2, 5, 9, 47, 48, 49, 120, 300]))) for _ in range(rng.randint(0, 12))]
        data = np.frombuffer(b" ".join(found) or b" ", np.uint8)
        sizes = np.array([len(w) for w in found], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        crc = csr_resample.word_crcs(data, ends - sizes, ends)
        bucket, _ = csr_resample.features(crc, sizes, np.zeros(len(found), np.int64))
        assert bucket.tolist() == [zlib.crc32(b" ".join(found[k : k + n])) % 10_000 for n in (1, 2, 3) for k in range(len(found) - n + 1)]
