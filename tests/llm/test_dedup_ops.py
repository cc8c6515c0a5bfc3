"""Line dedup, the Jaccard join and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import jaccard_join, line_dedup, suffix_dedup
from millrace.llm.components import components
from tests.llm.helpers import components as brute_components
from tests.llm.helpers import corpus, docs, lowered


# Line dedup


def line_brute(rows, min_chars):
    """Deletes lines of windows of any number of lines with min_chars characters that stand earlier; rows have different doc_ids."""
    order = sorted(set(rows), key=lambda k: (k[0] is not None, k[0] or 0))
    return dict(zip(order, line_brute_any([t for _, t in order], min_chars)))


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    base = [f"line {k} " + "x" * rng.randint(0, 30) for k in range(15)] + ["", "  "]
    texts = ["\n".join(rng.choice(base) for _ in range(rng.randint(0, 14))) for _ in range(25)] + [None, "", "\n", base[0]]
    frame = docs(spark, texts)
    got = {r.doc_id: r for r in line_dedup.dedup(frame, 30).collect()}
    gone = line_brute([(k, t) for k, t in enumerate(texts)], 30)
    for (k, text), removed in gone.items():
        assert got[k].n_removed_lines == len(removed), (k, text)
        if text is None:
            assert got[k].text is None
        else:
            place, kept = 0, []
            for line in text.split("\n"):
                if line.strip(" "):
                    place += 1
                    if place - 1 in removed:
                        continue
                kept.append(line)
            assert got[k].text == ("\n".join(kept) if any(x.strip(" ") for x in kept) or not removed else "")
    assert set(frame.columns) < set(line_dedup.dedup(frame, 30).columns)


def test_line_dedup_odd_rows(spark):
    long = "a line of more than fifty characters, which is enough to count as a run"
    rows = [(None, long), (1, long), (1, long), (1, long + "\nother"), (2, "short\nshort\nshort")]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup(docs(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, long), (1, ""), (1, ""), (1, "other"), (2, "short\nshort\nshort")]))
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_covered_places():
    rng = random.Random(4)
    for n in (0, 1, 5, 60):
        at, size = [rng.randrange(200) for _ in range(n)], [rng.randint(1, 30) for _ in range(n)]
        want = sorted({p for a, k in zip(at, size) for p in range(a, a + k)})
        assert line_dedup.covered(np.array(at, np.int64), np.array(size, np.int64)).tolist() == want


def test_line_dedup_long_text_of_short_lines(spark):
    # Windows of 50 lines each that overlap everywhere; of 60,000 lines all but the first copy of the cycle go.
    lines = [str(k % 10) for k in range(60_000)]
    got = line_dedup.dedup(docs(spark, ["\n".join(lines), "0"])).orderBy("doc_id").collect()
    assert [r.n_lines for r in got] == [60_000, 1] and got[1].text == "0"
    assert got[0].n_removed_lines == 60_000 - 10 and got[0].text == "\n".join(lines[:10])


def line_brute_any(texts, min_chars):
    """Deletes lines of windows of any number of lines with min_chars characters that stand earlier."""
    seqs = [[x for x in (t or "").split("\n") if x.strip(" ")] for t in texts]
    first, gone = {}, [set() for _ in texts]
    for k, lines in enumerate(seqs):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if first.setdefault(run, (k, i)) != (k, i) and sum(map(len, run)) >= min_chars:
                    gone[k].update(range(i, j))
    return gone


def test_line_dedup_runs_of_any_length(spark):
    """Runs of 3, 5, 6, 7, 11 lines that reach the minimum only as a whole, and random ones with short edge lines."""
    texts = []
    for n in (3, 5, 6, 7, 11):
        run = [(chr(97 + n) + chr(97 + k)).ljust(50 // n + (k < 50 % n), "x") for k in range(n)]
        assert sum(map(len, run)) == 50
        texts += ["\n".join(["before", *run, "after"]), "\n".join(["other", *run, "end"]), "\n".join(["less", *run[:-1], "end"])]
    rng = random.Random(7)
    base = [f"{k}" + "y" * rng.choice([0, 1, 3, 9, 20, 45, 60]) for k in range(8)]
    texts += ["\n".join(rng.choice(base) for _ in range(rng.randint(1, 20))) for _ in range(30)] + ["z\n" * 130, "z\n" * 49]
    want = line_brute_any(texts, 50)
    got = {r.doc_id: r for r in line_dedup.dedup(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(" ")]
        assert got[k].n_removed_lines == len(want[k]), (k, t)
        assert [x for x in got[k].text.split("\n") if x] == [x for i, x in enumerate(lines) if i not in want[k]]


def test_line_dedup_other_texts_of_one_doc_id(spark):
    """Texts of one doc_id are documents of their own: one copy of the run stays, in one of them."""
    run = "a line of more than fifty characters, which is enough to count as a run"
    got = line_dedup.dedup(docs(spark, [(7, f"one\n{run}"), (7, f"two\n{run}\n{run}"), (8, run)])).collect()
    assert sum(r.text.count(run) for r in got) == 1 and sum(r.n_removed_lines for r in got) == 3 and {r.doc_id for r in got if run in r.text} == {7}


# Jaccard join


def shingles(text):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in brute_components(edges, ids).items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join(spark, seed):
    texts = corpus(seed, 80)
    want = jaccard_brute(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs(spark, texts)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 5


def test_jaccard_chains_at_the_threshold(spark):
    """Each text shares exactly 8 of 10, or 4 of 6, shingles with the next: only the former link."""
    word = lambda k: f"w{k}"
    chain = [" ".join(word(j) for j in range(k, k + 13)) for k in range(0, 12)]  # 9 shingles each, 8 shared of 10
    loose = [" ".join(f"v{j}" for j in range(2 * k, 2 * k + 13)) for k in range(6)]  # 7 shared of 11
    got = {r.doc_id: r.component_id for r in jaccard_join.linked(docs(spark, chain + loose)).collect()}
    assert [got[k] for k in range(12)] == [0] * 12 and [got[k] for k in range(12, 18)] == list(range(12, 18))


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "A  b\tc d e f"), (6, ""), (7, None), (8, "x"), (9, "X")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.linked(docs(spark, rows)).collect())
    assert got == sorted([("None", 2, None), ("5", 2, 4), ("5", 2, 4), ("4", 2, 4), ("6", 0, 6), ("7", 0, 7), ("8", 1, 8), ("9", 1, 8)])
    assert jaccard_join.linked(docs(spark, [])).count() == 0


def test_jaccard_one_doc_id_with_other_texts(spark):
    """Rows of one doc_id are one node, through which others link; one of them may be empty."""
    a, b, c = "a b c d e f", "k l m n o p", "u v w x y z"
    rows = [(3, a), (5, a), (5, b), (9, b), (9, None), (12, c), (9, c), (20, "t"), (None, a), (None, c)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.linked(docs(spark, rows)).collect())
    assert got == sorted([("3", 2, 3), ("5", 2, 3), ("5", 2, 3), ("9", 2, 3), ("9", 0, 3), ("12", 2, 3), ("9", 2, 3), ("20", 1, 20), ("None", 2, None), ("None", 2, None)])


def test_hot_shingles_and_blocks(spark, monkeypatch):
    """A passage that all documents have, and a group of near copies, with tiny blocks and a low bound for hot shingles."""
    rng = random.Random(9)
    words = [f"t{k}" for k in range(2000)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    near = [rng.choice(words) for _ in range(120)]
    texts = []
    for k in range(60):
        if k % 2:
            other = near[:]
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(other))
        else:
            texts.append(passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "VERIFY", 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs(spark, texts)).collect()}
    assert got == jaccard_brute(list(enumerate(texts)))


def test_documents_joined_where_many_are_wanted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LISTED", 0)
    texts = corpus(11, 40)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs(spark, texts)).collect()} == jaccard_brute(list(enumerate(texts)))


def test_a_very_long_text(spark):
    """20 MB in one row, among short ones and a copy with a few other words."""
    rng = random.Random(12)
    words = [f"{k:x}y" for k in rng.sample(range(1 << 24), 400_000)] * 7
    other = words[:]
    for k in range(0, 400_000, 4000):
        other[k] = "changed"
    texts = [" ".join(words), "short", " ".join(other), "a b c d e f"]
    assert len(texts[0]) > 20 << 20
    got = {r.doc_id: r.component_id for r in jaccard_join.linked(docs(spark, texts).repartition(4)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


def test_merging_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(5)
    for _ in range(3):
        base = [rng.integers(0, 1 << 63, 80).astype(np.uint64) for _ in range(4)]
        sets = sorted((np.unique(np.concatenate([base[k % 4][rng.random(80) < 0.9], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for k in range(120)), key=len)
        n, blocks, parts = np.array([len(s) for s in sets]), np.arange(120) % 2, np.arange(120) // 3
        for one in (True, False):
            edges = [(i, j) for i in range(120) for j in range(i + 1, 120) if (one or blocks[i] != blocks[j]) and jaccard_join._links(sets[i], sets[j])]
            held = [(k, k - k % 3) for k in range(120)]
            got = jaccard_join.merging_links(n, parts.copy(), blocks, sets, one)
            assert set(got) <= set(edges) and len(got) < 40 and brute_components(got + held, range(120)) == brute_components(edges + held, range(120))
            maps = [jaccard_join.signature(s) for s in sets]
            found = jaccard_join.with_partner(n, np.arange(120), blocks, maps, one)
            assert all(found[i] and found[j] for i, j in edges)


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(0)
    for _ in range(3):
        base = [rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(8)]
        sets = []
        for k in range(90):
            s = base[k % 8].copy()
            s[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 1 << 63, 1).astype(np.uint64)
            sets.append(np.unique(s)[: 60 - k % 9])
        sets.sort(key=len)
        n = np.array([len(s) for s in sets])
        maps = np.stack([jaccard_join.folded(jaccard_join.signature(s), 8) for s in sets])
        got = set(jaccard_join.traverse(n, np.arange(90), maps, np.zeros(90), True))
        linked = {(i, j) for i in range(90) for j in range(i + 1, 90) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])}
        assert linked <= got and len(got) < 90 * 89 // 2


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, 3), (3, 9), (50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 3: 3, 5: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Suffix dedup


def suffix_brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [5, 6])
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    rows = list(enumerate(corpus(seed, 60)))
    rows += [(1000, "ab" * 400), (1001, "ab" * 90 + "c"), (1002, "Y " * 300), (1003, "x" + "Y " * 100), (1004, "é" * 60)]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in suffix_dedup.report(docs(spark, rows).repartition(3)).collect())
    assert got == suffix_brute(rows)


def test_suffix_dedup_one_doc_id_twice(spark):
    text = "the quick brown fox jumps over the lazy dog and then some more words follow it"
    rows = [(3, text), (3, text), (3, text + "!"), (3, "other " + text), (4, text), (None, text), (None, text)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.report(docs(spark, rows)).collect())
    n = len(text)
    assert got == [(0, n, 0), (0, n, 0), (3, n, 0), (3, n, 0), (3, n + 1, 0), (3, n + 6, 0), (4, n, n)]
    kept = [(r.doc_id, r.text) for r in suffix_dedup.deduplicated(docs(spark, rows)).collect()]
    assert (4, "") in kept and (3, "other " + text) in kept and len(kept) == 7
    assert suffix_dedup.report(docs(spark, [])).count() == 0


def test_suffix_dedup_in_slices(spark, monkeypatch):
    """Texts longer than a slice, with passages that lie across cuts."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 97)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    filler = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(k, filler(rng.randint(0, 300)) + passage[rng.randint(0, 60) :] + filler(rng.randint(0, 200))) for k in range(12)] + [(20, "z" * 500), (21, "z" * 260)]
    text = np.frombuffer(rows[0][1].encode(), np.uint8)
    covered = [k for _, start, count, *_ in suffix_dedup.sliced_blocks(text, np.array([0, len(text)])) for s, c in zip(start, count) for k in range(s, s + c)]
    assert covered == list(range(len(text) - 49))
    assert sorted(tuple(r) for r in suffix_dedup.report(docs(spark, rows)).collect()) == suffix_brute(rows)


def test_front_coding_and_loser_tree():
    rng = random.Random(2)
    entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"l", k, 0, k) for k in range(300)]
    runs = [suffix_dedup.front_coded(entries[k::7]) for k in range(7)] + [suffix_dedup.front_coded([])]
    merged = list(suffix_dedup.LoserTree([suffix_dedup.decoded(r) for r in runs]))
    assert [s for _, s, _ in merged] == sorted(e[0] for e in entries)
    assert sorted(r[1] for _, _, r in merged) == list(range(300))
    for (_, a, _), (lcp, b, _) in zip(merged, merged[1:]):
        assert lcp == suffix_dedup.common(a, b, 0)


def test_blocks_cover_all_windows():
    text = b"some text of a few words, some text of a few words, and an end that differs from it all, truly"
    doc, start, count, *_ = suffix_dedup.blocks(np.frombuffer(text, np.uint8), np.array([0, 10, len(text)]))
    assert sorted(k for s, c in zip(start, count) for k in range(s, s + c)) == list(range(len(text) - 10 - 49)) and set(doc) == {1}
