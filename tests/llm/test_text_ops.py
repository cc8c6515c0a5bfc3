"""Decontamination, SentencePiece coding, and the pipeline."""

import itertools
import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontam, pieces, toxicity
from millrace.llm.common import kept, trimmed
from tests.llm.helpers import corpus, docs
from tests.llm.test_dedup_ops import jaccard_brute, line_brute

BENCH = "item_id long, text string, n_windows int"


def bench(spark, *texts):
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], BENCH)


ITEM = "A train leaves the station with 120 passengers and travels 45 km before it stops, when 120 others get on and Maria counts all of them"


def leaks(spark, texts, *items):
    return {(r.doc_id, r.item_id): r.kind for r in decontam.find_leaks(docs(spark, texts), bench(spark, *items)).collect()}


def test_kinds_of_leaks(spark):
    texts = [
        "Before. " + ITEM + ". After", ITEM.replace("120", "77").replace("45", "9").replace("Maria", "Pedro"), ITEM.replace("120", "77", 1).replace("45", "9").replace("Maria", "Pedro"), ITEM.upper(), "nothing of the kind, in words that are not in it at all", None, "", ITEM[:40],
    ]
    got = leaks(spark, texts, ITEM, None, "", "too short")
    assert got[0, 0] == "exact" and got[1, 0] == "reparameterised" and not any(k > 2 and k != 3 for k, _ in got)
    assert all(item == 0 for _, item in got)


def test_inconsistent_slots_are_no_leak(spark):
    item = "add 5 apples to 5 pears then take 5 plums from the bowl"
    assert leaks(spark, [item.replace("5", "8"), "add 5 apples to 6 pears then take 7 plums from the bowl"], item) == {(0, 0): "reparameterised"}


def test_short_items_and_repeated_rows(spark):
    got = leaks(spark, [(1, "they say the cat sat down here today"), (1, "the cat sat down"), (None, "the cat sat down")], "The cat sat down", "The cat sat down")
    assert set(got) == {(1, 0), (None, 0)}
    (row,) = {tuple(r)[1:3] for r in decontam.find_leaks(docs(spark, ["the cat sat down"]), bench(spark, "The cat sat down", "The cat sat down")).collect()}
    assert row == (0, 2)
    assert decontam.find_leaks(docs(spark, []), bench(spark, ITEM)).count() == 0
    assert decontam.find_leaks(docs(spark, [ITEM]), bench(spark)).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    frame, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.find_leaks(frame, items).collect()))
    monkeypatch.setattr(decontam, "MAX_WINDOWS", 100)
    assert sorted(map(tuple, decontam.find_leaks(frame, items).collect())) == whole
    texts = {r.item_id: r.text for r in items.collect()}
    held = {(r.doc_id, i) for r in frame.collect() for i, t in texts.items() if t in (r.text or "")}
    assert held <= {(r[0], r[1]) for r in whole} and len(held) > 5
    clean = decontam.keep_clean(frame, items)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in frame.collect()} - {r[0] for r in whole} and clean.columns == frame.columns


def test_verbatim_copies_without_literal_windows(spark):
    """Arithmetic, title case, unspaced scripts, one word; other operators or numbers are no copy of a formula."""
    items = ["Compute 3 + 5 * 7 - 2", "The Great Old Tower Of London By Night And Day", "小明有三个苹果，他吃了一个，还剩几个？", "ゆきは本を12冊もっている", "2 + 2", "Xylograph"]
    texts = [f"Some words before. {t}\nand after" for t in items] + [f"前文{items[2]}后文", "Compute 3 * 5 + 7 - 2", "compute 3 + 5 * 7 - 4", "ゆきは本を15冊もっている。", "2 - 2 and 小明有三个", "the tower of london"]
    assert leaks(spark, texts, *items) == {**{(k, k): "exact" for k in range(6)}, (6, 2): "exact", (9, 3): "reparameterised"}
    clean = decontam.keep_clean(docs(spark, texts), bench(spark, *items))
    assert {r.doc_id for r in clean.collect()} == {7, 8, 10, 11}


def test_long_verbatim_passages(spark):
    """25 consecutive words of 60 are a leak, 13 too, 12 or scattered ones aren't; characters count half."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    part = lambda a, b: " ".join(["x", *words[a:b], "y"])
    han = "".join(chr(0x4E00 + k) for k in range(120))
    texts = [part(20, 45), part(20, 33), part(20, 32), part(0, 9) + part(20, 29) + part(40, 49), han[30:56], han[30:55]]
    assert leaks(spark, texts, " ".join(words), han) == {(0, 0): "exact", (1, 0): "exact", (4, 1): "exact"}


def leaks_brute(text, item):
    """The kind of leak, if any, by all windows and all alignments, on strings."""

    def tokens(text, symbols):
        number = r"[0-9]+(?:[.,][0-9]+)*"
        own = r"|[-+*/=<>^%()\[\]{}|&~#@$\\]" if symbols else ""
        return [(m[0], m.start()) for m in re.finditer(rf"(?:{number}|[A-Za-z\x80-\u07ff])+|[\u0800-\U0010ffff]{own}", text)]

    def template_of(text):
        out, end = [], 0
        for k, (word, at) in enumerate(tokens(text, False)):
            opens = k == 0 or re.search(r"[\n\r!.?]", text[end:at])
            low = "".join(c.lower() if c.isascii() else c for c in word)
            kind = "number" if word[0] in "0123456789" else "unit" if low in decontam.UNITS else "name" if re.match(r"[A-Z](?![A-Z])", word) and not opens else ""
            out.append((kind or low, low, bool(kind)))
            end = at + len(word)
        return out

    a, b = template_of(item), template_of(text)
    n = min(decontam.WINDOW, len(a))
    good = [p for p in range(len(a) - n + 1) if 2 * sum(not s for *_, s in a[p : p + n]) >= n] if n >= decontam.SHORTEST else []
    kind = None
    if good:
        shifts = {}
        for t in range(len(b) - n + 1):
            for p in good:
                if [x[0] for x in a[p : p + n]] == [x[0] for x in b[t : t + n]]:
                    shifts.setdefault(t - p, []).append(p)
        covered, same = set(), True
        for shift, places in sorted(shifts.items(), key=lambda x: (-len(x[1]), x[0])):
            pairs, ok, equal = set(), [], True
            for p in sorted(places):
                slots = {(a[q][1], b[q + shift][1]) for q in range(p, p + n) if a[q][2]}
                every = pairs | slots
                if len({x for x, _ in every}) == len({y for _, y in every}) == len(every):
                    pairs, equal = every, equal and all(x == y for x, y in slots)
                    ok.append(p)
            same = same and (equal or set(ok) <= covered)
            covered |= set(ok)
        if 2 * len(covered) >= len(good):
            kind = "exact" if same else "reparameterised"
    if kind is None:
        low = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w, _ in tokens(t, True)]
        x, y = low(item), low(text)
        words = [0 if w in "+-*/=<>^%()[]{}|&~#@$\\" else 1 if w[0] >= "\u0800" else 2 for w in x]
        m = min(decontam.WINDOW, len(x))
        places = [p for p in range(len(x) - m + 1) if m] if not any(words) else [p for p in range(len(x) - m + 1) if m and any(words[p : p + m])]
        there = {tuple(y[t : t + m]) for t in range(len(y) - m + 1)}
        held = [p for p in places if tuple(x[p : p + m]) in there]
        run = max((sum(words[p:q]) for p in range(len(x)) for q in range(p + 1, len(x) + 1) if any(y[t : t + q - p] == x[p:q] for t in range(len(y))) and q - p >= m), default=0)
        if held and (2 * len(held) >= len(places) or run >= 2 * decontam.VERBATIM):
            kind = "exact"
    return kind


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_brute_force(spark, seed):
    """Items that share stems, with numbers, names and units; documents that hold parts of them with other values."""
    rng = random.Random(seed)
    words = "the a of train goes to town and takes bread from shop when it rains 漢 字".split()
    slot = lambda: rng.choice([str(rng.randint(1, 9)), "Ann", "Bob", "km", "kg", "3.5"])
    prose = lambda n: [slot() if rng.random() < 0.2 else rng.choice(words) for _ in range(n)]
    stem = prose(12)
    items = [" ".join([*(stem if k % 3 == 0 else []), *prose(rng.randint(1, 25))]) for k in range(12)]
    texts = []
    for k in range(150):
        x = rng.choice(items).split()
        a = rng.randrange(len(x))
        part = [slot() if rng.random() < 0.05 else w for w in x[a // 3 : a // 3 + rng.randint(5, 40)]]
        texts.append(" ".join([*prose(rng.randint(0, 8)), *part, *prose(rng.randint(0, 8))]))
    texts += [" ".join(stem), *items[:3]]
    want = {(i, k): kind for i, t in enumerate(texts) for k, item in enumerate(items) if (kind := leaks_brute(t, item))}
    assert leaks(spark, texts, *items) == want and len(want) > 15


def test_a_stem_of_many_items_leads_to_few():
    """An item's own windows lead to it, not those of a stem that all items share."""
    items = [decontam.Item(k, "how many of the following words stand in it " + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(50)]
    index = decontam.Index(items)
    (table,) = index.plain_by_size.values()
    assert max(map(len, table.where.values())) == 50 and max(map(len, table.leads.values())) == 1


# SentencePiece


@pytest.fixture(scope="module")
def coder():
    with open(pieces.MODEL_PATH, "rb") as file:
        return pieces.encoder(file.read())


def test_encoding_equals_the_library(coder):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "    ", "é", "\n", "漢", "😀", "ing", "0", "aa", "==", "\t", "².", "▁", "x" * 40, "ĳ", "\u0301"]
    texts = [t or "" for t in corpus(8)] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for t in texts:
        ids, exact = coder.encode(t)
        assert ids.tolist() == sp.encode(t)
        assert exact == (coder.decode(ids.tolist()) == t) == ("▁" not in t)


def test_workers_keep_only_the_state_of_the_operator_at_work():
    made = []
    state = lambda: kept("model", lambda: made.append(1) or object())
    run = lambda batches: (state() for _ in batches)
    for _ in range(2):
        list(trimmed(run, "model")(iter([1, 2])))
    assert len(made) == 1
    list(trimmed(lambda batches: batches)(iter([1])))
    list(trimmed(run, "model")(iter([1])))
    assert len(made) == 2


def test_long_words_are_committed_on_the_way(coder):
    text = "thenandwhere" * 3000
    seen = []
    gen = coder.lattice(text)
    for piece in itertools.islice(gen, 5):
        seen.append(piece)
    assert "".join(seen) == text[: len("".join(seen))]
    assert "".join([*seen, *gen]) == text
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    assert coder.encode(text)[0].tolist() == sp.encode(text)


def test_unigram_is_optimal():
    rng = random.Random(4)
    vocabulary = ["<unk>", *"abc", "ab", "bc", "abc", "ca", "aab", "cc", "▁", "▁a"]
    table = [(p, rng.uniform(-5, -1), pieces.UNKNOWN if p == "<unk>" else pieces.NORMAL) for p in vocabulary]
    enc = pieces.Encoder(pieces.PieceModel(table, pieces.UNIGRAM))
    score = {p: s for p, s, _ in table}

    def best(t):
        top = [0.0] + [float("-inf")] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(j):
                if t[i:j] in score:
                    top[j] = max(top[j], top[i] + score[t[i:j]])
                elif j == i + 1:
                    top[j] = max(top[j], top[i] + enc.model.floor)
        return top[-1]

    for _ in range(200):
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 60)))
        found = list(enc.lattice(t))
        assert "".join(found) == t and sum(score.get(p, enc.model.floor) for p in found) == pytest.approx(best(t))


def test_round_trip_in_spark(spark):
    texts = [*corpus(9), " lead", "trail ", "a▁b"]
    frame = docs(spark, [*enumerate(texts), (None, "x"), (0, texts[0])])
    coded = pieces.encode(frame)
    assert coded.where("NOT exact").count() == 1 and coded.count() == len(texts) + 2
    back = {r.doc_id: r.text for r in pieces.decode(coded).where("doc_id IS NOT NULL").collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(texts))
    assert pieces.encode(docs(spark, [])).count() == 0 and coded.where("n_ids = 0").count() == sum(not t for t in texts)


def test_exact_is_told_from_the_decoded_text():
    """Segments that were remembered as faithful don't hide a fault in decoding the row's ids."""
    with open(pieces.MODEL_PATH, "rb") as file:
        own = pieces.Encoder(pieces.PieceModel.from_bytes(file.read()))
    ids, exact = own.encode(" the cat  sat é漢")
    assert exact and own.decode(ids.tolist()) == " the cat  sat é漢" and not own.encode("a▁b")[1]
    whole = own.decode
    own.decode = lambda ids: whole(ids)[1:]
    assert not own.encode(" the cat  sat é漢")[1]


# Pipeline


def test_pipeline_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{d}/documents.parquet").cache()
    columns = frame.columns
    stages = dict(corpus_pipeline.STAGES)
    lexicon = toxicity.learn(frame, spark.read.parquet(f"{d}/labels.parquet"))
    machine = toxicity.automaton(lexicon)

    one = stages["toxicity"](spark, frame, d).cache()
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in frame.collect() if toxicity.score_text(r.text, machine)[0] < toxicity.THRESHOLD}

    two = stages["line_dedup"](spark, one, d).cache()
    gone = line_brute([(r.doc_id, r.text) for r in one.collect()], 50)
    assert two.columns == columns and two.count() == one.count()
    for r in two.collect():
        (key,) = [k for k in gone if k[0] == r.doc_id]
        filled = [x for x in key[1].split("\n") if x.strip(" ")]
        assert [x for x in r.text.split("\n") if x.strip(" ")] == [x for k, x in enumerate(filled) if k not in gone[key]] and r.n_chars == len(r.text)

    three = stages["jaccard_join"](spark, two, d).cache()
    want = jaccard_brute([(r.doc_id, r.text) for r in two.collect()])
    assert {r.doc_id for r in three.collect()} == {i for i, (_, c) in want.items() if c == i} and three.columns == columns

    four = stages["decontamination"](spark, three, d).cache()
    bad = {r.doc_id for r in decontam.find_leaks(three, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - bad and four.columns == columns

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    texts = {r.doc_id: r.text for r in four.collect()}
    five = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: list(r.ids) for r in five} == {i: sp.encode(t) for i, t in texts.items()} and all(r.exact for r in five)


def test_pipeline_keeps_odd_rows(spark, tmp_path):
    rows = docs(spark, [(1, None), (2, ""), (None, "some text"), (4, "other text"), (4, "other text")]).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("fp"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ["1", "2", "4", "4", "None"]
