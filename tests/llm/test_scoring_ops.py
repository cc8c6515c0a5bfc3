"""Resampling, top-k, URL filter, licence scan and toxicity."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import license_scan, queries, resample, topk, toxicity, url_filter
from tests.llm.helpers import docs
from tests.oracle import duck, rows, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


# Resampling


def bucket_brute(text, number):
    """Buckets of words and pairs by plain integers: polynomial word hashes, weighted sums of two, each finished by splitmix64."""
    import re

    full = (1 << 64) - 1
    mix_1, mix_2, base = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15

    def mixed(x):
        x = ((x ^ (x >> 30)) * mix_1) & full
        x = ((x ^ (x >> 27)) * mix_2) & full
        return x ^ (x >> 31)

    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text)
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    hashes = [mixed((sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) + len(w) * base) & full) for w in words]
    pairs = [mixed((a * mix_1 + b * mix_1 * mix_1) & full) for a, b in zip(hashes, hashes[1:])]
    return [h % number for h in hashes + pairs]


def test_resample_weights(spark):
    texts = ["good words here", "Good words  there", "bad bad\tbad", None, "", "good words here", "é" * 9 + " 漢字 " + "long" * 200]
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    size = 5003
    got = {r.doc_id: r for r in resample.resample(docs(spark, texts), labels, share=0.5, n_buckets=size).collect()}
    raw, target = (np.bincount(sum((bucket_brute(t, size) for t in x), []), minlength=size) for x in ([t for t in texts if t], texts[:2]))
    p = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    for k, t in enumerate(texts):
        assert got[k].log_weight == pytest.approx(p[bucket_brute(t, size)].sum() if t else 0.0)
    assert sum(r.selected for r in got.values()) == 4 and got[2].n_grams == 5
    keys = sorted((r.key for r in got.values()), reverse=True)
    assert all(r.selected == (r.key >= keys[3]) for r in got.values())
    assert resample.resample(docs(spark, []), labels).count() == 0
    assert resample.resample(docs(spark, texts), labels.limit(0)).where("selected").count() == 7


def test_buckets_follow_the_corpus(spark):
    assert resample.bucket_count(docs(spark, ["few words", None])) == resample.LEAST_BUCKETS
    sizes = [resample.bucket_count(spark.range(n).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))) for n in (256, 1024, 4096)]
    assert sizes[0] == resample.LEAST_BUCKETS and sizes[2] == 2 * sizes[1] and all(n & (n - 1) == 0 for n in sizes)


def test_selection_follows_rows_not_files(spark, tmp_path):
    """The same rows in one plain file and in many compressed ones."""
    d = "/root/testdata/sf0.01"
    rows, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows.coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/plain")
    rows.repartition(13).write.option("compression", "zstd").parquet(f"{tmp_path}/packed")
    chosen = [sorted(r.doc_id for r in resample.resample(spark.read.parquet(f"{tmp_path}/{name}"), labels).where("selected").collect()) for name in ("plain", "packed")]
    assert chosen[0] == chosen[1] and chosen[0]


def test_kth_greatest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 10**6) for _ in range(300)] + [5.0] * 50 + [1e-300, -1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 200, len(values), len(values) + 5):
        assert resample.kth_greatest(df, "x", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert resample.kth_greatest(df, "x", 0) is None


def test_resample_separates_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op1_resample(spark, d).join(labels.dropDuplicates(["doc_id"]), "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()
    share = {r.quality: r.s for r in got}
    assert share[1] > 0.95 and share[0] < 0.35


# Top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.2, 6).astype("float32").tolist() for _ in range(150)] + [[0.1] * 6] * 60
    table = [(k, v) for k, v in enumerate(vectors)] + [(300, None), (320, [float("nan")] * 6), (340, [None] + [0.1] * 5), (360, [0.1, 0.2]), (380, []), (None, [0.1] * 6), (400, [float("inf")] * 6)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in table], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(frame.repartition(5), frame.where("vec_id % 20 = 0"), 20).collect()}
    ints = {i: np.floor(64 * np.array(v, dtype="float32").astype("float64")).astype(int) for i, v in table if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in ints if i % 20 == 0]:
        n = len(ints[q])
        scored = sorted((-int(ints[q][: len(v)] @ v[: len(ints[q])]) if n and len(v) else 0, i) for i, v in ints.items() if i != q)
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scored[:20])}
    assert got == want


def test_topk_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (0, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 8192)]
    empty = frame.limit(0)
    assert topk.search(empty, empty).count() == 0


def test_topk_scores_that_do_not_fit(spark):
    frame = spark.createDataFrame([(0, [1e17, 1.0]), (20, [1e17, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(frame, frame).collect()
    for huge in (-1e30, 1e30, 2.0**57, -(2.0**57)):
        far = spark.createDataFrame([(1, [huge, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.search(far, far.where("vec_id = 20")).collect()
    large = spark.createDataFrame([(0, [2.0**40]), (20, [2.0**8])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(large, large.where("vec_id = 0")).collect()] == [(0, 1, 20, 2**60)]


def test_topk_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(k, rng.normal(0, 1, 4).tolist()) for k in range(60)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.search(frame, frame, 3).collect()))
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "JOB", 25)
    assert sorted(map(tuple, topk.search(frame, frame, 3).collect())) == whole


# URL filter


def test_urls(spark):
    urls = {
        "https://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://m.www.example.com/en/x": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://x.net/fr/1": ("x.net", "/fr/1", "net/fr/", "block"), "http://com": ("com", "", None, None), "http://com/": ("com", "/", "com/", "allow"),
        "http://x.net/de/": ("x.net", "/de/", None, None), None: ("", "", None, None), "no scheme": ("", "", None, None), "": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "x://h?q/://": ("h", "", None, None), "http://É.com/É": ("É.com", "/É", "com/", "allow"),
    }
    frame = spark.createDataFrame([(k, u, "h", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, score double")
    for r, (host, path, rule, verdict) in zip(sorted(url_filter.url_filter(frame).collect()), urls.values()):
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.url_filter(frame.limit(0)).count() == 0


def test_url_weights_equal_brute_force(spark):
    def grams(text, field):
        codes = [ord(c) for c in "^" + text + "$"]
        out = set()
        for i in range(len(codes) - url_filter.GRAM + 1):
            h = field
            for c in codes[i : i + url_filter.GRAM]:
                h = (h * 257 + c) % 1_000_003
            out.add(h % url_filter.BUCKETS)
        return out

    import re

    x = np.zeros((len(url_filter.LABELLED), url_filter.BUCKETS + 1))
    y = np.array([float(label) for _, label in url_filter.LABELLED])
    for k, (u, _) in enumerate(url_filter.LABELLED):
        host, path = re.match(r"^.*?://([^/?#]*)([^?#]*)", u).groups()
        x[k, list(grams(host, 1) | grams(path, 2))] = 1
        x[k, -1] = 1
    w = np.zeros(url_filter.BUCKETS + 1)
    for _ in range(url_filter.STEPS):
        w = w * (1 - url_filter.DECAY) + x.T @ (y - 1 / (1 + np.exp(-x @ w))) * url_filter.RATE / len(y)
    assert url_filter.fit(spark) == pytest.approx(w.tolist(), abs=1e-9)
    pages = spark.createDataFrame([(1, "http://cheap-pills.example.org/order"), (2, "https://www.library.example.org/en/12.html")], "page_id long, url string")
    assert [r.verdict for r in url_filter.url_filter(pages).orderBy("page_id").collect()] == ["block", "allow"]


def test_url_classifier_on_rows_left_out(spark):
    """Fitted on four fifths of the labelled table, it decides the others; and a very long url is judged whole."""
    schema = "url string, label int"
    left = [r for k, r in enumerate(url_filter.LABELLED) if k % 5 == 0]
    fitted = spark.createDataFrame([r for k, r in enumerate(url_filter.LABELLED) if k % 5], schema)
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(left)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, fitted, ()).collect()}
    right = sum((got[k] == "block") == bool(label) for k, (_, label) in enumerate(left)) / len(left)
    assert len(left) == 26 and right >= 0.9
    long = spark.createDataFrame([(1, "http://spam-ads.test/" + "casino-" * 150_000), (2, "http://m.net/fr/" + "x" * 10**6)], "page_id long, url string")
    assert [(r.verdict, len(r.path)) for r in url_filter.url_filter(long).orderBy("page_id").collect()] == [("block", 1_050_001), ("block", 10**6 + 4)]


def test_url_fit_on_odd_tables(spark):
    schema = "url string, label int"
    assert set(url_filter.fit(spark, spark.createDataFrame([], schema))) == {0.0}
    assert len(url_filter.fit(spark, spark.createDataFrame([(None, 1), ("http://a.b/c", None), ("", 0)], schema))) == url_filter.BUCKETS + 1


# Licence scan


def test_license_scan(spark):
    texts = [
        "Released under CC-BY.\nAll  Rights\tReserved", "Licensed under the Apache License, Version 2.0.", "This work is under the GNU General Public License, version 3", None, "", "...", "cc by cc by", "Über alles: CC BY ÜBER",
        "accc by", "the mit license is under review", "Released under the MIT license", "İ K all rights reserved",
    ]
    got = sorted(license_scan.license_scan(docs(spark, texts)).collect())
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[:3]] == [(7, 2, 2, 4, "cc-by,reserved"), (8, 0, None, None, ""), (11, 1, 6, 6, "gpl")]
    assert got[1].labels == "apache-2.0" and got[1].score == 1.0 and "gpl" in got[2].labels
    assert [got[k].n_words for k in (3, 4, 5)] == [0, 0, 0] and got[6].n_base == 2 and got[6].last_word == 2
    assert got[8].n_base == 0 and got[10].labels == "mit" and got[11].base_labels == "reserved"
    assert license_scan.license_scan(docs(spark, [])).count() == 0
    wrapped = license_scan.license_scan(docs(spark, ["Some text.\nLicensed under the Apache\nLicense, Version 2.0\nmore", "permission is hereby granted, free\nof charge, to any person\nobtaining a copy", "this source code\n\nform is subject\n\nto the terms of the mozilla public license", "x " * 400_000 + "\nreleased under the\nMIT license"])).orderBy("doc_id").collect()
    assert [r.labels for r in wrapped] == ["apache-2.0", "mit", "mpl-2.0", "mit"]
    bsd = "redistribution and use in source and binary forms with or without modification are permitted"
    for size in (1, 2, 4):
        words = bsd.split()
        lines = ["x"] + [" ".join(words[k : k + size]) for k in range(0, len(words), size)] + ["", "y"]
        assert license_scan.license_scan(docs(spark, ["\n".join(lines)])).first().labels == "bsd"
    # What stands more than the longest template's words behind a line isn't in its block.
    far = bsd.split()
    assert license_scan.license_scan(docs(spark, [" ".join(far[:6]) + "\n" + "z\n" * 30 + " ".join(far[6:])])).first().labels == ""
    long = license_scan.license_scan(docs(spark, ["some short line\n" * 100_000 + "released under\nthe MIT\nlicense"])).first()
    assert (long.labels, long.n_words) == ("mit", 300_005)
    twice = license_scan.license_scan(docs(spark, [(1, texts[1]), (1, texts[1]), (None, texts[1])])).collect()
    assert [r.labels for r in twice] == ["apache-2.0"] * 3


@pytest.mark.parametrize("sign", ["\u0085", "\u2028", "\u2029", "\u000b", "\r"])
def test_license_scan_counts_words_over_line_separators(spark, sign):
    """Signs that end a line for some expressions, inside and between words."""
    texts = [f"a{sign}b c cc by d", f"x {sign} all rights reserved{sign} all rights reserved cc by\n{sign}e", f"cc{sign}by cc by{sign}"]
    for text, r in zip(texts, license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [k for p, _ in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))


def test_license_scan_equals_sql_where_licences_are(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_license_scan(spark, d).toPandas()
    assert (got.labels != "").sum() > 20 and rows(got) == rows(duck(queries.ORACLES["op6_license_scan"], d))


# Toxicity


def test_folding_and_matching():
    machine = toxicity.automaton({toxicity.fold("idiot"): 5.0, " stup": 4.0}, ("not stupid",))
    score = lambda t: toxicity.score_text(t, machine)
    for t in ("idiot", "1D10T!", "id!ot", "idiot$$$", "ІDІОТ", "ｉｄｉｏｔ", "ídìöt", "you, idi\u200bot."):
        assert score(t)[1] == 1, t
    assert score("idiots")[1] == 0 and score("stupidity")[1] == 1 and score("not stupid")[1] == 0 and score("stupid, not stupid")[1] == 1
    assert score(None) == (0.0, 0) and score("") == (0.0, 0)
    assert score("idiot")[0] > score("idiot" + " word" * 600)[0] > score("idiot" + " word" * 5000)[0] >= 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    right = (got.predicted == got.toxic).mean()
    assert right > 0.96
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.8


def test_everyday_words_are_not_toxic(spark):
    d = "/root/testdata/sf0.1"
    tables = [spark.read.parquet(f"{d}/{name}.parquet") for name in ("documents", "labels")]
    lexicon = toxicity.learn(*tables)
    everyday = ["The path to the lake is long.", "It is worth a visit.", "An idiom of the region.", "Sympathetic staff, worthwhile trip.", "A stupendous view and a pathway.", "Take out the trash."]
    assert all(r.score < 0.7 for r in toxicity.score(docs(spark, everyday), lexicon).collect())
    assert all(r.score < 0.5 for r in toxicity.score(docs(spark, everyday[:5]), lexicon).collect())
    got = toxicity.score(tables[0], lexicon).where("held_out").join(tables[1], "doc_id").toPandas()
    order, toxic = got.score.rank(), got.toxic == 1
    auc = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.96


def _labelled(spark, n=30):
    """Documents with one of two insults among changing words, clean ones with a harmless phrase, and copies of a toxic passage."""
    rng = random.Random(6)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    texts = [" ".join([*prose(9), "dolt" if k % 2 else ("nitwit", "nitwits", "nitwitted")[k % 3], *prose(9), "oaf" if k % 4 else "oafish", *prose(5)]) for k in range(2 * n)]
    texts += [" ".join([*prose(12), "seldom copied words of a passage", "dolt", *prose(3)]) for _ in range(n)]
    texts += [" ".join([*prose(20), "oaf tree" if k % 40 == 0 else "plum tree", *prose(3)]) for k in range(8 * n)]
    ids = [k for k in range(10**5) if zlib.crc32(str(k).encode()) % 3 != 1][: len(texts)]
    labels = spark.createDataFrame([(i, 0, int(k < 3 * n)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    return docs(spark, list(zip(ids, texts))), labels, texts


def test_toxicity_learner_against_brute_force(spark):
    frame, labels, texts = _labelled(spark)
    toxic, clean = [toxicity.fold(t) for t in texts[:90]], [toxicity.fold(t) for t in texts[90:]]
    want = {}
    for t in {t for x in texts[:90] for t in toxicity.terms_of(x)}:
        a, b = sum(t in x for x in toxic), sum(t in x for x in clean)
        weight = np.log((a + 0.5) / 91) - np.log((b + 0.5) / 241)
        before, after, begin = set(), set(), set()
        for x in toxic:
            w = ["", *x.split(), ""]
            here = [k for k in range(1, len(w) - 1) if f" {w[k]} ".startswith(t) and f" {w[k]}" != t]
            before |= {w[k - 1] for k in here}
            after |= {w[k + 1] for k in here}
            begin |= {w[k] for k in here}
        several = t.endswith(" ") or len(begin) >= toxicity.SEVERAL
        if a >= toxicity.LEAST and weight >= toxicity.ODDS and min(len(before), len(after)) >= toxicity.LEAST and several:
            want[t] = min(weight, toxicity.MOST)
    got = toxicity.learn(frame, labels)
    found = {t: w for t, w in got.items() if w is not None}
    assert found.keys() == want.keys() and found == pytest.approx(want)
    assert {" doit ", " nitwit ", " nitw"} <= want.keys() and " oafi" not in want and not any("copied" in t or "seidom" in t or "passage" in t for t in want)
    exceptions = {t for t, w in got.items() if w is None}
    assert " oaf tree " in exceptions and " oaf " not in exceptions
    assert all(sum(t in x for x in clean) >= toxicity.HARMLESS and not any(t in x for x in toxic) for t in exceptions)


def test_toxicity_matcher_against_a_naive_scan():
    rng = random.Random(2)
    lexicon = {" do": 1.0, " dolt": 3.0, " dott ": 2.5, " a ": 0.5, " b dolt ": None, " a a ": None}
    lexicon = {t.replace("l", "i"): w for t, w in lexicon.items()}
    machine = toxicity.automaton(lexicon, ("dott b",))
    for _ in range(300):
        text = " ".join(rng.choice(["do", "dolt", "dolts", "dott", "a", "b", "Do1t", "x"]) for _ in range(rng.randint(0, 12)))
        folded = toxicity.fold(text)
        every = [(k, t, w) for t, w in [*lexicon.items(), (" dott b ", None)] for k in range(len(folded)) if folded.startswith(t, k)]
        free = [(k, k + len(t) - 1) for k, t, w in every if w is None]
        best = {}
        for k, _, w in every:
            if w is not None and not any(a <= k < b for a, b in free):
                best[k] = max(best.get(k, 0), w)
        x = max(0.0, sum(best.values()) - toxicity.CHANCE)
        assert toxicity.score_text(text, machine) == (pytest.approx(x / (1 + x)), len(best)), text


def test_toxicity_odd_rows(spark):
    frame, labels, _ = _labelled(spark)
    lexicon = toxicity.learn(frame, labels)
    odd = docs(spark, [(1, "pure dolt, nitwit"), (None, "a nitwit and a d0lt"), (2, None), (2, ""), (3, "a fine day"), (4, "dolt nitwit " + "word " * 2_000_000)])
    got = toxicity.score(odd, lexicon).collect()
    assert {(r.doc_id, r.predicted) for r in got} == {(1, 1), (None, 1), (2, 0), (3, 0), (4, 0)} and len(got) == 6
    assert toxicity.keep_clean(odd, lexicon).columns == odd.columns and toxicity.keep_clean(odd, lexicon).count() == 4
    for rows_ in ([], [(1, None, 1), (None, 1, 1), (3, 1, None)], [(1, 0, 0)]):
        none = toxicity.learn(frame, spark.createDataFrame(rows_, "doc_id long, quality int, toxic int"))
        assert none == {} and {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), lexicon).count() == 0
