"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, takes accents off, maps homoglyphs (Cyrillic, Greek, full-width and the like)
and digit or sign substitutions to letters, and joins l with i, for 1 stands for either. Words are
then separated by single spaces, so a pattern " stem" finds a word's beginning and " word " a word.

Lexicon and exceptions are learned from labelled rows; no word is given. Words and word beginnings that ``LEAST``
toxic documents have get the log-odds of toxic over other documents, and those of ``ODDS`` and more are in the lexicon if they
stand after ``LEAST`` different words, and before as many, in toxic documents: words that copied text brings in have few neighbours. A
word beginning needs evidence of its own: ``SEVERAL`` different words of toxic documents begin with it, else only the whole words count. No pattern weighs more than
``MOST``, so one hit alone stays below the threshold. A phrase (a
matched word, with or without a neighbour) that ``HARMLESS`` clean documents and no toxic one have is an exception: the automaton
matches exceptions too, and terms inside are not counted. The hits' weights are divided by the length (a document
of up to ``FREE_WORDS`` words counts as that long); what is over ``CHANCE``, x, gives score = x / (1 + x).

The fit takes a bounded sample: at most ``MAX_TRAIN`` labelled rows, the first by a hash of doc_id. All their terms and
phrases that pass are kept, so the sample bounds them too. Only these and their counts reach the driver, no text does.
Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Labels that are null teach nothing; null and
empty texts score 0. Without toxic labels the lexicon is empty and all score 0. Identical rows get identical scores. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, staged, trimmed, tuned

MAX_TRAIN = 12_000
FREE_WORDS = 400
THRESHOLD = 0.7
CHANCE = 2.0
STEM = (4, 8)
LEAST, ODDS, HARMLESS, SEVERAL = 6, 2.5, 3, 3
MOST = 4.3
# Letters that look alike, and what digits and signs stand for.
HOMOGLYPHS = {
    **dict(zip("абвгдеёзикмнорстухіјѕԁԛԝһ", "abbrdeesukmhopctyxijsdqwh")), **dict(zip("αβγδεζηικνορτυχω", "abydezniknoptuxw")),
    **dict(zip("ıłøđħŧþðßæœ", ["i", "l", "o", "d", "h", "t", "p", "d", "ss", "ae", "oe"])),
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
}


def _table() -> dict[int, str]:
    """One folded string for each character: by decomposition where Unicode has one, else by HOMOGLYPHS."""
    table: dict[int, str] = {}
    for code in (*range(0x80, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        table[code] = "".join(HOMOGLYPHS.get(c, c) for c in plain)
    table |= {code: "" for code in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)}
    table |= {ord(c): x for c, x in HOMOGLYPHS.items()}
    table |= {c: "i" if chr(c) == "l" else chr(c) for c in range(97, 123)}
    return {c: x.replace("l", "i") for c, x in table.items()}


TABLE = _table()
# Without accents and homoglyphs a text needs only the ASCII part, which is much faster.
ASCII_TABLE = str.maketrans({c: x for c, x in TABLE.items() if c < 128})
# Signs stand for letters only within a word.
SIGNS = {"@": "a", "$": "s", "€": "e", "£": "i", "!": "i", "|": "i"}
SIGNS_WITHIN = re.compile(r"(?<=\w)[@$€£!|](?=\w)")
GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at either end."""
    lowered = (text or "").lower()
    if any(c in lowered for c in SIGNS):
        lowered = SIGNS_WITHIN.sub(lambda m: SIGNS[m[0]], lowered)
    return " " + GAPS.sub(" ", lowered.translate(ASCII_TABLE if lowered.isascii() else TABLE)).strip() + " "


def terms_of(text: str | None) -> set[str]:
    """The distinct words and word beginnings, as patterns."""
    out = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1))
    return out


def held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def _hits(words: list[str], known) -> Iterator[tuple[int, list[str]]]:
    """Places of words and, of each, its patterns among the known ones."""
    for k, word in enumerate(words):
        found = [t for t in (f" {word} ", *(f" {word[:n]}" for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1))) if t in known]
        if found:
            yield k, found


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, least: int = LEAST, odds: float = ODDS, harmless: int = HARMLESS) -> dict[str, float | None]:
    """Patterns with weights, and exceptions with None, from the labelled rows that are not held out."""
    spark = tuned(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    # The sample is bounded by max_train, and so is the table that is broadcast.
    picked = [(r.doc_id, r.toxic) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect()]
    n_toxic = sum(t for _, t in picked)
    n_clean = len(picked) - n_toxic
    if not n_toxic:
        return {}
    sample = spark.createDataFrame(picked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic").where("text <> ''"), "labelled")

    def counted(of) -> DataFrame:
        """term, clean, toxic: the documents that have each term."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, list[int]] = {}
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                    for term in of(text):
                        sums.setdefault(term, [0, 0])[toxic] += 1
            items = list(sums.items())
            for k in range(0, len(items), 20_000):
                part = items[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), pa.array([c[0] for _, c in part], pa.int64()), pa.array([c[1] for _, c in part], pa.int64())], ["term", "clean", "toxic"])

        return rows.mapInArrow(trimmed(count), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = counted(terms_of).where(F.col("toxic") >= least).withColumn("weight", weight).where(F.col("weight") >= odds)
    weights = {r.term: min(r.weight, MOST) for r in strong.collect()}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for text in batch.column("text").to_pylist():
                words = ["", *fold(text).split(), ""]
                pairs.update((t, words[k - 1], words[k + 1], words[k]) for k, found in _hits(words, weights) for t in found)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*pairs) if pairs else ((), (), (), ()))], ["term", "before", "after", "word"])

    between = rows.where("toxic = 1").select("text").mapInArrow(trimmed(neighbours), "term string, before string, after string, word string")
    wide = between.groupBy("term").agg(F.least(F.countDistinct("before"), F.countDistinct("after")).alias("n"), F.countDistinct("word").alias("words")).where(F.col("n") >= least)
    wide = wide.where(F.col("term").endswith(" ") | (F.col("words") >= SEVERAL))
    lexicon = {r.term: weights[r.term] for r in wide.collect()}

    def phrases(text: str | None) -> set[str]:
        words, out = fold(text).split(), set()
        for k, _ in _hits(words, lexicon):
            out.update(f" {' '.join(words[a:b])} " for a, b in ((k, k + 1), (k - 1, k + 1), (k, k + 2)) if a >= 0 and b <= len(words))
        return out

    clean = counted(phrases).where((F.col("toxic") == 0) & (F.col("clean") >= harmless)).collect()
    drop_staged(rows)
    return lexicon | {r.term: None for r in clean}


def automaton(lexicon: dict[str, float | None], exceptions=()) -> ahocorasick.Automaton:
    """Patterns with weights, or None for exceptions; further exceptions as phrases."""
    machine = ahocorasick.Automaton()
    machine.add_word("\0", (1, None))  # folded texts don't have it; an automaton of no words can't be used
    for pattern, weight in lexicon.items():
        machine.add_word(pattern, (len(pattern), weight))
    for phrase in exceptions:
        machine.add_word(fold(phrase), (len(fold(phrase)), None))
    machine.make_automaton()
    return machine


def score_text(text: str | None, machine: ahocorasick.Automaton) -> tuple[float, int]:
    """Score and number of hits. A word counts once, by the heaviest pattern that begins where it does."""
    folded = fold(text)
    hits: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(folded):
        start = end - size + 1
        if weight is None:
            free.append((start, end))
        else:
            hits[start] = max(hits.get(start, 0.0), weight)
    if free:
        hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in free)}
    x = max(0.0, sum(hits.values()) * FREE_WORDS / max(FREE_WORDS, folded.count(" ") - 1) - CHANCE)
    return x / (1 + x) if math.isfinite(x) else 1.0, len(hits)


def score(docs: DataFrame, lexicon: dict[str, float | None], exceptions=()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in batches:
            found = [score_text(t, machine) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())], ["doc_id", "score", "n_hits"])

    tuned(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, score double, n_hits int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")


def keep_clean(docs: DataFrame, lexicon: dict[str, float | None], exceptions=()) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in batches:
            keep = [score_text(t, machine)[0] < THRESHOLD for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    tuned(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)
