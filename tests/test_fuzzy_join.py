"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import fuzzy
from millrace.operators import fuzzy_join, matching


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


def _texts(rng, n, letters, longest):
    out = ["", "a", "aa", "é", "日本", "aaaaaaaaaa"]
    while len(out) < n:
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        out.append(text)
        for _ in range(2):
            near = list(text)
            for _ in range(rng.randint(1, 4)):
                near.insert(rng.randrange(len(near) + 1), rng.choice(letters))
                near.pop(rng.randrange(len(near)))
            out.append("".join(near))
    return [" ".join(sorted(t.split())) for t in out]


@pytest.mark.parametrize("letters, longest, threshold", [("ab ", 9, 0.72), ("abcdefgh ", 14, 0.72), ("etaoinshr  ", 40, 0.72), ("abc", 8, 0.68), ("abcde ", 12, 0.9)])
def test_no_pair_is_lost(spark, letters, longest, threshold):
    rng = random.Random(longest)
    left, right = _texts(rng, 60, letters, longest), _texts(rng, 80, letters, longest)
    right += left[10:20]
    frame = lambda x: spark.createDataFrame([(t,) for t in x] + [(None,)], "text string")
    want = {}
    for a in set(left):
        for b in set(right):
            ratio = 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
            if ratio >= threshold:
                want[a, b] = ratio
    found = fuzzy_join.similar(frame(left), frame(right), threshold).collect()
    assert len(found) == len(want) and {(r.a, r.b): r.score for r in found} == pytest.approx(want)


def test_few_pairs_are_compared(spark):
    d = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.substring_index(F.lower("text"), " ", 5).alias("text"))
    names = texts.select(fuzzy.sorted_tokens(F.substring("text", 1, 60)).alias("text")).where("text <> ''").distinct()
    asked = names.where(F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    n = asked.count()
    pairs, every = fuzzy_join.candidates(asked, names, matching.MIN_ACCEPT).count(), n * names.count()
    assert n <= pairs < 0.05 * every


def test_a_long_cart(spark):
    """A cart of 100,000 different lines, whose words come in any order and case."""
    products = spark.range(200).select(F.col("id").cast("string").alias("product_id"), F.concat_ws(" ", F.lit("product"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("product_name"), F.lit("").alias("search_terms"))
    name = F.substring(F.sha2((F.col("id") % 250).cast("string"), 256), 1, 12)
    cart = spark.range(100_000).select(F.concat(name, F.repeat(F.lit(" "), (F.col("id") / 250).cast("int") + 1), F.lit("Product")).alias("query"))
    best = matching.fuzzy_scores(cart, products).where("score = 1")
    assert best.count() == 80_000 and best.select("product_id").distinct().count() == 200


def test_thresholds_that_bounds_do_not_cover(spark):
    with pytest.raises(ValueError):
        fuzzy_join.candidates(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([("a",)], "text string"), 0.6)
