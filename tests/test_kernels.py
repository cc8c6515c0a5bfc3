import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import embed, events, fuzzy, geo, gtin, price, text


@pytest.mark.parametrize("quantity, value, unit", [("16 fl oz", 473.18, "ml"), ("6 x 330 ml", 330.0, "ml"), ("1,5 L", 5000.0, "ml"), ("12 lbs", None, None), ("2.5kg", 2500.0, "g"), ("", None, None), (None, None, None), ("500 mg", 0.5, "g")])
def test_quantity(spark, quantity, value, unit):
    q = F.lit(quantity).cast("string")
    r = spark.range(1).select(text.quantity_value(q).alias("v"), text.quantity_unit(q).alias("u")).first()
    assert (r.v, r.u) == (value, unit)


def test_search_terms_rule_out_plant_milk(spark):
    rows = [("Almond Milk", "Brand", "milk", ["almond"]), ("Whole milk 2", None, "milk", ["almond"]), ("a b", None, "milk", None)]
    df = spark.createDataFrame(rows, "n string, b string, t string, x array<string>")
    got = [r[0] for r in df.select(text.search_terms(F.col("n"), F.col("b"), F.col("t"), F.col("x"))).collect()]
    assert got == ["almond|brand", "milk|whole", "milk"]


def check_digit(digits: str) -> int:
    return (10 - sum(int(c) * (3 if k % 2 == 0 else 1) for k, c in enumerate(reversed(digits))) % 10) % 10


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**12 - 1), min_size=3, max_size=20))
def test_gtin_round_trip(spark, numbers):
    good = [f"{n:012d}{check_digit(f'{n:012d}')}" for n in numbers]
    bad = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in good]
    df = spark.createDataFrame([(c, True) for c in good] + [(c, False) for c in bad] + [("12", False), ("abc", False)], "code string, ok boolean")
    assert df.where(gtin.valid_gtin(F.col("code")) != F.col("ok")).count() == 0


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=12), st.text("abc ", max_size=12)), min_size=1, max_size=20))
def test_token_sort_ratio(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", fuzzy.token_sort_ratio(F.col("a"), F.col("b")).alias("x"), fuzzy.token_sort_ratio_arrow("a", "b").alias("y"), fuzzy.token_sort_ratio(F.col("b"), F.col("a")).alias("z")).collect()
    for r in got:
        p, q = (" ".join(sorted(t.split())) for t in (r.a, r.b))
        want = 2 * lcs(p, q) / (len(p) + len(q)) if p or q else 1.0
        assert r.x == pytest.approx(want) and r.y == pytest.approx(want) and r.z == pytest.approx(want) and 0 <= r.x <= 1


def test_geo_and_price(spark):
    r = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km"), price.base_price(F.lit(10.0), F.lit("x")).alias("p")).first()
    assert r.km == pytest.approx(6371.0 * math.pi / 2) and r.p == 8.5


def test_uniform_is_stable_and_even(spark):
    df = spark.range(10_000).select(price.uniform(3, F.col("id"), low=2.0, high=4.0).alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 2 <= low and high < 4 and abs(mean - 3) < 0.05


def test_embedding_has_unit_length_and_ranks_itself_first(spark):
    df = spark.createDataFrame([("oat milk",), ("milk oat",), ("chicken",), ("",)], "t string").withColumn("e", embed.ngram_embedding(F.col("t")))
    me = df.where("t = 'oat milk'").select(F.col("e").alias("q"))
    got = {r.t: r.c for r in df.crossJoin(me).select("t", embed.cosine(F.col("e"), F.col("q")).alias("c")).collect()}
    assert got["oat milk"] == pytest.approx(1.0) and got["oat milk"] > got["milk oat"] > got["chicken"]


def test_event_seconds(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(events.event_seconds(F.col("t"))).collect()] == [1704067200.0, 0.0, 0.0]
