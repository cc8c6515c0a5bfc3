"""URL filter: host and path rules first, then logistic regression on hashed character n-grams; built-in functions only.

The classifier is fitted by gradient descent inside one expression, from a small labelled table
(``LABELLED``, made by a rule, or any DataFrame of url and label with up to ``MAX_LABELLED`` rows). Its weights, one
for each of ``BUCKETS``, are then a literal of the scoring plan, which is a scan and a projection.

Null urls and those without ``://`` have an empty host and path and are judged by the classifier's
intercept. Urls of any length are judged whole. Repeated rows are judged alike. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BUCKETS, GRAM, STEPS, RATE, DECAY, MAX_LABELLED = 1021, 4, 80, 0.5, 0.002, 500
JUNK = "spam ads track click casino poker betting pills pharma loan prize free cheap adult xxx crypto replica diet farm banner popup win".split()
FINE = "news library museum garden weather school city music history science travel books river theatre hospital forum docs blog university recipes chess astronomy".split()


def _labelled(number: int = 64) -> tuple[tuple[str, int], ...]:
    """The small labelled table, made by a rule: hosts and paths of two words of one list each; 1 blocks."""
    shapes = ("http://{}-{}.test/{}/{}", "https://www.{}{}.test/{}?id={}", "https://{}.{}.test/{}-{}.html", "http://m.{}-{}.test/en/{}/{}", "https://{}{}.test/{}{}#top")
    url = lambda words, k: shapes[k % len(shapes)].format(words[k % len(words)], words[(5 * k + 3) % len(words)], words[(3 * k + 1) % len(words)], 7 * k)
    return tuple((url(words, k), label) for words, label in ((JUNK, 1), (FINE, 0)) for k in range(number))


LABELLED = _labelled()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def grams(text: Column, field: int) -> Column:
    """The buckets of the text's n-grams, with a mark at either end; equal strings fall apart by field."""
    codes = F.transform(F.split(F.concat(F.lit("^"), F.translate(text, UPPER, LOWER), F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    codes = F.filter(codes, lambda c: c > 0)

    def buckets(codes: Column) -> Column:
        def bucket(i: Column) -> Column:
            h = F.lit(field).cast("long")
            for k in range(GRAM):
                h = (h * F.lit(257) + F.element_at(codes, (i + k).cast("int"))) % F.lit(1_000_003)
            return (h % F.lit(BUCKETS)).cast("int")

        return F.when(F.size(codes) >= GRAM, F.transform(F.sequence(F.lit(1), F.size(codes) - GRAM + 1), bucket)).otherwise(F.array().cast("array<int>"))

    # The codes are bound by a lambda, for an expression would be computed again for each n-gram.
    return F.element_at(F.transform(F.array(codes), buckets), 1)


def features(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(grams(host, 1), grams(path, 2)))


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> list[float]:
    """BUCKETS weights and, last, the intercept. The labelled table is one row of a bounded number of examples."""
    if labelled is None:
        labelled = spark.createDataFrame(list(LABELLED), "url string, label int")
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
    rows = rows.select("url", "label", features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("url", "label", "f"))).alias("rows"))
    # For each bucket and, last, the intercept: the examples that have it.
    has = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), lambda b: F.filter(F.sequence(F.lit(1), F.size("rows")), lambda r: (b == BUCKETS) | F.array_contains(F.element_at("rows", r)["f"], b)))
    has = F.when(F.size("rows") > 0, has).otherwise(F.array().cast("array<array<int>>"))

    def descent(has: Column) -> Column:
        def step(w: Column, _: Column) -> Column:
            z = lambda r: F.aggregate(r["f"], F.element_at(w, BUCKETS + 1), lambda acc, b: acc + F.element_at(w, b + 1))
            wrong = F.transform("rows", lambda r: r["label"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-z(r))))
            moved = F.transform(F.array(wrong), lambda e: F.zip_with(w, has, lambda x, at: x * F.lit(1 - DECAY) + F.aggregate(at, F.lit(0.0), lambda acc, r: acc + F.element_at(e, r)) * F.lit(RATE) / F.size("rows")))
            return F.element_at(moved, 1)

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step)

    zero = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    # The lists are bound by a lambda, or each step would make them anew.
    trained = F.when(F.size("rows") > 0, F.element_at(F.transform(F.array(has), descent), 1)).otherwise(zero)
    return list(one.select(trained.alias("w")).first().w)


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and score, the classifier's probability of a block."""
    weights = fit(pages.sparkSession, labelled)
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = None
    for host, path, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, F.lit(host + path)) if rule is None else rule.when(fits, F.lit(host + path))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate(features(F.col("host"), F.col("path")), F.lit(float(weights[-1])), lambda acc, b: acc + F.element_at(w, b + 1))
    df = df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    no_rule = F.lit(None).cast("string")
    by_model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", (no_rule if rule is None else rule).alias("rule"), F.coalesce(no_rule if verdict is None else verdict, by_model).alias("verdict"), "score")


def oracle() -> str:
    """The same with the fit as a recursive query."""
    part = "coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', {1}), '')"
    low = f"translate({{0}}, '{UPPER}', '{LOWER}')"
    host, path = low.format(part.format("url", 1)), part.format("url", 2)
    codes = f"list_transform(string_split('^' || {low.format('{0}')} || '$', ''), lambda c: unicode(c)::BIGINT)"
    step = "{1}"
    for k in range(GRAM):
        step = f"(({step} * 257 + c[i + {k}]) % 1000003)"
    grams = f"(SELECT list_transform(range(1, len(c) - {GRAM - 2}), lambda i: ({step}) % {BUCKETS}) FROM (SELECT {codes} AS c))"
    features = f"list_distinct({grams.format('host', 1)} || {grams.format('path', 2)})"
    labelled = ", ".join(f"('{u}', {y}::DOUBLE)" for u, y in LABELLED)
    z = f"(w[{BUCKETS + 1}] + coalesce(list_sum(list_transform({{0}}, lambda b: w[b + 1])), 0))"
    names = [f"'{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda values: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {v}" for (h, p, _), v in zip(rules, values)) + " END"
    return f"""
WITH RECURSIVE l(url, y) AS (VALUES {labelled}),
x AS (SELECT y, {features} AS f FROM (SELECT y, {host} AS host, {path} AS path FROM l)),
t AS (SELECT list(y ORDER BY n) AS y, list(f ORDER BY n) AS f, count(*) AS n FROM (SELECT *, row_number() OVER () AS n FROM x)),
h AS (SELECT y, f, n, list_transform(range(0, {BUCKETS + 1}), lambda b: list_filter(range(1, n + 1), lambda r: b = {BUCKETS} OR list_contains(f[r], b))) AS has FROM t),
g(k, w) AS (SELECT 0, list_transform(range(0, {BUCKETS + 1}), lambda b: 0.0::DOUBLE) UNION ALL
  SELECT k + 1, list_transform(range(0, {BUCKETS + 1}), lambda b: w[b + 1] * {1 - DECAY}::DOUBLE + coalesce(list_sum(list_transform(has[b + 1], lambda r: e[r])), 0) * {RATE}::DOUBLE / n)
  FROM (SELECT k, w, has, n, list_transform(range(1, n + 1), lambda r: y[r] - 1 / (1 + exp(-{z.format('f[r]')}))) AS e FROM g, h WHERE k < {STEPS})),
p AS (SELECT page_id, host, path, {features} AS f FROM (SELECT page_id, {host} AS host, {path} AS path FROM pages)),
s AS (SELECT page_id, host, path, 1 / (1 + exp(-{z.format('f')})) AS score FROM p, (SELECT w FROM g WHERE k = {STEPS}))
SELECT page_id, host, path, {case(names)} AS rule, coalesce({case([f"'{r[2]}'" for r in rules])}, CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  floor(score * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM s"""
