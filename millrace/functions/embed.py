"""A hashing n-gram embedder, cosine similarity, and an optional model encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 512
SIZES = (2, 3, 4)


def ngram_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed counts of hashed character n-grams of the padded lower-cased text, scaled to length 1 (zeros for no n-grams).

    Buckets come from xxhash64, so vectors are the same in every process.
    """
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))

    def of_size(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, some).otherwise(F.array().cast("array<string>"))

    grams = [of_size(n) for n in SIZES]
    hashes = F.transform(F.concat(*grams), lambda g: F.xxhash64(g))
    places = F.transform(hashes, lambda h: F.struct(F.pmod(h, F.lit(dimensions)).cast("int").alias("at"), F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    # Each step is bound to a variable once: an expression within a lambda is worked out for every element.
    raw = _bound(places, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(all_, F.lit(0.0), lambda acc, p: acc + F.when(p["at"] == d, p["sign"]).otherwise(0.0))))
    with_norm = _bound(raw, lambda v: F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm")))
    return _bound(with_norm, lambda x: F.transform(x["v"], lambda y: F.when(x["norm"] > 0, y / x["norm"]).otherwise(y)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has length 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def model_encoder(name: str = "all-MiniLM-L6-v2"):
    """A pandas UDF that encodes texts with sentence-transformers, one model a worker; an ImportError where that package is absent."""
    import sentence_transformers

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sentence_transformers.SentenceTransformer(name)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist(), normalize_embeddings=True)))

    return encode
