"""Product matching: exact and fuzzy scores of queries against offers, with an optional embedding score.

Scores that reach MIN_ACCEPT are found by a similarity join of distinct texts (``fuzzy_join``), then joined back to the offers, so carts of any length do. Answers also give
the best score where none reaches it: queries that a store has no match for are compared with every distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fuzzy, text
from millrace.operators import fuzzy_join

# The thresholds of the matcher.
MIN_ACCEPT, SEMANTIC = 0.72, 0.55


def fuzzy_scores(queries: DataFrame, products: DataFrame, threshold: float | None = MIN_ACCEPT) -> DataFrame:
    """query, product_id, score: the best token-sort ratio of name and search terms, where it reaches the threshold (None: of all). A query that equals one has 1.

    queries: query. products: product_id, product_name, search_terms (pipe-joined).
    """
    # Equal texts, in lower case and trimmed, have equal sorted tokens, so their ratio is 1.
    form = lambda c: fuzzy.sorted_tokens(F.lower(c))
    texts = products.select("product_id", F.explode(F.array_append(text.split_terms(F.coalesce("search_terms", F.lit(""))), F.coalesce("product_name", F.lit("")))).alias("candidate"))
    texts = texts.select("product_id", form(F.col("candidate")).alias("text")).distinct()
    asked = queries.select("query", form(F.col("query")).alias("text")).distinct()
    if threshold is None:
        pairs = asked.select(F.col("text").alias("a")).distinct().join(texts.select(F.col("text").alias("b")).distinct())
        found = pairs.select("a", "b", fuzzy.token_sort_ratio_arrow("a", "b").alias("score"))
    else:
        found = fuzzy_join.similar(asked, texts, threshold)
    scored = found.join(asked, found.a == asked.text).select("query", "b", "score")
    return scored.join(texts, scored.b == texts.text).groupBy("query", "product_id").agg(F.max("score").alias("score"))


def accepted(fuzzy_score: Column, semantic_score: Column | None = None, has_model: bool = False) -> tuple[Column, Column]:
    """(score, method): the semantic score only with a model, from its threshold on and not below the fuzzy one; below MIN_ACCEPT no match."""
    use = F.lit(False) if semantic_score is None or not has_model else (semantic_score >= SEMANTIC) & (semantic_score >= fuzzy_score)
    best = fuzzy_score if semantic_score is None else F.when(use, semantic_score).otherwise(fuzzy_score)
    ok = best >= MIN_ACCEPT
    return F.when(ok, text.half_up(best, 3)), F.when(~ok, F.lit("none")).when(use, F.lit("semantic")).otherwise(F.lit("fuzzy"))


def _best(scores: DataFrame, stocked: DataFrame) -> DataFrame:
    """query, store_id, and offer: the best in stock (ties: lower price, then product_id) as a struct that begins with its score."""
    offer = F.struct("score", "product_id", "product_name", "price")
    first = F.min_by(offer, F.struct(-F.col("score"), F.col("price").isNull(), "price", "product_id")).alias("offer")
    return stocked.join(scores, "product_id").groupBy("query", "store_id").agg(first)


def match_at_stores(queries: DataFrame, offers: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """The best acceptable offer in stock of each query and store, with score and method; what no store has is absent (``answers`` adds it).

    semantic: query, product_id, score of a model's embeddings; without it the fuzzy score decides.
    """
    stocked = offers.where("in_stock").select("store_id", "product_id", "product_name", "search_terms", "price")
    best = _best(fuzzy_scores(queries, stocked.select("product_id", "product_name", "search_terms").distinct()), stocked)
    if semantic is None:
        chosen, method = best.select("query", "store_id", "offer"), F.lit("fuzzy")
        score, _ = accepted(F.col("offer.score"))
    else:
        other = _best(semantic.where(F.col("score") >= SEMANTIC), stocked).withColumnRenamed("offer", "other")
        both = best.join(other, ["query", "store_id"], "full")
        score, method = accepted(F.coalesce("offer.score", F.lit(0.0)), F.coalesce("other.score", F.lit(-1.0)), True)
        chosen = both.withColumns({"_score": score, "_method": method}).withColumn("offer", F.when(F.col("_method") == "semantic", F.col("other")).otherwise(F.col("offer")))
        score, method = F.col("_score"), F.col("_method")
    rows = chosen.select("query", "store_id", "offer.product_id", "offer.product_name", "offer.price", score.alias("score"), method.alias("method"))
    return rows.where("score IS NOT NULL").withColumn("available", F.lit(True))


def answers(matches: DataFrame, queries: DataFrame, offers: DataFrame) -> DataFrame:
    """A row for every query at every store, as the answer needs it: the match, or method none with the best fuzzy score there, for which no product is named."""
    stocked = offers.where("in_stock").select("store_id", "product_id", "product_name", "search_terms")
    every = queries.select("query").distinct().join(stocked.select("store_id").distinct())
    unmatched = every.join(matches, ["query", "store_id"], "left_anti").select("query").distinct()
    scores = fuzzy_scores(unmatched, stocked.select("product_id", "product_name", "search_terms").distinct(), None)
    best = stocked.select("store_id", "product_id").join(scores, "product_id").groupBy("query", "store_id").agg(text.half_up(F.max("score"), 3).alias("_best"))
    rows = every.join(matches, ["query", "store_id"], "left").join(best, ["query", "store_id"], "left")
    answered = {"available": F.col("score").isNotNull(), "score": F.coalesce("score", "_best"), "method": F.coalesce("method", F.lit("none"))}
    return rows.withColumns(answered).drop("_best")


def match_items(matches: DataFrame) -> DataFrame:
    """One row a query: the best match across stores, the number of stores that have one, and the price range."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "price", "store_id", "product_id", "product_name"))
    found = matches.where("available").groupBy("query").agg(best.alias("b"), F.count("*").alias("num_stores"), text.half_up(F.min("price")).alias("min_price"), text.half_up(F.max("price")).alias("max_price"))
    return found.select("query", F.col("b.product_name").alias("product_name"), F.col("b.store_id").alias("store_id"), (-F.col("b.s")).alias("score"), "num_stores", "min_price", "max_price")
