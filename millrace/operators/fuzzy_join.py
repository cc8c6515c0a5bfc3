"""Similarity join for the token-sort ratio: pairs of texts whose ratio reaches a threshold, without meeting all pairs.

Both sides are brought to their distinct sorted-token forms, of m and n characters. From 2 * LCS >= t * (m + n) follow, for every pair that is wanted:

- length: the longer one has (2 - t) / t times the shorter one's characters at most;
- characters: at least L = ceil(t * (m + n) / 2) are common to both, as multisets, and at least L of one text stand in the other at most m - L places before or n - L behind;
- neighbours: of the d = m + n - 2 * L characters that stay alone each parts two common neighbours at most once. With a sign put at either end, L + 2 characters are
  matched, so L + 1 - d pairs of neighbours are common to both, as multisets: two at least for any m and n, for t > 2 / 3.

So texts are sets of neighbour pairs, each with its number among equal ones, in global order from rare to frequent. A pair of texts
with ``need`` common ones has the rarest of these among the size - need + 1 first of either side: an equi-join on that token
and the length finds it once, the other bounds rule it out or not, and only what is left is compared by LCS. A token that very many texts have is a
group of the join that AQE may split; it is the first common token of few pairs, being frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fuzzy

FIRST, LAST = "\x01", "\x02"


def least_common(total: Column, threshold: float) -> Column:
    """L: characters that two texts of so many together must have in common."""
    return F.ceil(F.lit(threshold) * total / 2 - F.lit(1e-9))


def _counted(texts: DataFrame, parts: Column) -> DataFrame:
    """text, token: each part with its number among the text's equal ones."""
    parted = texts.select("text", F.explode(parts).alias("part")).groupBy("text", "part").count()
    return parted.select("text", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("k"), "part").select("text", F.concat("part", F.col("k").cast("string")).alias("token"))


def _neighbours(text: Column) -> Column:
    padded = F.concat(F.lit(FIRST), text, F.lit(LAST))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(2)))


def _prepared(texts: DataFrame, order: DataFrame) -> DataFrame:
    """text, size, tokens (numbers in the global order, ascending), unknown (tokens that the other side hasn't: rarer than all) and chars (with their numbers) of each text."""
    tokens = _counted(texts, _neighbours(F.col("text"))).join(order, "token", "left")
    ranked = tokens.groupBy("text").agg(F.sort_array(F.collect_list("place")).alias("tokens"), F.count_if(F.col("place").isNull()).cast("int").alias("unknown"))
    letters = _counted(texts, F.filter(F.split("text", ""), lambda c: c != "")).groupBy("text").agg(F.collect_list("token").alias("chars"))
    return ranked.join(letters, "text", "left").select("text", F.length("text").alias("size"), "tokens", "unknown", F.coalesce("chars", F.array().cast("array<string>")).alias("chars"))


def _in_place(a: Column, b: Column, m: Column, n: Column, least: Column) -> Column:
    """Characters of a that stand in b at most m - least places before or n - least places behind."""
    def near(i: Column) -> Column:
        start = F.greatest(F.lit(1), i - (m - least))
        return F.instr(F.substring(b, start.cast("int"), (i + n - least - start + 1).cast("int")), F.substring(a, i, F.lit(1))) > 0

    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), near))


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of the two sides' texts (column ``text``, sorted tokens) that the bounds leave; every pair that reaches the threshold is one."""
    if threshold <= 2 / 3:
        raise ValueError("below a threshold of 2 / 3 pairs may have nothing in common that a join can find")
    left, right = left.select("text").where("text IS NOT NULL").distinct(), right.select("text").where("text IS NOT NULL").distinct()
    # Ascending numbers by frequency: parts of the sort are numbered one after another.
    order = _counted(right, _neighbours(F.col("text"))).groupBy("token").agg(F.count("*").alias("n")).orderBy("n", "token").select("token", F.monotonically_increasing_id().alias("place"))
    one, two = _prepared(left, order), _prepared(right, order)
    total = F.col("m") + F.col("n")
    need = (3 * least_common(total, threshold) + 1 - total).cast("int")
    # The left side is taken for each length that the right side has and that can meet its own.
    sizes = right.select(F.length("text").alias("n")).distinct()
    spread = one.select(F.col("text").alias("a"), F.col("size").alias("m"), F.col("tokens").alias("tokens_a"), "unknown", F.col("chars").alias("chars_a")).join(
        sizes, (2 * F.least("m", "n") >= least_common(total, threshold) * 2) & (F.col("n") <= F.ceil(F.col("m") * ((2 - threshold) / threshold) + 1e-9)) & (F.col("m") <= F.ceil(F.col("n") * ((2 - threshold) / threshold) + 1e-9))
    )
    asked = spread.withColumn("need", need).select("*", F.explode(F.slice("tokens_a", F.lit(1), F.greatest(F.size("tokens_a") - F.col("need") + 1, F.lit(0)))).alias("token"))
    held = two.select(F.col("text").alias("b"), F.col("size").alias("n"), F.col("tokens").alias("tokens_b"), F.col("chars").alias("chars_b"), F.posexplode("tokens").alias("place", "token"))
    within = F.col("place") < F.size("tokens_b") - F.col("need") + 1
    common = F.array_intersect("tokens_a", "tokens_b")
    near = asked.join(held, ["token", "n"]).where(within & (F.element_at(common, 1) == F.col("token")) & (F.size(common) >= F.col("need")))
    least = least_common(total, threshold)
    near = near.where(F.size(F.array_intersect("chars_a", "chars_b")) >= least)
    return near.where((F.col("m") == 0) | (_in_place(F.col("a"), F.col("b"), F.col("m"), F.col("n"), least) >= least)).select("a", "b")


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, score: the pairs of sorted-token texts whose ratio reaches the threshold."""
    scored = candidates(left, right, threshold).select("a", "b", fuzzy.token_sort_ratio_arrow("a", "b").alias("score"))
    return scored.where(F.col("score") >= threshold)
