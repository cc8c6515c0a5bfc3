"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_pairs, csr_resample, decontam, jaccard_join, license_scan, line_dedup, merkle, pieces, resample, suffix_dedup, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 20 = 0"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.url_filter(_table(spark, sf_dir, "pages"))
    return judged.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.lowered_text(), merkle.chosen())


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_pairs.decode(byte_pairs.encode(_table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_csr_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csr_resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OPERATORS = (
    op1_resample, op2_line_dedup, op3_topk, op4_url_filter, op5_decontam, op6_license_scan, op7_toxicity, op8_jaccard_join, op9_pieces, op10_suffix_dedup,
    op11_merkle, op12_byte_pairs, op13_csr_resample,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES = {
    "op2_line_dedup": line_dedup.oracle(), "op3_topk": topk.oracle(), "op4_url_filter": url_filter.oracle(), "op6_license_scan": license_scan.oracle(), "op8_jaccard_join": jaccard_join.oracle(),
    "op10_suffix_dedup": suffix_dedup.oracle(), "op11_merkle": merkle.oracle(),
}
