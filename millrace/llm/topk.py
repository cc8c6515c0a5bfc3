"""Exact top-k search by a three-phase uniform threshold.

A score is the sum of partial scores, one for each of ``LISTS`` groups of dimensions. Queries are taken
``JOB`` at a time, and each meets all candidates, in blocks of ``BLOCK`` queries and ``ROWS`` candidates:

1. every candidate task takes, per query and list, its local best partial scores, resolves those
   candidates' whole scores and sends the k best; the k-th of all of them is a safe cutoff, as k
   candidates reach it;
2. the cutoffs (one number a query) go to all tasks. A candidate that reaches the cutoff t has a partial
   score of at least t / LISTS in some list: these entries are sufficient, and only they are collected;
3. their remaining partial scores are resolved exactly, and those that reach the cutoff compete; each
   task sends k a query at most, and the k best of all are ranked.

A list's partial scores are computed for all candidates, being what the list is; a whole score only for entries that a
list names. Each job's answers are written to the shared folder, so a lost executor costs tasks of one job at most.

A component x counts as floor(64 * x), x as double, and scores are integers; equal scores go to the
smaller vec_id. A score, or a component, that doesn't fit in 64 bits can't be told and raises an error. Vectors that are null or hold null or non-finite components take no part, nor do rows
without vec_id. Where lengths differ, missing components count as 0. A query's own row is every row of its
vec_id. Repeated rows of one vec_id are candidates each; as queries, they answer once, with the greatest
vector. Fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import shared_path, tuned

K, LISTS, BLOCK, JOB, ROWS = 20, 2, 2048, 16384, 2048
NONE = np.iinfo(np.int64).min
SCHEMA = "query_id long, rank int, vec_id long, score long"


def vectors(df: DataFrame) -> DataFrame:
    """vec_id and the integer components of the vectors that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(x.cast("double") * F.lit(64.0))
    # In doubles, for a cast would cut a larger one to the largest long.
    fits = lambda x: F.abs(x.cast("double") * F.lit(64.0)) < F.lit(2.0**62)
    ints = F.transform("embedding", lambda x: F.when(fits(x), scaled(x).cast("long")).otherwise(F.raise_error(F.lit("scores of over 64 bits")).cast("long")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select("vec_id", ints.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the list column, cut or filled with zeros to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, at = np.zeros((len(sizes), width), dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)])
    for k, n in enumerate(sizes):
        out[k, : min(n, width)] = flat[at[k] : at[k] + min(n, width)]
    return out


def _products(queries: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floating point where that is exact."""
    most = float(queries.shape[1]) * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if most >= 2.0**62 and np.where(own, 0.0, np.abs(queries.astype(float)) @ np.abs(rows.astype(float)).T).max(initial=0) >= 2.0**62:
        raise OverflowError("scores of over 64 bits")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)


def _lists(width: int) -> list[slice]:
    edges = np.linspace(0, width, min(LISTS, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _partials(ids: np.ndarray, queries: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Of each block of queries and candidates: the queries' places, candidate ids, partial scores of each list and a mask of each query's own row."""
    lists = _lists(queries.shape[1])
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        rows, found = _matrix(part.column("v"), queries.shape[1]), part.column("vec_id").to_numpy()
        for first in range(0, len(ids), BLOCK):
            block = slice(first, first + BLOCK)
            own = ids[block, None] == found[None, :]
            yield block, found, [_products(queries[block, s], rows[:, s], own) for s in lists], own


def _first_phase(ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), NONE)
        for batch in batches:
            for block, found, parts, own in _partials(ids, queries, batch):
                n = len(found)
                tops = []
                for p in parts:
                    p = np.where(own, NONE, p)
                    tops.append(np.argpartition(p, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(p), 1)))
                # The lists' entries, each candidate once a query.
                top = np.sort(np.concatenate(tops, axis=1), axis=1)
                again = np.concatenate([np.zeros((len(top), 1), dtype=bool), top[:, 1:] == top[:, :-1]], axis=1)
                whole = sum(np.take_along_axis(p, top, axis=1) for p in parts)
                scores = np.where(again | np.take_along_axis(own, top, axis=1), NONE, whole)
                both = np.concatenate([best[block], scores], axis=1)
                best[block] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        q, at = np.nonzero(best > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, at])], ["q", "score"])

    return run


def _last_phases(ids: np.ndarray, queries: np.ndarray, cutoffs: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = cutoffs.copy()
        kept = [np.zeros(0, dtype=np.int64)] * 3
        n_lists = len(_lists(queries.shape[1]))
        for batch in batches:
            for block, found, parts, own in _partials(ids, queries, batch):
                here = bar[block]
                uniform = np.where(here == NONE, NONE, -((-here) // n_lists))[:, None]
                enough = ~own & np.logical_or.reduce([p >= uniform for p in parts])
                q, at = np.nonzero(enough)
                score = sum(p[q, at] for p in parts)
                good = score >= here[q]
                q, at, score = q[good] + block.start, at[good], score[good]
                q, vec, score = (np.concatenate(x) for x in zip(kept, (q, found[at], score)))
                order = np.lexsort((vec, -score, q))
                q, vec, score = q[order], vec[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                # This task's own k-th score is a cutoff too.
                full = place == k - 1
                bar[q[full]] = np.maximum(bar[q[full]], score[full])
                kept = [x[place < k] for x in (q, vec, score)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query. Both inputs have vec_id and embedding."""
    spark = tuned(candidates.sparkSession)
    rows = vectors(candidates)
    asked = vectors(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    path, block = shared_path(spark, "topk"), []

    def answered(block: list) -> DataFrame:
        ids = np.array([r.vec_id for r in block], dtype=np.int64)
        width = max(len(r.v) for r in block)
        matrix = np.zeros((len(block), max(width, 1)), dtype=np.int64)
        for n, r in enumerate(block):
            matrix[n, : len(r.v)] = r.v
        first = rows.mapInArrow(_first_phase(ids, matrix, k), "q int, score long")
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        cutoffs = np.full(len(ids), NONE)
        for r in first.withColumn("n", nth).where(F.col("n") == k).collect():
            cutoffs[r.q] = r.score
        found = rows.mapInArrow(_last_phases(ids, matrix, cutoffs, k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    for r in asked.toLocalIterator(prefetchPartitions=False):
        block.append(r)
        if len(block) == JOB:
            answered(block).write.mode("append").parquet(path)
            block = []
    rest = answered(block) if block else spark.createDataFrame([], SCHEMA)
    rest.write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def oracle(k: int = K) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""
