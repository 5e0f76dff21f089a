"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components become integer weights; a component's place is its term. The queries, a stated set, are cut into chunks of
bounded bytes, which are broadcast one at a time; candidates never move. A task takes its candidates in blocks: each term's
postings (candidates with a weight other than 0) are scattered, times the query's weight, into dense score arrays; a partition
selection keeps the k best of a block, the blocks' best are merged in the task, and the tasks' best, k rows a query each, by a
shuffle. Nothing is skipped, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import batches, materialise

QUERY_BYTES, CANDIDATES, SCALE = 8 << 20, 4096, 256


def weights(rows: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, w): floor(scale * x) of each component as a long. Rows whose id or vector is null, or that hold a null or non-finite component, go."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.filter(v.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), ints.alias("w"))


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, by falling score and rising id."""
    order = np.lexsort((ids, ~score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    order = order[place < k]
    return query[order], ids[order], score[order]


def dense(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Rows of differing length as a matrix, filled up with zeros."""
    size = np.diff(offsets)
    w = np.zeros((len(size), int(size.max()) if len(size) else 0), np.int64)
    w[np.arange(w.shape[1]) < size[:, None]] = flat
    return w


def scores(asked: np.ndarray, qw: np.ndarray, ids: np.ndarray, cw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block of candidates for each query."""
    width = min(qw.shape[1], cw.shape[1])
    top = [int(np.abs(x.astype(np.float64)).max()) if x.size else 0 for x in (qw, cw)]
    exact = np.int64 if top[0] * top[1] * max(1, width) < 2**62 else object
    postings = [(np.flatnonzero(cw[:, t]), cw[:, t][cw[:, t] != 0].astype(exact)) for t in range(width)]
    out = []
    for i, x in enumerate(asked):
        total = np.zeros(len(ids), exact)
        for t in np.flatnonzero(qw[i, :width]):
            at, weight = postings[t]
            total[at] += weight * (int(qw[i, t]) if exact is object else qw[i, t])
        other = np.flatnonzero(ids != x)
        s = total[other] if exact is np.int64 else np.array([min(max(v, -(2**63)), 2**63 - 1) for v in total[other]], np.int64)
        if len(s) > k:  # partition selection, then all that tie with the k-th
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            other, s = other[near], s[near]
        out.append((np.full(len(s), x), ids[other], s))
    return best_of(*map(np.concatenate, zip(*out)), k)


def top_k(rows: DataFrame, id_col: str, vector: str, is_query: F.Column, k: int = 5, query_bytes: int = QUERY_BYTES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, id, score): of each query the k best others by integer inner product, ties to the smaller id; all if fewer.

    Missing trailing components count as 0; an empty vector scores 0. Rows with one id are one another's own: none is a candidate
    for a query of that id, and such a query asks once, with its smallest vector. As a candidate each such row counts. Scores
    beyond a long are held at its bounds. A chunk of queries has about `query_bytes`; candidates are read once for each chunk.
    """
    spark = rows.sparkSession
    every = weights(rows, id_col, vector).select("id", "w")
    asked = materialise(weights(rows.filter(is_query), id_col, vector).groupBy("id").agg(F.min("w").alias("w")), "queries")
    chunks = max(1, -(-int(asked.agg(F.sum(F.size("w") * 8 + 16)).first()[0] or 0) // query_bytes))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)))

    def found(chunk: int) -> DataFrame:
        mine = asked.filter(F.col("chunk") == chunk).select("id", "w").toArrow().combine_chunks()  # of bounded size
        lists = pa.concat_arrays(mine.column("w").chunks) if len(mine) else pa.array([], pa.list_(pa.int64()))
        sent = spark.sparkContext.broadcast((mine.column("id").to_numpy(), lists.offsets.to_numpy(), lists.flatten().to_numpy()))

        def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, offsets, flat = sent.value
            qw, best = dense(offsets, flat), (np.empty(0, np.int64),) * 3
            for b in (b.slice(at, candidates) for b in parts for at in range(0, b.num_rows, candidates)):
                w = b.column("w")
                ends = w.offsets.to_numpy()
                new = scores(ids, qw, b.column("id").to_numpy(), dense(ends, w.flatten().to_numpy()), k) if len(ids) else best
                best = best_of(*(np.concatenate(x) for x in zip(best, new)), k)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in best], ["query_id", "id", "score"])

        return every.mapInArrow(score, "query_id long, id long, score long")

    if chunks == 1:
        part = found(0)
    else:
        with batches(spark, candidates):
            part = reduce(DataFrame.unionAll, [materialise(found(i), "best") for i in range(chunks)])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return part.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    got = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return got.withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
