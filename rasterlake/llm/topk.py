"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each segment the mean and the deviation are kept, at several resolutions. They bound a
squared distance from below by the sum over segments of length * ((mean - mean')^2 + (deviation - deviation')^2), and with the
norms the inner product from above. Candidates are bounded coarse to fine; only those that may still enter a query's best k
are compared exactly.

Queries come in passes of at most about ``block`` rows, a bounded broadcast; each pass reads all candidates once and leaves k
rows a query and task, which are merged by rank. No row is left out of either side.

Components are floor(scale * x), x as double. Defined cases: vectors null, empty or holding null or non-finite components take
no part; vectors are compared with those of equal length; a query's own row is any of equal id; repeated candidate rows count
each, repeated query rows get their results each; candidates of null id take part, come last among equals and keep a null id; a
score beyond 64 bits is held at the limit. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Shared, integers, materialise, scratch, small_batches, with_row_id

LEVELS = (4, 16)
SLACK = 1e-9


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of each segment, so that the bound is a plain inner product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(np.int64)
    size = np.diff(edges)
    sums, squares = np.add.reduceat(x, edges[:-1], 1), np.add.reduceat(x * x, edges[:-1], 1)
    return np.concatenate((sums / np.sqrt(size), np.sqrt(np.maximum(squares - sums * sums / size, 0))), 1)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products of integers held as doubles, exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if top < 2**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    if top < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), c.astype(np.int64))
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(q, c)], np.int64)


class Search:
    """The best k of one pass's queries over the candidates that a task has seen."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.statistics = [segment_statistics(vectors, s) for s in LEVELS]
        self.query = self.found = self.score = np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(self.ids), 1024):
            self._add(slice(a, a + 1024), ids, vectors)

    def _add(self, part: slice, ids: np.ndarray, vectors: np.ndarray) -> None:
        coarse = self.statistics[0][part] @ segment_statistics(vectors, LEVELS[0]).T
        room = lambda bound, least: bound + SLACK * np.abs(bound) + 0.5 >= least
        q, c = np.nonzero(room(coarse, self.least[part][:, None]) & (self.ids[part][:, None] != ids))
        q += part.start
        fine = segment_statistics(vectors, LEVELS[1])
        keep = [np.zeros(0, bool)]
        for a in range(0, len(q), 200_000):
            i, j = q[a : a + 200_000], c[a : a + 200_000]
            keep.append(room(np.einsum("ij,ij->i", self.statistics[1][i], fine[j]), self.least[i]))
        keep = np.concatenate(keep)
        q, c = q[keep], c[keep]
        score = [np.zeros(0, np.int64)]
        for a in range(0, len(q), 200_000):
            score.append(_scores(self.vectors[q[a : a + 200_000]], vectors[c[a : a + 200_000]]))
        score = np.concatenate(score)
        good = score >= self.least[q]
        query, found, score = np.concatenate((self.query, q[good])), np.concatenate((self.found, ids[c[good]])), np.concatenate((self.score, score[good]))
        order = np.lexsort((found, -score.astype(object) if (score == -(2**63)).any() else -score, query))
        query, found, score = query[order], found[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        best = rank < self.k
        self.query, self.found, self.score = query[best], found[best], score[best]


def _vectors(column: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors."""
    n = np.asarray(column.value_lengths())
    at = np.concatenate(([0], np.cumsum(n)))
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return [(rows := np.flatnonzero(n == d), flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(n).tolist()]


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, block: int = 1 << 14) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of ``queries`` the k best rows of ``vectors`` by inner product."""
    spark = vectors.sparkSession
    small_batches(spark)
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound)
    wanted = materialise(with_row_id(pick(queries), "row"), "topk-queries")
    passes = max(1, math.ceil(wanted.count() / block))
    schema = "query long, query_id long, vec_id long, score long"
    out = scratch(spark, "topk-found")
    for p in range(passes):
        got = wanted.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).toArrow().combine_chunks()
        column = got["v"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64()))
        ids, rows = integers(got["id"].combine_chunks()) if got.num_rows else np.zeros(0, np.int64), got["row"].to_numpy()
        parts = {m.shape[1]: (ids[r], rows[r], m) for r, m in _vectors(column, scale)}
        shared = Shared(spark, parts)

        def run(batches, shared=shared):
            searches = {d: (Search(i, m, k), r) for d, (i, r, m) in shared.value.items()}
            for batch in batches:
                found = integers(batch.column("id"))
                for r, m in _vectors(batch.column("v"), scale):
                    if m.shape[1] in searches:
                        searches[m.shape[1]][0].add(found[r], m)
            for s, r in searches.values():
                yield pa.RecordBatch.from_arrays([pa.array(r[s.query]), pa.array(s.ids[s.query]), pa.array(s.found, mask=s.found == NULL_ID), pa.array(s.score)], names=["query", "query_id", "vec_id", "score"])

        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        ranked = pick(vectors).mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
