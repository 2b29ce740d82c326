"""Exact top-k by inner product with MaxScore over shards of the candidates.

A term is a component with a sign: a candidate stands in the posting list of (j, +) or (j, -) as its component j is above
or below zero. For a query, the term of component j with the query's own sign adds at most |q_j| times the largest value in
its list; the opposite sign only subtracts, so its bound is 0. Terms in ascending order of bound whose bounds together
stay below the threshold (the k-th best score so far) are non-essential: a candidate in no other list can't reach it.
Essential lists are traversed, the rest is probed from the largest bound down while a candidate can still compete.

Shards and blocks of queries are keys of a Spark cogroup: each pair is one bounded task. The k best of each shard are
merged by a window over at most k rows a shard for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS = 8192, 2048


class Shard:
    """Posting lists of the signed components of a block of integer vectors, and the block itself for probes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, np.ascontiguousarray(rows.T)
        self.lists = []
        for column in self.rows:
            both = []
            for sign in (1, -1):
                docs = np.flatnonzero(column * sign > 0)
                values = column[docs] * sign
                both.append((docs, values, int(values.max()) if len(values) else 0))
            self.lists.append(both)

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, the query's own id aside; ties to the smaller id."""
        other = self.ids != query_id
        weights = np.abs(q)
        terms = [self.lists[j][0 if x > 0 else 1] for j, x in enumerate(q)]
        bounds = np.array([w * t[2] for w, t in zip(weights, terms, strict=True)], np.int64)
        order = np.argsort(bounds, kind="stable")
        theta = self.first_threshold(q, order, terms, other, k)
        total = np.cumsum(bounds[order])
        skip = int(np.searchsorted(total, theta, side="left")) if theta is not None and theta > 0 else 0
        if theta is None or theta <= 0:  # a candidate in no list at all scores 0 or less and may still count
            at = np.flatnonzero(other)
            theta = None
        else:
            seen = np.zeros(len(self.ids), bool)
            for j in order[skip:]:
                seen[terms[j][0]] = True
            at = np.flatnonzero(seen & other)
        gained = np.zeros(len(self.ids), np.int64)
        for j in order[skip:]:
            docs, values, _ = terms[j]
            gained[docs] += weights[j] * values
        score, rest = gained[at], int(total[skip - 1]) if skip else 0

        def prune(at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = score + rest >= theta
            return (at, score) if keep.all() else (at[keep], score[keep])

        if theta is not None:
            at, score = prune(at, score)
        for j in order[skip:][::-1]:  # what the opposite sign takes away
            if q[j]:
                score = score + np.minimum(q[j] * self.rows[j][at], 0)
                if theta is not None:
                    at, score = prune(at, score)
        for j in order[:skip][::-1]:  # probes of the non-essential terms
            score, rest = score + q[j] * self.rows[j][at], rest - int(bounds[j])
            at, score = prune(at, score)
        best = np.lexsort((self.ids[at], -score))[:k]
        return at[best], score[best]

    def first_threshold(self, q: np.ndarray, order: np.ndarray, terms: list, other: np.ndarray, k: int) -> int | None:
        """The k-th best exact score among candidates that do well on the strongest lists."""
        rough = np.zeros(len(self.ids), np.int64)
        for j in order[::-1][:12]:
            rough += q[j] * self.rows[j]
        at = np.flatnonzero(other)
        if len(at) < k:
            return None
        if len(at) > 4 * k:
            at = at[np.argpartition(rough[at], len(at) - 4 * k)[len(at) - 4 * k :]]
        return int(np.sort((q[:, None] * self.rows[:, at]).sum(0))[-k])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the lists; shorter vectors are filled with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best candidates by inner product, its own id aside.

    Both inputs: id bigint, v array<bigint>. Vectors are taken as padded with zeros to a common width. Fewer than k
    candidates: all of them; no candidate: no row. Repeated ids are candidates each for itself.
    """
    n, m = candidates.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    left = candidates.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(cands: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if cands.num_rows and asked.num_rows:
            import pyarrow.compute as pc

            width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() or 0 for t in (cands, asked))
            order = np.argsort(cands.column("id").to_numpy(), kind="stable")
            shard = Shard(cands.column("id").to_numpy()[order], _matrix(cands.column("v"), width)[order])
            for query_id, q in zip(asked.column("id").to_numpy(), _matrix(asked.column("v"), width), strict=True):
                at, score = shard.search(query_id, q, k)
                out[0].append(np.full(len(at), query_id))
                out[1].append(shard.ids[at])
                out[2].append(score)
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.table({"query_id": cat(out[0]), "vec_id": cat(out[1]), "score": cat(out[2])})

    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(embedding: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, finite), F.lit(False))


def op2_top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50; components become floor(256 * x)."""
    fine = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    whole = fine.select(F.col("vec_id").cast("bigint").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    return top_k(whole.where(F.col("id") % every == 0), whole, k)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
