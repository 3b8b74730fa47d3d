"""Exact top-k by inner product with a KD-tree for each shard.

Components become whole numbers, so scores are exact.  Vectors are dealt into shards of near-equal size by a hash of their
ids.  A shard's KD-tree splits at medians of its widest dimension and keeps tight bounding boxes; the best inner product that
a box can hold for a query bounds what is below it, and nodes are opened best first until no bound reaches the query's kth
score.  A first pass searches each query's own shard only; the kth score found there goes with the query to all the others,
where it prunes from the start.

Shards meet queries in blocks, one group for each shard and block; what a group holds is bounded by the two parameters.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 1024, 1024, 64
SCALE = 1024
_LOW = np.iinfo(np.int64).min


class Tree:
    """KD-tree over the rows of an int64 matrix."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self.low, self.high = [], []
        self._node(np.arange(len(vectors)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _node(self, rows: np.ndarray) -> int:
        me, part = len(self.rows), self.vectors[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.rows.append(rows)
        self.children.append(None)
        if len(rows) > LEAF_ROWS and (high > low).any():
            order = np.argsort(part[:, int((high - low).argmax())], kind="stable")
            half = len(rows) // 2
            self.children[me] = (self._node(rows[order[:half]]), self._node(rows[order[half:]]))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the greatest inner product with any point of the node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: int, k: int, kth: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) of rows but ``own`` that reach ``kth``, ties to the smaller id."""
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        heap = [(-int(bound[0]), 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-int(bound[child]), child))
                continue
            rows = self.rows[node]
            score = self.vectors[rows] @ query
            take = (score >= kth) & (ids[rows] != own)
            if take.any():
                best_ids, best = np.append(best_ids, ids[rows[take]]), np.append(best, score[take])
                order = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[order], best[order]
                if len(best) == k:
                    kth = max(kth, int(best[-1]))
        return best_ids, best


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def whole(x: Column, scale: int) -> Column:
    return F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v and dim of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & (F.size(x) > 0)).select("vec_id", whole(x, scale).alias("v"), F.size(x).alias("dim"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best other rows.

    Rows without id or vector, with an empty vector, or with a null or non-finite component take no part.  Vectors of other
    lengths than the query's are no candidates.  Rows that repeat an id are candidates each, but never for that id; of
    repeated queries the shortest vector counts, and of those the one that sorts first.  Fewer than k candidates: all of them.
    Scores are exact while sums of products fit 64 bits.  No rows: no rows out.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = prepared(vectors, scale)
    total = rows.count()
    n_shards = max(1, -(-total // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    is_query = F.col("vec_id") % every == 0

    def own_shard(part: pd.DataFrame) -> pd.DataFrame:
        ids, v = part["vec_id"].to_numpy(), _matrix(part["v"])
        tree, at = Tree(v), np.flatnonzero(ids % every == 0)
        bound = tree.bounds(v[at])
        kth = [int(s[-1]) if len(s) == k else _LOW for s in (tree.search(v[i], bound[j], ids, ids[i], k, _LOW)[1] for j, i in enumerate(at))]
        return pd.DataFrame({"query_id": ids[at], "kth": np.array(kth, dtype=np.int64), "v": pd.Series([*v[at]], dtype=object), "dim": np.full(len(at), v.shape[1], dtype=np.int32)})

    queries = rows.groupBy("shard", "dim").applyInPandas(own_shard, "query_id long, kth long, v array<long>, dim int")
    queries = cut(queries.groupBy("query_id").agg(F.min(F.struct("dim", "v", "kth")).alias("x")).select("query_id", "x.*"))
    n_blocks = max(1, -(-queries.count() // block_queries))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    held = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(queries):
            ids, tree, q = part["vec_id"].to_numpy(), Tree(_matrix(part["v"])), _matrix(queries["v"])
            bound = tree.bounds(q)
            for j, (own, kth) in enumerate(zip(queries["query_id"], queries["kth"], strict=True)):
                found, score = tree.search(q[j], bound[j], ids, own, k, kth)
                out.append(pd.DataFrame({"query_id": np.full(len(found), own), "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ["shard", "block", "dim"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
