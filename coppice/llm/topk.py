"""Exact top-k inner products: a ball tree per shard, searched best bound first.

Vectors are dealt by a hash to shards of bounded size. Queries visit the shards in
waves, each four times as wide as all before: first one shard, then three more, then
twelve. The k-th score found so far goes along into the next wave, where a node whose
bound stays below it is never opened. In a wave a task builds one shard's tree and
searches it for at most ``block`` queries, so a shard is copied only as often as the
queries that ask it in that wave need tasks (or idle cores are there for it).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise

_LEAF = 64
_LONG = 2**63 - 1


class BallTree:
    """A ball tree over integer vectors; nodes are arrays, leaves ranges of rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(ids))
        self.x = vectors.astype(np.float64)
        self.centre, self.radius, self.kids, self.span = [], [], [], []
        self._split(0, len(ids))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.vectors, self.ids, self.x = vectors[self.order], ids[self.order], self.x[self.order]
        self.top = float(np.abs(self.x).max(initial=0))

    def _split(self, a: int, b: int) -> int:
        node, rows = len(self.span), self.order[a:b]
        x = self.x[rows]
        centre = x.mean(0) if x.shape[1] else np.zeros(0)
        self.centre.append(centre)
        far = np.sqrt(((x - centre) ** 2).sum(1))
        self.radius.append(float(far.max(initial=0)))
        self.span.append((a, b))
        self.kids.append(())
        if b - a > _LEAF and self.radius[node] > 0:
            one = x[far.argmax()]
            other = x[((x - one) ** 2).sum(1).argmax()]
            cut = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(x @ (other - one), cut)]
            self.kids[node] = (self._split(a, a + cut), self._split(a + cut, b))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each node's points."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(1))[:, None]
        top = q @ self.centre.T + norm * self.radius
        return top + 1e-9 * (np.abs(top) + norm * (self.radius + np.sqrt((self.centre**2).sum(1)))) + 1e-6

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` points but ``own``, those under ``least``
        left out; ties go to the smaller id."""
        ids, scores, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), least
        exact = self.top * float(np.abs(query).max(initial=0)) * max(len(query), 1) < 2**53
        q = query.astype(np.float64)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= kth:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            a, b = self.span[node]
            if exact:
                s = (self.x[a:b] @ q).astype(np.int64)
            else:
                s = np.array([min(max(sum(int(u) * int(v) for u, v in zip(row, query)), -_LONG - 1), _LONG) for row in self.vectors[a:b]], np.int64)
            i = self.ids[a:b]
            good = (i != own) & (s >= kth)
            if good.any():
                ids, scores = _leaders(np.r_[ids, i[good]], np.r_[scores, s[good]], k)
            if len(ids) == k:
                kth = max(kth, float(scores[-1]))
        return ids, scores


def _leaders(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids, each with its greatest score, ties to the smaller id."""
    order = np.lexsort((ids, ~scores))  # ~ turns the order of longs round, -2^63 too
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order[first]], scores[order[first]]


def _task(k: int):
    def work(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(queries):
            size = points.v.map(len)
            asked = queries.v.map(len)
            for n in asked.unique():  # vectors of another length have no product
                part, mine = points[size == n], queries[asked == n]
                if not len(part):
                    continue
                tree = BallTree(np.stack(part.v.to_numpy()).astype(np.int64).reshape(len(part), n), part.vec_id.to_numpy())
                q = np.stack(mine.v.to_numpy()).astype(np.int64).reshape(len(mine), n)
                for a in range(0, len(q), 256):
                    for i, bound in enumerate(tree.bounds(q[a : a + 256]), a):
                        row = mine.iloc[i]
                        least = -np.inf if pd.isna(row.least) else float(row.least)
                        ids, scores = tree.search(q[i], bound, row.vec_id, k, least)
                        out.append(pd.DataFrame({"query_id": row.vec_id, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return work


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double. Rows with a null
    id, a null vector, or a null or non-finite component are left out."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull()).where(fine).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _lanes(asked: int, shards: int, block: int, cores: int) -> int:
    """Tasks that share a shard's queries in a wave: as many as ``block`` demands, or
    as keep all cores busy, each with 64 queries at least."""
    each = -(-asked // shards)
    return max(1, -(-each // block), min(-(-cores // shards), each // 64))


def top_k(df: DataFrame, query_every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, block: int = 1 << 14, components: int = 1 << 21) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every row
    whose id is divisible by ``query_every`` with all rows of other ids.

    Fewer than ``k`` candidates give as many rows; ties go to the smaller vec_id.
    Rows that ``integer_vectors`` leaves out take no part; vectors are compared
    with those of their own length. Of rows that repeat a query's id the greatest
    vector asks; as candidates, repeated ids count with their greatest score.
    Products beyond a long are held at its end. An empty table gives no rows.
    ``components``: numbers in a shard, which with ``block`` bounds a task. Equal rows
    are one, and a shard is dealt by id and vector, so no id gathers in one task.
    """
    vectors = materialise(integer_vectors(df, vec_id, vector, scale).distinct(), "vectors")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, -(-n // max(256, components // max(width or 1, 1))))
    points = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)))
    queries = vectors.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    queries = materialise(queries.withColumn("home", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards))), "queries")
    total, cores = queries.count(), df.sparkSession.sparkContext.defaultParallelism

    def search(asked: DataFrame, first: int, end: int) -> DataFrame:
        """Of the shards that follow its home, a query asks those from ``first`` to ``end``."""
        lanes = _lanes(total * (end - first), shards, block, cores)
        turn = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long")))
        asked = asked.withColumn("turn", turn).withColumn("shard", F.pmod(F.col("home") + F.col("turn"), F.lit(shards)))
        asked = asked.withColumn("lane", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(lanes)).cast("int"))
        copies = points.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        return copies.groupBy("shard", "lane").cogroup(asked.groupBy("shard", "lane")).applyInPandas(_task(k), "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = best(search(queries.withColumn("least", F.lit(None).cast("double")), 0, 1))
    first = 1
    while first < shards:
        found, end = materialise(found, "found"), min(shards, 4 * first)
        kth = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("least"))
        asked = queries.join(kth, queries.vec_id == kth.query_id, "left").drop("query_id")
        found, first = best(found.drop("rank").unionByName(search(asked, first, end))), end
    return found
