"""Exact top-k inner products: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

LEAF_ROWS = 128
#: rows of a shard and queries of a block: they bound what one task holds
SHARD_ROWS = 4096
BLOCK_QUERIES = 1024


class BallTree:
    """Nodes in arrays; rows of a leaf are in order of their ids, so that equal scores come smaller id first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.centers, self.radii, self.children, self.leaves = [], [], [], []
        self.ids, self.rows = ids, rows
        order = np.argsort(ids, kind="stable")
        if len(order):
            self._add(order, rows.astype(np.float64))
        self.centers, self.radii = np.array(self.centers).reshape(len(self.radii), rows.shape[1]), np.array(self.radii)

    def _add(self, members: np.ndarray, points: np.ndarray) -> int:
        node, here = len(self.radii), points[members]
        center = here.mean(0)
        away = np.sqrt(((here - center) ** 2).sum(1))
        self.centers.append(center)
        self.radii.append(away.max())
        self.children.append(())
        self.leaves.append(members)
        if len(members) > LEAF_ROWS and away.max() > 0:
            # along the line between two far points, halved at the median
            a = here[away.argmax()]
            b = here[((here - a) ** 2).sum(1).argmax()]
            side = np.argsort(here @ (b - a), kind="stable")
            half = len(side) // 2
            self.leaves[node] = None
            self.children[node] = (self._add(members[np.sort(side[:half])], points), self._add(members[np.sort(side[half:])], points))
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ids and scores of its k best rows that reach ``floor``, -1 and the least integer where there are fewer.

        A node is opened only while its bound ``q.c + |q| r`` reaches the query's k-th
        score so far; the leaves that are left are visited in falling order of their bounds.
        """
        least = np.iinfo(np.int64).min
        best_ids = np.full((len(queries), k), -1, np.int64)
        best = np.full((len(queries), k), least, np.int64)
        if not len(self.radii) or not len(queries):
            return best_ids, best
        kth = floor.copy()
        exact = np.float64 if _fits(queries, self.rows) else np.int64
        rows, asked = self.rows.astype(exact), queries.astype(exact)
        real = queries.astype(np.float64)
        norm = np.sqrt((real**2).sum(1))
        size = np.sqrt((self.centers**2).sum(1)) + self.radii
        q, node, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        inner = np.array([bool(c) for c in self.children])
        first = np.array([c[0] if c else 0 for c in self.children])
        second = np.array([c[1] if c else 0 for c in self.children])
        while len(q):
            bound = (real[q] * self.centers[node]).sum(1) + norm[q] * self.radii[node]
            bound += 1e-9 * norm[q] * size[node] + 1e-3  # above rounding; scores are whole numbers
            live = bound >= kth[q]
            q, node, bound = q[live], node[live], bound[live]
            leaf = ~inner[node]
            found.append((q[leaf], node[leaf], bound[leaf]))
            q, node = np.concatenate([q[~leaf]] * 2), np.concatenate([first[node[~leaf]], second[node[~leaf]]])
        q, node, bound = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-bound, q))
        q, node, bound = q[order], node[order], bound[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for t in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero(turn == t)
            now = now[bound[now] >= kth[q[now]]]
            for leaf in np.unique(node[now]):
                who, members = q[now[node[now] == leaf]], self.leaves[leaf]
                score = (asked[who] @ rows[members].T).astype(np.int64)
                own = query_ids[who][:, None] == self.ids[members][None, :]
                score[own] = least
                top = np.argsort(-score.astype(np.float64) if exact is np.float64 else -np.maximum(score, least + 1), axis=1, kind="stable")[:, :k]
                ids = np.concatenate([best_ids[who], np.where(np.take_along_axis(own, top, 1), -1, self.ids[members][top])], 1)
                both = np.concatenate([best[who], np.take_along_axis(score, top, 1)], 1)
                keep = np.lexsort((ids, -np.maximum(both, least + 1)), axis=1)[:, :k]
                best_ids[who], best[who] = np.take_along_axis(ids, keep, 1), np.take_along_axis(both, keep, 1)
                kth[who] = np.maximum(kth[who], best[who][:, -1])
        return best_ids, best


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every inner product is exact in doubles."""
    most = lambda x: int(np.abs(x).max(initial=0))
    return a.shape[1] * most(a) * most(b) < 1 << 53


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Queries (qkey, query_id, v, floor) against rows (row_id, row_v) of the same number of components."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"qkey": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
    width = len(rows.row_v.iloc[0])
    stack = lambda v: np.array(v.tolist(), np.int64).reshape(len(v), width)
    tree = BallTree(rows.row_id.to_numpy(np.int64), stack(rows.row_v))
    ids, score = tree.search(queries.query_id.to_numpy(np.int64), stack(queries.v), queries.floor.to_numpy(np.int64), k)
    n = ids.shape[1]
    out = pd.DataFrame({"qkey": np.repeat(queries.qkey.to_numpy(), n), "query_id": np.repeat(queries.query_id.to_numpy(), n), "vec_id": ids.ravel(), "score": score.ravel()})
    return out[score.ravel() > np.iinfo(np.int64).min]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns ``vec_id, v (array<bigint>)`` with floor(256 x) of every component; unusable vectors are left out."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return (
        vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("bigint")).alias("v"))
    )


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best rows for every row where ``is_query`` (a column of ``vec_id``) holds, exactly.

    Columns ``query_id, rank (from 1), vec_id, score``; the score is the inner product of the
    components turned into floor(256 x), ties go to the smaller id. Rows are dealt to shards by
    hash, so equal vectors and near ones spread evenly. Each query first searches its own
    shard; its k-th score there is shared with all other shards, which return only rows that
    reach it. A task holds one shard and one block of queries, both of bounded size.

    Null ids, null vectors and vectors with a null or non-finite component take no part.
    Rows repeated with id and vector count once. A query is never its own partner: rows of
    its id are left out. Vectors of different length are never compared. Scores must fit a
    long. An empty table gives no rows, other columns are not read.
    """
    data = whole_vectors(vectors, id_col, vector_col).withColumn("qkey", F.xxhash64("vec_id", "v")).dropDuplicates(["vec_id", "qkey"])
    n, asked = data.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("vec_id")))).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / BLOCK_QUERIES))
    data = data.withColumn("width", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int"))
    queries = data.where(is_query(F.col("vec_id"))).withColumnRenamed("vec_id", "query_id").withColumn("block", F.pmod(F.xxhash64("qkey", F.lit(3)), F.lit(blocks)).cast("int"))
    found = "qkey bigint, query_id bigint, vec_id bigint, score bigint"
    run = lambda a, b: _search(a, b, k)
    least = F.lit(-(2**63) + 1).cast("bigint")

    deal = lambda q: q.select("shard", "block", "width", "qkey", "query_id", "v", "floor")
    rows = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block", "width"]
    rows = rows.select(*[F.col(c).alias(f"row_{c}") for c in keys], F.col("vec_id").alias("row_id"), F.col("v").alias("row_v"))
    search = lambda q: deal(q).groupBy(*keys).cogroup(rows.groupBy(*[f"row_{c}" for c in keys])).applyInPandas(run, found)

    home = cut_lineage(search(queries.withColumn("floor", least)))
    floors = home.groupBy("qkey").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    away = queries.join(floors, "qkey", "left").withColumn("floor", F.coalesce("floor", least))
    away = away.withColumn("shard", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(shards - 1)), F.col("shard"))))
    every = home.unionByName(search(away))
    order = Window.partitionBy("qkey", "query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
