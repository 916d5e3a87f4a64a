"""Exact top-k search by inner product in M-trees.

Vectors are lengthened by one component so that all have the same norm; the nearest by distance are then those of the
largest inner product. Each shard of the vectors is an M-tree of pages with covering radii and distances to the parent;
a best-first search visits pages by their least possible distance and leaves out, by the triangle inequality on stored
distances, those that cannot hold a better vector. Scores themselves are exact integers.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: Vectors of a shard, about; entries of a page.
SHARD_ROWS, PAGE = 8192, 64


class Node:
    __slots__ = ("pivot", "radius", "members", "to_pivot", "children", "child_radius", "pivots")


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        """ids (int64) and vectors (int64, one row each)."""
        self.ids, self.v = ids, vectors
        self.f = vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", self.f, self.f)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.x = np.column_stack((self.f, np.sqrt(np.maximum(self.top - norms, 0))))
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)), self.x[0], 0) if len(ids) else None

    def _build(self, rows: np.ndarray, pivot: np.ndarray, depth: int) -> Node:
        node = Node()
        node.pivot, node.members, node.children = pivot, rows, []
        node.to_pivot = np.linalg.norm(self.x[rows] - pivot, axis=1)
        node.radius = float(node.to_pivot.max())
        if len(rows) > PAGE and node.radius > 0:
            k = min(PAGE, -(-len(rows) // PAGE) + 1)
            seeds = self.x[self.rng.choice(rows, k, replace=False)]
            near = np.argmin(np.stack([np.linalg.norm(self.x[rows] - s, axis=1) for s in seeds]), 0)
            groups = [rows[near == i] for i in range(k)]
            if max(map(len, groups)) == len(rows):  # one place holds nearly all: cut it anyhow
                groups = np.array_split(rows, -(-len(rows) // PAGE))
                seeds = self.x[[g[0] for g in groups]]
            node.children = [self._build(g, s, depth + 1) for g, s in zip(groups, seeds, strict=True) if len(g)]
            node.pivots = np.stack([c.pivot for c in node.children])
            node.to_pivot = np.linalg.norm(node.pivots - pivot, axis=1)  # the children's parent distances
            node.child_radius = np.array([c.radius for c in node.children])
        return node

    def search(self, q: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), larger scores and then smaller ids first, without the rows whose id is own."""
        if self.root is None:
            return []
        qf = np.append(q.astype(np.float64), 0.0)
        base = float(qf @ qf) + self.top
        slack = 1e-7 * (base + 1)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        reach = np.inf
        count = itertools.count()
        queue = [(0.0, next(count), self.root, float(np.linalg.norm(qf - self.root.pivot)))]
        while queue:
            least, _, node, dist = heapq.heappop(queue)
            if least > reach:
                break
            if node.children:
                able = np.flatnonzero(np.abs(dist - node.to_pivot) - node.child_radius <= reach)
                d = np.linalg.norm(node.pivots[able] - qf, axis=1)
                lower = np.maximum(d - node.child_radius[able], 0)
                for i, dd, ll in zip(able.tolist(), d.tolist(), lower.tolist(), strict=True):
                    if ll <= reach:
                        heapq.heappush(queue, (ll, next(count), node.children[i], dd))
                continue
            rows = node.members[np.abs(dist - node.to_pivot) <= reach]
            if own is not None:
                rows = rows[self.ids[rows] != own]
            if not len(rows):
                continue
            score = self.v[rows] @ q
            if len(best) == k:
                rows, score = rows[score >= best[0][0]], score[score >= best[0][0]]
            order = np.lexsort((self.ids[rows], -score))[:k]
            for s, i in zip(score[order].tolist(), self.ids[rows[order]].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                else:
                    heapq.heappushpop(best, (s, -i))
            if len(best) == k:
                reach = np.sqrt(max(base - 2 * best[0][0], 0) + slack) + 1e-9
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _search_shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, vec_id, v) sorted by shard and kind: a shard's vectors (0), then the queries on it (1)."""
    shard, ids, vectors, tree = None, [], [], None
    out: list[tuple[int, int, int]] = []

    def flush() -> pa.RecordBatch:
        cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])

    for b in batches:
        for s, kind, i, v in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if s != shard:
                shard, ids, vectors, tree = s, [], [], None
            if kind == 0:
                ids.append(i)
                vectors.append(v)
                continue
            if tree is None:
                width = max(map(len, vectors), default=0)
                flat = np.zeros((len(vectors), width), np.int64)
                for r, x in enumerate(vectors):
                    flat[r, : len(x)] = x
                tree, vectors = MTree(np.array(ids, np.int64), flat), []
            q = np.zeros(tree.v.shape[1] if tree.v.ndim == 2 else 0, np.int64)
            q[: len(v)] = v[: len(q)]
            out += [(i, found, score) for score, found in tree.search(q, k, i)]
            if len(out) > 50_000:
                yield flush()
    yield flush()


def exact_top_k(vectors: DataFrame, k: int = 10, scale: float = 1024.0, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by query_every, the k rows of other
    ids with the largest inner products of floor(scale * x), ties to the smaller id; all rows if there are fewer.

    Vectors that are null or hold a null or non-finite component, and rows with a null id, take no part; of vectors of
    unlike length the shorter counts as filled with zeros. Vectors whose squared norm reaches 2^62 fail the job, as scores would leave the range of a long. Repeated
    candidate rows each count; a repeated query is answered once. An empty table gives an empty result.
    Queries are a hundredth of the rows; each shard of SHARD_ROWS vectors gets all of them, in a stream.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)))
    whole = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    whole = written(whole, "vectors")
    # Scores are sums of products of longs: vectors whose norms would let one leave that range fail the job.
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    largest = whole.agg(F.max(norm)).first()[0] or 0.0
    if largest >= 2.0**62:
        raise ValueError(f"vectors are too large for integer scores: the largest squared norm is {largest:g}")
    shards = max(1, -(-whole.count() // SHARD_ROWS))
    sharded = whole.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = whole.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"])
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    ordered = sharded.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = ordered.mapInArrow(lambda it: _search_shards(it, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
