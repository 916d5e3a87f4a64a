"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_if_small, written

#: A node is a hub with more edges than this share of all, and than this number: so at most 1 / HUB_SHARE nodes are.
HUB_SHARE, HUB_EDGES = 1e-4, 1000


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation. Large: each node's larger neighbours go to the least of its neighbourhood.
    Small: a node and its smaller neighbours do. Only minima are aggregated, so a hub's edges combine before the shuffle."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("edges")), "cc-least")
    # A hub's edges would meet its minimum in one task. Hubs are few, as each has HUB_SHARE of all edges or more: their
    # minima go to the edges; the others' edges are at most that share of a join.
    total = least.agg(F.sum("edges")).first()[0] or 0
    bound = max(HUB_EDGES, int(total * HUB_SHARE))
    hubs, rest = least.where(F.col("edges") > bound).select("u", "m"), least.where(F.col("edges") <= bound).select("u", "m")
    joined = both.join(broadcast_if_small(rest), "u")
    if not hubs.isEmpty():
        joined = joined.unionByName(both.join(F.broadcast(hubs), "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges (a, b), comp being the least node of its component; self-edges keep
    their node. Null ends are not edges. An empty table gives an empty one. Each round is written to the shared folder."""
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    was = state(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        now = written(_step(_step(now, True), False), "cc")
        if (new := state(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
