"""Breadth-first expansion for a batch of queries, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.plans.config import Direction, TraversalConfig
from weftgraph.plans.materialize import materialized

#: So many rows of a level (some 40 bytes each) are sent to all tasks.
FRONTIER = 500_000

TRAVERSED = ["query_id", "node_id", "rank", "depth", "path_weight", "path_edge_id"]


def _half_edges(edges: DataFrame, config: TraversalConfig, by_dst: DataFrame | None = None) -> DataFrame:
    """at, neighbor, dir, edge_seq, edge_id, w of the edges that may be followed: outgoing first, then incoming."""
    usable = lambda df: df.where(F.col("active") & (F.col("weight") >= config.min_edge_weight))
    side = lambda a, b, d: usable(by_dst if a == "dst" and by_dst is not None else edges).select(F.col(a).alias("at"), F.col(b).alias("neighbor"), F.lit(d).alias("dir"), "edge_seq", "edge_id", F.col("weight").cast("double").alias("w"))
    if config.direction is Direction.OUTGOING:
        return side("src", "dst", 0)
    if config.direction is Direction.INCOMING:
        return side("dst", "src", 0)
    return side("src", "dst", 0).unionByName(side("dst", "src", 1))


def first_seeds(seeds: DataFrame) -> DataFrame:
    """query_id, node_id, pos: repeated seeds keep their first place."""
    return seeds.groupBy("query_id", "node_id").agg(F.min("pos").alias("pos"))


def bfs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, config: TraversalConfig, edges_by_dst: DataFrame | None = None) -> DataFrame:
    """query_id, node_id, rank (discovery order from 0), depth, path_weight, path_edge_id.

    seeds: query_id, node_id, pos. Seeds that are no active node are dropped. A node
    belongs to the edge that finds it first, in order of the parent's rank, the
    direction and edge_seq, and its weight is the product along that path; the
    first max_nodes found are kept. Of a level's candidates each node's first edge
    is a partial minimum before the shuffle, and ranks need no more than max_nodes
    rows of a query. Every level's new nodes are written once (checkpoint), so the
    plan does not grow with depth. A frontier of up to FRONTIER rows, counted, goes
    to the edges, which are then read in place and not shuffled; edges_by_dst serves
    the incoming direction. Larger frontiers meet the edges in a shuffle on `at`.
    """
    cap = config.max_nodes
    known = nodes.where("active").select("node_id")
    start = first_seeds(seeds).join(known, "node_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("pos", "node_id")
    start = start.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < max(cap, 0))
    level = materialized(start.select("query_id", "node_id", "rank", F.lit(0).alias("depth"), F.lit(1.0).alias("path_weight"), F.lit(None).cast("long").alias("path_edge_id")))
    seen, half = level, _half_edges(edges, config, edges_by_dst)
    small = level.count() <= FRONTIER
    for depth in range(1, config.max_depth + 1):
        parent = level.select("query_id", F.col("node_id").alias("at"), F.col("rank").alias("parent_rank"), F.col("path_weight").alias("pw"))
        step = half.join(F.broadcast(parent) if small else parent, "at").select("query_id", F.col("neighbor").alias("node_id"), F.struct("parent_rank", "dir", "edge_seq", "edge_id", (F.col("pw") * F.col("w")).alias("weight")).alias("claim"))
        claimed = step.groupBy("query_id", "node_id").agg(F.min("claim").alias("claim"))
        fresh = claimed.join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").join(known, "node_id", "left_semi")
        order = Window.partitionBy("query_id").orderBy("claim")
        fresh = fresh.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
        count = seen.groupBy("query_id").agg(F.count("*").alias("before"))
        level = fresh.join(count, "query_id").withColumn("rank", (F.col("before") + F.col("n") - 1).cast("long")).where(F.col("rank") < cap)
        level = materialized(level.select("query_id", "node_id", "rank", F.lit(depth).alias("depth"), F.col("claim.weight").alias("path_weight"), F.col("claim.edge_id").alias("path_edge_id")))
        size = level.count()
        if not size:
            break
        small = size <= FRONTIER
        seen = seen.unionByName(level)
    return seen.select(*TRAVERSED)
