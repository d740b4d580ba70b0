"""Hybrid scores, ranking and the induced subgraph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.functions.vectors import clamp
from weftgraph.operators.traversal import FRONTIER, bfs
from weftgraph.plans.config import HybridScoreConfig, TraversalConfig
from weftgraph.plans.materialize import materialized


def hybrid_scores(seeds: DataFrame, traversed: DataFrame, config: HybridScoreConfig) -> DataFrame:
    """query_id, node_id, final_score, vector_score, graph_score, depth, rank, path_edge_id, place.

    final = alpha * vector + (1 - alpha) * graph; vector: the seed's score (the last of
    repeated seeds), 0 for other nodes; graph: path weight * decay ^ depth, cut to
    [0, 1]. Scores below the threshold go (NaN stays); place ranks the rest from 0
    by falling score, ties by discovery. Of rows that repeat a node the best stays.
    """
    alpha, decay = min(1.0, max(0.0, config.alpha)), min(1.0, max(0.0, config.depth_decay))
    last = seeds.groupBy("query_id", "node_id").agg(F.max_by("score", "pos").cast("double").alias("seed_score"))
    graph = clamp(F.col("path_weight") * F.pow(F.lit(decay), F.col("depth")), 0.0, 1.0)
    rows = traversed.join(last, ["query_id", "node_id"], "left").withColumn("vector_score", F.coalesce("seed_score", F.lit(0.0))).withColumn("graph_score", graph)
    rows = rows.withColumn("final_score", F.lit(alpha) * F.col("vector_score") + F.lit(1.0 - alpha) * F.col("graph_score"))
    rows = rows.where(~(F.col("final_score") < config.min_score) | F.isnan("final_score"))
    best = rows.groupBy("query_id", "node_id").agg(F.max(F.struct("final_score", (-F.col("rank")).alias("first"), "rank", "vector_score", "graph_score", "depth", "path_edge_id")).alias("b")).select("query_id", "node_id", "b.final_score", "b.vector_score", "b.graph_score", "b.depth", "b.rank", "b.path_edge_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank", "node_id")
    return best.withColumn("place", F.row_number().over(order) - 1)


def induced_edges(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """query_id and the active edges with both ends among a query's scored nodes, of any weight, with the places of their ends (and their names, where scored has them).

    Up to FRONTIER scored rows, counted, are sent to the edges, which are then read once and in place.
    """
    names = ["name"] if "name" in scored.columns else []
    ends = lambda node: scored.select("query_id", F.col("node_id").alias(node), *[F.col(c).alias(f"{node}_{c}") for c in ("place", *names)])
    small = scored.count() <= FRONTIER
    sent = F.broadcast if small else lambda df: df
    both = edges.where("active").join(sent(ends("src")), "src").join(sent(ends("dst")), ["query_id", "dst"])
    return both.select("query_id", "edge_id", "src", "dst", "relation", F.col("weight").cast("double").alias("weight"), "edge_seq", "src_place", "dst_place", *[f"{e}_name" for e in ("src", "dst") if names])


@dataclass(frozen=True)
class Subgraph:
    """Scored entities and induced edges of a batch of queries."""

    entities: DataFrame
    edges: DataFrame
    seeds: DataFrame

    def node_ids(self) -> DataFrame:
        return self.entities.select("query_id", "node_id")

    def entity(self, node_id: int) -> DataFrame:
        return self.entities.where(F.col("node_id") == node_id)

    def outgoing(self, node_id: int) -> DataFrame:
        return self.edges.where(F.col("src") == node_id)

    def incoming(self, node_id: int) -> DataFrame:
        return self.edges.where(F.col("dst") == node_id)

    def counts(self) -> DataFrame:
        """query_id, entity_count, edge_count."""
        n = self.entities.groupBy("query_id").agg(F.count("*").alias("entity_count"))
        m = self.edges.groupBy("query_id").agg(F.count("*").alias("edge_count"))
        return n.join(m, "query_id", "left").select("query_id", "entity_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


def extract_subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, traversal: TraversalConfig, scoring: HybridScoreConfig, edges_by_dst: DataFrame | None = None) -> Subgraph:
    """Traversal, then scores and threshold (a dropped node may have led to kept ones), then induced edges.

    Entities (with their names) and edges (with those of their ends) are computed
    once and written; pruning and rendering read these rows only.
    """
    scored = materialized(hybrid_scores(seeds, bfs(nodes, edges, seeds, traversal, edges_by_dst), scoring))
    sent = F.broadcast(scored) if scored.count() <= FRONTIER else scored
    named = materialized(nodes.select("node_id", "name").join(sent, "node_id").select(*scored.columns, "name"))
    return Subgraph(named, materialized(induced_edges(edges, named)), seeds)
