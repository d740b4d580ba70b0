"""Batch mutations: upserts, edge inserts and deletes with cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import trimmed
from weftgraph.functions.vectors import clamp
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import DimensionMismatch, DuplicateId, InvalidConfig, NodeNotFound
from weftgraph.plans.materialize import materialized


def _numbered(df: DataFrame, order: list[str], base: int, name: str) -> DataFrame:
    """Consecutive numbers from base in the given order: ranges of the order are counted, then numbered inside."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy(*order)))
    ranged = materialized(ranged)  # ranges are sampled, so they are fixed before use
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (F.lit(base - 1) + F.col("__base") + F.col("__in")).cast("long")).drop("__part", "__in", "__base")


def upsert_nodes(graph: PropertyGraph, rows: DataFrame, dim: int | None = None) -> PropertyGraph:
    """rows: name, type, description, embedding (nullable), seq. The last row of a name wins.

    Names, types and descriptions are trimmed; names may not be empty. An existing node's type and description
    are overwritten, by empty ones (null) too; its vector stays where no row of the
    batch brings one. New nodes get the next ids in order of their first seq.
    """
    rows = rows.withColumns({c: trimmed(F.col(c)) for c in ("name", "type", "description")})
    checks = rows.agg(F.count_if(F.col("name").isNull() | (F.col("name") == "")).alias("empty"), F.max(F.size("embedding")).alias("most"), F.min(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("least")).first()
    if checks.empty:
        raise InvalidConfig(f"{checks.empty} rows have an empty name")
    if dim is not None and checks.least is not None and (checks.least != dim or checks.most != dim):
        raise DimensionMismatch(dim, checks.least if checks.least != dim else checks.most)
    last = F.max(F.struct("seq", "type", "description")).alias("last")
    vector = F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("seq"))).alias("embedding")
    merged = rows.groupBy("name").agg(last, vector, F.min("seq").alias("first_seq")).select("name", F.nullif("last.type", F.lit("")).alias("new_type"), F.nullif("last.description", F.lit("")).alias("new_description"), "embedding", "first_seq")
    both = graph.nodes.join(merged, "name", "full_outer")
    known = both.where("node_id is not null")
    kept = known.select("node_id", "name", F.when(F.col("first_seq").isNotNull(), F.col("new_type")).otherwise(F.col("type")).alias("type"), F.when(F.col("first_seq").isNotNull(), F.col("new_description")).otherwise(F.col("description")).alias("description"), F.col("active") | F.col("first_seq").isNotNull(), "embedding").toDF("node_id", "name", "type", "description", "active", "embedding")
    top = graph.nodes.agg(F.max("node_id")).first()[0]
    fresh = _numbered(both.where("node_id is null").drop("node_id"), ["first_seq", "name"], (-1 if top is None else top) + 1, "node_id")
    fresh = fresh.select("node_id", "name", F.col("new_type").alias("type"), F.col("new_description").alias("description"), F.lit(True).alias("active"), "embedding")
    everything = kept.unionByName(fresh)
    brought = everything.where("embedding is not null").select("node_id", F.col("embedding").cast("array<float>").alias("embedding"))
    vectors = graph.vectors.join(brought.select("node_id"), "node_id", "left_anti").unionByName(brought)
    return graph.having(nodes=everything.drop("embedding"), vectors=vectors)


def add_edges(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """rows: src, dst, relation, weight, directed, seq. Ends must be active nodes; weights are cut to [0, 1].

    Ids go on from the largest there is, in order of seq; parallel edges and
    self-loops are allowed.
    """
    rows = rows.withColumn("relation", trimmed(F.col("relation")))
    if not rows.where("relation is null or relation = ''").isEmpty():
        raise InvalidConfig("an edge has an empty relation")
    ids = graph.active_nodes().select("node_id")
    ends = rows.select(F.explode(F.array("src", "dst")).alias("node_id"))
    lost = ends.join(ids, "node_id", "left_anti").limit(1).collect()
    if lost:
        raise NodeNotFound(lost[0].node_id)
    top = graph.edges.agg(F.max("edge_id").alias("e"), F.max("edge_seq").alias("s")).first()
    fresh = _numbered(rows, ["seq", "src", "dst", "relation"], (top.e or 0) + 1, "edge_id")
    shift = (top.s or 0) - (top.e or 0)
    fresh = fresh.select("edge_id", "src", "dst", "relation", clamp(F.col("weight"), 0.0, 1.0).cast("float").alias("weight"), "directed", F.lit(True).alias("active"), (F.col("edge_id") + shift).alias("edge_seq"))
    return graph.having(edges=graph.edges.unionByName(fresh))


def remove_nodes(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Nodes of column node_id go, with their edges and vectors."""
    gone = ids.select("node_id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node_id", "gone"), F.col(end) == F.col("gone"), "left_anti")
    return PropertyGraph(graph.nodes.join(gone, "node_id", "left_anti"), edges, graph.vectors.join(gone, "node_id", "left_anti"))


def remove_edges(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    return graph.having(edges=graph.edges.join(ids.select("edge_id").distinct(), "edge_id", "left_anti"))


def set_nodes_active(graph: PropertyGraph, ids: DataFrame, active: bool) -> PropertyGraph:
    """Soft delete or its undoing; all other fields stay."""
    return graph.having(nodes=_toggled(graph.nodes, ids, "node_id", active))


def set_edges_active(graph: PropertyGraph, ids: DataFrame, active: bool) -> PropertyGraph:
    return graph.having(edges=_toggled(graph.edges, ids, "edge_id", active))


def _toggled(df: DataFrame, ids: DataFrame, key: str, active: bool) -> DataFrame:
    named = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(named, key, "left").withColumn("active", F.when(F.col("__hit"), F.lit(active)).otherwise(F.col("active"))).select(*df.columns)


def put_vectors(graph: PropertyGraph, rows: DataFrame, dim: int | None = None) -> PropertyGraph:
    """rows: node_id, embedding: replaces or inserts."""
    if dim is not None:
        odd = rows.where(F.size("embedding") != dim).select(F.size("embedding").alias("n")).limit(1).collect()
        if odd:
            raise DimensionMismatch(dim, odd[0].n)
    rows = rows.select("node_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return graph.having(vectors=graph.vectors.join(rows.select("node_id"), "node_id", "left_anti").unionByName(rows))


def check_unique(df: DataFrame, key: str) -> None:
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateId(f"{key} {twice[0][key]} is there {twice[0]['count']} times")
