"""The property graph: three DataFrames, point look-ups, neighbourhoods and topology."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import trimmed
from weftgraph.functions.vectors import sq8_quantize
from weftgraph.plans.config import EDGES, NODES, VECTORS


@dataclass(frozen=True)
class PropertyGraph:
    """nodes, edges and vectors; an operation returns a new graph.

    edges_by_dst: the same edges laid out by their target, where a snapshot has them
    so; a graph with other edges has none.
    """

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    edges_by_dst: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), spark.createDataFrame([], VECTORS))

    def having(self, **frames: DataFrame) -> PropertyGraph:
        return replace(self, **(frames | {"edges_by_dst": None} if "edges" in frames else frames))

    def incoming(self) -> DataFrame:
        """The edges, by dst where they are laid out so."""
        return self.edges if self.edges_by_dst is None else self.edges_by_dst

    # look-ups (filters reach the Parquet scan) ---------------------------------

    def active_nodes(self) -> DataFrame:
        return self.nodes.where("active")

    def active_edges(self) -> DataFrame:
        return self.edges.where("active")

    def node(self, node_id: int) -> DataFrame:
        return self.active_nodes().where(F.col("node_id") == node_id)

    def node_by_name(self, name: str) -> DataFrame:
        return self.active_nodes().where(F.col("name") == trimmed(F.lit(name)))

    def nodes_by_names(self, names: DataFrame) -> DataFrame:
        """names: query_id, name, pos. Adds node_id; names that no node has go."""
        wanted = names.withColumn("name", trimmed(F.col("name")))
        return wanted.join(self.active_nodes().select("name", "node_id"), "name")

    def edge(self, edge_id: int) -> DataFrame:
        return self.edges.where(F.col("edge_id") == edge_id)

    def vector(self, node_id: int) -> DataFrame:
        return self.vectors.where(F.col("node_id") == node_id)

    def quantized_vector(self, node_id: int) -> DataFrame:
        """node_id, data, scale, norm: the eight-bit form of one vector."""
        return self.vector(node_id).select("node_id", sq8_quantize(F.col("embedding")).alias("q")).select("node_id", "q.*")

    # neighbourhoods -------------------------------------------------------------

    def out_edges(self, nodes: DataFrame) -> DataFrame:
        """Edges that leave the nodes (column node_id), inactive ones included, with their order pos."""
        order = Window.partitionBy("node_id").orderBy("edge_seq")
        return nodes.select("node_id").join(self.edges, F.col("node_id") == F.col("src")).withColumn("pos", F.row_number().over(order) - 1)

    def in_edges(self, nodes: DataFrame) -> DataFrame:
        order = Window.partitionBy("node_id").orderBy("edge_seq")
        return nodes.select("node_id").join(self.incoming(), F.col("node_id") == F.col("dst")).withColumn("pos", F.row_number().over(order) - 1)

    def out_neighbors(self) -> DataFrame:
        """node_id, neighbor, edge_id over active edges; parallel edges stay."""
        return self.active_edges().select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor"), "edge_id")

    def in_neighbors(self) -> DataFrame:
        return self.active_edges().select(F.col("dst").alias("node_id"), F.col("src").alias("neighbor"), "edge_id")

    def all_neighbors(self) -> DataFrame:
        """Outgoing (dir 0), then incoming (dir 1); a self-loop is there twice."""
        return self.out_neighbors().withColumn("dir", F.lit(0)).unionByName(self.in_neighbors().withColumn("dir", F.lit(1)))

    # topology -------------------------------------------------------------------

    def out_degree(self) -> DataFrame:
        """node_id, degree over active edges; 0 for nodes without any."""
        count = self.active_edges().groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id").join(count, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def csr_offsets(self) -> DataFrame:
        """node_id, offset for ids 0 to the largest + 1: where each node's active edges begin in source order.

        The running sum goes in blocks of ids: sums of blocks, then sums inside
        each, so no task sorts all nodes.
        """
        size = 1 << 16
        top = self.nodes.agg(F.max("node_id")).first()[0]
        spark = self.nodes.sparkSession
        ids = spark.range(0, 0 if top is None else top + 1).select(F.col("id").alias("node_id"))
        count = self.active_edges().groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"))
        rows = ids.join(count, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("node_id") / size).cast("long").alias("block"))
        blocks = rows.groupBy("block").agg(F.sum("n").alias("total"))
        before = blocks.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("base"))
        inside = F.sum("n").over(Window.partitionBy("block").orderBy("node_id"))
        ends = rows.withColumn("inside", inside).join(before, "block").select((F.col("node_id") + 1).alias("node_id"), (F.col("base") + F.col("inside")).cast("long").alias("offset"))
        return spark.createDataFrame([(0, 0)], "node_id long, offset long").unionByName(ends)

    def stats(self) -> DataFrame:
        """One row: counts of active nodes and edges, of vectors, of CSR slots, and the CSR's bytes (8 an offset, 32 an edge)."""
        nodes = self.nodes.agg(F.count_if("active").alias("node_count"), F.coalesce(F.max("node_id") + 1, F.lit(0)).alias("csr_nodes"))
        edges = self.edges.agg(F.count_if("active").alias("edge_count"))
        vectors = self.vectors.agg(F.count("*").alias("vector_count"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).alias("vector_bytes"))
        # three one-row aggregates side by side
        return nodes.join(edges, F.lit(True)).join(vectors, F.lit(True)).withColumn("csr_bytes", 8 * (F.col("csr_nodes") + 1) + 32 * F.col("edge_count"))
