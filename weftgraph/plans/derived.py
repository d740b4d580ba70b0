"""Graphs derived from the star-schema tables, by SQL that other engines share word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.operators.graph import PropertyGraph

#: (a, b) of the ring's edges k = 0, 1, 2: vec_id -> (a * vec_id + b) mod n.
RING = ((1, 1), (7, 3), (13, 5))


def ring_edges_sql() -> str:
    parts = " union all ".join(
        f"select vec_id * 3 + {k} as edge_id, vec_id as src, (vec_id * {a} + {b}) % (select count(*) from embeddings) as dst, 'R{k}' as relation, cast(((vec_id * 31 + {k * 17}) % 100) as double) / cast(100 as double) as weight from embeddings"
        for k, (a, b) in enumerate(RING)
    )
    return f"({parts})"


def ring_nodes_sql() -> str:
    return "(select vec_id as node_id, concat('vec_', vec_id) as name, cast(label as varchar(20)) as type from embeddings)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ring(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A node per embedding; three edges from each."""
    e = read(spark, sf_dir, "embeddings")
    n = e.count()
    nodes = e.select(F.col("vec_id").alias("node_id"), F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("name"), F.col("label").cast("string").alias("type"), F.lit(None).cast("string").alias("description"), F.lit(True).alias("active"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(RING)])).alias("x")
    v = F.col("vec_id")
    edges = e.select(v, kinds).select(
        (v * 3 + F.col("x.k")).alias("edge_id"), v.alias("src"), ((v * F.col("x.a") + F.col("x.b")) % n).alias("dst"), F.concat(F.lit("R"), F.col("x.k").cast("string")).alias("relation"), (((v * 31 + F.col("x.k") * 17) % 100).cast("double") / 100.0).alias("weight"), F.lit(True).alias("directed"), F.lit(True).alias("active"), (v * 3 + F.col("x.k")).alias("edge_seq")
    )
    return PropertyGraph(nodes, edges, e.select(F.col("vec_id").alias("node_id"), "embedding"))


KIND = 10_000_000

COMMERCE_NODES = f"""
select {KIND} * 1 + r_regionkey as node_id, r_name as name, 'region' as type from region
union all select {KIND} * 2 + n_nationkey, n_name, 'nation' from nation
union all select {KIND} * 3 + c_custkey, c_name, 'customer' from customer
union all select {KIND} * 4 + s_suppkey, s_name, 'supplier' from supplier
union all select {KIND} * 5 + p_partkey, p_name, 'part' from part
union all select {KIND} * 6 + o_orderkey, concat('order_', o_orderkey), 'order' from orders
"""

COMMERCE_EDGES = f"""
select cast({KIND} * 1 + n_regionkey as bigint) as src, cast({KIND} * 2 + n_nationkey as bigint) as dst, 'HAS_NATION' as relation, cast(1.0 as double) as weight from nation
union all select {KIND} * 2 + c_nationkey, {KIND} * 3 + c_custkey, 'HAS_CUSTOMER', cast(0.9 as double) from customer
union all select {KIND} * 2 + s_nationkey, {KIND} * 4 + s_suppkey, 'HAS_SUPPLIER', cast(0.9 as double) from supplier
union all select {KIND} * 3 + o_custkey, {KIND} * 6 + o_orderkey, 'PLACED', cast(1.0 as double) - cast(0.15 as double) * (cast(substring(o_orderpriority, 1, 1) as int) - 1) from orders
union all select {KIND} * 6 + l_orderkey, {KIND} * 5 + l_partkey, 'CONTAINS', cast(1.0 as double) - cast(5 as double) * l_discount from lineitem
union all select {KIND} * 5 + l_partkey, {KIND} * 4 + l_suppkey, 'SUPPLIED_BY', cast(0.8 as double) from (select distinct l_partkey, l_suppkey from lineitem) as ps
"""


def commerce(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node_id, name, type and src, dst, relation, weight of the star schema as a graph."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(COMMERCE_NODES), spark.sql(COMMERCE_EDGES)
