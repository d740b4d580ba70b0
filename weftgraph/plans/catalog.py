"""The registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions import text as tx
from weftgraph.functions import vectors as vx
from weftgraph.operators import dictionary as dic
from weftgraph.operators import mutation as mut
from weftgraph.operators.knn import knn, min_score
from weftgraph.operators.pruning import prune
from weftgraph.operators.rendering import json_payload, json_text, markdown, triples
from weftgraph.operators.resolution import resolve_entities
from weftgraph.operators.scoring import extract_subgraph, hybrid_scores
from weftgraph.operators.traversal import bfs
from weftgraph.plans.config import Direction, EngineConfig, HybridScoreConfig, MarkdownConfig, MarkdownStyle, Metric, Quantization, QueryOptions, ResolutionConfig, TraversalConfig
from weftgraph.plans.derived import COMMERCE_EDGES, COMMERCE_NODES, commerce, read, ring, ring_edges_sql, ring_nodes_sql
from weftgraph.plans.materialize import shared_folder
from weftgraph.plans.retriever import Engine
from weftgraph.sources import graph_file, snapshot

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: The queries of searches: every row whose id is divisible by 50, against all rows.
_ASKED = "vec_id % 50 = 0"


def r6(c):
    return F.round(c, 6)


# vectors -----------------------------------------------------------------------

_V = "embedding::double[]"
_PAIRS = f"(select a.vec_id as a_id, b.vec_id as b_id, a.{_V} as a, b.{_V} as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one."""
    e = read(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), (F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("b"))
    return a.join(b, "a_id")


def _pair_query(name: str, f, sql: str) -> None:
    _query(name, f"select a_id, b_id, round({sql}, 6) as value from {_PAIRS}")(lambda s, d: _pairs(s, d).select("a_id", "b_id", r6(f(F.col("a"), F.col("b"))).alias("value")))


_pair_query("vec_dot", vx.dot, "list_dot_product(a, b)")
_pair_query("vec_cosine", vx.cosine, "list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))")
_pair_query("vec_euclidean", vx.euclidean, "list_distance(a, b)")
_pair_query("vec_manhattan", vx.manhattan, "list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))")


@_query("vec_norm", f"select vec_id, round(sqrt(list_dot_product({_V}, {_V})), 6) as norm, round(list_dot_product({_V}, {_V}), 6) as norm_squared from embeddings")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", r6(vx.norm(v)).alias("norm"), r6(vx.norm_squared(v)).alias("norm_squared"))


@_query("vec_normalize", f"select vec_id, round(list_sum(list_transform({_V}, lambda x: abs(x / sqrt(list_dot_product({_V}, {_V}))))), 6) as l1, round(({_V})[1] / sqrt(list_dot_product({_V}, {_V})), 6) as first from embeddings")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vx.normalized(F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").withColumn("u", unit)
    return rows.select("vec_id", r6(F.aggregate(F.transform("u", lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x)).alias("l1"), r6(F.col("u")[0]).alias("first"))


_METRIC_SQL = {
    Metric.COSINE: ("list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v))", "desc"),
    Metric.DOT: ("list_dot_product(q, v)", "desc"),
    Metric.EUCLIDEAN: ("list_distance(q, v)", "asc"),
    Metric.MANHATTAN: ("list_sum(list_transform(list_zip(q, v), lambda x: abs(x[1] - x[2])))", "asc"),
}


def _knn_sql(metric: Metric, where: str, k: int) -> str:
    score, way = _METRIC_SQL[metric]
    return f"""
    select query_id, node_id, round(score, 6) as score, pos from (
      select *, row_number() over (partition by query_id order by score {way}, node_id) - 1 as pos from (
        select query_id, vec_id as node_id, {score} as score
        from (select vec_id as query_id, {_V} as q from embeddings where {where}), (select vec_id, {_V} as v from embeddings)))
    where pos < {k}"""


def _tables(spark: SparkSession, sf_dir: str, where: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node_id"), "embedding"), e.where(where).select(F.col("vec_id").alias("query_id"), "embedding")


def _knn_query(name: str, metric: Metric, where: str, k: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors, asked = _tables(spark, sf_dir, where)
        return knn(vectors, asked, k, metric).select("query_id", "node_id", r6(F.col("score")).alias("score"), F.col("pos").cast("long").alias("pos"))

    _query(name, _knn_sql(metric, where, k))(run)


_knn_query("knn_cosine", Metric.COSINE, _ASKED, 10)
_knn_query("knn_dot", Metric.DOT, _ASKED, 10)
_knn_query("knn_euclidean", Metric.EUCLIDEAN, _ASKED, 10)
_knn_query("knn_manhattan", Metric.MANHATTAN, _ASKED, 10)
_knn_query("knn_multi_query", Metric.COSINE, _ASKED, 5)


@_query("topk_min_score", f"select query_id, min(score) as min_score from ({_knn_sql(Metric.COSINE, _ASKED, 3)}) group by query_id")
def topk_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _tables(spark, sf_dir, _ASKED)
    return min_score(knn(vectors, asked, 3), ["query_id"]).select("query_id", r6(F.col("min_score")).alias("min_score"))


# eight-bit quantisation ----------------------------------------------------------

_TOP = f"list_max(list_transform({_V}, lambda x: abs(x)))"
_CODES = f"list_transform({_V}, lambda x: round(x * 127.0::double / {_TOP})::int)"
_Q8 = f"(select vec_id, {_V} as v, {_CODES} as data, ({_TOP} / 127.0::double)::float as scale, sqrt(list_dot_product({_V}, {_V}))::float as norm from embeddings)"
_PAIRS8 = f"(select a.vec_id as a_id, b.vec_id as b_id, a.v as q, a.data as da, a.scale as sa, b.data as db, b.scale as sb, b.norm as nb from {_Q8} a join {_Q8} b on b.vec_id = a.vec_id + 1)"


def _quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").withColumn("q8", vx.sq8_quantize(F.col("embedding")))


@_query("sq8_quantize", f"select vec_id, array_to_string(data, ',') as data, round(scale::double, 6) as scale, round(norm::double, 6) as norm from {_Q8}")
def sq8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantized(spark, sf_dir).select("vec_id", F.array_join(F.col("q8.data").cast("array<string>"), ",").alias("data"), r6(F.col("q8.scale").cast("double")).alias("scale"), r6(F.col("q8.norm").cast("double")).alias("norm"))


@_query("sq8_dequantize_error", f"select vec_id, round(list_max(list_transform(list_zip(v, data), lambda x: abs(x[1] - (x[2]::double * scale::double)::float::double))), 6) as worst from {_Q8}")
def sq8_dequantize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = vx.sq8_dequantize(F.col("q8"))
    gap = F.array_max(F.zip_with(F.col("embedding").cast("array<double>"), back, lambda x, y: F.abs(x - y.cast("double"))))
    return _quantized(spark, sf_dir).select("vec_id", r6(gap).alias("worst"))


def _pairs8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.withColumn("qa", vx.sq8_quantize(F.col("a"))).withColumn("qb", vx.sq8_quantize(F.col("b")))


@_query("sq8_dot_asym", f"select a_id, b_id, round(list_dot_product(q, db::double[]) * sb::double, 6) as value from {_PAIRS8}")
def sq8_dot_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs8(spark, sf_dir).select("a_id", "b_id", r6(vx.sq8_dot(F.col("a"), F.col("qb"))).alias("value"))


@_query("sq8_dot_sym", f"select a_id, b_id, round(list_dot_product(da::double[], db::double[]) * sa::double * sb::double, 6) as value from {_PAIRS8}")
def sq8_dot_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs8(spark, sf_dir).select("a_id", "b_id", r6(vx.sq8_dot_symmetric(F.col("qa"), F.col("qb"))).alias("value"))


@_query(
    "sq8_cosine_knn",
    f"""select query_id, node_id, round(score, 6) as score, pos from (
    select *, row_number() over (partition by query_id order by score desc, node_id) - 1 as pos from (
      select query_id, vec_id as node_id, least(1.0, greatest(-1.0, list_dot_product(q, data::double[]) * scale::double / (sqrt(list_dot_product(q, q)) * norm::double))) as score
      from (select vec_id as query_id, {_V} as q from embeddings where {_ASKED}), {_Q8})) where pos < 10""",
)
def sq8_cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _tables(spark, sf_dir, _ASKED)
    found = knn(vectors.select("node_id", vx.sq8_quantize(F.col("embedding")).alias("embedding")), asked, 10)
    return found.select("query_id", "node_id", r6(F.col("score")).alias("score"), F.col("pos").cast("long").alias("pos"))


def _sq8_all(name: str, metric: Metric, score: str, way: str) -> None:
    """Every vector against all eight-bit ones: the queries go to the vectors as a matrix."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors, asked = _tables(spark, sf_dir, "true")
        found = knn(vectors.select("node_id", vx.sq8_quantize(F.col("embedding")).alias("embedding")), asked, 3, metric)
        return found.select("query_id", "node_id", r6(F.col("score")).alias("score"), F.col("pos").cast("long").alias("pos"))

    _query(
        name,
        f"""select query_id, node_id, round(score, 6) as score, pos from (
        select *, row_number() over (partition by query_id order by score {way}, node_id) - 1 as pos from (
          select query_id, vec_id as node_id, {score} as score from (select vec_id as query_id, {_V} as q from embeddings), {_Q8})) where pos < 3""",
    )(run)


_sq8_all("sq8_cosine_knn_all", Metric.COSINE, "least(1.0, greatest(-1.0, list_dot_product(q, data::double[]) * scale::double / (sqrt(list_dot_product(q, q)) * norm::double)))", "desc")
_sq8_all("sq8_dot_knn_all", Metric.DOT, "list_dot_product(q, data::double[]) * scale::double", "desc")


@_query("sq8_point", f"select vec_id as node_id, array_to_string(data, ',') as data, round(scale::double, 6) as scale, round(norm::double, 6) as norm from {_Q8} where vec_id = 7")
def sq8_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ring(spark, sf_dir).quantized_vector(7)
    return found.select("node_id", F.array_join(F.col("data").cast("array<string>"), ",").alias("data"), r6(F.col("scale").cast("double")).alias("scale"), r6(F.col("norm").cast("double")).alias("norm"))


@_query("sq8_memory", "select count(*) as vectors, sum(len(embedding) + 8)::bigint as sq8_bytes, sum(len(embedding) * 4)::bigint as float_bytes from embeddings")
def sq8_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantized(spark, sf_dir).agg(F.count("*").alias("vectors"), F.sum(vx.sq8_bytes(F.col("q8"))).alias("sq8_bytes"), F.sum(vx.float_bytes(F.col("embedding"))).alias("float_bytes"))


# topology --------------------------------------------------------------------------

_E, _N = ring_edges_sql(), ring_nodes_sql()
_OUT = f"select src as node_id, dst as neighbor, edge_id from {_E}"
_IN = f"select dst as node_id, src as neighbor, edge_id from {_E}"
_query("out_neighbors", _OUT)(lambda s, d: ring(s, d).out_neighbors())
_query("in_neighbors", _IN)(lambda s, d: ring(s, d).in_neighbors())
_query("all_neighbors", f"select *, 0 as dir from ({_OUT}) union all select *, 1 as dir from ({_IN})")(lambda s, d: ring(s, d).all_neighbors())


@_query("out_edges", f"select src as node_id, edge_id, dst, relation, row_number() over (partition by src order by edge_id) - 1 as pos from {_E}")
def out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring(spark, sf_dir)
    return g.out_edges(g.nodes).select("node_id", "edge_id", "dst", "relation", F.col("pos").cast("long").alias("pos"))


@_query("in_edges", f"select dst as node_id, edge_id, src, relation, row_number() over (partition by dst order by edge_id) - 1 as pos from {_E}")
def in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring(spark, sf_dir)
    return g.in_edges(g.nodes).select("node_id", "edge_id", "src", "relation", F.col("pos").cast("long").alias("pos"))


@_query(
    "point_lookups",
    f"select 'node' as what, node_id as id, name as value from {_N} where node_id = 5 union all select 'name', node_id, name from {_N} where name = 'vec_9' union all select 'edge', edge_id, relation from {_E} where edge_id = 16 union all select 'vector', vec_id, round(sqrt(list_dot_product({_V}, {_V})), 4)::varchar from embeddings where vec_id = 11",
)
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring(spark, sf_dir)
    row = lambda df, what, key, value: df.select(F.lit(what).alias("what"), F.col(key).alias("id"), value.cast("string").alias("value"))
    found = row(g.node(5), "node", "node_id", F.col("name")).unionByName(row(g.node_by_name(" vec_9 "), "name", "node_id", F.col("name")))
    return found.unionByName(row(g.edge(16), "edge", "edge_id", F.col("relation"))).unionByName(row(g.vector(11), "vector", "node_id", F.round(vx.norm(F.col("embedding")), 4)))


@_query("commerce_edges", f"select src, dst, relation, round(weight, 6) + 0.0 as weight from ({COMMERCE_EDGES})")
def commerce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce(spark, sf_dir)[1].select("src", "dst", "relation", (F.round("weight", 6) + 0.0).alias("weight"))


@_query("commerce_degree", f"select n.node_id, n.name, n.type, count(e.src) as degree from ({COMMERCE_NODES}) n left join ({COMMERCE_EDGES}) e on e.src = n.node_id group by 1, 2, 3")
def commerce_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = commerce(spark, sf_dir)
    count = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.join(count, "node_id", "left").select(F.col("node_id").cast("long").alias("node_id"), "name", "type", F.coalesce("degree", F.lit(0)).alias("degree"))


_query("out_degree", f"select node_id, count(e.src) as degree from {_N} n left join {_E} e on e.src = n.node_id group by node_id")(lambda s, d: ring(s, d).out_degree())
_query("csr_offsets", f"select 0::bigint as node_id, 0::bigint as offset union all select src + 1, (sum(count(*)) over (order by src))::bigint from {_E} group by src")(lambda s, d: ring(s, d).csr_offsets())


@_query("graph_stats", f"select (select count(*) from {_N}) as node_count, (select count(*) from {_E}) as edge_count, (select count(*) from embeddings) as vector_count, (select 8 * (max(node_id) + 2) from {_N}) + 32 * (select count(*) from {_E}) as csr_bytes")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring(spark, sf_dir).stats().select("node_count", "edge_count", "vector_count", "csr_bytes")


# traversal -------------------------------------------------------------------------

_SEEDS = {0: (0, 3, 3), 1: (77, 12), 2: (5,)}


def _seed_rows(seeds: dict[int, tuple[int, ...]]) -> list[tuple[int, int, float, int]]:
    return [(q, n, round(1.0 - 0.1 * i, 1), i) for q, ns in seeds.items() for i, n in enumerate(ns)]


def _seeds(spark: SparkSession, seeds: dict[int, tuple[int, ...]] = _SEEDS) -> DataFrame:
    return spark.createDataFrame(_seed_rows(seeds), "query_id long, node_id long, score double, pos int")


def _seeds_sql(seeds: dict[int, tuple[int, ...]] = _SEEDS) -> str:
    rows = ", ".join(f"({q}::bigint, {n}::bigint, {s}::double, {p})" for q, n, s, p in _seed_rows(seeds))
    return f"(values {rows}) as seeds(query_id, node_id, score, pos)"


def bfs_sql(config: TraversalConfig, seeds: str) -> str:
    """Level by level: first claims, discovery ranks, the cap."""
    use = f"(select * from {_E} where weight >= {config.min_edge_weight}::double)"
    out = f"select src as origin, dst as nb, 0 as dir, edge_id, weight from {use}"
    back = f"select dst as origin, src as nb, {int(config.direction is Direction.UNDIRECTED)} as dir, edge_id, weight from {use}"
    half = {Direction.OUTGOING: out, Direction.INCOMING: back, Direction.UNDIRECTED: f"{out} union all {back}"}[config.direction]
    parts = [
        f"half as ({half})",
        f"l0 as (select query_id, node_id, row_number() over (partition by query_id order by min(pos), node_id) - 1 as rank, 0 as depth, 1.0::double as path_weight, null::bigint as path_edge_id from {seeds} group by query_id, node_id)",
        "s0 as (select * from l0)",
    ]
    for d in range(1, config.max_depth + 1):
        p = d - 1
        parts += [
            f"c{d} as (select query_id, nb, rank, dir, edge_id, path_weight * weight as w, row_number() over (partition by query_id, nb order by rank, dir, edge_id) as first from l{p} join half on origin = node_id)",
            f"f{d} as (select * from c{d} c where first = 1 and not exists (select 1 from s{p} s where s.query_id = c.query_id and s.node_id = c.nb))",
            f"l{d} as (select query_id, nb as node_id, (select count(*) from s{p} s where s.query_id = f{d}.query_id) + row_number() over (partition by query_id order by rank, dir, edge_id) - 1 as rank, {d} as depth, w as path_weight, edge_id as path_edge_id from f{d})",
            f"s{d} as (select * from s{p} union all select * from l{d})",
        ]
    return f"with {', '.join(parts)} select query_id, node_id, rank, depth, path_weight, path_edge_id from s{config.max_depth} where rank < {config.max_nodes}"


def _bfs_query(name: str, config: TraversalConfig, seeds: dict[int, tuple[int, ...]] = _SEEDS) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = ring(spark, sf_dir)
        return bfs(g.nodes, g.edges, _seeds(spark, seeds), config).withColumn("path_weight", F.round("path_weight", 9)).withColumn("path_edge_id", F.coalesce("path_edge_id", F.lit(-1)))

    _query(name, f"select query_id, node_id, rank, depth, round(path_weight, 9) as path_weight, coalesce(path_edge_id, -1) as path_edge_id from ({bfs_sql(config, _seeds_sql(seeds))})")(run)


_bfs_query("bfs_out_d1", TraversalConfig(max_depth=1))
_bfs_query("bfs_out_d2", TraversalConfig(max_depth=2))
_bfs_query("bfs_in_d2", TraversalConfig(max_depth=2, direction=Direction.INCOMING))
_bfs_query("bfs_undirected_d2", TraversalConfig(max_depth=2, direction=Direction.UNDIRECTED))
_bfs_query("bfs_min_weight", TraversalConfig(max_depth=4, min_edge_weight=0.5))
_bfs_query("bfs_max_nodes", TraversalConfig(max_depth=3, max_nodes=7))
_bfs_query("bfs_multi_seed", TraversalConfig(max_depth=3, min_edge_weight=0.3), {q: tuple((q * 37 + i * 11) % 500 for i in range(5)) for q in range(6)})


# scoring ---------------------------------------------------------------------------

_TRAVERSE = TraversalConfig(max_depth=2, min_edge_weight=0.2)


def _scored_sql(scoring: HybridScoreConfig, traverse: TraversalConfig = _TRAVERSE, seeds: str | None = None) -> str:
    seeds = seeds or _seeds_sql()
    return f"""select *, row_number() over (partition by query_id order by final_score desc, rank, node_id) - 1 as place from (
      select t.*, coalesce(score, 0.0::double) as vector_score, least(greatest(path_weight * pow({scoring.depth_decay}::double, depth), 0), 1) as graph_score,
        {scoring.alpha}::double * coalesce(score, 0.0::double) + {1.0 - scoring.alpha}::double * least(greatest(path_weight * pow({scoring.depth_decay}::double, depth), 0), 1) as final_score
      from ({bfs_sql(traverse, seeds)}) t left join (select query_id, node_id, arg_max(score, pos) as score from {seeds} group by all) using (query_id, node_id))
    where final_score >= {scoring.min_score}::double"""


#: Seeds have no edge; -1 stands for null, as engines differ in how nulls of whole numbers print.
def _no_edge():
    return F.coalesce("path_edge_id", F.lit(-1)).alias("path_edge_id")


_SCORED = "query_id, node_id, round(final_score, 9) as final_score, round(vector_score, 9) as vector_score, round(graph_score, 9) as graph_score, depth, rank, coalesce(path_edge_id, -1) as path_edge_id, place"


def _scored(spark: SparkSession, sf_dir: str, scoring: HybridScoreConfig) -> DataFrame:
    g = ring(spark, sf_dir)
    rows = hybrid_scores(_seeds(spark), bfs(g.nodes, g.edges, _seeds(spark), _TRAVERSE), scoring)
    return rows.select("query_id", "node_id", *[F.round(c, 9).alias(c) for c in ("final_score", "vector_score", "graph_score")], "depth", "rank", _no_edge(), F.col("place").cast("long").alias("place"))


_query("hybrid_score", f"select {_SCORED} from ({_scored_sql(HybridScoreConfig(min_score=0.0))})")(lambda s, d: _scored(s, d, HybridScoreConfig(min_score=0.0)))
_query("hybrid_threshold", f"select {_SCORED} from ({_scored_sql(HybridScoreConfig(min_score=0.15))})")(lambda s, d: _scored(s, d, HybridScoreConfig(min_score=0.15)))

_HYBRID = HybridScoreConfig()
_INDUCED = f"""select s.query_id, e.edge_id, e.src, e.dst, e.relation, e.weight, e.edge_id as edge_seq, s.place as src_place, t.place as dst_place
  from {_E} e join scored s on s.node_id = e.src join scored t on t.node_id = e.dst and t.query_id = s.query_id"""


def _subgraph(spark: SparkSession, sf_dir: str):
    g = ring(spark, sf_dir)
    return g, extract_subgraph(g.nodes, g.edges, _seeds(spark), _TRAVERSE, _HYBRID)


@_query("induced_edges", f"with scored as ({_scored_sql(_HYBRID)}) select query_id, edge_id, src, dst, relation, round(weight, 6) as weight from ({_INDUCED})")
def induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subgraph(spark, sf_dir)[1].edges.select("query_id", "edge_id", "src", "dst", "relation", r6(F.col("weight")).alias("weight"))


_NAMED = {0: (0, 3), 1: (77,)}
_NAME_SEEDS = "(values (0::bigint, 0::bigint, 1.0::double, 0), (0::bigint, 3::bigint, 1.0::double, 1), (1::bigint, 77::bigint, 1.0::double, 0)) as seeds(query_id, node_id, score, pos)"
_RING_CONFIG = EngineConfig(dim=64, quantization=Quantization.NONE, min_edge_weight=0.2, auto_flush=False)


@_query("retrieve_seed_names", f"select {_SCORED} from ({_scored_sql(_HYBRID, TraversalConfig(2, 0.2, 100), _NAME_SEEDS)})")
def retrieve_seed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(q, f" vec_{n} ", i) for q, ns in _NAMED.items() for i, n in enumerate(ns)] + [(1, "unknown", 9)], "query_id long, name string, pos int")
    found = Engine(ring(spark, sf_dir), _RING_CONFIG).retrieve_by_names(names).scored_entities
    return found.select("query_id", "node_id", *[F.round(c, 9).alias(c) for c in ("final_score", "vector_score", "graph_score")], "depth", "rank", _no_edge(), F.col("place").cast("long").alias("place"))


# budget and rendering ----------------------------------------------------------------

_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
_TOKENS = "case when {0} = '' then 0 else greatest(" + _WORDS + ", ceil(length({0}) / 4.0)::int) end"


@_query("heuristic_tokens", f"select doc_id, ({_TOKENS.format('text')})::int as tokens from documents")
def heuristic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.heuristic_tokens(F.col("text")).alias("tokens"))


_BUDGET = 60
_LINE = "'- [' || name || '] (Relevância: ' || printf('%.2f', final_score) || ')' || chr(10)"
_EDGE_LINE = "'  - ' || relation || ' -> [' || name || '] (Confiança: ' || printf('%.2f', weight) || ')' || chr(10)"
_TITLE = "'# Contexto Recuperado do Conhecimento:' || chr(10)"


def _prune_sql(budget: int, scored: str | None = None) -> str:
    """The item list of each query, walked by a recursive query."""
    return f"""with recursive scored as ({scored or _scored_sql(_HYBRID)}), induced as ({_INDUCED}), names as (select * from {_N}),
    items as (
      select query_id, place as later, 0 as kind, place as source, 0 as seq, s.node_id as id, {_TOKENS.format('(' + _LINE + ')')} as cost, {_LINE} as line from scored s join names n on n.node_id = s.node_id
      union all select query_id, greatest(src_place, dst_place), 1, src_place, edge_seq, edge_id, {_TOKENS.format('(' + _EDGE_LINE + ')')}, {_EDGE_LINE} from induced i join names n on n.node_id = i.dst),
    numbered as (select *, row_number() over (partition by query_id order by later, kind, source, seq, id) as i from items),
    walk as (
      select distinct query_id, 0::bigint as i, ({_TOKENS.format('(' + _TITLE + ')')})::bigint as spent, false as stopped, -1 as kind, -1::bigint as id, false as taken from items
      union all
      select w.query_id, n.i, case when not w.stopped and w.spent + n.cost <= {budget} then w.spent + n.cost else w.spent end,
        w.stopped or (n.kind = 0 and w.spent + n.cost > {budget}), n.kind, n.id, not w.stopped and w.spent + n.cost <= {budget}
      from walk w join numbered n on n.query_id = w.query_id and n.i = w.i + 1),
    kept as (select w.query_id, n.later, n.kind, n.source, n.seq, n.id, n.line, w.spent from walk w join numbered n on n.query_id = w.query_id and n.i = w.i where w.taken)"""


def _pruned(spark: SparkSession, sf_dir: str, budget: int = _BUDGET):
    g, sub = _subgraph(spark, sf_dir)
    return g, prune(sub, g.nodes, budget)


@_query("prune_entities_prefix", f"{_prune_sql(_BUDGET)} select query_id, id as node_id, later as place from kept where kind = 0")
def prune_entities_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir)[1].entities.select("query_id", "node_id", F.col("place").cast("long").alias("place"))


@_query("prune_full", f"{_prune_sql(_BUDGET)} select query_id, max(spent)::int as total_tokens, {_BUDGET} as budget, count(*) filter (where kind = 0)::int as entity_count, count(*) filter (where kind = 1)::int as edge_count, string_agg(id::varchar, ',' order by id) filter (where kind = 1) as edges from kept group by query_id")
def prune_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = _pruned(spark, sf_dir)
    ids = p.edges.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("edge_id")), lambda x: x.cast("string")), ",").alias("edges"))
    return p.totals.join(ids, "query_id", "left")


@_query("render_hierarchical", f"{_prune_sql(_BUDGET)} select query_id, {_TITLE} || string_agg(line, '' order by source, kind, seq) as text from kept group by query_id")
def render_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _pruned(spark, sf_dir)
    return markdown(p.entities, p.edges, g.nodes)


@_query(
    "render_separated",
    f"""{_prune_sql(_BUDGET)},
    own as (select k.query_id, string_agg('- [' || name || '] (Score: ' || printf('%.2f', final_score) || ')' || chr(10), '' order by later) as a from kept k join scored s on s.query_id = k.query_id and s.node_id = k.id join names n on n.node_id = k.id where kind = 0 group by k.query_id),
    links as (select k.query_id, string_agg('- [vec_' || i.src || '] --' || i.relation || ' (' || printf('%.2f', i.weight) || ')--> [vec_' || i.dst || ']' || chr(10), '' order by source, seq) as b from kept k join induced i on i.query_id = k.query_id and i.edge_id = k.id where kind = 1 group by k.query_id)
    select query_id, '# Contexto Recuperado do Conhecimento:' || chr(10) || chr(10) || '## Entidades:' || chr(10) || a || coalesce(chr(10) || '## Relações Estruturais:' || chr(10) || b, '') as text from own left join links using (query_id)""",
)
def render_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _pruned(spark, sf_dir)
    return markdown(p.entities, p.edges, g.nodes, MarkdownConfig(style=MarkdownStyle.SEPARATED))


@_query("render_triples", f"{_prune_sql(_BUDGET)} select k.query_id, string_agg('(vec_' || i.src || ', ' || i.relation || ', vec_' || i.dst || ')' || chr(10), '' order by source, seq) as text from kept k join induced i on i.query_id = k.query_id and i.edge_id = k.id where kind = 1 group by k.query_id")
def render_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _pruned(spark, sf_dir)
    return triples(p.edges, g.nodes)


@_query("json_relations", f"{_prune_sql(_BUDGET)} select k.query_id, i.src as source_id, 'vec_' || i.src as source, i.relation, i.dst as target_id, 'vec_' || i.dst as target, round(i.weight, 6) as weight from kept k join induced i on i.query_id = k.query_id and i.edge_id = k.id where kind = 1")
def json_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _pruned(spark, sf_dir)
    rows = json_payload(p.entities, p.edges, p.totals, g.nodes).select("query_id", F.explode("relations").alias("r")).select("query_id", "r.*")
    return rows.withColumn("weight", r6(F.col("weight").cast("double")))


@_query("render_json")
def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _pruned(spark, sf_dir)
    return json_text(json_payload(p.entities, p.edges, p.totals, g.nodes))


# mutation ---------------------------------------------------------------------------


def _upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten upserts of old names (one of them twice) and all labels as new ones."""
    e = read(spark, sf_dir, "embeddings")
    old = e.where("vec_id < 10").select(F.concat(F.lit(" vec_"), F.col("vec_id").cast("string"), F.lit(" ")).alias("name"), F.lit("again").alias("type"), F.when(F.col("vec_id") % 2 == 0, F.lit("")).otherwise(F.lit("new text")).alias("description"), F.lit(None).cast("array<float>").alias("embedding"), F.col("vec_id").alias("seq"))
    twice = e.where("vec_id = 4").select(F.lit("vec_4").alias("name"), F.lit("last").alias("type"), F.lit("last text").alias("description"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(99).cast("long").alias("seq"))
    new = e.groupBy("label").agg(F.min("vec_id").alias("v")).select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("name"), F.lit("label").alias("type"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<float>").alias("embedding"), (F.col("label") + 200).cast("long").alias("seq"))
    return old.unionByName(twice).unionByName(new)


@_query(
    "upsert_merge",
    f"""select node_id, name, case when node_id = 4 then 'last' when node_id < 10 then 'again' else type end as type,
      case when node_id = 4 then 'last text' when node_id < 10 and node_id % 2 = 1 then 'new text' end as description from {_N}
    union all select (select count(*) from embeddings) + row_number() over (order by label) - 1, 'label_' || label, 'label', null from (select distinct label from embeddings)""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mut.upsert_nodes(ring(spark, sf_dir), _upserts(spark, sf_dir)).nodes.select("node_id", "name", "type", "description")


@_query("upsert_trimmed", f"select node_id, name, case when node_id = 3 then 'new' else type end as type, case when node_id = 3 then 'a text' end as description from {_N}")
def upsert_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space around names, types and descriptions goes; what is left empty is null."""
    rows = spark.createDataFrame([("\tvec_3 ", " new\n", "  a text ", None, 1), (" vec_3", "new ", " \u2003a text\t", None, 2)], "name string, type string, description string, embedding array<float>, seq long")
    return mut.upsert_nodes(ring(spark, sf_dir), rows).nodes.select("node_id", "name", "type", "description")


@_query("vector_upsert", f"select vec_id, round(sqrt(list_dot_product({_V}, {_V})) * case when vec_id % 3 = 0 then 2 else 1 end, 5) as norm from embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors are replaced by their doubles."""
    g = ring(spark, sf_dir)
    changed = mut.put_vectors(g, g.vectors.where("node_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    return changed.vectors.select(F.col("node_id").alias("vec_id"), F.round(vx.norm(F.col("embedding")), 5).alias("norm"))


@_query("add_edge_validated", f"select edge_id, src, dst, relation, round(weight, 6) as weight from {_E} union all select (select max(edge_id) from {_E}) + row_number() over (order by vec_id), vec_id, label::bigint, 'HAS_LABEL', round(least(greatest(label / 4.0::double - 0.25::double, 0), 1), 6) from embeddings")
def add_edge_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), F.col("label").cast("long").alias("dst"), F.lit(" HAS_LABEL ").alias("relation"), (F.col("label") / 4.0 - 0.25).alias("weight"), F.lit(True).alias("directed"), F.col("vec_id").alias("seq"))
    edges = mut.add_edges(ring(spark, sf_dir), rows).edges
    return edges.select("edge_id", "src", "dst", "relation", r6(F.col("weight").cast("double")).alias("weight"))


@_query("remove_node_cascade", f"select 'node' as what, node_id as id from {_N} where node_id % 7 <> 0 union all select 'edge', edge_id from {_E} where src % 7 <> 0 and dst % 7 <> 0 union all select 'vector', vec_id from embeddings where vec_id % 7 <> 0")
def remove_node_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring(spark, sf_dir)
    left = mut.remove_nodes(g, g.nodes.where("node_id % 7 = 0"))
    kind = lambda df, what, key: df.select(F.lit(what).alias("what"), F.col(key).alias("id"))
    return kind(left.nodes, "node", "node_id").unionByName(kind(left.edges, "edge", "edge_id")).unionByName(kind(left.vectors, "vector", "node_id"))


@_query("remove_edge", f"select edge_id, src, dst from {_E} where edge_id % 5 <> 0")
def remove_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring(spark, sf_dir)
    return mut.remove_edges(g, g.edges.where("edge_id % 5 = 0")).edges.select("edge_id", "src", "dst")


@_query("soft_delete", f"select src as node_id, dst as neighbor, edge_id from {_E} where edge_id % 4 <> 0")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring(spark, sf_dir)
    return mut.set_edges_active(g, g.edges.where("edge_id % 4 = 0"), False).out_neighbors()


@_query("name_lookup", f"select q as query_id, node_id, name, type from {_N} join (values (1, 'vec_7'), (2, 'vec_123')) as w(q, w) on name = w")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring(spark, sf_dir)
    wanted = spark.createDataFrame([(1, " vec_7"), (2, "vec_123\t"), (3, "VEC_7")], "query_id int, name string")
    return g.nodes_by_names(wanted).join(g.nodes.select("node_id", "type"), "node_id").select("query_id", "node_id", "name", "type")


_FIRST = "select source as text, min(doc_id) as first_seq from documents group by source"


@_query("dictionary_ids", f"select text, row_number() over (order by first_seq, text) - 1 as string_id from ({_FIRST})")
def dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.dictionary(read(spark, sf_dir, "documents"), "source", "doc_id").select("text", "string_id")


@_query("dictionary_stats", "select count(*) as strings, sum(strlen(text))::bigint as total_bytes from (select distinct text from documents)")
def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.dictionary_stats(read(spark, sf_dir, "documents").select("text").distinct())


# resolution, storage, end to end ------------------------------------------------------


@_query("entity_resolution")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as entities, in order; the fold depends on order, so SQL has no form of it."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("seq"), F.concat(F.lit("entity_"), F.col("vec_id").cast("string")).alias("name"), F.col("label").cast("string").alias("type"), F.concat(F.lit("text "), (F.col("vec_id") % 17).cast("string")).alias("description"), "embedding")
    return resolve_entities(ring(spark, sf_dir).empty(spark), rows, ResolutionConfig(threshold=0.38))[1]


@_query("snapshot_roundtrip", f"select n.node_id, name, type, count(e.src) as degree, round(min(list_dot_product({_V}, {_V})), 6) as norm_squared from {_N} n join embeddings on vec_id = n.node_id left join {_E} e on e.src = n.node_id group by 1, 2, 3")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/snapshot-{spark.sparkContext.applicationId}"
    snapshot.save(ring(spark, sf_dir), path, _RING_CONFIG)
    g = snapshot.load(spark, path, _RING_CONFIG)
    return g.nodes.select("node_id", "name", "type").join(g.out_degree(), "node_id").join(g.vectors, "node_id").select("node_id", "name", "type", "degree", r6(vx.norm_squared(F.col("embedding"))).alias("norm_squared"))


def _file(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}.graph"
    graph_file.write_graph(ring(spark, sf_dir), path, 64)
    return path


@_query("graph_file_nodes", f"select node_id, name, type, true as active, count(e.src) as degree from {_N} n left join {_E} e on e.src = n.node_id group by all")
def graph_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one file and read back."""
    g = graph_file.read_graph(spark, _file(spark, sf_dir))
    return g.nodes.join(g.out_degree(), "node_id").select("node_id", "name", "type", "active", "degree")


@_query("graph_file_edges", f"select edge_id, src, dst, relation, round(weight, 5) as weight from {_E}")
def graph_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_file.read_section(spark, _file(spark, sf_dir), "edges").select("edge_id", "src", "dst", "relation", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@_query("graph_file_vectors", f"select vec_id as node_id, array_to_string(data, ',') as data, round(scale::double, 6) as scale, round(norm::double, 6) as norm from {_Q8}")
def graph_file_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_file.read_section(spark, _file(spark, sf_dir), "vectors")
    return rows.select("node_id", F.array_join(F.col("data").cast("array<string>"), ",").alias("data"), r6(F.col("scale").cast("double")).alias("scale"), r6(F.col("norm").cast("double")).alias("norm"))


@_query("graph_file_strings", f"select text from (select name as text from {_N} union select type from {_N} union select relation from {_E}) where text is not null")
def graph_file_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_file.read_section(spark, _file(spark, sf_dir), "strings").select("text")


@_query(
    "graph_file_checksum",
    f"""select 64 + 8 + 32 * n + 8 + 8 * (n + 1) + 32 * m + 8 + (64 + 8) * n + 4 + 4 * (k + 1) + bytes as length, true as sound from (
      select (select count(*) from {_N}) as n, (select count(*) from {_E}) as m, count(*) as k, sum(strlen(text))::bigint as bytes from (select name as text from {_N} union select type from {_N} union select relation from {_E}))""",
)
def graph_file_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's length by its layout, and whether the checksum in its header is that of its bytes."""
    path = _file(spark, sf_dir)
    stored = spark.read.format("binaryFile").load(path).select(F.conv(F.concat(*[F.hex(F.expr(f"substring(content, {graph_file.CHECKSUM_AT + i}, 1)")) for i in (4, 3, 2, 1)]), 16, 10).cast("long").alias("stored"))
    return graph_file.file_checksums(spark, path).join(stored, F.lit(True)).select("length", (F.col("checksum") == F.col("stored")).alias("sound"))


def _retrieved(spark: SparkSession, sf_dir: str, where: str = _ASKED):
    asked = read(spark, sf_dir, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), "embedding")
    return Engine(ring(spark, sf_dir), _RING_CONFIG).retrieve(asked, QueryOptions(max_tokens=200))


_KNN_SEEDS = f"(select query_id, node_id, score, pos from ({_knn_sql(Metric.COSINE, _ASKED, 5).replace('round(score, 6)', 'score')})) as seeds"


@_query("retrieve_scored", f"select {_SCORED} from ({_scored_sql(_HYBRID, TraversalConfig(2, 0.2, 100), _KNN_SEEDS)})")
def retrieve_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _retrieved(spark, sf_dir).scored_entities
    return found.select("query_id", "node_id", *[F.round(c, 9).alias(c) for c in ("final_score", "vector_score", "graph_score")], "depth", "rank", _no_edge(), F.col("place").cast("long").alias("place"))


@_query("retrieve_markdown", f"{_prune_sql(200, _scored_sql(_HYBRID, TraversalConfig(2, 0.2, 100), _KNN_SEEDS))} select query_id, {_TITLE} || string_agg(line, '' order by source, kind, seq) as text from kept group by query_id")
def retrieve_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: the context of a batch of query vectors."""
    return _retrieved(spark, sf_dir, _ASKED).markdown()
