"""The whole retrieval for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions.text import TokenCounter, heuristic_tokens
from weftgraph.functions.vectors import sq8_quantize
from weftgraph.operators import mutation, resolution
from weftgraph.operators.graph import PropertyGraph
from weftgraph.operators.knn import knn
from weftgraph.operators.pruning import Pruned, prune
from weftgraph.operators.rendering import json_payload, json_text, markdown, triples
from weftgraph.operators.scoring import Subgraph, extract_subgraph
from weftgraph.plans.config import EngineConfig, MarkdownConfig, QueryOptions, Quantization, ResolutionConfig
from weftgraph.plans.materialize import materialized
from weftgraph.sources import snapshot


@dataclass(frozen=True)
class Retrieval:
    """What a batch of queries found: DataFrames keyed by query_id. Texts, payloads and totals have a row for every query asked."""

    subgraph: Subgraph
    pruned: Pruned
    nodes: DataFrame
    options: QueryOptions
    asked: DataFrame
    budget: int

    @property
    def scored_entities(self) -> DataFrame:
        """The ranking before pruning."""
        return self.subgraph.entities

    def _texts(self, found: DataFrame) -> DataFrame:
        """A query that found nothing has an empty text."""
        return self.asked.join(found, "query_id", "left").select("query_id", F.coalesce("text", F.lit("")).alias("text"))

    def totals(self) -> DataFrame:
        """query_id, total_tokens, budget, entity_count, edge_count; zeros where nothing was found."""
        zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
        joined = self.asked.join(self.pruned.totals.drop("budget"), "query_id", "left")
        return joined.select("query_id", zero("total_tokens"), F.lit(self.budget).alias("budget"), zero("entity_count"), zero("edge_count"))

    def markdown(self) -> DataFrame:
        return self._texts(markdown(self.pruned.entities, self.pruned.edges, self.nodes, MarkdownConfig(style=self.options.markdown_style)))

    def triples(self) -> DataFrame:
        return self._texts(triples(self.pruned.edges, self.nodes))

    def payload(self) -> DataFrame:
        return json_payload(self.pruned.entities, self.pruned.edges, self.totals(), self.nodes)

    def json(self) -> DataFrame:
        return json_text(self.payload())


class Engine:
    """A graph with a configuration. Mutations replace the graph; with auto_flush and a path they are saved."""

    def __init__(self, graph: PropertyGraph, config: EngineConfig = EngineConfig(), path: str | None = None, counter: TokenCounter = heuristic_tokens) -> None:
        self.graph, self.config, self.path, self.counter, self.dirty = graph, config, path, counter, False
        self.ingested: dict[str, int] = {}

    @classmethod
    def in_memory(cls, spark: SparkSession, config: EngineConfig = EngineConfig(), **options) -> Engine:
        return cls(PropertyGraph.empty(spark), config, **options)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), **options) -> Engine:
        found = snapshot.load(spark, path, config)
        engine = cls(PropertyGraph.empty(spark) if found is None else found, config, path, **options)
        if found is not None:
            engine.ingested = dict(snapshot.manifest(spark, path).get("ingested", {}))
        if found is None:
            engine.dirty = True
            if config.auto_flush:
                engine.flush()
        return engine

    # mutation --------------------------------------------------------------------

    def _changed(self, graph: PropertyGraph) -> None:
        self.graph, self.dirty = graph, True
        if self.path and self.config.auto_flush:
            self.flush()

    def flush(self) -> int | None:
        """Saves what has changed; nothing where there is no path or no change. The graph is re-read, which cuts its lineage."""
        if not self.path or not self.dirty:
            return None
        version = snapshot.save(self.graph, self.path, self.config, ingested=self.ingested)
        self.graph, self.dirty = snapshot.load(self.graph.nodes.sparkSession, self.path, self.config, verify=False), False
        return version

    def upsert_nodes(self, rows: DataFrame) -> None:
        self._changed(mutation.upsert_nodes(self.graph, rows, self.config.dim))

    def add_edges(self, rows: DataFrame, ingested: dict[str, int] | None = None) -> None:
        """ingested: numbers of the batches, by source, that are saved with these edges."""
        graph = mutation.add_edges(self.graph, rows)
        self.ingested |= ingested or {}
        self._changed(graph)

    def remove_nodes(self, ids: DataFrame) -> None:
        self._changed(mutation.remove_nodes(self.graph, ids))

    def remove_edges(self, ids: DataFrame) -> None:
        self._changed(mutation.remove_edges(self.graph, ids))

    def upsert_resolved(self, rows: DataFrame, config: ResolutionConfig = ResolutionConfig(), by_type: bool = False) -> DataFrame:
        graph, results = resolution.resolve_entities(self.graph, rows, config, self.config.metric, by_type, self.config.dim)
        self._changed(graph)
        return results

    def clear(self) -> None:
        """An empty graph; earlier versions of a snapshot stay."""
        self._changed(PropertyGraph.empty(self.graph.nodes.sparkSession))

    def stats(self) -> DataFrame:
        return self.graph.stats()

    # retrieval -------------------------------------------------------------------

    def searchable(self) -> DataFrame:
        """Vectors of active nodes, eight-bit where so configured."""
        live = self.graph.vectors.join(self.graph.active_nodes().select("node_id"), "node_id", "left_semi")
        return live.withColumn("embedding", sq8_quantize(F.col("embedding"))) if self.config.quantization is Quantization.SQ8 else live

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn(self.searchable(), queries, k, self.config.metric, self.config.dim)

    def retrieve(self, queries: DataFrame, options: QueryOptions = QueryOptions()) -> Retrieval:
        """queries: query_id, embedding."""
        return self._from_seeds(self.search(queries, options.top_k_seeds), options, queries)

    def retrieve_by_names(self, names: DataFrame, options: QueryOptions = QueryOptions()) -> Retrieval:
        """names: query_id, name, pos. Every name that a node has is a seed of score 1; others are ignored."""
        seeds = self.graph.nodes_by_names(names).select("query_id", "node_id", F.lit(1.0).alias("score"), "pos")
        return self._from_seeds(seeds, options, names)

    def _from_seeds(self, seeds: DataFrame, options: QueryOptions, queries: DataFrame) -> Retrieval:
        found = extract_subgraph(self.graph.nodes, self.graph.edges, materialized(seeds), options.traversal(self.config), options.scoring(self.config), self.graph.edges_by_dst)
        budget = options.budget(self.config)
        kept = prune(found, self.graph.nodes, budget, self.counter)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id")).distinct()
        return Retrieval(found, kept, self.graph.nodes, options, asked, budget)
