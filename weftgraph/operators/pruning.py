"""Greedy pruning to a token budget, as one ordered fold per query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions.text import TokenCounter, heuristic_tokens, two_decimals
from weftgraph.operators.scoring import Subgraph
from weftgraph.plans.config import MarkdownConfig
from weftgraph.plans.materialize import materialized

#: Labels of nodes and relations that have no name.
ENTITY, RELATION, TARGET, OTHER_TARGET, SOURCE = "Entidade", "RELACAO", "Alvo", "Destino", "Origem"


def entity_line(name: Column, score: Column | None, word: str = "Relevância") -> Column:
    label = F.concat(F.lit("- ["), F.coalesce(name, F.lit(ENTITY)), F.lit("]"))
    return F.concat(label, F.lit("\n")) if score is None else F.concat(label, F.lit(f" ({word}: "), two_decimals(score), F.lit(")\n"))


def relation_line(relation: Column, target: Column, weight: Column | None) -> Column:
    label = F.concat(F.lit("  - "), F.coalesce(relation, F.lit(RELATION)), F.lit(" -> ["), F.coalesce(target, F.lit(TARGET)), F.lit("]"))
    return F.concat(label, F.lit("\n")) if weight is None else F.concat(label, F.lit(" (Confiança: "), two_decimals(weight), F.lit(")\n"))


def named_entities(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """entities with their node's name, looked up where they do not carry it."""
    return entities if "name" in entities.columns else entities.join(nodes.select("node_id", "name"), "node_id", "left")


def named_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_name and dst_name, looked up where they do not carry them."""
    for end in ("src", "dst"):
        if f"{end}_name" not in edges.columns:
            edges = edges.join(nodes.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name")), end, "left")
    return edges


@dataclass(frozen=True)
class Pruned:
    """What fits: entities and edges as in the subgraph, and totals (query_id, total_tokens, budget, entity_count, edge_count)."""

    entities: DataFrame
    edges: DataFrame
    totals: DataFrame


def prune(subgraph: Subgraph, nodes: DataFrame, budget: int, counter: TokenCounter = heuristic_tokens) -> Pruned:
    """Entities by rank until the first that does not fit; edges between accepted entities where they fit.

    An edge is due right after its later end, so a query's items have one order:
    (place of the later end, entity before edges, place of the source, edge_seq). The
    fold keeps the tokens spent, whether an entity has been refused, and what was
    accepted. Costs are those of the hierarchical lines under the fixed title. A
    query's items are at most its max_nodes entities and their edges.
    """
    spark = nodes.sparkSession
    title = spark.range(1).select(counter(F.lit(f"# {MarkdownConfig().title}:\n")).alias("n")).first().n
    item = "struct<later:int,kind:int,source:int,seq:long,id:long,cost:int>"
    shape = lambda later, kind, source, seq, key, cost: F.struct(later.cast("int").alias("later"), F.lit(kind).alias("kind"), source.cast("int").alias("source"), seq.cast("long").alias("seq"), key.cast("long").alias("id"), cost.cast("int").alias("cost")).cast(item).alias("item")
    own = named_entities(subgraph.entities, nodes).withColumn("line", entity_line(F.col("name"), F.col("final_score")))
    own = own.select("query_id", shape(F.col("place"), 0, F.col("place"), F.lit(0), F.col("node_id"), counter(F.col("line"))))
    links = named_ends(subgraph.edges, nodes).withColumn("line", relation_line(F.col("relation"), F.col("dst_name"), F.col("weight")))
    links = links.select("query_id", shape(F.greatest("src_place", "dst_place"), 1, F.col("src_place"), F.col("edge_seq"), F.col("edge_id"), counter(F.col("line"))))
    queries = own.select("query_id").distinct()
    if title >= budget:
        totals = queries.select("query_id", F.lit(0).alias("total_tokens"), F.lit(budget).alias("budget"), F.lit(0).alias("entity_count"), F.lit(0).alias("edge_count"))
        return Pruned(subgraph.entities.limit(0), subgraph.edges.limit(0), totals)
    state = lambda spent, stopped, taken: F.struct(spent.cast("long").alias("spent"), stopped.alias("stopped"), taken.alias("taken"))
    kept = "array<struct<kind:int,id:long>>"
    fits = lambda s, x: ~s["stopped"] & (s["spent"] + x["cost"] <= budget)
    fold = F.aggregate(
        F.array_sort(F.collect_list("item")),
        state(F.lit(title), F.lit(False), F.array().cast(kept)),
        lambda s, x: F.when(fits(s, x), state(s["spent"] + x["cost"], s["stopped"], F.concat(s["taken"], F.array(F.struct(x["kind"].alias("kind"), x["id"].alias("id")))))).otherwise(state(s["spent"], s["stopped"] | (x["kind"] == 0), s["taken"])),
    )
    folded = materialized(own.unionByName(links).groupBy("query_id").agg(fold.alias("s")))  # a row a query, read by what follows
    taken = folded.select("query_id", F.explode("s.taken").alias("t")).select("query_id", "t.kind", "t.id")
    entities = subgraph.entities.join(taken.where("kind = 0").select("query_id", F.col("id").alias("node_id")), ["query_id", "node_id"], "left_semi")
    edges = subgraph.edges.join(taken.where("kind = 1").select("query_id", F.col("id").alias("edge_id")), ["query_id", "edge_id"], "left_semi")
    count = lambda kind: F.size(F.filter("s.taken", lambda t: t["kind"] == kind))
    totals = folded.select("query_id", F.col("s.spent").cast("int").alias("total_tokens"), F.lit(budget).alias("budget"), count(0).alias("entity_count"), count(1).alias("edge_count"))
    return Pruned(entities, edges, totals)
