"""Markdown, JSON and triples, one text per query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions.text import two_decimals
from weftgraph.operators.pruning import ENTITY, OTHER_TARGET, RELATION, SOURCE, TARGET, entity_line, named_ends, named_entities, relation_line
from weftgraph.plans.config import MarkdownConfig, MarkdownStyle


def _named(edges: DataFrame, nodes: DataFrame, target: str) -> DataFrame:
    """edges with source, target and label; what has no name gets its fallback."""
    rows = named_ends(edges, nodes)
    return rows.withColumn("source", F.coalesce("src_name", F.lit(SOURCE))).withColumn("target", F.coalesce("dst_name", F.lit(target))).withColumn("label", F.coalesce("relation", F.lit(RELATION)))


def _joined(lines: DataFrame, head: Column) -> DataFrame:
    """lines: query_id, o (a sortable struct), line."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"])
    return lines.groupBy("query_id").agg(F.concat(head, F.array_join(texts, "")).alias("text"))


def _order(*columns: Column) -> Column:
    return F.struct(*[c.cast("long").alias(f"o{i}") for i, c in enumerate(columns)]).alias("o")


def markdown(entities: DataFrame, edges: DataFrame, nodes: DataFrame, config: MarkdownConfig = MarkdownConfig()) -> DataFrame:
    """query_id, text; a query without entities has no row (its text is empty)."""
    named = named_entities(entities, nodes)
    score = F.col("final_score") if config.scores else None
    if config.style is MarkdownStyle.HIERARCHICAL:
        own = named.select("query_id", _order(F.col("place"), F.lit(0), F.lit(0)), entity_line(F.col("name"), score).alias("line"))
        shown = entities.select("query_id", F.col("node_id").alias("dst"))
        rows = _named(edges.drop("source", "target"), nodes, TARGET).join(shown, ["query_id", "dst"], "left_semi")
        links = rows.select("query_id", _order(F.col("src_place"), F.lit(1), F.col("edge_seq")), relation_line(F.col("label"), F.col("target"), F.col("weight") if config.weights else None).alias("line"))
        return _joined(own.unionByName(links), F.lit(f"# {config.title}:\n"))
    own = named.select("query_id", _order(F.lit(0), F.col("place"), F.lit(0)), entity_line(F.col("name"), score, "Score").alias("line"))
    rows = _named(edges, nodes, OTHER_TARGET)
    arrow = F.concat(F.lit(" ("), two_decimals(F.col("weight")), F.lit(")")) if config.weights else F.lit("")
    line = F.concat(F.lit("- ["), F.col("source"), F.lit("] --"), F.col("label"), arrow, F.lit("--> ["), F.col("target"), F.lit("]\n"))
    links = rows.select("query_id", _order(F.lit(2), F.col("src_place"), F.col("edge_seq")), line.alias("line"))
    head = rows.select("query_id").distinct().select("query_id", _order(F.lit(1), F.lit(0), F.lit(0)), F.lit("\n## Relações Estruturais:\n").alias("line"))
    shown = entities.select("query_id").distinct()
    lines = own.unionByName(head.join(shown, "query_id", "left_semi")).unionByName(links.join(shown, "query_id", "left_semi"))
    return _joined(lines, F.lit(f"# {config.title}:\n\n## Entidades:\n"))


def triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, text: a line (source, relation, target) per edge, in order of source and edge_seq."""
    rows = _named(edges, nodes, OTHER_TARGET)
    line = F.concat(F.lit("("), F.col("source"), F.lit(", "), F.col("label"), F.lit(", "), F.col("target"), F.lit(")\n"))
    return _joined(rows.select("query_id", _order(F.col("src_place"), F.col("edge_seq")), line.alias("line")), F.lit(""))


def json_payload(entities: DataFrame, edges: DataFrame, totals: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, entities (id, name, score), relations (source_id, source, relation, target_id, target, weight), total_tokens, budget."""
    named = named_entities(entities, nodes)
    own = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("node_id").alias("id"), F.coalesce("name", F.lit(ENTITY)).alias("name"), F.col("final_score").cast("float").alias("score")).alias("v")))).alias("e"))
    rows = _named(edges, nodes, OTHER_TARGET)
    links = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("src_place", "edge_seq", F.struct(F.col("src").alias("source_id"), "source", F.col("label").alias("relation"), F.col("dst").alias("target_id"), "target", F.col("weight").cast("float").alias("weight")).alias("v")))).alias("r"))
    plain = lambda c: F.transform(c, lambda x: x["v"])
    entity, relation = "array<struct<id:bigint,name:string,score:float>>", "array<struct<source_id:bigint,source:string,relation:string,target_id:bigint,target:string,weight:float>>"
    return totals.join(own, "query_id", "left").join(links, "query_id", "left").select("query_id", F.coalesce(plain("e"), F.array().cast(entity)).alias("entities"), F.coalesce(plain("r"), F.array().cast(relation)).alias("relations"), "total_tokens", "budget")


def json_text(payload: DataFrame) -> DataFrame:
    """query_id, text: indented JSON with the shortest decimals of single-precision numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import numpy as np

        short = lambda x: None if x is None else float(str(np.float32(x)))
        for pdf in batches:
            texts = []
            for _, row in pdf.iterrows():
                entities = [{**dict(e), "score": short(e["score"])} for e in row["entities"]]
                relations = [{**dict(r), "weight": short(r["weight"])} for r in row["relations"]]
                whole = {"entities": entities, "relations": relations, "total_tokens": int(row["total_tokens"]), "budget": int(row["budget"])}
                texts.append(json.dumps(whole, indent=2, ensure_ascii=False))
            yield pd.DataFrame({"query_id": pdf["query_id"], "text": texts})

    return payload.mapInPandas(run, "query_id long, text string")
