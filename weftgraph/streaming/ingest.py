"""Streaming ingest: micro-batches of nodes and edges go through the batch mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.plans.config import ResolutionConfig
from weftgraph.plans.retriever import Engine


def ingest_nodes(stream: DataFrame, engine: Engine, checkpoint: str, resolve: ResolutionConfig | None = None, **trigger) -> StreamingQuery:
    """Upserts each micro-batch (columns as upsert_nodes; as upsert_resolved with `resolve`).

    An upsert of the same batch twice gives the same graph, so a batch that is
    replayed after a failure does no harm. The engine should have a path and
    auto_flush, which also keeps the plan short.
    """

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if resolve is None:
            engine.upsert_nodes(batch)
        else:
            engine.upsert_resolved(batch, resolve)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_edges(stream: DataFrame, engine: Engine, checkpoint: str, source: str = "edges", **trigger) -> StreamingQuery:
    """Adds each micro-batch's edges once; parallel edges are kept.

    A batch is known by the source's name and its number, which a snapshot keeps:
    one that is replayed after a failure, having been saved, is left out. A stream
    with a new checkpoint folder starts a new count and needs a new source name.
    """

    def each(batch: DataFrame, number: int) -> None:
        if number > engine.ingested.get(source, -1):
            engine.add_edges(batch, {source: number})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
