"""Connected components by min-label propagation with pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.common import dropped, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns of edges: a, b (long). Returns node, component (the smallest node reached).

    Each round takes the least label of each node and of its neighbours, then
    follows that label's own label, so long chains shrink geometrically. Labels
    are written in the shared folder after each round. The neighbours' labels
    are pre-aggregated, so a hub costs one partial minimum per task; the join of
    a hub's links with its one label row is split by adaptive execution.
    No edge, self loop or repeated edge changes the result; null ends are ignored.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = saved(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    written = labels
    while True:  # labels only fall, so this ends
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(seen, labels.node == seen.a, "left").select("node", F.least("component", "least").alias("next"), F.col("component").alias("old"))
        parent = labels.select(F.col("node").alias("p"), F.col("component").alias("pc"))
        step = step.join(parent, step.next == parent.p, "left").select("node", F.least("next", "pc").alias("component"), "old")
        step = saved(step, "labels")
        dropped(written)
        written, labels = step, step.select("node", "component")
        if step.where("component < old").isEmpty():
            dropped(both)
            return labels
