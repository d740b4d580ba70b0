"""Candidates by products in single precision, scored in double, beside scores of every pair, component by component."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import vectors as vx
from weftgraph.operators import knn as module
from weftgraph.operators.best import Batch, Best
from weftgraph.plans.config import Metric


def plain_best(metric, q, ids, x, k):
    """ids of the k best rows of x for each of q, ties by the smaller id."""
    out = []
    for v in np.asarray(q, float):
        total, size = np.zeros(len(x)), np.zeros(len(x))
        for a, b in zip(v, np.asarray(x, float).T):
            total += a * b if metric in (Metric.COSINE, Metric.DOT) else (a - b) ** 2 if metric is Metric.EUCLIDEAN else np.abs(a - b)
            size += b * b
        if metric is Metric.COSINE:
            size = np.sqrt(sum(a * a for a in v) * size)
            total = np.where(size < 1e-12, 0.0, np.clip(total / np.where(size < 1e-12, 1.0, size), -1.0, 1.0))
        out.append(ids[np.lexsort((ids, total if metric.is_distance else -total))[:k]].tolist())
    return out


def rows_of(rng, kind, count, dim=8):
    x = rng.normal(size=(count, dim)).astype(np.float32)
    if kind == "ties":
        x = rng.integers(-1, 2, size=(count, dim)).astype(np.float32)
    if kind == "near":
        x = x[rng.integers(0, 9, count)] + (1e-7 * rng.normal(size=(count, dim))).astype(np.float32)
    if kind == "sizes":
        x *= np.exp(4 * rng.normal(size=(count, 1))).astype(np.float32)
    if kind == "zeros":
        x[rng.random(count) < 0.3] = 0
        x[:3] *= np.float32(1e-9)
    return x


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("kind", ["plain", "ties", "near", "sizes", "zeros"])
def test_candidates_hold_the_best(metric, kind):
    rng = np.random.default_rng(7)
    x, q, ids = rows_of(rng, kind, 3000), rows_of(rng, kind, 60), rng.permutation(3000)
    best = Best(metric, q, 3)
    for at in range(0, 3000, 1700):
        best.see(Batch.of(metric, 3, ids[at : at + 1700], x[at : at + 1700]))
    row, found, _ = best.found()
    assert [found[row == i].tolist() for i in range(60)] == plain_best(metric, q, ids, x, 3)


def test_few_pairs_are_scored_again(monkeypatch):
    """A common vector and a common query cost no more than a rare one, and most pairs are only products."""
    rng, scored = np.random.default_rng(8), []
    take = Best._take
    monkeypatch.setattr(Best, "_take", lambda self, rows, columns, batch: scored.append(len(rows)) or take(self, rows, columns, batch))
    x = rows_of(rng, "plain", 20_000, 16)
    x[::2] = x[0]
    best = Best(Metric.COSINE, x, 3)
    best.see(Batch.of(Metric.COSINE, 3, np.arange(20_000), x))
    assert sum(scored) < 20_000 * 20_000 / 1000


@pytest.mark.parametrize("metric", [Metric.COSINE, Metric.DOT])
def test_cells_of_codes(spark, monkeypatch, metric):
    """Every vector against all eight-bit ones in packed cells, as the columns have it; equal vectors lie in several shards."""
    rng = np.random.default_rng(9)
    x = rows_of(rng, "plain", 300)
    x[200:] = x[:100]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<float>")
    asked, codes = rows.withColumnRenamed("node_id", "query_id"), rows.withColumn("embedding", vx.sq8_quantize(F.col("embedding")))
    take = lambda: [tuple(r) for r in module.knn(codes, asked, 3, metric).orderBy("query_id", "pos").select("query_id", "node_id", "score").collect()]
    monkeypatch.setattr(module, "COLUMN_QUERIES", 1000)
    columns = take()
    monkeypatch.setattr(module, "COLUMN_QUERIES", 1)
    assert take() == columns
    monkeypatch.setattr(module, "BLOCK_QUERIES", 70)
    monkeypatch.setattr(module, "SHARD_VECTORS", 40)
    assert take() == columns and len(columns) == 900
