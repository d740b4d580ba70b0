import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import vectors as vx
from weftgraph.operators.knn import knn, min_score, top_k
from weftgraph.plans.config import DimensionMismatch, Metric


def pairs(spark, a, b):
    return spark.createDataFrame([(i, [float(v) for v in x], [float(v) for v in y]) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<float>, b array<float>")


def test_metrics(spark):
    df = pairs(spark, [[1, 2, 3], [0, 0, 0]], [[4, 5, 6], [1, 1, 1]])
    rows = df.orderBy("i").select(vx.dot(F.col("a"), F.col("b")), vx.cosine(F.col("a"), F.col("b")), vx.norm(F.col("b")), vx.normalized(F.col("a"))).collect()
    assert rows[0][0] == 32.0
    assert rows[0][1] == pytest.approx(32 / np.sqrt(14 * 77))
    assert rows[1][1] == 0.0 and list(rows[1][3]) == [0.0, 0.0, 0.0]
    flat = pairs(spark, [[1, 2]], [[4, 6]]).select(vx.euclidean(F.col("a"), F.col("b")), vx.manhattan(F.col("a"), F.col("b"))).first()
    assert (flat[0], flat[1]) == (5.0, 7.0)


def test_columns_agree_with_arrays(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 65)).astype(np.float32), rng.normal(size=(40, 65)).astype(np.float32)
    df = pairs(spark, a, b).orderBy("i")
    got = np.array([list(r) for r in df.select(*[vx.distance_or_similarity(m, F.col("a"), F.col("b")) for m in Metric]).collect()])
    x, y = a.astype(float), b.astype(float)
    want = np.stack([(x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), (x * y).sum(1), np.sqrt(((x - y) ** 2).sum(1)), np.abs(x - y).sum(1)], 1)
    assert np.abs(got - want).max() < 1e-9


def test_eight_bit_accuracy(spark):
    rng = np.random.default_rng(42)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = unit(rng.normal(size=(200, 384))), unit(rng.normal(size=(200, 384)))
    df = pairs(spark, a, b).withColumn("q", vx.sq8_quantize(F.col("b"))).withColumn("qa", vx.sq8_quantize(F.col("a")))
    rows = df.select(vx.cosine(F.col("a"), F.col("b")).alias("exact"), vx.sq8_cosine(F.col("a"), F.col("q")).alias("near"), vx.sq8_dot_symmetric(F.col("qa"), F.col("q")).alias("both"), vx.sq8_bytes(F.col("q")).alias("bytes")).toPandas()
    error = (rows.exact - rows.near).abs()
    assert error.mean() < 0.008 and error.max() < 0.025
    assert (rows.exact - rows.both).abs().max() < 0.03
    assert set(rows.bytes) == {392}


def test_eight_bit_codes(spark):
    df = pairs(spark, [[0.0] * 4, [1.0, -0.5, 0.25, 0.0]], [[0.0] * 4] * 2)
    rows = df.orderBy("i").select(vx.sq8_quantize(F.col("a")).alias("q")).select("q.*", vx.sq8_dequantize(F.col("q")).alias("back")).collect()
    assert list(rows[0].data) == [0] * 4 and rows[0].scale == rows[0].norm == 0.0
    assert list(rows[1].data) == [127, -64, 32, 0]  # halves away from zero
    assert np.abs(np.array(rows[1].back) - [1, -0.5, 0.25, 0]).max() < 0.02


def test_knn_small(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0, 0.0])], "node_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.node_id for r in knn(vectors, queries, 2).orderBy("pos").collect()] == [1, 3]
    assert knn(vectors, queries, 9).count() == 3
    assert knn(vectors, queries, 0).count() == 0
    with pytest.raises(DimensionMismatch):
        knn(vectors, queries, 1, dim=5)
    line = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, [0.0, 10.0])], "node_id long, embedding array<float>")
    origin = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.score for r in knn(line, origin, 3, Metric.EUCLIDEAN).orderBy("pos").collect()] == [0.0, 3.0, 10.0]


@pytest.mark.parametrize("metric", list(Metric))
def test_knn_ways_agree(spark, monkeypatch, metric):
    from weftgraph.operators import knn as module

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 12)).astype(np.float32)
    x[7] = x[90]  # a tie
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<float>")
    queries = vectors.where("node_id < 20").withColumnRenamed("node_id", "query_id")
    take = lambda: [tuple(r) for r in knn(vectors, queries, 4, metric).orderBy("query_id", "pos").select("query_id", "node_id").collect()]
    sent = take()
    monkeypatch.setattr(module, "COLUMN_QUERIES", 100)
    assert take() == sent
    monkeypatch.setattr(module, "COLUMN_QUERIES", 1)
    monkeypatch.setattr(module, "BROADCAST_COMPONENTS", 1)
    monkeypatch.setattr(module, "SHARD_VECTORS", 50)
    monkeypatch.setattr(module, "BLOCK_QUERIES", 7)
    assert take() == sent


def test_eight_bit_recall(spark):
    rng = np.random.default_rng(1337)
    x = rng.normal(size=(500, 384))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<float>")
    queries = vectors.where("node_id < 16").withColumnRenamed("node_id", "query_id")
    exact = {(r.query_id, r.node_id) for r in knn(vectors, queries, 10).collect()}
    near = {(r.query_id, r.node_id) for r in knn(vectors.withColumn("embedding", vx.sq8_quantize(F.col("embedding"))), queries, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.95


def test_top_k(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([0.4, 0.9, 0.8, 0.2, 0.7])], "g int, node_id int, s double")
    best = top_k(df, ["g"], 3, "s")
    assert [r.node_id for r in best.orderBy("pos").collect()] == [1, 2, 4]
    assert min_score(best, ["g"], "s").first().min_score == 0.7
