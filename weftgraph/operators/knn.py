"""Exact nearest neighbours, for one query vector or a batch of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.functions.vectors import distance_or_similarity, sq8_dequantize, sq8_metric
from weftgraph.operators.best import Batch, Best, fewer_copies
from weftgraph.plans.config import DimensionMismatch, Metric

#: Above so many queries columns give way to matrix products.
COLUMN_QUERIES = 16
#: Query vectors go to all tasks up to so many components in all (64 MB of doubles), and up to as many as a block has.
BROADCAST_COMPONENTS = 8_000_000
#: Both sides of a cell at most; fewer where vectors are long.
SHARD_VECTORS, BLOCK_QUERIES, SHARD_COMPONENTS, BLOCK_COMPONENTS = 65_536, 16_384, 16_000_000, 4_000_000
_FOUND = "query_id long, node_id long, score double"


def top_k(df: DataFrame, group: list[str], k: int, score: str, ascending: bool = False, tie: str = "node_id", rank: str = "pos") -> DataFrame:
    """The k best rows of each group, with their rank from 0; ties go to the smaller tie column."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(order, tie))).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


def min_score(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """The least of the kept scores of each group."""
    return df.groupBy(*group).agg(F.min(score).alias("min_score"))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist())


def _columns(pdf: pd.DataFrame) -> tuple[np.ndarray | None, ...]:
    """ids, vectors or codes, and of codes scale and norm."""
    quantized = "scale" in pdf.columns
    return pdf["node_id"].to_numpy(), _matrix(pdf["embedding"]), *((pdf[c].to_numpy(np.float64) if quantized else None) for c in ("scale", "norm"))


def _rows(query_ids: np.ndarray, best: Best) -> pd.DataFrame:
    row, ids, scores = best.found()
    return pd.DataFrame({"query_id": query_ids[row], "node_id": ids, "score": scores})


def _streamed(vectors: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int, metric: Metric) -> DataFrame:
    """All queries go to all tasks; each keeps k rows a query over all that it reads."""
    sent = vectors.sparkSession.sparkContext.broadcast((query_ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, asked = sent.value
        best = Best(metric, asked, k)
        for pdf in batches:
            if len(pdf):
                best.see(Batch.of(metric, k, *_columns(pdf)))
        yield _rows(names, best)

    return vectors.mapInPandas(run, _FOUND)


def search_all(vectors: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int, metric: Metric) -> DataFrame:
    """As `knn`, for a bounded number of queries that the driver holds."""
    return top_k(_streamed(vectors, query_ids, q, k, metric), ["query_id"], k, "score", metric.is_distance)


def _in_cells(vectors: DataFrame, keys: DataFrame, k: int, metric: Metric, asked: int, dim: int) -> DataFrame:
    """Both sides are packed, a row for each shard of vectors and block of queries; every pair of these meets in one task."""
    n, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // min(SHARD_VECTORS, max(1024, SHARD_COMPONENTS // dim))))
    blocks = -(-asked // min(BLOCK_QUERIES, max(1024, BLOCK_COMPONENTS // dim)))
    blocks = max(blocks, min(-(-3 * cores // shards), -(-asked // 1024)))

    def of_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, scale, norm = fewer_copies(k, *_columns(pdf))
        parts = {"ids": ids.astype(np.int64), "x": x, "scale": scale, "norm": norm}
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "kind": [x.dtype.str], **{c: [None if v is None else v.tobytes()] for c, v in parts.items()}})

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "query_ids": [pdf["query_id"].to_numpy(np.int64).tobytes()], "q": [_matrix(pdf["q"]).astype(np.float64).tobytes()]})

    def meet(own: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(against):
            return pd.DataFrame({"query_id": [], "node_id": [], "score": []})
        v, a = own.iloc[0], against.iloc[0]
        ids, query_ids = np.frombuffer(v["ids"], np.int64), np.frombuffer(a["query_ids"], np.int64)
        scale, norm = (None if v[c] is None else np.frombuffer(v[c], np.float64) for c in ("scale", "norm"))
        best = Best(metric, np.frombuffer(a["q"], np.float64).reshape(len(query_ids), -1), k)
        best.see(Batch.of(metric, k, ids, np.frombuffer(v["x"], v["kind"]).reshape(len(ids), -1), scale, norm, fewer=False))
        return _rows(query_ids, best)

    spread = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("node_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(of_shard, "shard int, kind string, ids binary, x binary, scale binary, norm binary")
    right = keys.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(of_block, "block int, query_ids binary, q binary")
    left = left.select("*", spread("block", blocks)).repartition(shards * blocks, "shard", "block")
    right = right.select("*", spread("shard", shards)).repartition(shards * blocks, "shard", "block")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, _FOUND)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.COSINE, dim: int | None = None) -> DataFrame:
    """query_id, node_id, score, pos (from 0): the k nearest vectors of each query, all vectors compared.

    vectors: node_id, embedding (array<float>, or the eight-bit struct). queries:
    query_id, embedding. The number of queries is counted first: few are compared
    as columns, more as matrix products with the queries sent to all tasks (each
    task keeps k of its own per query before the shuffle), and beyond the size
    bound both sides are dealt into packed cells that meet by an equi-join. All
    pairs are compared, so time grows with queries times vectors; memory of a task
    does not. Distances ascend, similarities descend; ties go to the smaller
    node_id. Eight-bit cosines go by the norm of the original vector whatever the
    number of queries.
    """
    quantized = vectors.schema["embedding"].dataType.typeName() == "struct"
    facts = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("most"), F.min(F.size("embedding")).alias("least")).first()
    if k <= 0 or not facts.n:
        return vectors.sparkSession.createDataFrame([], "query_id long, node_id long, score double, pos int")
    if dim is not None and (facts.least != dim or facts.most != dim):
        raise DimensionMismatch(dim, facts.least if facts.least != dim else facts.most)
    keys = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    if facts.n <= COLUMN_QUERIES:
        pair = vectors.join(F.broadcast(keys), F.lit(True))  # at most COLUMN_QUERIES rows, counted above
        score = sq8_metric(metric, F.col("q"), F.col("embedding")) if quantized else distance_or_similarity(metric, F.col("q"), F.col("embedding"))
        found = pair.select("query_id", "node_id", score.alias("score"))
        return top_k(found, ["query_id"], k, "score", metric.is_distance)
    if quantized and metric in (Metric.COSINE, Metric.DOT):
        vectors = vectors.select("node_id", F.col("embedding.data").alias("codes"), F.col("embedding.scale").cast("double").alias("scale"), F.col("embedding.norm").cast("double").alias("norm")).withColumnRenamed("codes", "embedding")
    else:
        vectors = vectors.select("node_id", (sq8_dequantize(F.col("embedding")) if quantized else F.col("embedding")).alias("embedding"))
    if facts.n <= BLOCK_QUERIES and facts.n * facts.most <= BROADCAST_COMPONENTS:
        rows = keys.collect()
        found = _streamed(vectors, np.array([r.query_id for r in rows]), np.array([r.q for r in rows], np.float64), k, metric)
    else:
        found = _in_cells(vectors, keys, k, metric, facts.n, max(1, facts.most))
    return top_k(found, ["query_id"], k, "score", metric.is_distance)
