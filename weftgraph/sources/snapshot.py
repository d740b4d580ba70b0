"""Versioned, checksummed snapshots of a graph as Parquet tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import EDGES, NODES, VECTORS, ChecksumMismatch, EngineConfig, Metric, Quantization, SnapshotCorrupt, UnsupportedVersion

FORMAT_VERSION = 1
_TABLES = {"nodes": NODES, "edges": EDGES, "vectors": VECTORS, "edges_by_dst": EDGES}


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Written beside, then renamed over, so readers see the old or the new content."""
    jvm = spark.sparkContext._jvm
    where, _ = _files(spark, path)
    beside, fs = _files(spark, path + ".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(data))
    out.hsync()
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(where), options)


def _read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def content_hash(df: DataFrame) -> tuple[int, int]:
    """(rows, a hash of the rows that no order changes)."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row.n, int(row.h) % (1 << 64)


def save(graph: PropertyGraph, path: str, config: EngineConfig, buckets: int | None = None, ingested: dict[str, int] | None = None) -> int:
    """Writes a new version and points CURRENT at it; returns the version.

    Edges are written in ranges of src, sorted by (src, edge_seq), so that a point
    look-up or a frontier's join reads few row groups. Vectors stay FLOAT; with
    SQ8 their eight-bit form can be derived at any time. Edges are written twice, in
    ranges of src and of dst, so that both directions are read by ranges.
    ingested: the last number of each source that the graph holds.
    """
    spark = graph.nodes.sparkSession
    current = _read_text(spark, f"{path}/CURRENT")
    version = int(current) + 1 if current else 1
    folder = f"{path}/v={version}"
    by = lambda df, *keys: (df.repartitionByRange(buckets, *keys[:1]) if buckets else df.repartitionByRange(*keys[:1])).sortWithinPartitions(*keys)
    frames = {"nodes": by(graph.nodes, "node_id"), "edges": by(graph.edges, "src", "edge_seq"), "vectors": by(graph.vectors, "node_id"), "edges_by_dst": by(graph.edges, "dst", "edge_seq")}
    manifest: dict[str, Any] = {"format": FORMAT_VERSION, "dim": config.dim, "metric": config.metric.value, "quantization": config.quantization.value, "ingested": ingested or {}, "tables": {}}
    for name, df in frames.items():
        df.select(*[F.col(f.name).cast(f.dataType) for f in _TABLES[name]]).write.mode("overwrite").parquet(f"{folder}/{name}")
        n, h = content_hash(spark.read.schema(_TABLES[name]).parquet(f"{folder}/{name}"))
        manifest["tables"][name] = {"rows": n, "hash": h}
    write_bytes(spark, f"{folder}/MANIFEST.json", json.dumps(manifest).encode())
    write_bytes(spark, f"{path}/CURRENT", str(version).encode())
    return version


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any] | None:
    """The manifest of a version (default: the current one); None where there is no snapshot."""
    current = _read_text(spark, f"{path}/CURRENT")
    if current is None and version is None:
        return None
    number = version or int(current)
    text = _read_text(spark, f"{path}/v={number}/MANIFEST.json")
    if text is None:
        raise SnapshotCorrupt(f"version {number} has no manifest")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise SnapshotCorrupt(f"the manifest of version {number} is no JSON") from e
    if found.get("format") != FORMAT_VERSION:
        raise UnsupportedVersion(f"format {found.get('format')}, this reads {FORMAT_VERSION}")
    return found | {"version": number}


def load(spark: SparkSession, path: str, config: EngineConfig | None = None, version: int | None = None, verify: bool = True) -> PropertyGraph | None:
    """The graph of a version, or None where there is none. Wrong contents and another dim or metric are errors."""
    found = manifest(spark, path, version)
    if found is None:
        return None
    if config is not None and (found["dim"], found["metric"]) != (config.dim, config.metric.value):
        raise SnapshotCorrupt(f"the snapshot has dim {found['dim']} and metric {Metric(found['metric']).name}, not {config.dim} and {config.metric.name}")
    frames = {}
    for name, schema in _TABLES.items():
        if name not in found["tables"]:  # written before this table was
            frames[name] = None
            continue
        frames[name] = spark.read.schema(schema).parquet(f"{path}/v={found['version']}/{name}")
        if verify:
            n, h = content_hash(frames[name])
            facts = found["tables"][name]
            if (n, h) != (facts["rows"], facts["hash"]):
                raise ChecksumMismatch(facts["hash"], h)
    by_dst = frames.pop("edges_by_dst")
    return PropertyGraph(**frames, edges_by_dst=by_dst)


def quantization(found: dict[str, Any]) -> Quantization:
    return Quantization(found["quantization"])


def crc32(content: Column) -> Column:
    """IEEE CRC-32 of a binary column."""
    return F.crc32(content)
