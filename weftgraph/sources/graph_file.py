"""The single-file binary format: reading many files in parallel, writing one.

Layout (fixed values): a header of 64 bytes, then nodes, edges by source (CSR),
eight-bit vectors and strings; all little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions.vectors import sq8_quantize
from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import ChecksumMismatch, InvalidConfig, Metric, SnapshotCorrupt, UnsupportedVersion
from weftgraph.sources.snapshot import write_bytes

#: Magic, version, flags, sizes, and the id that means "none".
MAGIC, VERSION, FLAG_SQ8 = b"GRPH", 1, 1
HEADER = struct.Struct("<4sHHHBBIIIQQQQI4x")
CHECKSUM_AT = 56
ACTIVE, DIRECTED, NONE = 1, 2, 0xFFFFFFFF
NO_VECTOR = 0xFFFFFFFFFFFFFFFF
NODE = np.dtype([("id", "<u4"), ("name", "<u4"), ("type", "<u4"), ("description", "<u4"), ("vector", "<u8"), ("flags", "<u4"), ("_", "<u4")])
EDGE = np.dtype([("id", "<u4"), ("src", "<u4"), ("dst", "<u4"), ("relation", "<u4"), ("weight", "<f4"), ("flags", "<u4"), ("_", "<u8")])


def vector_type(dim: int) -> np.dtype:
    return np.dtype([("scale", "<f4"), ("norm", "<f4"), ("data", "i1", (dim,))])


def checksum(data: bytes) -> int:
    """CRC-32 of the file without its own four bytes; of a shorter buffer, of all."""
    if len(data) < HEADER.size:
        return zlib.crc32(data)
    return zlib.crc32(data[CHECKSUM_AT + 4 :], zlib.crc32(data[:CHECKSUM_AT]))


@dataclass(frozen=True)
class Header:
    flags: int
    dim: int
    metric: int
    quantization: int
    nodes: int
    edges: int
    string_bytes: int
    node_at: int
    edge_at: int
    vector_at: int
    string_at: int
    checksum: int

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise SnapshotCorrupt(f"a header has {HEADER.size} bytes, this has {len(data)}")
        magic, version, *rest = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise SnapshotCorrupt(f"wrong magic bytes {magic!r}")
        if version != VERSION:
            raise UnsupportedVersion(f"version {version}, this reads {VERSION}")
        return cls(*rest)

    def packed(self) -> bytes:
        return HEADER.pack(MAGIC, VERSION, self.flags, self.dim, self.metric, self.quantization, self.nodes, self.edges, self.string_bytes, self.node_at, self.edge_at, self.vector_at, self.string_at, self.checksum)


def _array(data: bytes, at: int, kind: np.dtype, n: int) -> np.ndarray:
    if at + n * kind.itemsize > len(data):
        raise SnapshotCorrupt("a section ends beyond the file")
    return np.frombuffer(data, kind, n, at)


@dataclass(frozen=True)
class GraphFile:
    """The sections of one file as arrays."""

    header: Header
    nodes: np.ndarray
    offsets: np.ndarray
    edges: np.ndarray
    vectors: np.ndarray
    strings: list[str]

    @classmethod
    def parse(cls, data: bytes, verify: bool = True) -> GraphFile:
        head = Header.parse(data)
        if verify and checksum(data) != head.checksum:
            raise ChecksumMismatch(head.checksum, checksum(data))
        whole = lambda at, code: struct.unpack_from(code, data, at) if at + struct.calcsize(code) <= len(data) else (0,) * len(code[1:])
        (n,) = whole(head.node_at, "<I")
        nodes = _array(data, head.node_at + 8, NODE, n)
        slots, m = whole(head.edge_at, "<II")
        offsets = _array(data, head.edge_at + 8, np.dtype("<u8"), slots + 1)
        edges = _array(data, head.edge_at + 8 + 8 * (slots + 1), EDGE, m)
        count, dim = whole(head.vector_at, "<IH")
        vectors = _array(data, head.vector_at + 8, vector_type(dim), count)
        (k,) = whole(head.string_at, "<I")
        ends = _array(data, head.string_at + 4, np.dtype("<u4"), k + 1).tolist()
        base = head.string_at + 4 + 4 * (k + 1)
        if base + ends[-1] > len(data):
            raise SnapshotCorrupt("strings end beyond the file")
        try:
            strings = [data[base + a : base + b].decode() for a, b in zip(ends, ends[1:], strict=False)]
        except UnicodeDecodeError as e:
            raise SnapshotCorrupt("a string is not UTF-8") from e
        return cls(head, nodes, offsets, edges, vectors, strings)

    def text(self, i: int) -> str | None:
        return self.strings[i] if i != NONE and i < len(self.strings) else None


def _parsed(section: str, verify: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                f = GraphFile.parse(bytes(content), verify)
                if section == "nodes":
                    a = f.nodes
                    yield pd.DataFrame({"path": path, "node_id": a["id"].astype(np.int64), "name": [f.text(i) for i in a["name"]], "type": [f.text(i) for i in a["type"]], "description": [f.text(i) for i in a["description"]], "active": a["flags"] & ACTIVE > 0})
                elif section == "edges":
                    a = f.edges
                    yield pd.DataFrame({"path": path, "edge_id": a["id"].astype(np.int64), "src": a["src"].astype(np.int64), "dst": a["dst"].astype(np.int64), "relation": [f.text(i) for i in a["relation"]], "weight": a["weight"], "directed": a["flags"] & DIRECTED > 0, "active": a["flags"] & ACTIVE > 0, "edge_seq": a["id"].astype(np.int64)})
                elif section == "vectors":
                    # vector i belongs to the i-th node, in order of id, that has one
                    owners = np.sort(f.nodes["id"][f.nodes["vector"] != NO_VECTOR])[: len(f.vectors)].astype(np.int64)
                    v = f.vectors[: len(owners)]
                    yield pd.DataFrame({"path": path, "node_id": owners, "data": list(v["data"].astype(np.int8)), "scale": v["scale"], "norm": v["norm"]})
                else:
                    yield pd.DataFrame({"path": path, "string_id": np.arange(len(f.strings)), "text": f.strings})

    return run


_SECTIONS = {
    "nodes": "path string, node_id long, name string, type string, description string, active boolean",
    "edges": "path string, edge_id long, src long, dst long, relation string, weight float, directed boolean, active boolean, edge_seq long",
    "vectors": "path string, node_id long, data array<tinyint>, scale float, norm float",
    "strings": "path string, string_id long, text string",
}


def read_section(spark: SparkSession, path: str, section: str, verify: bool = True) -> DataFrame:
    """Rows of one section of every file at path, inactive records included; a task per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_parsed(section, verify), _SECTIONS[section])


def read_graph(spark: SparkSession, path: str, verify: bool = True) -> PropertyGraph:
    """One file as a graph with dequantised vectors."""
    nodes, edges, vectors = (read_section(spark, path, s, verify).drop("path") for s in ("nodes", "edges", "vectors"))
    plain = F.transform("data", lambda x: (x.cast("double") * F.col("scale")).cast("float"))
    return PropertyGraph(nodes, edges, vectors.select("node_id", plain.alias("embedding")))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, checksum of every file at path."""
    files = spark.read.format("binaryFile").load(path)
    rest = F.concat(F.substring("content", 1, CHECKSUM_AT), F.expr(f"substring(content, {CHECKSUM_AT + 5})"))
    return files.select("path", "length", F.crc32(F.when(F.col("length") >= HEADER.size, rest).otherwise(F.col("content"))).alias("checksum"))


def encode(nodes: list, edges: list, vectors: dict[int, tuple[list[int], float, float]], dim: int, metric: Metric = Metric.COSINE) -> bytes:
    """The bytes of a file. nodes and edges: rows of the tables; vectors: (data, scale, norm) by node id."""
    names: dict[str, int] = {}
    number = lambda s: NONE if s is None else names.setdefault(s, len(names))
    node_rows = np.zeros(len(nodes), NODE)
    for i, r in enumerate(sorted(nodes, key=lambda r: r["node_id"])):
        node_rows[i] = (r["node_id"], number(r["name"]), number(r["type"]), number(r["description"]), 0 if r["node_id"] in vectors else NO_VECTOR, ACTIVE * r["active"], 0)
    top = max((r["node_id"] for r in nodes), default=-1) + 1
    edge_rows = np.zeros(len(edges), EDGE)
    for i, r in enumerate(sorted(edges, key=lambda r: (r["src"], r["edge_seq"]))):
        edge_rows[i] = (r["edge_id"], r["src"], r["dst"], number(r["relation"]), r["weight"], ACTIVE * r["active"] | DIRECTED * r["directed"], 0)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(edge_rows["src"].astype(np.int64), minlength=top))]).astype("<u8") if top else np.zeros(1, "<u8")
    vector_rows = np.zeros(len(vectors), vector_type(dim))
    for i, key in enumerate(sorted(vectors)):
        data, scale, norm = vectors[key]
        vector_rows[i] = (scale, norm, data)
    texts = [s.encode() for s in names]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<u4")
    sections = [
        struct.pack("<I4x", len(nodes)) + node_rows.tobytes(),
        struct.pack("<II", len(offsets) - 1, len(edges)) + offsets.tobytes() + edge_rows.tobytes(),
        struct.pack("<IH2x", len(vectors), dim) + vector_rows.tobytes(),
        struct.pack("<I", len(texts)) + ends.tobytes() + b"".join(texts),
    ]
    at = [HEADER.size]
    for s in sections[:-1]:
        at.append(at[-1] + len(s))
    head = Header(FLAG_SQ8, dim, metric.value, 1, len(nodes), len(edges), len(sections[3]), *at, 0)
    data = head.packed() + b"".join(sections)
    total = checksum(data)
    return data[:CHECKSUM_AT] + struct.pack("<I", total) + data[CHECKSUM_AT + 4 :]


def write_graph(graph: PropertyGraph, path: str, dim: int, metric: Metric = Metric.COSINE, most: int = 5_000_000) -> int:
    """Writes the active part of a graph as one file, beside and then renamed; returns its bytes.

    The format is one sequence of bytes with 32-bit ids, so its rows go through the
    driver: more than `most` nodes or edges are an error (snapshots have no such
    limit). Vectors are quantised by the executors.
    """
    nodes, edges = graph.active_nodes(), graph.active_edges()
    n, m = nodes.count(), edges.count()
    if max(n, m) > most:
        raise InvalidConfig(f"{n} nodes and {m} edges are too many for one file; write a snapshot")
    vectors = graph.vectors.join(nodes.select("node_id"), "node_id", "left_semi").select("node_id", sq8_quantize(F.col("embedding")).alias("q")).select("node_id", "q.*")
    coded = {r.node_id: (list(r.data), r.scale, r.norm) for r in vectors.collect()}
    data = encode([r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()], coded, dim, metric)
    write_bytes(nodes.sparkSession, path, data)
    return len(data)
