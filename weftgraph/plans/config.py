"""Schemas, enums, configurations and errors."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import types as T

NODES = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("description", T.StringType()), T.StructField("active", T.BooleanType())])
EDGES = T.StructType([T.StructField("edge_id", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("relation", T.StringType()), T.StructField("weight", T.FloatType()), T.StructField("directed", T.BooleanType()), T.StructField("active", T.BooleanType()), T.StructField("edge_seq", T.LongType())])
VECTORS = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
SQ8 = T.StructType([T.StructField("data", T.ArrayType(T.ByteType())), T.StructField("scale", T.FloatType()), T.StructField("norm", T.FloatType())])


class Metric(Enum):
    """The value is the number in files."""

    COSINE = 0
    DOT = 1
    EUCLIDEAN = 2
    MANHATTAN = 3

    @property
    def is_distance(self) -> bool:
        return self in (Metric.EUCLIDEAN, Metric.MANHATTAN)


class Quantization(Enum):
    NONE = 0
    SQ8 = 1


class Direction(Enum):
    OUTGOING = "outgoing"
    INCOMING = "incoming"
    UNDIRECTED = "undirected"


class MarkdownStyle(Enum):
    HIERARCHICAL = "hierarchical"
    SEPARATED = "separated"


class EngineError(Exception):
    """The base of this package's errors."""


class InvalidConfig(EngineError, ValueError):
    pass


class DimensionMismatch(EngineError, ValueError):
    def __init__(self, expected: int, got: int) -> None:
        super().__init__(f"vectors have {expected} components, got {got}")
        self.expected, self.got = expected, got


class NodeNotFound(EngineError, KeyError):
    pass


class DuplicateId(EngineError, ValueError):
    pass


class SnapshotCorrupt(EngineError):
    pass


class ChecksumMismatch(SnapshotCorrupt):
    def __init__(self, expected: int, got: int) -> None:
        super().__init__(f"checksum is {got}, expected {expected}")
        self.expected, self.got = expected, got


class UnsupportedVersion(SnapshotCorrupt):
    pass


@dataclass(frozen=True)
class TraversalConfig:
    max_depth: int = 2
    min_edge_weight: float = 0.0
    max_nodes: int = 1000
    direction: Direction = Direction.OUTGOING


@dataclass(frozen=True)
class HybridScoreConfig:
    alpha: float = 0.6
    depth_decay: float = 0.85
    min_score: float = 0.05


@dataclass(frozen=True)
class ResolutionConfig:
    threshold: float = 0.92
    require_type: bool = True
    merge_descriptions: bool = True


@dataclass(frozen=True)
class MarkdownConfig:
    title: str = "Contexto Recuperado do Conhecimento"
    scores: bool = True
    weights: bool = True
    style: MarkdownStyle = MarkdownStyle.HIERARCHICAL


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


@dataclass(frozen=True)
class EngineConfig:
    dim: int = 384
    metric: Metric = Metric.COSINE
    quantization: Quantization = Quantization.SQ8
    max_tokens: int = 2048
    alpha: float = 0.6
    depth_decay: float = 0.85
    min_score: float = 0.05
    max_depth: int = 2
    min_edge_weight: float = 0.5
    max_nodes: int = 100
    direction: Direction = Direction.OUTGOING
    auto_flush: bool = True

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise InvalidConfig("dim must be positive")
        if self.max_tokens <= 0:
            raise InvalidConfig("max_tokens must be positive")
        if not 0 <= self.alpha <= 1:
            raise InvalidConfig("alpha must lie in [0, 1]")

    def having(self, **changes: object) -> EngineConfig:
        """A copy with some fields changed; alpha and depth_decay are cut to [0, 1]."""
        for name in ("alpha", "depth_decay"):
            if name in changes:
                changes[name] = _unit(changes[name])
        return replace(self, **changes)


@dataclass(frozen=True)
class QueryOptions:
    """None: the engine's setting."""

    top_k_seeds: int = 5
    max_tokens: int | None = None
    max_depth: int | None = None
    min_score: float | None = None
    alpha: float | None = None
    markdown_style: MarkdownStyle = MarkdownStyle.HIERARCHICAL

    def traversal(self, c: EngineConfig) -> TraversalConfig:
        return TraversalConfig(c.max_depth if self.max_depth is None else self.max_depth, c.min_edge_weight, c.max_nodes, c.direction)

    def scoring(self, c: EngineConfig) -> HybridScoreConfig:
        return HybridScoreConfig(_unit(c.alpha if self.alpha is None else self.alpha), c.depth_decay, c.min_score if self.min_score is None else self.min_score)

    def budget(self, c: EngineConfig) -> int:
        return c.max_tokens if self.max_tokens is None else self.max_tokens
