"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Unit vectors are cut into subspaces of two components, each coded in four bits.
The codebooks minimise a loss that weighs the residual parallel to the vector
`eta` times the orthogonal one, since that is what moves large inner products.
Every vector is coded once; codes and residual lengths are written beside it. A
query becomes a table of 16 partial products per subspace; a scan adds them up for
every code, and each vector that can be among the nearest by its sum and residual is
reranked by its exact cosine in double precision, where it lies: no vector is
shuffled or copied for a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import hashed_sample, saved

CODES = 16


@dataclass
class AnisotropicQuantizer:
    """books: (subspaces, 16, components of a subspace)."""

    books: np.ndarray
    dim: int
    eta: float

    @staticmethod
    def _split(x: np.ndarray, m: int, d: int) -> np.ndarray:
        if m * d > x.shape[1]:
            x = np.pad(x, ((0, 0), (0, m * d - x.shape[1])))
        return x.reshape(len(x), m, d)

    @classmethod
    def fit(cls, x: np.ndarray, eta: float = 4.0, sub: int = 2, rounds: int = 8, seed: int = 7) -> AnisotropicQuantizer:
        """x: unit vectors, a bounded sample. Alternates coordinate descent on codes with closed-form centres."""
        n, dim = x.shape
        m = -(-dim // sub)
        parts = cls._split(x.astype(np.float64), m, sub)
        rng = np.random.default_rng(seed)
        books = np.stack([parts[rng.choice(n, CODES, replace=n < CODES), j] for j in range(m)])
        model = cls(books, dim, eta)
        codes = np.zeros((n, m), np.int64)
        for j in range(m):  # plain k-means first
            for _ in range(rounds):
                codes[:, j] = ((parts[:, j, None] - books[j]) ** 2).sum(2).argmin(1)
                for c in np.unique(codes[:, j]):
                    books[j, c] = parts[codes[:, j] == c, j].mean(0)
        for _ in range(rounds):
            codes = model.encode(x, codes, sweeps=1)
            chosen = books[np.arange(m), codes]
            along = ((parts - chosen) * parts).sum((1, 2))
            for j in range(m):
                v, own = parts[:, j], codes[:, j]
                rest = along - ((v - books[j, own]) * v).sum(1)
                want = v + (eta - 1) * (rest + (v * v).sum(1))[:, None] * v
                for c in np.unique(own):
                    rows = own == c
                    lhs = rows.sum() * np.eye(sub) + (eta - 1) * v[rows].T @ v[rows]
                    books[j, c] = np.linalg.solve(lhs, want[rows].sum(0))
                along = rest + ((v - books[j, own]) * v).sum(1)
        return model

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors, from the nearest centres on by coordinate descent on the anisotropic loss."""
        m, _, d = self.books.shape
        parts = self._split(x.astype(np.float64), m, d)
        square = np.stack([((parts[:, j, None] - self.books[j]) ** 2).sum(2) for j in range(m)], 1)  # n, m, 16
        along = np.stack([((parts[:, j, None] - self.books[j]) * parts[:, j, None]).sum(2) for j in range(m)], 1)
        codes = square.argmin(2) if codes is None else codes.copy()
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[rows, j, codes[:, j]]
                codes[:, j] = (square[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                total = rest + along[rows, j, codes[:, j]]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes to a byte; an odd last subspace stands alone."""
        codes = self.encode(x).astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def slopes(self, x: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: the residual's part along the coded vector (as a multiple), the length across it, the coded squared length."""
        m, _, d = self.books.shape
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(x), -1)[:, :m]
        coded = self.books[np.arange(m), codes].reshape(len(x), -1)
        rest = self._split(x, m, d).reshape(len(x), -1) - coded
        square = (coded * coded).sum(1)
        along = (rest * coded).sum(1) / np.where(square > 0, square, 1)
        return along, np.sqrt(np.maximum((rest * rest).sum(1) - along * along * square, 0)), square

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each unit query the partial products of every code: (queries, byte columns, 256)."""
        m, _, d = self.books.shape
        four = np.einsum("qmd,mcd->qmc", self._split(q.astype(np.float64), m, d), self.books)
        if m % 2:
            four = np.pad(four, ((0, 0), (0, 1), (0, 0)))
        low, high = four[:, 0::2], four[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two, so that its largest component is near one: no square overflows or vanishes, no bit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


@dataclass
class Coded:
    """Vectors (scaled, in double) with ids, keys and what the index has of them."""

    ids: np.ndarray
    keys: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    along: np.ndarray
    across: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, model: AnisotropicQuantizer, ids: np.ndarray, keys: np.ndarray, x: np.ndarray) -> Coded:
        x = scaled(x)
        codes = model.packed(unit(x))
        return cls(ids, keys, x, codes, *model.slopes(unit(x), codes))

    def few_of_each(self, most: int) -> Coded:
        """Repeated rows once; of equal vectors those with the `most` smallest ids, as no others can be among the nearest."""
        _, number = np.unique(np.ascontiguousarray(self.x + 0.0).view(np.dtype((np.void, 8 * self.x.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((self.keys, self.ids, number.ravel()))
        group, keys = number.ravel()[order], self.keys[order]
        again = np.zeros(len(order), bool)
        again[1:] = (group[1:] == group[:-1]) & (keys[1:] == keys[:-1])
        order, group = order[~again], group[~again]
        rank = np.arange(len(order)) - np.searchsorted(group, group)
        keep = np.sort(order[rank < most])
        if len(keep) == len(self.ids):
            return self
        return Coded(*(a[keep] for a in (self.ids, self.keys, self.x, self.codes, self.along, self.across, self.square)))


class Nearest:
    """The k nearest found so far for each query, over any number of batches of coded vectors.

    A vector x is its coded part, longer by `along`, plus a rest of the length
    `across` at right angles. The scan knows the product q has with the former; with
    the rest it is at most across times what q has beside the coded part (a sure
    bound). And where cos(q, x) = t, it is t across^2 plus the product of the rest
    with a direction at right angles to x, whose deviation is across / sqrt(d - 1) of
    its length; `margin` such deviations are granted. A vector that both bounds
    let reach the k-th best so far is reranked, be it one or a third of a batch, so
    groups of almost equal vectors, whose rest is the query's own, are never cut.
    """

    def __init__(self, model: AnisotropicQuantizer, keys: np.ndarray, q: np.ndarray, k: int, margin: float = 4.0, first: int = 64) -> None:
        self.model, self.keys, self.q, self.k, self.margin, self.first = model, keys, scaled(q) if len(q) else q, k, margin, max(first, k + 1)
        self.lengths = np.sqrt((self.q * self.q).sum(axis=1))
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        self.reranked = 0

    def _take(self, i: int, batch: Coded, norms: np.ndarray, rows: np.ndarray) -> None:
        """Measures rows and keeps the k best: falling score, then id."""
        rows = rows[batch.keys[rows] != self.keys[i]]
        self.reranked += len(rows)
        score = (batch.x[rows] * self.q[i]).sum(axis=1) / (norms[rows] * self.lengths[i])
        score, ids, keys = (np.concatenate([a, b]) for a, b in zip(self.best[i], (score, batch.ids[rows], batch.keys[rows]), strict=True))
        order = np.lexsort((keys, ids, -score))
        same = np.zeros(len(order), bool)
        same[1:] = (keys[order[1:]] == keys[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
        order = order[~same][: self.k]
        self.best[i] = (score[order], ids[order], keys[order])

    def add(self, batch: Coded, block: int = 64) -> None:
        batch = batch.few_of_each(self.k + 1)
        n, d = batch.x.shape
        norms = np.sqrt((batch.x * batch.x).sum(axis=1))
        columns = [np.ascontiguousarray(batch.codes[:, j]).astype(np.intp) for j in range(batch.codes.shape[1])]
        longer, short = (1 + batch.along).astype(np.float32), 1 - batch.across**2
        noise = self.margin * batch.across * np.sqrt(np.maximum(short, 0)) / np.sqrt(max(d - 1, 1))
        inverse = np.where(batch.square > 0, 1 / np.where(batch.square > 0, batch.square, 1), 0)
        for at in range(0, len(self.q), block):
            part = slice(at, at + block)
            tables = self.model.tables(self.q[part] / self.lengths[part, None])
            for i, table in enumerate(tables, at):
                scan = table[0].take(columns[0])
                for j in range(1, len(columns)):
                    scan += table[j].take(columns[j])
                found = scan * longer
                rows = np.zeros(0, np.int64)
                if len(self.best[i][0]) < self.k:
                    rows = np.argpartition(-found, self.first)[: self.first] if n > self.first else np.arange(n)
                    self._take(i, batch, norms, rows)
                if len(rows) == n:
                    continue
                edge = self.best[i][0][-1] if len(self.best[i][0]) == self.k else -1.0
                slack = 1e-4  # sums are in single precision
                more = np.flatnonzero(found >= edge * short - np.sqrt(max(1 - edge * edge, 0)) * noise - slack) if edge > 0 else np.arange(n)
                beside = np.sqrt(np.maximum(1 - scan[more] ** 2 * inverse[more], 0))
                more = more[found[more] + batch.across[more] * beside + slack >= edge]
                if len(rows):
                    more = np.setdiff1d(more, rows, assume_unique=True)
                if len(more):
                    self._take(i, batch, norms, more)


def usable(column: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def indexed(rows: DataFrame, models: dict[int, AnisotropicQuantizer]) -> DataFrame:
    """rows (vec_id, key, is_query, d, v) with code (packed four-bit codes), along, across, square. No shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                for at in range(0, part.num_rows, 8192):
                    own = part.slice(at, 8192)
                    c = Coded.of(sent.value[d], own.column(0).to_numpy(), own.column(1).to_numpy(), _matrix(own.column(4), d))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([r.tobytes() for r in c.codes], pa.binary()), *map(pa.array, (c.along, c.across, c.square))], names=[*own.schema.names, "code", "along", "across", "square"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, key long, is_query boolean, d int, v {kind}, code binary, along double, across double, square double")


def scanned(index: DataFrame, model: AnisotropicQuantizer, d: int, asked: list, k: int, margin: float) -> DataFrame:
    """query_id, query_key, vec_id, key, score: each task's k nearest of its own vectors for the asked queries (rows vec_id, key, v)."""
    sent = index.sparkSession.sparkContext.broadcast((model, np.array([r.vec_id for r in asked], np.int64), np.array([r.key for r in asked], np.int64), np.array([r.v for r in asked], np.float64).reshape(len(asked), d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids, keys, q = sent.value
        near = Nearest(model, keys, q, k, margin)
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                near.add(Coded(batch.column(0).to_numpy(), batch.column(1).to_numpy(), scaled(_matrix(batch.column(2), d)), codes, *(batch.column(j).to_numpy() for j in (4, 5, 6))))
        n = [len(b[0]) for b in near.best]
        score, vec, key = (np.concatenate([np.zeros(0, kind), *(b[j] for b in near.best)]).astype(kind) for j, kind in enumerate((np.float64, np.int64, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.repeat(keys, n)), pa.array(vec), pa.array(key), pa.array(score)], names=["query_id", "query_key", "vec_id", "key", "score"])

    return index.where(F.col("d") == d).select("vec_id", "key", "v", "code", "along", "across", "square").mapInArrow(run, "query_id long, query_key long, vec_id long, key long, score double")


def search(
    vectors: DataFrame, queries: Column, k: int = 5, margin: float = 4.0, fit_rows: int = 16_384, id_column: str = "vec_id", vector_column: str = "embedding", query_components: int = 4_000_000, eta: float = 4.0
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row where `queries` holds.

    Nearness is the cosine; ties go to the smaller vec_id; the row itself is no
    candidate. The codebooks are fitted on at most `fit_rows` vectors, those of
    least hash; every row is indexed. Queries go to all tasks in blocks of at most
    `query_components` numbers (32 MB); each block is one scan of the index, which
    returns k rows a query and task. Vectors null, zero, or holding null or
    non-finite components take no part, nor do rows without an id. Vectors of
    different lengths have no cosine: each length is searched on its own. Rows that
    repeat id and vector are one; rows that share an id only are separate candidates,
    and separate queries. Without usable rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
    vec_id, v = F.col(id_column).cast("long"), F.col(vector_column)
    rows = rows.select(vec_id.alias("vec_id"), F.xxhash64(vec_id, v).alias("key"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.size(v).alias("d"), v.alias("v"))
    models = {}
    for d in sorted(r.d for r in rows.select("d").distinct().collect()):
        sample = hashed_sample(rows.where(F.col("d") == d), F.col("key"), fit_rows).select("v").collect()
        models[d] = AnisotropicQuantizer.fit(unit(scaled(np.array([r.v for r in sample], np.float64))), eta)
    found = spark.createDataFrame([], "query_id long, query_key long, vec_id long, key long, score double")
    if not models:
        return found.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    index = saved(indexed(rows, models), "index")
    asked = index.where("is_query").select("vec_id", "key", "d", "v").dropDuplicates(["vec_id", "key"])
    for r in asked.groupBy("d").agg(F.count("*").alias("n")).collect():
        blocks = -(-r.n * r.d // query_components)
        for b in range(blocks):
            some = asked.where((F.col("d") == r.d) & (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)) == b)).collect()
            if some:
                part = scanned(index, models[r.d], r.d, some, k, margin)
                found = found.unionByName(part if blocks == 1 else saved(part, "nearest"))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", "key")
    once = found.dropDuplicates(["query_id", "query_key", "vec_id", "key"])
    return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
