"""The k best vectors of each query, batch after batch.

Matrix products in single precision find candidates within a proven bound of the
error; these alone are scored in double, component by component, as the column
expressions and SQL do. So equal vectors have equal scores wherever they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from weftgraph.functions.vectors import TINY
from weftgraph.plans.config import Metric

#: Scores in one product; of a batch the first columns only set bounds.
ROWS, COLUMNS, FIRST = 512, 8192, 1024
#: Pairs scored in double at a time.
PAIRS = 8192
NOBODY = np.iinfo(np.int64).max


def _total(terms) -> np.ndarray:
    out = 0.0
    for t in terms:
        out = out + t
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    return _total(c * c for c in np.ascontiguousarray(x.T, np.float64)) if len(x) else np.zeros(0)


def _finished(metric: Metric, total: np.ndarray, qq: np.ndarray, xx: np.ndarray, scale, norm) -> np.ndarray:
    """Similarities, or distances below zero, from sums over the components."""
    if metric is Metric.EUCLIDEAN:
        return -np.sqrt(total)
    if metric is Metric.MANHATTAN:
        return -total
    if scale is not None:
        total = total * scale
    if metric is Metric.COSINE:
        size = np.sqrt(qq * xx) if norm is None else np.sqrt(qq) * norm
        total = np.where(size < TINY, 0.0, np.clip(total / np.where(size < TINY, 1.0, size), -1.0, 1.0))
    return total


def _term(metric: Metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a - b) ** 2 if metric is Metric.EUCLIDEAN else np.abs(a - b) if metric is Metric.MANHATTAN else a * b


def all_pairs(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, vectors): every pair in double; distances are below zero."""
    a, b = np.ascontiguousarray(q.T, np.float64), np.ascontiguousarray(x.T, np.float64)
    total = np.zeros((len(q), len(x)))
    for u, v in zip(a, b):
        total += _term(metric, u[:, None], v[None, :])
    return _finished(metric, total, _squares(q)[:, None], _squares(x)[None, :], None, None)


def _row_keys(*parts: np.ndarray) -> np.ndarray:
    """One opaque value a row, equal where all bytes of the parts are."""
    whole = np.ascontiguousarray(np.concatenate([np.ascontiguousarray(p).reshape(len(p), -1).view(np.uint8) for p in parts], axis=1))
    return whole.view(np.dtype((np.void, whole.shape[1]))).ravel()


def fewer_copies(k: int, ids: np.ndarray, x: np.ndarray, scale: np.ndarray | None = None, norm: np.ndarray | None = None) -> tuple[np.ndarray | None, ...]:
    """Of equal vectors the k with the smallest ids; no others can be among the k best."""
    if not len(ids) or not x.shape[1]:
        return ids, x, scale, norm
    _, same = np.unique(_row_keys(x, *(p for p in (scale, norm) if p is not None)), return_inverse=True)
    if same.max() + 1 == len(x):
        return ids, x, scale, norm
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    keep = np.sort(order[place < k])
    return tuple(None if p is None else p[keep] for p in (ids, x, scale, norm))


@dataclass
class Batch:
    """Vectors made ready for products: of equal ones only as many as can be wanted."""

    ids: np.ndarray
    x: np.ndarray
    scale: np.ndarray | None
    norm: np.ndarray | None
    size: np.ndarray
    unit: np.ndarray
    top: float

    @classmethod
    def of(cls, metric: Metric, k: int, ids: np.ndarray, x: np.ndarray, scale: np.ndarray | None = None, norm: np.ndarray | None = None, fewer: bool = True) -> Batch:
        """scale, norm: those of eight-bit codes in x."""
        if fewer:
            ids, x, scale, norm = fewer_copies(k, ids, x, scale, norm)
        y = np.asarray(x, np.float64)
        if scale is not None:
            y = y * scale[:, None]
        with np.errstate(all="ignore"):
            size = np.abs(y).sum(1) if metric is Metric.MANHATTAN else np.sqrt((y * y).sum(1))
            if metric is Metric.COSINE:
                size = size if norm is None else norm
                y = np.where(size[:, None] == 0, 0.0, y / np.where(size == 0, 1.0, size)[:, None])
            reach = np.sqrt((y * y).sum(1)) if metric is Metric.COSINE else size
            top = float(reach.max()) if len(reach) else 0.0
            unit = np.asarray(y / (top or 1.0), np.float32)
        return cls(ids, x, scale, norm, size, unit, top or 1.0)


class Best:
    """The k best of all batches seen, ties by the smaller id, for each row of q."""

    def __init__(self, metric: Metric, q: np.ndarray, k: int) -> None:
        self.metric, self.k = metric, k
        q = np.ascontiguousarray(q, np.float64)
        _, first, self.copies = np.unique(_row_keys(q), return_index=True, return_inverse=True) if q.shape[1] else (None, np.arange(len(q)), np.arange(len(q)))
        self.q = q[first]
        with np.errstate(all="ignore"):
            self.qq = _squares(self.q)
            self.size = np.abs(self.q).sum(1) if metric is Metric.MANHATTAN else np.sqrt(self.qq)
            self.unit = np.asarray(self.q / np.where(self.size == 0, 1.0, self.size)[:, None], np.float32)
        self.good = np.full((len(self.q), k), -np.inf)
        self.ids = np.full((len(self.q), k), NOBODY)

    def see(self, batch: Batch) -> None:
        if not len(batch.ids) or not len(self.q):
            return
        # twice the bound of the rounding of both sides and of the sums, in units of the largest product
        slack = 2.0 * (self.q.shape[1] + 16) * 2.0**-24
        sizes, mine = batch.size, self.size
        plain = bool(np.isfinite(batch.unit).all() and np.isfinite(self.unit).all() and np.isfinite(sizes).all() and np.isfinite(mine).all() and batch.top < 1e150 and mine.max() < 1e150)
        if plain and self.metric is Metric.COSINE and (sizes > 0).any() and (mine > 0).any():
            plain = sizes[sizes > 0].min() * mine[mine > 0].min() > 2 * TINY
        for at in range(0, len(self.q), ROWS):
            rows = slice(at, at + ROWS)
            first = COLUMNS if np.isfinite(self.good[rows]).all() else FIRST
            edges = [0, *range(min(first, len(batch.ids)), len(batch.ids), COLUMNS), len(batch.ids)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if plain:
                    i, j = self._candidates(batch, rows, a, b, slack)
                else:
                    n = len(self.q[rows])
                    i, j = np.repeat(np.arange(n), b - a), np.tile(np.arange(a, b), n)
                if len(i):
                    self._take(at + i, j, batch)

    def _candidates(self, batch: Batch, rows: slice, a: int, b: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        worst, size, k = self.good[rows, -1], self.size[rows], self.k
        with np.errstate(invalid="ignore"):
            if self.metric is Metric.COSINE:
                scores, least = self.unit[rows] @ batch.unit[a:b].T, worst / batch.top
            elif self.metric is Metric.DOT:
                scores, least = self.unit[rows] @ batch.unit[a:b].T, worst / (np.where(size == 0, 1.0, size) * batch.top)
            else:
                # both sides by the larger size
                r = max(float(size.max()), batch.top)
                mine, other = self.unit[rows] * np.asarray(size / r, np.float32)[:, None], batch.unit[a:b] * np.float32(batch.top / r)
                if self.metric is Metric.EUCLIDEAN:
                    scores = mine @ other.T
                    scores -= np.asarray((batch.size[a:b] / r) ** 2 / 2, np.float32)
                    least = ((size / r) ** 2 - (worst / r) ** 2) / 2
                else:
                    scores = np.zeros((len(mine), b - a), np.float32)
                    for u, v in zip(mine.T, np.ascontiguousarray(other.T)):
                        scores -= np.abs(u[:, None] - v)
                    least = worst / r
                slack *= 4
        bound = least - slack
        if b - a > k:
            open_ = np.flatnonzero(~np.isfinite(bound))
            if len(open_):
                bound[open_] = self._kth(scores[open_], batch.top, slack)
        found = np.flatnonzero((scores >= self._single(bound)[:, None]).ravel())
        if len(found) > 32 * len(scores) and b - a > k:
            bound = np.maximum(bound, self._kth(scores, batch.top, slack))
            found = np.flatnonzero((scores >= self._single(bound)[:, None]).ravel())
        i, j = np.divmod(found, b - a)
        return i, j + a

    @staticmethod
    def _single(bound: np.ndarray) -> np.ndarray:
        return np.asarray(np.where(np.isnan(bound), -np.inf, bound), np.float32)

    def _kth(self, scores: np.ndarray, top: float, slack: float) -> np.ndarray:
        """What k of these columns surely reach, less the error of others."""
        at = scores.shape[1] - self.k
        kth = np.partition(scores, at, axis=1)[:, at].astype(np.float64)
        if self.metric is not Metric.COSINE:
            return kth - 2 * slack
        # cosines are cut to [-1, 1] and tie there
        bound = np.minimum(kth, 1.0 / top) - 2 * slack
        return np.where(bound <= -1.0 / top, -np.inf, bound)

    def _take(self, rows: np.ndarray, columns: np.ndarray, batch: Batch) -> None:
        good = np.empty(len(rows))
        for at in range(0, len(rows), PAIRS):
            i, j = rows[at : at + PAIRS], columns[at : at + PAIRS]
            x = np.asarray(batch.x[j], np.float64)
            a, b = np.ascontiguousarray(self.q[i].T), np.ascontiguousarray(x.T)
            total = _total(_term(self.metric, u, v) for u, v in zip(a, b)) + np.zeros(len(i))
            xx = _squares(x) if self.metric is Metric.COSINE and batch.norm is None else None
            good[at : at + PAIRS] = _finished(self.metric, total, self.qq[i], xx, None if batch.scale is None else batch.scale[j], None if batch.norm is None else batch.norm[j])
        self.put(rows, batch.ids[columns], good)

    def put(self, rows: np.ndarray, ids: np.ndarray, good: np.ndarray) -> None:
        """Pairs with their scores (distances below zero), by rows of the distinct queries."""
        good = np.where(np.isnan(good), -np.inf, good)
        named, k = np.unique(rows), self.k
        row = np.concatenate([np.repeat(named, k), rows])
        every, ids = np.concatenate([self.good[named].ravel(), good]), np.concatenate([self.ids[named].ravel(), ids])
        order = np.lexsort((ids, -every, row))
        starts = np.searchsorted(row[order], named)
        first = order[(starts[:, None] + np.arange(k)).ravel()]
        self.good[named], self.ids[named] = every[first].reshape(-1, k), ids[first].reshape(-1, k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, score), best first within a row."""
        good, ids = self.good[self.copies], self.ids[self.copies]
        row, place = np.nonzero(ids != NOBODY)
        good = np.where(np.isneginf(good), np.nan, good)[row, place]
        return row, ids[row, place], -good if self.metric.is_distance else good
