"""Vector expressions: metrics, normalisation and eight-bit scalar quantisation.

All are JVM-side columns over array<float>, computed in double.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftgraph.plans.config import Metric

#: Fixed value: norms (and products of norms) below it count as zero.
TINY = 1e-12


def _summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _summed(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm_squared(v: Column) -> Column:
    return _summed(F.transform(_double(v), lambda x: x * x))


def norm(v: Column) -> Column:
    return F.sqrt(norm_squared(v))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is (almost) zero; cut to [-1, 1]."""
    size = F.sqrt(norm_squared(a) * norm_squared(b))
    return F.when(size < TINY, F.lit(0.0)).otherwise(clamp(dot(a, b) / size, -1.0, 1.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_summed(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _summed(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


def normalized(v: Column) -> Column:
    """Divided by its norm; unchanged where that is (almost) zero."""
    n = norm(v)
    return F.when(n > TINY, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def distance_or_similarity(metric: Metric, a: Column, b: Column) -> Column:
    return {Metric.COSINE: cosine, Metric.DOT: dot, Metric.EUCLIDEAN: euclidean, Metric.MANHATTAN: manhattan}[metric](a, b)


# eight-bit scalar quantisation ------------------------------------------------


def sq8_quantize(v: Column) -> Column:
    """struct(data array<tinyint>, scale, norm): scale is the largest magnitude / 127; the norm stays the original's."""
    top = F.coalesce(F.array_max(F.transform(_double(v), lambda x: F.abs(x))), F.lit(0.0))

    def coded(top: Column) -> Column:
        small = top < TINY
        # round() takes halves away from zero; cut before the narrow cast
        codes = F.transform(_double(v), lambda x: clamp(F.round(x * 127.0 / F.when(small, F.lit(1.0)).otherwise(top)), -127.0, 127.0).cast("tinyint"))
        zeros = F.transform(v, lambda x: F.lit(0).cast("tinyint"))
        return F.struct(
            F.when(small, zeros).otherwise(codes).alias("data"),
            F.when(small, F.lit(0.0)).otherwise(top / 127.0).cast("float").alias("scale"),
            F.when(small, F.lit(0.0)).otherwise(norm(v)).cast("float").alias("norm"),
        )

    # an array of one: within the lambda the largest magnitude has a name, and is not found again for each component
    return F.transform(F.array(top), coded)[0]


def sq8_dequantize(q: Column) -> Column:
    scale = q["scale"].cast("double")
    return F.transform(q["data"], lambda x: (x.cast("double") * scale).cast("float"))


def sq8_dot(query: Column, q: Column) -> Column:
    """Asymmetric: a float query against a quantised vector."""
    return dot(query, q["data"].cast("array<float>")) * q["scale"].cast("double")


def sq8_dot_symmetric(a: Column, b: Column) -> Column:
    whole = F.aggregate(F.zip_with(a["data"], b["data"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return whole.cast("double") * a["scale"].cast("double") * b["scale"].cast("double")


def sq8_cosine(query: Column, q: Column) -> Column:
    """Asymmetric, with the norm of the original vector."""
    size = norm(query) * q["norm"].cast("double")
    return F.when(size < TINY, F.lit(0.0)).otherwise(clamp(sq8_dot(query, q) / size, -1.0, 1.0))


def sq8_metric(metric: Metric, query: Column, q: Column) -> Column:
    """The metric of a query and a quantised vector; distances go by the dequantised one."""
    if metric is Metric.COSINE:
        return sq8_cosine(query, q)
    if metric is Metric.DOT:
        return sq8_dot(query, q)
    return distance_or_similarity(metric, query, sq8_dequantize(q))


def sq8_bytes(q: Column) -> Column:
    return F.size(q["data"]) + 8


def float_bytes(v: Column) -> Column:
    return F.size(v) * 4
