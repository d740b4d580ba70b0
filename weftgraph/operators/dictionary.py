"""String dictionary: ids by first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.operators.mutation import _numbered


def dictionary(rows: DataFrame, text: str = "text", seq: str = "seq", base: int = 0) -> DataFrame:
    """text, string_id: distinct texts numbered from base by their first seq; null texts have no id."""
    first = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(seq).alias("first_seq"))
    return _numbered(first, ["first_seq", "text"], base, "string_id").select("text", "string_id", "first_seq")


def encoded(rows: DataFrame, words: DataFrame, text: str = "text", name: str = "string_id") -> DataFrame:
    """rows with the id of their text, null where the dictionary has none."""
    return rows.join(words.select(F.col("text").alias("__t"), F.col("string_id").alias(name)), F.col(text) == F.col("__t"), "left").drop("__t")


def resolved(rows: DataFrame, words: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the text of an id, null for null and unknown ids."""
    return rows.join(words.select(F.col("string_id").alias("__i"), F.col("text").alias(name)), F.col(key) == F.col("__i"), "left").drop("__i")


def dictionary_stats(words: DataFrame) -> DataFrame:
    """One row: strings, total_bytes (UTF-8)."""
    return words.agg(F.count("*").alias("strings"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("total_bytes"))
