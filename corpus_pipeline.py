"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import packing, quality as quality_op, secrets as secrets_op, simhash
from weftgraph.llm.common import saved
from weftgraph.llm.decontam import Decontaminator
from weftgraph.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged like any other; repeated rows share their fate;
    without labels all stay.
    """
    judged = quality_op.classify(docs, table(spark, sf_dir, "labels"), prefix="__quality_")
    return judged.where("__quality_keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays (nulls last).

    Near-duplicates share 0.8 of their runs of five words, measured on the texts.
    Rows are judged by their texts: of rows that share a doc_id and differ all stay;
    of repeated rows, and of null and wordless texts, one stays.
    """
    return simhash.without_copies(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go (all of a shorter one); null texts stay."""
    return Decontaminator().clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become [kind]; n_chars follows. No row goes; null texts stay null, repeated rows stay repeated."""
    return secrets_op.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens. A null text is one end token; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs, f"pipeline_{name}")
    return docs
