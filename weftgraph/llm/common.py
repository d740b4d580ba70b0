"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MASK = 0xFFFFFFFFFFFFFFFF


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    One is set only where the session names none, as in local tests.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftgraph-")
        context.setCheckpointDir(folder)
    return folder


#: Makes Spark delete an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in here needs no shuffle file afterwards, so none outlives its write."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read again.

    This cuts the lineage: an executor that is lost later costs a re-read only.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned_shuffles(spark):
        df.write.parquet(path, compression="zstd")  # texts take a quarter less than by the default
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Removes what saved() wrote, in whatever store the folder lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*frames: DataFrame) -> None:
    """Removes the files of frames that saved() returned, once nothing will read them."""
    for df in frames:
        deleted(df.sparkSession, df._weft_path)


def hashed_sample(df: DataFrame, by: Column, n: int) -> DataFrame:
    """At most n rows, those of least hash `by`: a threshold from the count leaves few others, so no task sends n rows to one place."""
    total = df.count()
    most = min(1 << 30, -(-(n + 6 * int(n**0.5) + 10) * (1 << 30) // max(total, 1)))
    return df.where(F.pmod(by, F.lit(1 << 30)) < most).orderBy(F.pmod(by, F.lit(1 << 30)), by).limit(n)


class RowNumbers:
    """Numbers for the rows of one task, different from those of any other task of the job; fixed once the rows are written."""

    def __init__(self) -> None:
        from pyspark import TaskContext

        self.at = TaskContext.get().partitionId() << 36

    def take(self, n: int) -> pa.Array:
        self.at += n
        return pa.array(np.arange(self.at - n, self.at), pa.int64())


def joined_spread(rows: DataFrame, side: DataFrame, key: str, least: int = 100_000) -> DataFrame:
    """rows inner-joined on key with side, which has one row for each key.

    Keys that hold over `least` rows and a ten-thousandth of all (so at most 10,000
    keys) are sent to all tasks with their one row; the others meet by a shuffle.
    Null keys join nothing.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = [r[0] for r in counts.where((F.col("__n") > max(least, total // 10_000)) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(side, key)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], f"{key} {rows.schema[key].dataType.simpleString()}"))
    return rows.join(F.broadcast(side.join(keys, key, "left_semi")), key).unionByName(rows.join(keys, key, "left_anti").join(side, key))


#: Bitmaps (4 KB for 32,768 numbers) that go to all tasks at most: 64 MB, for numbers of some 500 million rows.
BROADCAST_MAPS = 16_384


def among(rows: DataFrame, numbers: DataFrame, key: str, most: int = BROADCAST_MAPS) -> DataFrame:
    """The rows whose number `key` is among `numbers` (a column of that name, without nulls); rows without a number go.

    The numbers become bitmaps, one for each range that holds some. While there are
    at most `most` of them all tasks get them and no row is shuffled; beyond that
    the rows meet the numbers in a semi join.
    """
    where = F.bitmap_bucket_number(F.col(key)).alias("__weft_map")
    maps = saved(numbers.groupBy(where).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("__weft_bits")), "numbers")
    if maps.count() > most:
        return rows.join(numbers.select(key), key, "left_semi")
    at = f"bitmap_bit_position(`{key}`)"
    byte = f"cast(conv(hex(substring(__weft_bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    found = rows.select("*", where).join(F.broadcast(maps), "__weft_map").where(F.expr(f"getbit({byte}, cast({at} % 8 as int)) = 1"))
    return found.drop("__weft_map", "__weft_bits")


def text_bytes(column: str | Column = "text") -> Column:
    """Null texts are empty; Python gets UTF-8 bytes and decodes only what it must."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col, F.lit("")).cast("binary")


def fold(id_column: str, parts: int) -> Column:
    """crc32(id as text) mod parts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def picked(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def chunks(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair (a, b); order counts."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = (x + b) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of uint64 keys.

    The upper bits of each key and its place are sorted as one number, which is
    several times as fast as sorting places by key; keys that differ only below
    those bits are put right afterwards.
    """
    n = len(keys)
    low = np.uint64((1 << n.bit_length()) - 1)
    keys = keys << np.uint64(64 - int(keys.max()).bit_length() if n and keys.max() else 0)
    order = np.sort(keys & ~low | np.arange(n, dtype=np.uint64)) & low
    order = order.astype(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong):
        upper = ordered | low
        starts = np.unique(np.searchsorted(upper, upper[wrong]))
        for a, b in zip(starts, np.searchsorted(upper, upper[starts], side="right"), strict=True):
            order[a:b] = order[a:b][np.argsort(ordered[a:b], kind="stable")]
    return order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sorted keys, number of each key's group, first place of each group)."""
    order = sorted_order(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return ordered[head], inverse, order[head]


class WordHashes(dict):
    """64-bit hash of each word, remembered; the memory is emptied at a fixed size."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
