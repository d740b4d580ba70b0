"""Interpolated modified Kneser-Ney language model, counted and scored in Spark.

Documents become chunks of word hashes, written once. From the highest order
down, each chunk sends its distinct n-grams (sorted 64-bit hashes with counts) to
shards by hash. A shard merges them into one sorted hash array with count
columns, written as that part of the model, memory-maps it and answers each
chunk's n-grams in order; one chunk in each n-gram's list is told that it owns
it. Owners then count, one order lower, what Kneser-Ney needs: distinct left
extensions of each suffix, and totals and count classes of each context. At the
end a chunk has every number its documents' probabilities take.

A word's key is its whole 64-bit hash, so the vocabulary and the base score are
exact but for the odds of a clash of two words: 1 in 370,000 for ten million words.
A longer n-gram's key has 21 bits more than it takes to count the corpus's tokens,
so at every size at most one n-gram in two million shares its key with another one
and is counted with it; sorted, a key takes about four bytes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weftgraph.llm.common import WordHashes, cleaned_shuffles, deleted, grouped, mix, new_path, picked, saved, sorted_order, text_bytes

#: Hashes that stand for the start and the end of a text.
PAD, STOP = np.uint64(0x5D41_402A_BC4B_2A), np.uint64(0xB1A8_7E36_90CD_73)
#: Bits of a word's key.
WORD_BITS = 64
#: Counted for each n-gram below the highest order; the highest has its count alone.
#: context_rest is the total without what follows once or twice, which is zero for most.
LOWER = ("continuations", "context_rest", "context_ones", "context_twos", "context_more", "raw")

# packed arrays ---------------------------------------------------------------


def squeezed(a: np.ndarray, deltas: bool = False) -> bytes:
    """An integer array as compressed byte planes; deltas: of a sorted array, its steps."""
    if deltas and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    a = np.ascontiguousarray(a)
    head = np.array([a.dtype.itemsize, len(a)], "<i8").tobytes()
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(data: bytes, deltas: bool = False) -> np.ndarray:
    width, n = np.frombuffer(data[:16], "<i8")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:], max_output_size=int(width * n) + 1), np.uint8)
    a = np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel() if n else np.zeros(0, f"<u{width}")
    return np.cumsum(a, dtype=a.dtype) if deltas else a


def narrow(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds all of a."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


# chunks ----------------------------------------------------------------------


@dataclass
class Chunk:
    """Documents as word hashes, with order - 1 start marks before each and a stop after it."""

    ids: np.ndarray
    null_ids: np.ndarray
    train: np.ndarray
    lens: np.ndarray  # tokens of each document, the stop included
    words: np.ndarray  # uint64 hash of every token, without marks

    def packed(self) -> bytes:
        names, codes, _ = grouped(self.words)
        # by falling count; words of the same count, most of all those with one, by hash
        by = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        parts = [squeezed(self.ids.view(np.uint64)), squeezed(self.null_ids.astype(np.uint8)), squeezed(self.train.astype(np.uint8)), squeezed(self.lens.astype("<u4")), squeezed(names[by], deltas=True), squeezed(narrow(place[codes]))]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(unsqueezed(data[at + 8 : at + 8 + n], deltas=len(parts) == 4))  # the words' hashes
            at += 8 + n
        ids, null_ids, train, lens, names, codes = parts
        return cls(ids.view(np.int64), null_ids.astype(bool), train.astype(bool), lens.astype(np.int64), names[codes] if len(codes) else np.zeros(0, np.uint64))


class Grams:
    """The n-gram hashes at every position of a chunk."""

    def __init__(self, chunk: Chunk, order: int, bits: int) -> None:
        lens, pads = chunk.lens, order - 1
        total = int(lens.sum()) + pads * len(lens)
        stops = np.cumsum(lens + pads)
        self.doc = np.repeat(np.arange(len(lens)), lens)
        # positions of predicted tokens among all
        self.at = np.arange(int(lens.sum())) + pads * (self.doc + 1)
        marked = np.full(total, PAD, np.uint64)
        marked[self.at] = chunk.words
        mask = np.uint64((1 << bits) - 1)
        self.keys = [marked]
        for _ in range(order - 1):
            last = self.keys[-1]
            self.keys.append(mix(np.concatenate([[PAD], last[:-1]]), marked) & mask)
        self.train = chunk.train[self.doc]
        self.starts = stops - lens - 1
        # where among asked-for keys the one before each token is: the token before, or the start of the text
        self.before = np.arange(len(self.at)) - 1
        self.before[np.cumsum(lens) - lens] = len(self.at) + np.arange(len(lens))

    def asked(self, n: int) -> np.ndarray:
        """Keys of order n (from 1) at predicted tokens, and of the contexts at the starts of texts."""
        keys = self.keys[n - 1]
        return keys[self.at] if n == len(self.keys) else np.concatenate([keys[self.at], keys[self.starts]])


def chunk_rows(docs: DataFrame, train: Column, id_column: str, text_column: str, chunk_tokens: int) -> DataFrame:
    """chunk (long), data, tokens: the documents in chunks of about chunk_tokens tokens; one read of the texts."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, known = TaskContext.get().partitionId(), 0, WordHashes()
        ids, train, lens, words, size = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal count
            got = Chunk(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), np.array(train, bool), np.array(lens, np.int64), np.concatenate(words))
            count += 1
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | count - 1], pa.int64()), pa.array([got.packed()], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "data", "tokens"])

        for batch in batches:
            for i, text, t in zip(*picked(batch, "id", "text", "train"), strict=True):
                hashes = known.of(text.lower().split())
                ids.append(i)
                train.append(t)
                lens.append(len(hashes) + 1)
                words += [hashes, np.array([STOP])]
                size += lens[-1]
                if size >= chunk_tokens:
                    yield chunk()
                    ids, train, lens, words, size = [], [], [], [], 0
        if ids:
            yield chunk()

    return source.mapInArrow(run, "chunk long, data binary, tokens long")


# one order -------------------------------------------------------------------


def _sent(chunk: int, keys: np.ndarray, columns: list[np.ndarray], shards: int, bits: int) -> list[dict]:
    """Rows for the shards that own some of the sorted keys: equal ranges of the hash."""
    width = (1 << bits) // shards + 1
    cuts = np.searchsorted(keys, np.array([i * width for i in range(1, shards)], np.uint64))
    out = []
    for s, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
        if b > a:
            out.append({"shard": s, "chunk": chunk, "keys": squeezed(keys[a:b], deltas=True), "columns": [squeezed(narrow(c[a:b])) for c in columns]})
    return out


_SENT = "shard int, chunk long, keys binary, columns array<binary>"
_MODEL = "shard int, chunk long, keys binary, columns array<binary>, stats array<double>"


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _shard(pdf: pd.DataFrame, top: bool) -> pd.DataFrame:
    """The shard of the model (chunk -1: keys, columns, stats) and the answers to each chunk (columns in its order of keys, then owned)."""
    pdf = pdf.sort_values("chunk")
    keys = [unsqueezed(k, deltas=True) for k in pdf["keys"]]
    values = [[unsqueezed(c) for c in cs] for cs in pdf["columns"]]
    every = np.concatenate(keys)
    source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = sorted_order(every)
    ordered = every[order]
    head = np.ones(len(ordered), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    firsts = np.flatnonzero(head)
    sums = []
    for j in range(len(values[0])):
        column = np.concatenate([v[j].astype(np.uint64) for v in values])[order]
        sums.append(np.add.reduceat(column, firsts))
        if j == 0:
            # the first chunk that counted the n-gram owns it
            chunk = np.where(column > 0, source[order], len(keys))
            owner = np.minimum.reduceat(chunk, firsts)
    names = ordered[firsts]
    del every, ordered, order
    # the arrays go to a file that is mapped for the look-ups
    with tempfile.TemporaryDirectory() as folder:
        mapped = []
        for j, a in enumerate([names.astype("<u8"), *map(narrow, sums), narrow(owner)]):
            path = os.path.join(folder, str(j))
            a.tofile(path)
            mapped.append(np.memmap(path, a.dtype, "r"))
        del a
        names, sums, owner = mapped[0], mapped[1:-1], mapped[-1]  # what was in memory goes
        out = []
        for i, (chunk, own) in enumerate(zip(pdf["chunk"], keys, strict=True)):
            at = np.searchsorted(names, own)
            columns = [squeezed(narrow(np.asarray(c[at]))) for c in sums]
            out.append({"shard": int(pdf["shard"].iloc[0]), "chunk": chunk, "keys": None, "columns": [*columns, squeezed((owner[at].astype(np.int64) == i).astype(np.uint8))], "stats": None})
        count = sums[0]
        classes = np.bincount(np.minimum(count, 5).astype(np.int64), minlength=6)
        stats = [float(classes[i]) for i in (1, 2, 3, 4)] + [float(count.sum()), float((count > 0).sum()), float((count > 2).sum())]
        stats += [0.0, 0.0] if top else [float(sums[-1].sum()), float((sums[-1] > 0).sum())]
        seen = np.logical_or.reduce([s > 0 for s in sums])
        out.append({"shard": int(pdf["shard"].iloc[0]), "chunk": -1, "keys": squeezed(names[seen], deltas=True), "columns": [squeezed(narrow(s[seen])) for s in sums], "stats": stats})
        del mapped, names, sums, owner
    return _frame(out, ["shard", "chunk", "keys", "columns", "stats"])


def _merge(top: bool):
    return lambda pdf: _shard(pdf, top)


def _answers(pdf: pd.DataFrame) -> list[np.ndarray]:
    """A chunk's answers of one order, all shards in hash order: one array a column, then owned."""
    pdf = pdf.sort_values("shard")
    parts = [[unsqueezed(c).astype(np.int64) for c in cs] for cs in pdf["columns"]]
    return [np.concatenate([p[j] for p in parts]) for j in range(len(parts[0]))] if parts else []


def _first_sends(order: int, shards: int, bits: int):
    """Order's own n-grams with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(*picked(batch, "chunk", "data"), strict=True):
                grams = Grams(Chunk.unpacked(data), order, bits)
                keys, inverse, _ = grouped(grams.asked(order))
                count = np.bincount(inverse, weights=grams.train, minlength=len(keys)).astype(np.int64)
                rows = _sent(chunk, keys, [count], shards, bits)
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow_sent)

    return run


_arrow_sent = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("columns", pa.list_(pa.binary()))])


def _next_sends(order: int, n: int, shards: int, bits: int):
    """From a chunk and the answers of order n + 1: what its owned n-grams add to order n."""

    def run(chunks: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        names = ["shard", "chunk", "keys", "columns"]
        if not len(chunks):
            return _frame([], names)
        grams = Grams(Chunk.unpacked(chunks["data"].iloc[0]), order, bits)
        answers = _answers(above)
        _, above_at, first = grouped(grams.asked(n + 1))
        first = first[first < len(grams.at)]  # without the contexts at the starts of texts
        where = above_at[first]
        count = answers[0][where]
        owned = answers[-1][where].astype(bool) & (count > 0)
        token, count = first[owned], count[owned]
        keys, inverse, _ = grouped(grams.asked(n))
        suffix, context = inverse[token], inverse[grams.before[token]]
        size = len(keys)
        sums = lambda where, weight=None: np.bincount(where, weights=weight, minlength=size).astype(np.int64)
        more = count > 2
        columns = [sums(suffix), sums(context[more], count[more]), sums(context[count == 1]), sums(context[count == 2]), sums(context[more])]
        columns.append(sums(inverse[: len(grams.at)], grams.train) if n == 1 else np.zeros(size, np.int64))
        return _frame(_sent(int(chunks["chunk"].iloc[0]), keys, columns, shards, WORD_BITS if n == 1 else bits), names)

    return run


# the model -------------------------------------------------------------------


def discounts(ones: float, twos: float, threes: float, fours: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; fixed ones where those are too few."""
    if min(ones, twos, threes) <= 0:
        return 0.5, 0.75, 0.9
    y = ones / (ones + 2 * twos)
    raw = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))


@dataclass
class Totals:
    """Per order from 1: discounts; and the unigram totals."""

    discounts: list[tuple[float, float, float]]
    continuations: float
    ones: float
    twos: float
    more: float
    train_tokens: int
    vocabulary: int


def _scores(order: int, bits: int, totals: Totals):
    def run(chunks: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not len(chunks):
            return _frame([], names)
        chunk = Chunk.unpacked(chunks["data"].iloc[0])
        grams = Grams(chunk, order, bits)
        vocabulary, n_all = totals.vocabulary, totals.train_tokens
        p = None
        context: list[np.ndarray] = []
        raw = None
        for n in range(1, order + 1):
            answers = _answers(answered[answered["n"] == n])
            _, inverse, _ = grouped(grams.asked(n))
            here = inverse[: len(grams.at)]
            count = answers[0][here].astype(float)
            d = totals.discounts[n - 1]
            cut = np.select([count <= 0, count == 1, count == 2], [0.0, d[0], d[1]], d[2])
            if n == 1:
                rest = d[0] * totals.ones + d[1] * totals.twos + d[2] * totals.more
                total = totals.continuations
                p = np.maximum(count - cut, 0) / total + rest / total / (vocabulary + 1) if total else np.full(len(count), 1 / (vocabulary + 1))
                raw = answers[5][here]
            else:
                rest, ones, twos, more = (c.astype(float) for c in context)
                total = rest + ones + 2 * twos
                known = total > 0
                safe = np.where(known, total, 1)
                q = np.maximum(count - cut, 0) / safe + (d[0] * ones + d[1] * twos + d[2] * more) / safe * p
                p = np.where(known, q, p)
            if n < order:  # as a context of the next order: the key one place before
                before = inverse[grams.before]
                context = [answers[j][before] for j in (1, 2, 3, 4)]
        starts = np.cumsum(chunk.lens) - chunk.lens
        base = np.log10((raw + 0.5) / (n_all + 0.5 * (vocabulary + 1)))
        ids = pd.array(chunk.ids, dtype="Int64")
        ids[chunk.null_ids] = pd.NA
        add = lambda a: np.add.reduceat(a, starts)
        return pd.DataFrame({"doc_id": ids, "held_out": ~chunk.train, "n_tokens": chunk.lens, "n_known": add((raw > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))})[names]

    return run


def kneser_ney(docs: DataFrame, train: Column, order: int = 3, id_column: str = "doc_id", text_column: str = "text", chunk_tokens: int = 800_000, shard_keys: int = 1_200_000) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(scores, model): scores of every row of docs, by a model of the rows where train holds.

    scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 of the text's probability, its end included). model: for each order a
    table of shards (sorted keys, count columns, statistics). A-Z are lower-cased,
    words end at white space. A null text is empty and has its end as one token;
    null train counts as false; rows that repeat count and are scored each; without
    training rows every token has the probability 1. Everything grows with the
    input: no n-gram is dropped. Words that training has not seen share the mass
    that unigrams leave, as one more word.
    """
    spark: SparkSession = docs.sparkSession
    # bucketed by chunk, so that answers come to the chunks and those stay where they are
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lm_chunks_{uuid.uuid4().hex}"
    made = chunk_rows(docs, train, id_column, text_column, chunk_tokens).repartition(buckets, "chunk")
    with cleaned_shuffles(spark):
        made.write.format("parquet").bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    tables: dict[int, DataFrame] = {}
    models: dict[int, DataFrame] = {}
    paths = []
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = min(63, max(32, int(tokens).bit_length() + 21))
    chunks = chunks.select("chunk", "data")
    if order < 2:
        raise ValueError("order must be 2 or more")
    for n in range(order, 0, -1):
        shards = tokens // shard_keys + 1  # a chunk sends at most as many keys as it has tokens
        if n == order:
            sent = chunks.mapInArrow(_first_sends(order, shards, bits), _SENT)
        else:
            above = tables[n + 1].select("shard", "chunk", "columns")
            sent = chunks.groupBy("chunk").cogroup(above.groupBy("chunk")).applyInPandas(_next_sends(order, n, shards, bits), _SENT)
        made = sent.groupBy("shard").applyInPandas(_merge(n == order), _MODEL)
        paths.append(new_path(spark, f"lm_order_{n}"))
        with cleaned_shuffles(spark):
            made.withColumn("part", F.when(F.col("chunk") < 0, "model").otherwise("answers")).write.partitionBy("part").parquet(paths[-1])
        tables[n], models[n] = (_part(spark, paths[-1], part, made.schema) for part in ("answers", "model"))
    stats = {n: _summed(t) for n, t in models.items()}
    one = stats[1]
    totals = Totals([discounts(*stats[n][:4]) for n in range(1, order + 1)], one[4], one[0], one[1], one[6], int(one[7]), int(one[8]))
    answered = None
    for n, table in tables.items():
        part = table.select("chunk", "shard", "columns", F.lit(n).alias("n"))
        answered = part if answered is None else answered.unionByName(part)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scores = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(_scores(order, bits, totals), schema)
    scores = saved(scores.withColumn("train_tokens", F.lit(totals.train_tokens).cast("long")), "lm_scores")
    # the model stays; chunks and answers have done their work
    spark.sql(f"drop table {name}")
    for path in paths:
        deleted(spark, f"{path}/part=answers")
    return scores, models


def _part(spark: SparkSession, path: str, part: str, schema: T.StructType) -> DataFrame:
    """One partition of an order's table; an empty table has no folder for it."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())])).parquet(path).where(F.col("part") == part).drop("part")


def _summed(table: DataFrame) -> list[float]:
    row = table.select(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(9)]).first()
    return [float(v or 0) for v in row]


def perplexity(score: Column, tokens: Column) -> Column:
    """From a log10 probability and the number of tokens."""
    return F.pow(F.lit(10.0), -score / tokens)
