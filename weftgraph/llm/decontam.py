"""Benchmark decontamination by winnowing.

Of every w consecutive k-gram hashes of a document the least is kept, so each
span of w + k - 1 words keeps at least one. With w + k - 1 equal to the window
of the items, every item window in a document shares its own least k-gram with
the document's fingerprints. A shared fingerprint is extended to the w windows
around it, and those meet the items' windows in an equi-join on the window's hash.

Before the join two Bloom filters of a bounded size, one of the items'
fingerprints and one of their windows, leave out what no item has. They let a few
others pass, never lose one, and the join decides, so that the size of the
benchmark changes no result and no pass over the documents is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.common import RowNumbers, WordHashes, chunks, mix, picked, record_batch, saved, text_bytes

#: A-Z become a-z; all other ASCII but a-z and 0-9 parts words.
_UPPER, _WORD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz0123456789"
TABLE = bytes(c + 32 if c in _UPPER else c if c in _WORD or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the width words from each position on; positions near the end are left out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, width):
        out = mix(out, words[i : n + i])
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash (the rightmost of equals) of every w consecutive ones."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for i in range(1, w):
        now = grams[i : n + i]
        take = now <= least
        np.copyto(least, now, where=take)
        at[take] = np.flatnonzero(take) + i
    return np.unique(at)


#: A filter is in so many slices, by the key's lowest bits; each slice has at most MOST_BITS (so 32 MB a filter).
SLICES, MOST_BITS, BITS_A_KEY, PROBES = 64, 1 << 22, 16, 4


def probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of uint64 keys in a slice of `bits` (a power of two) bits."""
    other = mix(keys, np.uint64(7))
    return [((keys >> np.uint64(6)) + np.uint64(i) * other & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


class Bloom:
    """slices: packed bits of each slice; a slice without keys is empty."""

    def __init__(self, bits: int, slices: dict[int, bytes]) -> None:
        self.bits, self.keys = bits, bool(slices)
        self.data = np.zeros((SLICES, bits // 8), np.uint8)
        for i, packed in slices.items():
            self.data[i] = np.frombuffer(packed, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether keys may be in the set: never False for one that is."""
        if not self.keys:
            return np.zeros(len(keys), bool)
        row = (keys & np.uint64(SLICES - 1)).astype(np.int64)
        out = np.ones(len(keys), bool)
        for at in probes(keys, self.bits):
            out &= (self.data[row, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def blooms(keys: DataFrame, names: list[str]) -> dict[str, Bloom]:
    """Filters of the distinct keys (columns name, key). Slices are made by the executors; at most len(names) * 64 of bounded size come back."""
    n = {r.name: r.n for r in keys.groupBy("name").agg(F.approx_count_distinct("key").alias("n")).collect()}
    bits = {name: min(MOST_BITS, max(1 << 10, 1 << (BITS_A_KEY * n.get(name, 0) // SLICES).bit_length())) for name in names}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["name"].iloc[0]
        full = np.zeros(bits[name], bool)
        for at in probes(pdf["key"].to_numpy().view(np.uint64), bits[name]):
            full[at] = True
        return pd.DataFrame({"name": [name], "slice": pdf["slice"].iloc[:1], "data": [np.packbits(full, bitorder="little").tobytes()]})

    rows = keys.distinct().withColumn("slice", F.col("key").bitwiseAND(SLICES - 1)).groupBy("name", "slice").applyInPandas(build, "name string, slice long, data binary").collect()
    return {name: Bloom(bits[name], {r.slice: bytes(r.data) for r in rows if r.name == name}) for name in names}


class Filters:
    """What tells a document's task which windows may be an item's: fingerprints, windows, and the lengths of short items."""

    def __init__(self, fingerprints: Bloom, windows: Bloom, short: list[int]) -> None:
        self.fingerprints, self.windows, self.short = fingerprints, windows, short


class Decontaminator:
    """window = k + w - 1 words; documented parameters k (words in a gram) and window."""

    def __init__(self, window: int = 10, k: int = 5) -> None:
        self.window, self.k, self.w = window, k, window - k + 1

    # items -----------------------------------------------------------------

    def item_windows(self, benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
        """fp, hash, length, item: the windows of every item. A short item is one window, without a fingerprint.

        An item without an id has windows like any other; its item is null.
        """
        out = pa.schema([("fp", pa.int64()), ("hash", pa.int64()), ("length", pa.int32()), ("item", pa.string())])
        size, k, w = self.window, self.k, self.w

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                for item, text in zip(*picked(batch, "item", "text"), strict=True):
                    words = known.of(words_of(text))
                    if not len(words):
                        continue
                    whole = gram_hashes(words, min(len(words), size))
                    n = len(whole)
                    fps = pa.nulls(n, pa.int64())
                    if len(words) >= size:
                        grams = gram_hashes(words, k)
                        least = np.lib.stride_tricks.sliding_window_view(grams, w).min(axis=1)
                        fps = pa.array(least.view(np.int64))
                    yield record_batch(out, [fps, pa.array(whole.view(np.int64)), pa.array(np.full(n, min(len(words), size)), pa.int32()), pa.array([item] * n, pa.string())])

        source = benchmark.select(F.col(id_column).cast("string").alias("item"), text_bytes(text_column).alias("text"))
        return source.mapInArrow(run, "fp long, hash long, length int, item string").distinct()

    def filters(self, windows: DataFrame) -> Filters:
        keys = windows.where("fp is not null").select(F.lit("fp").alias("name"), F.col("fp").alias("key")).unionByName(windows.select(F.lit("window").alias("name"), F.col("hash").alias("key")))
        made = blooms(keys, ["fp", "window"])
        short = sorted(r.length for r in windows.where(F.col("length") < self.window).select("length").distinct().collect())
        return Filters(made["fp"], made["window"], short)

    # documents -------------------------------------------------------------

    def _marked(self, docs: DataFrame, text_column: str, filters: Filters) -> DataFrame:
        """docs with __row (a number, once written), __words and __at: array<struct<begin, length, hash>> of windows that pass the filters. No shuffle."""
        size, k, w = self.window, self.k, self.w
        shared = docs.sparkSession.sparkContext.broadcast(filters)
        names = docs.columns
        source = docs.withColumn("__weft_text", text_bytes(text_column))
        mark = pa.struct([("begin", pa.int32()), ("length", pa.int32()), ("hash", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, numbers = WordHashes(), RowNumbers()
            for batch in batches:
                texts = batch.column(len(names))
                counts, offsets, begins, lengths, hashes = [], [], [], [], []
                for part in chunks(batch.num_rows, 256):
                    words = [words_of(t) for t in texts.slice(part.start, part.stop - part.start).to_pylist()]
                    n = np.fromiter(map(len, words), np.int64, len(words))
                    doc, begin, length, value = candidates(known.of([x for ws in words for x in ws]), n, shared.value, size, k, w)
                    counts.append(n)
                    offsets.append(np.bincount(doc, minlength=len(n)))
                    begins.append(begin)
                    lengths.append(length)
                    hashes.append(value)
                join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
                ends = np.concatenate([[0], np.cumsum(join(offsets, np.int64))]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(join(begins, np.int32)), pa.array(join(lengths, np.int32)), pa.array(join(hashes, np.uint64).view(np.int64))], fields=list(mark))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], numbers.take(batch.num_rows), pa.array(join(counts, np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[*names, "__row", "__words", "__at"]
                )

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return source.mapInArrow(run, f"{kept}{', ' if kept else ''}__row long, __words long, __at array<struct<begin:int,length:int,hash:long>>")

    @staticmethod
    def _confirmed(marked: DataFrame, windows: DataFrame) -> DataFrame:
        """__row, begin, length, hash of the windows that are an item's. Rows without marks are not shuffled."""
        own = marked.where(F.size("__at") > 0).select("__row", F.explode("__at").alias("m")).select("__row", "m.begin", "m.length", "m.hash")
        return own.join(windows.select("hash", "length").distinct(), ["hash", "length"])

    def hits(self, docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """doc_id, n_words, n_hit, spans (array of [first word, end)), items (sorted strings) for every row of docs.

        One pass over the texts; what passes the filters meets the items' distinct
        windows, so a window that thousands of items share is matched once, and
        those items are looked up for the documents that hold it. Null and wordless
        texts have no words and no hits; rows that repeat a doc_id are kept apart;
        an empty benchmark gives no hits; an item without an id counts for hits and
        is in no list.
        """
        windows = saved(self.item_windows(benchmark), "item_windows")
        # the text goes with the pass; only its marks are written
        source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("__weft_source"))
        marked = saved(self._marked(source, "__weft_source", self.filters(windows)).drop("__weft_source"), "marked")
        found = saved(self._confirmed(marked, windows), "confirmed")
        owners = windows.where("item is not null").select("hash", "length", "item").distinct()
        items = found.select("__row", "hash", "length").distinct().join(owners, ["hash", "length"]).groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("items"))
        spans = found.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("length")).alias("end")))).alias("s")).mapInArrow(_merged, "__row long, n_hit long, spans array<array<int>>")
        hit = spans.join(items, "__row", "left")
        suspects = marked.where(F.size("__at") > 0).select("__row", "doc_id", "__words").join(hit, "__row", "left")
        none = marked.where(F.size("__at") == 0).select("__row", "doc_id", "__words").withColumns({"n_hit": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<array<int>>"), "items": F.lit(None).cast("array<string>")})
        return suspects.unionByName(none).select(
            "doc_id", F.col("__words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )

    def clean(self, docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
        """The rows of docs, as they are, that hold no window of any item; a null text is clean.

        The marked rows are written once; only those with marks meet the confirmed
        ones by their row's number.
        """
        windows = saved(self.item_windows(benchmark), "item_windows")
        marked = saved(self._marked(docs, text_column, self.filters(windows)), "marked")
        hit = self._confirmed(marked, windows).select("__row").distinct()
        suspects = marked.where(F.size("__at") > 0).join(hit, "__row", "left_anti")
        return marked.where(F.size("__at") == 0).select(*docs.columns).unionByName(suspects.select(*docs.columns))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a row, sorted by begin, as their union; and its length."""
    for batch in batches:
        hits, spans = [], []
        for (own,) in zip(*picked(batch, "s"), strict=True):
            begin, end = (np.fromiter((x[name] for x in own), np.int64, len(own)) for name in ("begin", "end"))
            end = np.maximum.accumulate(end)
            first = np.concatenate([[True], begin[1:] > end[:-1]])
            last = np.concatenate([first[1:], [True]])
            hits.append(int((end[last] - begin[first]).sum()))
            spans.append(np.stack([begin[first], end[last]], axis=1).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["__row", "n_hit", "spans"])


def candidates(words: np.ndarray, lens: np.ndarray, filters: Filters, size: int, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin in it, length, hash) of windows that pass the filters, by document. The documents' words lie one after another.

    Each kept gram whose fingerprint passes is extended to the w windows around it,
    however many items share it.
    """
    ends = np.cumsum(lens)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(begin: np.ndarray, value: np.ndarray, length: int) -> None:
        doc = np.searchsorted(ends, begin, side="right")
        good = begin + length <= ends[doc]
        begin, value = begin[good], value[good]
        good = filters.windows.has(value)
        out.append((begin[good], np.full(int(good.sum()), length), value[good]))

    if filters.fingerprints.keys and len(words) >= size:
        grams = gram_hashes(words, k)
        kept = winnow(grams, w)
        kept = kept[filters.fingerprints.has(grams[kept])]
        begin = np.unique(kept[:, None] - np.arange(w))
        begin = begin[(begin >= 0) & (begin + size <= len(words))]
        value = words[begin].copy()
        for i in range(1, size):
            value = mix(value, words[begin + i])
        add(begin, value, size)
    for length in filters.short:
        value = gram_hashes(words, length)
        add(np.arange(len(value)), value, length)
    begin, length, value = (np.concatenate([np.zeros(0, kind), *(o[j] for o in out)]).astype(kind) for j, kind in enumerate((np.int64, np.int64, np.uint64)))
    doc = np.searchsorted(ends, begin, side="right")
    order = np.lexsort((begin, doc))
    begin, length, value, doc = begin[order], length[order], value[order], doc[order]
    return doc, begin - (ends - lens)[doc] if len(doc) else begin, length, value
