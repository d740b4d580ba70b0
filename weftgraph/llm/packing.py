"""Packing into windows of a fixed number of tokens by best-fit decreasing.

Documents longer than a window are first cut into full windows, which are
sequences of their own. The tails are dealt into shards of a bounded number of
pieces, and each shard packs its own, longest first: a segment tree indexed by
remaining capacity finds the open window with the least room that is enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.common import picked, record_batch, saved, text_bytes

_ENCODERS: dict[str, object] = {}


class Encoder:
    """Token ids of byte_bpe_50k.json, special tokens in texts included.

    The ids are those of the `tokenizers` library without added tokens. Texts
    that hold none of the file's special strings are encoded by `tiktoken` with
    the same merges, where the folder has them as ranks: that gives the same ids
    several times as fast (tests compare both).
    """

    def __init__(self, path: str) -> None:
        import base64
        import json
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith("byte_bpe_50k.json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): every document cut into full windows and a tail."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    out = pa.schema([*fields, ("ids", pa.binary())] if keep_ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(*picked(batch, "doc_id", "text"), strict=True):
                ids = np.array([*coder.ids(text.decode("utf-8", "replace")), end_id], "<u4")
                for s in range(0, len(ids), window):
                    part = ids[s : s + window].tobytes()
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), len(ids), *([part] if keep_ids else [])))
            yield record_batch(out, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(out))

    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


class RoomTree:
    """Open windows by remaining capacity; finds the least capacity that is at least what is asked."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for least; it leaves the tree."""
        i, count = least + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not count[2 * i])
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; lengths come longest first."""
    tree, where, offset, opened = RoomTree(window), [], [], 0
    for n in lengths:
        if (found := tree.take(n)) is None:
            found, opened = (window, opened), opened + 1
        room, sequence = found
        where.append(sequence)
        offset.append(window - room)
        if room > n:
            tree.add(room - n, sequence)
    return where, offset


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, shard_pieces: int = 100_000, **options) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Each shard of tails (dealt by a hash of the piece, so equal documents spread)
    packs at most about `shard_pieces` of them; only its last windows have more
    padding than one shard for all would leave. sequence_id: the shard in the
    upper bits, the window in it below; full windows take the odd numbers of a
    shard, windows of tails the even ones. Null texts are empty: one end token.
    Repeated rows are packed each; an empty table gives no rows.
    """
    cut = saved(pieces(docs, tokenizer, window, **options), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    names, schema = cut.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        full = int((pdf["length"] == window).sum())
        where, offset = best_fit(pdf["length"].iloc[full:].tolist(), window)
        number = np.concatenate([2 * np.arange(full, dtype=np.int64) + 1, 2 * np.array(where, np.int64)])
        pdf["sequence_id"] = (shard << 32) + number
        pdf["offset"] = np.concatenate([np.zeros(full, np.int64), np.array(offset, np.int64)])
        return pdf[[*names, "sequence_id", "offset"]]

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, f"{schema}, sequence_id long, offset long")
