"""Text expressions: trimming, token counts and fixed-point numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Counts tokens of a string column; the one place where users plug in a function.
TokenCounter = Callable[[Column], Column]


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def heuristic_tokens(text: Column) -> Column:
    """The larger of the words and a quarter of the characters, rounded up; 0 for an empty text."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(words, F.ceil(F.length(text) / 4).cast("int")))


def bpe_counter(ranks_path: str, pattern: str, special: dict[str, int] | None = None) -> TokenCounter:
    """Counts byte-pair tokens by a local rank file (base64 token, rank); special tokens count as one each."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        for texts in batches:
            yield texts.map(lambda t: len(coder.encode(t or "", allowed_special="all"))).astype("int32")

    return count


def named_bpe_counter(encoding: str = "cl100k_base") -> TokenCounter:
    """By a named public encoding. Its ranks must be at hand on the driver: otherwise this raises, as other counts would change the budget's meaning."""
    import tiktoken

    tiktoken.get_encoding(encoding)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = tiktoken.get_encoding(encoding)
        for texts in batches:
            yield texts.map(lambda t: len(coder.encode(t or "", allowed_special="all"))).astype("int32")

    return run


@F.pandas_udf(StringType())
def two_decimals(x: pd.Series) -> pd.Series:
    """The exact binary value with two decimals, halves to even (format_string rounds its shortest form)."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.2f}")
