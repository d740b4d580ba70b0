"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon (words and word beginnings) is counted in Spark on a bounded sample
of labelled documents. Features: densities of the lexicon, its nearness to words
of the second person, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.common import picked, record_batch, saved, text_bytes
from weftgraph.llm.trees import Calibrated

#: Words of the second person in English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
#: Signs that stand for letters in obfuscated words, and the letters.
SIGNS = str.maketrans("@4013$5!7", "aaoiessit")
#: What is cut from the ends of words.
EDGES = ".,;:?!\"'()[]{}<>#%&*$+=|/\\~^_-"
#: Lengths of the word beginnings that can be in the lexicon.
BEGINNINGS = (4, 5, 6)
#: Words of so many letters are counted by a digest.
LONG = 40
#: Stands for the document itself among the counted terms.
DOCUMENT = ""

LEX, BEGIN, YOU, CAPS, MASKED, BANG = 1, 2, 4, 8, 16, 32
FEATURES = ["lex_density", "lex_count", "begin_density", "begin_count", "near_you", "you_density", "caps", "masked", "masked_lex", "bang", "upper", "punct", "log_words", "distinct_lex", "lex_spread", "strength"]


def plain(word: str) -> str:
    """Lower case without marks at the ends, with the letters that signs stand for."""
    word = word.lower().strip(EDGES) or word.lower()
    return word.translate(SIGNS) if any(c.isalpha() for c in word) else word


def terms(word: str) -> list[str]:
    """What of a word can be in the lexicon: itself (a long one as its digest), and its beginnings (marked by a star)."""
    whole = word if len(word) < LONG else "=" + hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=12).hexdigest()
    return [whole, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


class Terms(dict):
    """The terms of a raw word, remembered up to a fixed size."""

    LIMIT = 200_000

    def __missing__(self, raw: bytes) -> list[str]:
        if len(self) >= self.LIMIT:
            self.clear()
        found = terms(plain(raw.decode("utf-8", "replace")))
        if len(raw) < LONG:
            self[raw] = found
        return found


@dataclass
class Lexicon:
    """Terms with the documents they are in: toxic, clean."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    least_documents: int = 3
    least_weight: float = 2.5

    def weight(self, term: str, own: int | None = None) -> float:
        """Log odds of the term, or 0 where it is not in the lexicon; own: a label not to be counted."""
        nt, nc = self.counts.get(term, (0, 0))
        t, c = self.toxic, self.clean
        if own == 1:
            nt, t = max(nt - 1, 0), max(t - 1, 0)
        elif own == 0:
            nc, c = max(nc - 1, 0), max(c - 1, 0)
        if nt < self.least_documents:
            return 0.0
        w = math.log((nt + 0.5) / (t + 1)) - math.log((nc + 0.5) / (c + 1))
        return w if w >= self.least_weight else 0.0


class WordCodes(dict):
    """What a raw word shows, as bits, and its lexicon weight; remembered up to a fixed size."""

    LIMIT = 300_000

    def __init__(self, lexicon: Lexicon, own: int | None = None) -> None:
        self.lexicon, self.own, self.weights = lexicon, own, {}

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
            self.weights.clear()
        word = raw.decode("utf-8", "replace")
        low = plain(word)
        whole, *starts = [self.lexicon.weight(t, self.own) for t in terms(low)]
        core = word.strip(EDGES)
        masked = any(c in "@4013$5!7*" for c in core) and any(c.isalpha() for c in core)
        code = LEX * (whole > 0) | BEGIN * (max(starts, default=0) > 0) | YOU * (low in SECOND) | CAPS * (len(core) > 2 and core.isupper()) | MASKED * masked | BANG * word.endswith("!")
        if code & (LEX | BEGIN):
            self.weights[raw] = max(whole, *starts, 0.0) if starts else whole
        self[raw] = code
        return code


def features(text: bytes, codes: WordCodes, reach: int = 5) -> list[float]:
    """The dense features of one text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.fromiter(map(codes.__getitem__, words), np.uint8, n)
    lex = np.flatnonzero(c & (LEX | BEGIN))
    whole = int(np.count_nonzero(c & LEX))
    begin = int(np.count_nonzero(c & BEGIN))
    you = np.flatnonzero(c & YOU)
    near = 0
    if len(lex) and len(you):
        near = int((np.searchsorted(you, lex + reach, side="right") > np.searchsorted(you, lex - reach)).sum())
    found = {words[i] for i in lex.tolist()}
    letters = len(text)
    upper = letters - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = letters - len(text.translate(None, b".,;:?!\"'()[]{}<>#%&*$+=|/\\~^_-@"))
    return [
        100 * whole / n,
        math.log1p(whole),
        100 * begin / n,
        math.log1p(begin),
        100 * near / n,
        100 * len(you) / n,
        float(np.count_nonzero(c & CAPS)) / n,
        float(np.count_nonzero(c & MASKED)) / n,
        math.log1p(np.count_nonzero((c & MASKED > 0) & (c & (LEX | BEGIN) > 0))),
        float(np.count_nonzero(c & BANG)) / n,
        upper / letters,
        marks / letters,
        math.log1p(n),
        math.log1p(len(found)),
        float(lex[-1] - lex[0]) / n if len(lex) else 0.0,
        sum(codes.weights.get(w, 0.0) for w in found) / (1 + len(found)),
    ]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    model: Calibrated
    labelled: int

    @classmethod
    def fit(
        cls, docs: DataFrame, labels: DataFrame, train: Column | None = None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        sample_rows: int = 12_000, lexicon_toxic: int = 8_000, lexicon_clean: int = 16_000, lexicon_terms: int = 20_000,
    ) -> ToxicityModel:
        """train: a condition on the column `id`. The bounds are on labelled rows, chosen by hash.

        Null ids and labels are left out; a repeated id has its largest label. Rows
        that repeat an id count each in the lexicon and once in the fit. Null and
        empty texts have features of zero, very long ones are read whole; without
        labelled rows every text gets the same score.
        """
        marked = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id is not null and label in (0, 1)")
        marked = marked.groupBy("id").agg(F.max("label").alias("label"))
        if train is not None:
            marked = marked.where(train)
        marked = saved(marked, "labels")
        order = (F.xxhash64("id"), "id")
        # toxic rows are rare: half of the sample may be theirs
        part = lambda label, n: marked.where(F.col("label") == label).orderBy(*order).limit(n)
        texts = docs.select(F.col(id_column).alias("id"), text_bytes(text_column).alias("text"))
        counted = saved(part(1, lexicon_toxic).unionByName(part(0, lexicon_clean)), "lexicon_rows")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
            of = Terms()
            for batch in batches:
                seen: dict[str, list[int]] = {}
                for text, label in zip(*picked(batch, "text", "label"), strict=True):
                    for t in {DOCUMENT, *chain.from_iterable(of[w] for w in set(text.split()))}:
                        seen.setdefault(t, [0, 0])[1 - label] += 1
                yield record_batch(out, [list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]])

        sums = texts.join(F.broadcast(counted), "id").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        sums = saved(sums, "lexicon_terms")
        whole = sums.where(F.col("term") == DOCUMENT).first()
        toxic, clean = (whole.toxic, whole.clean) if whole else (0, 0)
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        kept = sums.where("toxic >= 3").where(odds >= 2.0).where(F.col("term") != DOCUMENT).orderBy(F.desc(odds * F.sqrt("toxic")), "term").limit(lexicon_terms).collect()
        lexicon = Lexicon({r.term: (r.toxic, r.clean) for r in kept}, toxic, clean)
        in_lexicon = F.broadcast(counted.select("id", F.lit(True).alias("counted")))
        chosen = saved(part(1, sample_rows // 2).unionByName(part(0, sample_rows)), "fitted_rows")
        shared = docs.sparkSession.sparkContext.broadcast(lexicon)

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = {own: WordCodes(shared.value, own) for own in (0, 1, None)}
            for batch in batches:
                key, texts, label, counted = picked(batch, "key", "text", "label", "counted")
                # a document that is in the lexicon's counts does not vouch for itself
                x = [features(t, codes[y if c else None]) for t, y, c in zip(texts, label, counted, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(label, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "x"])

        rows = texts.join(F.broadcast(chosen), "id").join(in_lexicon, "id", "left").select(F.xxhash64("id").alias("key"), "text", "label", "counted")
        # one row for each id, so repeated documents cannot exceed the bound
        rows = rows.mapInArrow(dense, "id long, label long, x array<double>").groupBy("id").agg(F.min(F.struct("label", "x")).alias("v")).select("id", "v.*").collect()
        rows = sorted(rows, key=lambda r: r.id)
        x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
        y = np.array([r.label for r in rows], float)
        # each class weighs what was counted of it, whatever the bounds let into the sample
        counted_of = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
        share = [max(1.0, counted_of.get(label, 0) / bound) for label, bound in ((0, sample_rows), (1, sample_rows // 2))]
        weight = np.where(y > 0, share[1], share[0])
        weight = weight * (len(weight) / max(weight.sum(), 1))
        return cls(lexicon, Calibrated.fit(x, y, np.array([(r.id * 2654435761 >> 7) % 4 for r in rows], np.int64), weight=weight), len(rows))

    def score(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """doc_id, score (0 to 1) for every row of docs, and no other column of theirs; null texts are empty. One pass, no shuffle."""
        shared = docs.sparkSession.sparkContext.broadcast((self.lexicon, self.model))
        source = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text"))
        kind = source.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, model = shared.value
            codes = WordCodes(lexicon)
            for batch in batches:
                x = np.array([features(t, codes) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(model.predict(x), 0, 1))], names=["doc_id", "score"])

        return source.mapInArrow(run, f"doc_id {kind}, score double")
