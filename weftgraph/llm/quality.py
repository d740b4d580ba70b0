"""Quality classifier by hierarchical empirical Bayes.

Boosted trees on the shape of a text give each document's evidence. Evidence is
summed by host and by path in grouped aggregations; a site's posterior is its
mean, shrunk toward its parent (path to host, host to all documents) by as many
pseudo-documents as the spread between sites warrants. A document's own evidence
is taken out of its site before both are combined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.common import RowNumbers, fold, picked, saved, text_bytes
from weftgraph.llm.trees import Calibrated

#: Groups of bytes whose shares are features.
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?",
    "bang": b"!",
    "symbol": b"#$%&*+<=>@^_~",
    "bar": b"|/\\",
    "bracket": b"()[]{}",
    "quote": b"\"'`-",
}
FEATURES = [*_GROUPS, "high", "log_words", "mean_word", "distinct", "top_word", "repeats", "short_words", "long_words", "line_repeats", "pair_distinct", "word_tail"]


def shape(text: bytes) -> list[float]:
    """The dense features of one text; an empty text has zeros."""
    n = len(text)
    words = text.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    m = len(words)
    shares = [(n - len(text.translate(None, g))) / n for g in _GROUPS.values()]
    lens = np.fromiter(map(len, words), np.int64, m)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, m)
    lines = text.split(b"\n")
    # letters and stops aside, what do words end in?
    tails = sum(w[-1] in b"#$%&*+<=>@^_~|!" for w in words)
    same = int((codes[1:] == codes[:-1]).sum())
    pairs = len(np.unique(codes[1:] * m + codes[:-1])) / (m - 1) if m > 1 else 1.0
    return [
        *shares,
        sum(shares) * -1 + 1,
        float(np.log1p(m)),
        float(lens.mean()),
        len(known) / m**0.8,
        float(np.bincount(codes).max()) / m,
        same / m,
        float((lens <= 2).mean()),
        float((lens > 15).mean()),
        1 - len(set(lines)) / len(lines),
        pairs,
        tails / m,
    ]


@dataclass
class QualityModel:
    """sample_rows: at most so many labelled rows are fitted, those of least hash.

    Null ids and labels are left out, a repeated id counts once (its largest label);
    empty and null texts have features of zero, very long ones are read whole;
    without labelled rows every text gets 0.5.
    """

    model: Calibrated
    labelled: int

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_rows: int = 20_000, train: Column | None = None) -> QualityModel:
        chosen = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label")).where("id is not null and label in (0, 1)")
        chosen = chosen.groupBy("id").agg(F.max("label").alias("label"))
        if train is not None:
            chosen = chosen.where(train)
        chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        rows = docs.select(F.col(id_column).alias("id"), text_bytes(text_column).alias("text")).join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("key"), "text", "label")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, texts, label = picked(batch, "key", "text", "label")
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(label, pa.float64()), pa.array([shape(t) for t in texts], pa.list_(pa.float64()))], names=["id", "label", "x"])

        # one row for each id, so repeated documents cannot exceed the bound
        got = rows.mapInArrow(run, "id long, label double, x array<double>").groupBy("id").agg(F.min(F.struct("label", "x")).alias("v")).select("id", "v.*").collect()
        got = sorted(got, key=lambda r: r.id)
        x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
        y = np.array([r.label for r in got])
        place = np.array([(r.id * 2654435761 >> 7) % 4 for r in got], np.int64)
        return cls(Calibrated.fit(x, y, place), len(got))

    def evidence(self, docs: DataFrame, text_column: str = "text", name: str = "evidence", row_name: str | None = None) -> DataFrame:
        """docs with one more column (double): the document classifier's probability of good quality.

        row_name: a column with a number for each row as well, fixed once the result is written.
        """
        model = docs.sparkSession.sparkContext.broadcast(self.model)
        names = docs.columns
        source = docs.withColumn("__weft_text", text_bytes(text_column))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = RowNumbers()
            for batch in batches:
                x = np.array([shape(t) for t in batch.column(len(names)).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
                p = np.clip(model.value.predict(x), 1e-6, 1 - 1e-6)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p), numbers.take(batch.num_rows)], names=[*names, name, row_name or "__row"])

        out = f"{', '.join([*(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema), f'`{name}` double', f'`{row_name or "__row"}` long'])}"
        made = source.mapInArrow(run, out)
        return made if row_name else made.drop("__row")


def _strength(between: float, inside: float, least: float = 2.0, most: float = 10_000.0) -> float:
    """Pseudo-documents of a prior: the variance inside a site over that between sites, less one."""
    return float(min(most, max(least, inside / between - 1))) if between > 0 else most


def strengths(paths: DataFrame, hosts: DataFrame, mean: float) -> tuple[float, float]:
    """(of hosts toward the mean, of paths toward their host), by the method of moments: the spread of means beyond chance.

    paths: site_host, n, s, nh, sh; hosts: n, s.
    """
    h = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.lit(mean)) ** 2).alias("v")).first()
    inside = mean * (1 - mean)
    scale = h.n - h.nn / h.n if h.n else 0.0
    kh = _strength((h.v - (h.k - 1) * inside) / scale, inside) if scale > 0 else _strength(0.0, inside)
    # a path's spread is about its own host's mean
    host = F.col("sh") / F.col("nh")
    p = paths.agg(
        F.count("*").alias("k"), F.count_distinct("site_host", F.col("site_host").isNull()).alias("h"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / F.col("nh")).alias("nn"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - host) ** 2).alias("v"), F.sum(F.col("n") * host * (1 - host)).alias("inside"),
    ).first()
    scale = p.n - p.nn if p.n else 0.0
    inside = p.inside / p.n if p.n else 0.0
    kp = _strength((p.v - (p.k - hosts.count()) * inside) / scale, inside) if scale > 0 else _strength(0.0, inside)
    return kh, kp


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame, host: str, path: str, evidence: str = "evidence") -> tuple[DataFrame, float]:
    """A row per (host, path): n, s of the path, nh, sh of the host; the strengths as columns; the global mean."""
    paths = saved(scored.groupBy(F.col(host).alias("site_host"), F.col(path).alias("site_path")).agg(F.count("*").cast("double").alias("n"), F.sum(evidence).alias("s")), "paths")
    hosts = saved(paths.groupBy("site_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 1e-4), 1 - 1e-4) if total.n else 0.5
    sites = paths.join(hosts.select(F.col("site_host").alias("h"), F.col("n").alias("nh"), F.col("s").alias("sh")), F.col("site_host").eqNullSafe(F.col("h"))).drop("h")
    kh, kp = strengths(sites, hosts, mean)
    return saved(sites.withColumn("kh", F.lit(kh)).withColumn("kp", F.lit(kp)), "sites"), mean


#: So many sites (some 100 bytes each) go to all tasks; more of them meet the documents' narrow rows in a shuffle.
BROADCAST_SITES = 200_000


def classify(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host: str = "source", path: str = "lang", label_column: str = "quality", threshold: float = 0.5,
    sample_rows: int = 20_000, train: Column | None = None, prefix: str = "", columns: list[str] | None = None, broadcast_sites: int = BROADCAST_SITES,
) -> DataFrame:
    """docs with evidence, site (the site's posterior without the document), quality (their combination) and keep.

    columns: those of docs that are returned (all by default). Each text is scored
    once; the scored rows are written with these columns and read again. Documents
    without a host or path form a site of nulls; null and empty texts have features
    of zero; rows that repeat count each; without labels every text has the evidence
    0.5 and stays; an empty table gives no rows. The added columns are named with
    `prefix`; columns of docs with these names are replaced. A host with a third of
    the documents is summed in partial aggregates, and no text is shuffled by host.
    """
    added = [prefix + n for n in ("evidence", "site", "quality", "keep")]
    model = QualityModel.fit(docs, labels, id_column, text_column, label_column, sample_rows, train)
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in added]
    # under their own names until the end, so that no column of docs can be taken for them
    keyed = docs.select(*[F.col(c) for c in wanted], F.col(host).alias("__weft_h"), F.col(path).alias("__weft_p"), F.col(text_column).alias("__weft_t"))
    scored = saved(model.evidence(keyed, "__weft_t", "__weft_evidence", "__weft_row").drop("__weft_t"), "scored")
    sites, mean = site_posteriors(scored, "__weft_h", "__weft_p", "__weft_evidence")
    few = sites.count() <= broadcast_sites
    sites = sites.select(F.col("site_host").alias("__weft_host"), F.col("site_path").alias("__weft_path"), F.struct("n", "s", "nh", "sh", "kh", "kp").alias("__weft_site"))
    own, at = F.col("__weft_evidence"), lambda n: F.col("__weft_site")[n]
    up = (at("sh") - own + at("kh") * F.lit(mean)) / (at("nh") - 1 + at("kh"))
    site = (at("s") - own + at("kp") * up) / (at("n") - 1 + at("kp"))
    both = 1 / (1 + F.exp(-(logit(own) - F.lit(float(np.log(mean / (1 - mean)))) + logit(F.col("__weft_prior")))))
    same = F.col("__weft_h").eqNullSafe(F.col("__weft_host")) & F.col("__weft_p").eqNullSafe(F.col("__weft_path"))
    if few:
        joined = scored.join(F.broadcast(sites), same).withColumn("__weft_prior", site).withColumn("__weft_both", both)
    else:
        narrow = scored.select("__weft_row", "__weft_h", "__weft_p", "__weft_evidence").join(sites, same).withColumn("__weft_prior", site).withColumn("__weft_both", both)
        joined = scored.join(narrow.select("__weft_row", "__weft_prior", "__weft_both"), "__weft_row")
    values = [own, F.col("__weft_prior"), F.col("__weft_both"), F.col("__weft_both") >= threshold]
    return joined.select(*wanted, *[v.alias(n) for v, n in zip(values, added, strict=True)])


def held_out(id_column: str = "doc_id") -> Column:
    return fold(id_column, 4) == 2
