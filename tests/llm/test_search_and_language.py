"""ANN search and the language model beside brute force."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ann
from weftgraph.llm.common import fold, grouped, sorted_order
from weftgraph.llm.ngram_lm import Chunk, discounts, kneser_ney, perplexity, squeezed, unsqueezed

SCHEMA = "vec_id long, embedding array<float>, label int, v double"


def vectors(spark, rows):
    """With extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 1, 0.5) for i, x in rows], SCHEMA)


def brute(rows, query, k):
    q = dict(rows)[query]
    q = np.asarray(q, np.float32).astype(float)
    scored = []
    for i, x in rows:
        if i != query:
            x = np.asarray(x, np.float32).astype(float)
            scored.append((-(x * q).sum() / math.sqrt((x * x).sum()) / math.sqrt((q * q).sum()), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32)) for i in range(3000)]
    found = ann.search(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=5).collect()
    by = collections.defaultdict(dict)
    for r in found:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = 0
    for query, got in by.items():
        want = brute(rows, query, 5)
        hits += len({i for i, _ in want} & {i for i, _ in got.values()})
        exact = dict(brute(rows, query, len(rows)))
        assert [got[k][1] for k in range(1, 6)] == sorted((s for _, s in got.values()), reverse=True)
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got.values())
    assert len(by) == 30 and hits / 150 >= 0.9


def test_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(40)] + [(100, [1.0, 1.0, 0.1]), (101, [0.0, 0.0, 1.0])]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [nan, 1, 1]), (203, [inf, 1, 1]), (204, [None, 1, 1]), (206, []), (None, [1, 1, 0])]
    df = vectors(spark, rows + bad).union(vectors(spark, [(3, [1.0, 1.0, 0.0])]))
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(df, F.col("vec_id").isin(2, 100, 201), k=5).collect()}
    assert [found[2, k][0] for k in range(1, 6)] == [0, 1, 3, 4, 5]  # copies: the smaller ids, without the row itself
    assert [found[100, k][0] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert not any(q == 201 for q, _ in found)
    few = ann.search(vectors(spark, rows[:3]), F.col("vec_id") == 0, k=5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.search(vectors(spark, bad[:5]), F.col("vec_id") > 0).count() == 0
    assert ann.search(vectors(spark, []), F.col("vec_id") > 0).count() == 0


def test_lengths_sizes_and_shared_ids(spark):
    """Lengths are searched apart; huge and tiny vectors take part; rows that share an id are separate."""
    rows = [(0, [1.0, 2.0]), (1, [1e200, 2e200]), (2, [1e-200, 2.1e-200]), (3, [5e-324, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 1.0, 0.0]), (6, [-1.0, 2.0]), (6, [1.0, 2.05]), (7, [3.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id").isin(0, 4), k=9).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in got[0]] == [1, 6, 2, 6, 3] and got[0][0][1] == pytest.approx(1) and got[0][3][1] == pytest.approx(0.6) and got[0][4][1] == pytest.approx(5**-0.5)
    assert [i for i, _ in got[4]] == [7, 5]
    both = ann.search(df, F.col("vec_id") == 6, k=1).collect()
    assert [r.vec_id for r in both] == [2, 2]


def test_anisotropic_loss_favours_the_parallel_part():
    rng = np.random.default_rng(0)
    x = ann.unit(rng.normal(size=(2000, 16)))

    def along(eta):
        model = ann.AnisotropicQuantizer.fit(x, eta=eta)
        codes = model.encode(x)
        near = model.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, :16]
        return np.abs(((x - near) * x).sum(1)).mean()

    assert along(8.0) < along(1.0)


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8)) for i in range(9000)]
    df = vectors(spark, rows)
    one = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 1000 == 0, margin=50).collect())
    two = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 1000 == 0, margin=50, query_components=16).collect())
    assert one == two
    assert [(r[2]) for r in one if r[0] == 0] == [i for i, _ in brute(rows, 0, 5)]


def test_no_vector_is_shuffled(spark):
    """Only keys and scores lie in exchanges; vectors are coded once, in a pass without one."""
    df = vectors(spark, [(i, np.arange(1, 9) + i) for i in range(50)])
    plan = ann.search(df, F.col("vec_id") % 10 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "embedding" not in plan and "cogroup" not in plan.lower()


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall_over_many_vectors(kind):
    """120,000 vectors in batches, 64 components: at least 0.9 of the 5 nearest, few reranked."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120_000, 64)).astype(np.float32).astype(float)
    if kind == "clusters":
        x = rng.normal(size=(300, 64))[rng.integers(0, 300, len(x))] + 0.35 * x
    model = ann.AnisotropicQuantizer.fit(ann.unit(x[::11]))
    asked = np.arange(0, len(x), 2000)
    ids = np.arange(len(x))
    near = ann.Nearest(model, asked, x[asked], 5)
    for at in range(0, len(x), 10_000):
        near.add(ann.Coded.of(model, ids[at : at + 10_000], ids[at : at + 10_000], x[at : at + 10_000]))
    exact = ann.unit(x[asked]) @ ann.unit(x).T
    exact[np.arange(len(asked)), asked] = -2
    hits = sum(len(set(b[1]) & set(np.argsort(-e)[:5].tolist())) for b, e in zip(near.best, exact, strict=True))
    share = near.reranked / (len(asked) * len(x))
    print(kind, "recall", hits / (5 * len(asked)), "reranked", share)
    assert hits / (5 * len(asked)) >= 0.98 and share < 0.05


# language model --------------------------------------------------------------------


def plain_model(docs, train, n=3):
    """Counts, and a function for the probability of a gram, by the textbook."""
    start, end = "<s>", "</s>"
    tokens = [d.lower().split() + [end] for d in docs]
    counts = {k: collections.Counter() for k in range(1, n + 1)}
    for t, used in zip(tokens, train, strict=True):
        padded = [start] * (n - 1) + t
        for i in range(n - 1, len(padded) if used else 0):
            counts[n][tuple(padded[i - n + 1 : i + 1])] += 1
    for k in range(n - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    raw = collections.Counter(w for t, used in zip(tokens, train, strict=True) if used for w in t)
    cut = {}
    follow = {k: collections.defaultdict(list) for k in counts}
    for k in counts:
        of = collections.Counter(counts[k].values())
        d = discounts(of[1], of[2], of[3], of[4])
        cut[k] = lambda c, d=d: 0 if c <= 0 else d[min(c, 3) - 1]
        for g, c in counts[k].items():
            follow[k][g[:-1]].append(c)

    def p(k, g):
        lower = 1 / (len(raw) + 1) if k == 1 else p(k - 1, g[1:])
        seen = follow[k].get(g[:-1])
        if not seen:
            return lower
        c = counts[k].get(g, 0)
        return max(c - cut[k](c), 0) / sum(seen) + sum(map(cut[k], seen)) / sum(seen) * lower

    scores = []
    for t in tokens:
        padded = [start] * (n - 1) + t
        scores.append(sum(math.log10(p(n, tuple(padded[i - n + 1 : i + 1]))) for i in range(n - 1, len(padded))))
    return tokens, raw, p, scores


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_the_textbook_ones(spark, small, order):
    rng = np.random.default_rng(2)
    docs = [" ".join(rng.choice(list("abcdefG"), rng.integers(0, 40))) for _ in range(50)]
    docs[3], docs[5], docs[7] = "", docs[6], "\x0b x\ty  z" + " a" * 3000
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(50)]
    tokens, raw, p, want = plain_model(docs, train, order)
    for context in (("a", "b")[: order - 1], ("<s>",) * (order - 1), ("q", "b")[: order - 1]):
        assert sum(p(order, (*context, w)) for w in [*raw, "unseen"]) == pytest.approx(1)
    df = spark.createDataFrame([(i, d, 1, "z") for i, d in enumerate(docs)], "doc_id long, text string, chunk int, words string")
    options = {"chunk_tokens": 60, "shard_keys": 50} if small else {}
    scores, model = kneser_ney(df, fold("doc_id", 5) != 1, order, **options)
    rows = scores.withColumn("perplexity", perplexity(F.col("score"), F.col("n_tokens"))).orderBy("doc_id").collect()
    total = sum(raw.values())
    for r, t, score, used in zip(rows, tokens, want, train, strict=True):
        assert r.score == pytest.approx(score, rel=1e-9) and r.held_out == (not used)
        assert r.n_tokens == len(t) and r.n_known == sum(w in raw for w in t) and r.train_tokens == total
        assert r.base_score == pytest.approx(sum(math.log10((raw[w] + 0.5) / (total + 0.5 * (len(raw) + 1))) for w in t))
        assert r.perplexity == pytest.approx(10 ** (-score / len(t)))
    # the model's arrays are sorted, and hold every gram once
    keys = [unsqueezed(r["keys"], deltas=True) for r in model[order].orderBy("shard").collect()]
    joined = np.concatenate(keys)
    assert (np.diff(joined.astype(np.int64)) > 0).all()
    assert len(joined) == len({tuple((["<s>"] * (order - 1) + t)[i : i + order]) for t, used in zip(tokens, train, strict=True) if used for i in range(len(t))})


def test_language_model_of_odd_tables(spark):
    schema = "doc_id long, text string"
    nothing = kneser_ney(spark.createDataFrame([], schema), fold("doc_id", 5) != 1)[0]
    assert nothing.count() == 0
    rows = [(None, None), (1, "a b"), (1, "a b"), (2, "")]
    got = kneser_ney(spark.createDataFrame(rows, schema), F.lit(True))[0].collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 1), (False, 3), (False, 3), (True, 1)]
    untrained = kneser_ney(spark.createDataFrame(rows, schema), F.lit(None).cast("boolean"))[0].collect()
    assert all(r.held_out and r.score == r.base_score == 0.0 and r.n_known == 0 for r in untrained)


def test_sorted_orders():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        k = rng.integers(0, 1 << 56, n, dtype=np.uint64)
        k = np.concatenate([k, k ^ np.uint64(1), k])
        assert (sorted_order(k) == np.argsort(k, kind="stable")).all()
        names, numbers = np.unique(k, return_inverse=True)
        a, b, first = grouped(k)
        assert (a == names).all() and (b == numbers).all() and (k[first] == names).all()
        assert (unsqueezed(squeezed(names, deltas=True), deltas=True) == names).all()


def test_chunks_round_trip():
    words = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    c = Chunk(np.array([5, 0, -3]), np.array([False, True, False]), np.array([True, False, True]), np.array([100, 1, 199]), words)
    d = Chunk.unpacked(c.packed())
    for name in ("ids", "null_ids", "train", "lens", "words"):
        assert (getattr(c, name) == getattr(d, name)).all()


def test_search_among_near_equal_vectors():
    """A third of the vectors is one group of almost equal ones."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x[:1000] = rng.normal(size=64) + 0.01 * rng.normal(size=(1000, 64))
    ids, asked = np.arange(3000), np.concatenate([np.arange(0, 1000, 100), np.arange(1000, 3000, 200)])
    model = ann.AnisotropicQuantizer.fit(ann.unit(x[::3]))
    near = ann.Nearest(model, asked, x[asked], 5)
    for part in (ids[::2], ids[1::2]):
        near.add(ann.Coded.of(model, part, part, x[part]))
    for i, best in zip(asked, near.best, strict=True):
        exact = ann.unit(x) @ ann.unit(x[i : i + 1])[0]
        exact[i] = -2
        assert set(best[1]) == set(np.argsort(-exact)[:5])
