"""Decontamination, secrets, packing, near-duplicates, quality and toxicity beside plain versions."""

import base64
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import common, decontam, packing, quality, secrets, simhash, toxicity
from weftgraph.llm.components import connected_components
from weftgraph.llm.decontam import Decontaminator, gram_hashes, winnow, words_of
from weftgraph.llm.queries import tokenizer_path

#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, evidence string, node string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", "y", 2) for i, t in rows], SCHEMA)


def prose(rnd, n, letters="abcdefghij"):
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 6))) for _ in range(n))


# decontamination -------------------------------------------------------------------


def hit_words(text, items, size=10):
    """(words, hit words, items found) by comparing every window."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if own and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bits", [1 << 22, 8])
def test_every_shared_window_is_hit(spark, bits, monkeypatch):
    """Also where the filters are so full that almost everything passes."""
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    rnd = random.Random(4)
    items = [(i, prose(rnd, rnd.choice([3, 9, 10, 11, 40]))) for i in range(12)] + [(90, ""), (91, None), (92, "Ab, éß c"), (93, "ab éß c"), (94, "x y " * 12), (None, prose(rnd, 15)), (None, "only here")]
    rows = []
    for i in range(60):
        own = prose(rnd, rnd.randint(0, 60)).split()
        for _ in range(rnd.randint(0, 3)):
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(w) - 3))
            own[len(own) // 2 : len(own) // 2] = w[a : a + rnd.randint(1, 30)]
        rows.append((i, ", ".join(own).upper() if i % 2 else " ".join(own)))
    rows += [(100, None), (101, ""), (102, "x y " * 4000), (None, items[4][1]), (5, items[4][1]), (5, items[4][1]), (103, "but only here, " + items[-2][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hash int")
    tool = Decontaminator()
    found = tool.hits(docs(spark, rows), bench).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in found)
    want = sorted((str(i), *hit_words(t, items)[:2], tuple(hit_words(t, items)[2])) for i, t in rows)
    assert got == want
    assert all(r.n_hit == len({p for a, b in r.spans for p in range(a, b)}) for r in found)
    kept = tool.clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((i, t)) for i, t in rows if not hit_words(t, items)[1])


def test_a_window_of_many_items(spark):
    """A prompt that 3,000 items share is matched once a place; a gram of many windows does not multiply candidates."""
    prompt = " ".join(f"p{i}" for i in range(10))
    items = [(i, f"{prompt} own{i}") for i in range(3000)] + [(9000 + i, f"a{i} a{i} a{i} x1 x2 x3 x4 x5 b{i} b{i}") for i in range(500)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tool = Decontaminator()
    windows = tool.item_windows(bench).cache()
    assert windows.select("hash").distinct().count() == 1 + 3000 + 500
    rows = docs(spark, [(1, f"said {prompt} twice {prompt}"), (2, "x1 x2 x3 x4 x5 " * 2000), (3, f"{prompt} own7")])
    marked = tool._marked(rows, "text", tool.filters(windows)).select("doc_id", F.size("__at").alias("n")).collect()
    assert {r.doc_id: r.n for r in marked}[1] == 2 and {r.doc_id: r.n for r in marked}[2] < 100
    found = {r.doc_id: r for r in tool.hits(rows, bench).collect()}
    assert (found[1].n_hit, len(found[1]["items"]), found[2].n_hit) == (20, 3000, 0)
    assert found[3].n_hit == 11 and len(found[3]["items"]) == 3000


def test_filters_lose_no_key(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    made = decontam.blooms(spark.createDataFrame([("a", int(k)) for k in keys], "name string, key long"), ["a", "b"])
    assert made["a"].has(keys.view(np.uint64)).all() and not made["b"].has(keys.view(np.uint64)).any()
    assert made["a"].has(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.02


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in Decontaminator().hits(docs(spark, [(1, "a b")]), bench).collect()] == [0]
    assert Decontaminator().hits(docs(spark, []), bench).count() == 0


def test_winnowing_keeps_a_hash_of_every_window():
    grams = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64)
    kept = set(winnow(grams, 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(295))
    assert len(winnow(grams[:5], 6)) == 0 and len(gram_hashes(grams, 400)) == 0
    assert words_of("A-b\x7fÉ9".encode()) == [b"a", b"b", "É9".encode()]


# secrets -----------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


KEY = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([5 + i] * 40)) for i in range(8)))
SEC1 = der(0x30, der(2, b"\x01") + der(4, bytes(range(32))) + der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, SEC1))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"rest" * 9
TOKEN = ".".join(base64.urlsafe_b64encode(x).rstrip(b"=").decode() for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), b'{"sub":"1234567890"}', bytes(range(32))))


def test_base_spans_and_structures(spark):
    b64 = lambda x: base64.b64encode(x).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(KEY))) + "\n-----END RSA PRIVATE KEY-----"
    noise = b64(bytes(random.Random(1).randbytes(90)))
    rows = [
        (1, "éé PassWord = 'abcdef' and token:short Api_Key=\"a.b/c+d\" 🙂 secret=12345"),
        (2, "AKIA" + "B" * 16 + " AKIA" + "C" * 15 + "0123456789abcdef01234567g" + "f" * 23),
        (3, "ſecret=abcdefgh toKen=abcdefgh"),  # letters that only Unicode folds
        (4, f"x {TOKEN} y {TOKEN[:-1]}.z a.b.c"),
        (5, pem),
        (6, f"{b64(KEY)} {b64(SEC1)} {b64(PKCS8)} {b64(SSH)} {noise} {b64(KEY[:-3])}"),
        (7, f"{KEY.hex()} {KEY.hex()[:-2]}"),
        (8, None), (9, ""), (None, "token=abcdefg"), (10, "token=" * 5000 + "password: " + "a" * 50_000),
    ]
    found = {(r.doc_id, len(r.found)): r.found for r in secrets.scan(docs(spark, rows)).collect()}
    got = {k[0]: [tuple(f) for f in v] for k, v in found.items()}
    for i, t in rows:
        order = {k: n for n, k in enumerate(secrets.KINDS)}
        want = sorted(base_spans(t or ""), key=lambda s: (s[1], order[s[0]]))
        assert [s for s in got[i] if s[0] in secrets.BASE_KINDS] == want
        assert got[i] == sorted(got[i], key=lambda s: (s[1], order[s[0]]))
    added = {i: [s[0] for s in got[i] if s[0] not in secrets.BASE_KINDS] for i in got}
    assert added[4] == ["jwt"] * 1 and added[5] == ["pem"] and added[6] == ["key64"] * 4 and added[7] == ["keyhex"]
    assert not added[1] and not added[2]


def test_open_markers_take_linear_time():
    """Each BEGIN without an END once made a search to the end of the text."""
    import time

    began = time.perf_counter()
    text = "-----BEGIN RSA PRIVATE KEY-----\n" * 20_000 + "a.b" * 100_000 + "A: " * 100_000
    assert secrets.spans_of(text.encode()) == []
    assert time.perf_counter() - began < 5
    # the last BEGIN before an END is the one it closes
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4\n" + base64.b64encode(KEY).decode() + "\n-----END RSA PRIVATE KEY-----"
    found = secrets.spans_of(("-----BEGIN RSA PRIVATE KEY----- and " + pem + " -----END RSA PRIVATE KEY-----").encode())
    assert [(s, e, secrets.KINDS[k]) for s, e, k in found if k > 2] == [(36, 36 + len(pem), "pem")]


def test_no_gate_hides_a_structure():
    header = base64.urlsafe_b64encode(b' {"alg":"HS256"}').rstrip(b"=").decode()
    token = f"{header}.{TOKEN.split('.')[1]}.{TOKEN.split('.')[2]}"
    assert "eyJ" not in header and [k for _, _, k in secrets.spans_of(f"x {token}".encode())] == [secrets.KINDS.index("jwt")]
    lines = re.findall(".{1,64}", base64.b64encode(KEY).decode())
    for end in ("\n", "\r\n"):
        for after in ("", "\nplain words follow"):
            text = "key:\n" + end.join(lines) + after
            assert [(text[s:e].split(), k) for s, e, k in secrets.spans_of(text.encode()) if k > 2] == [(lines, secrets.KINDS.index("key64"))]
    url = base64.urlsafe_b64encode(KEY.replace(bytes([6] * 40), b"\xfb\xff" * 20)).decode()
    assert ("-" in url or "_" in url) and [k for _, _, k in secrets.spans_of(url.encode()) if k > 2] == [secrets.KINDS.index("key64")]


def test_redaction(spark):
    rows = [(1, "my token=abcdefgh ok"), (2, "clean"), (3, None), (4, f"a {TOKEN} b")]
    before = docs(spark, rows)
    after = secrets.redact(before)
    assert after.columns == before.columns
    out = {r.doc_id: r for r in after.collect()}
    assert out[1].text == "my [assign] ok" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean" and out[3].text is None and out[4].text == "a [jwt] b"
    assert secrets.redacted("abcdefgh", [(1, 4, 0), (2, 6, 1), (7, 8, 2)]) == "a[assign]g[hex]"
    assert secrets.redact(docs(spark, [])).count() == 0


# packing -------------------------------------------------------------------------------


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.randint(0, 150))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "x" * 30_000), (203, "a <|endoftext|> b"), (204, "Zoë 🙂\t\n  don't 12345 ſ\u200d漢字"), (207, "again"), (207, "again")]
    packed = packing.pack(docs(spark, rows), tokenizer_path(), window=64, shard_pieces=60).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    spans = {}
    for r in packed:
        spans.setdefault(r.doc_id, []).append(r)
    for i, versions in texts.items():
        ids = versions[0]
        assert sum(r.length for r in spans[i]) == len(ids) * len(versions)
        for r in spans[i]:
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_best_fit_is_the_tightest():
    rnd = random.Random(8)
    for _ in range(50):
        lengths = sorted((rnd.randint(1, 31) for _ in range(60)), reverse=True)
        where, offset = packing.best_fit(lengths, 32)
        room: list[int] = []
        for n, w, o in zip(lengths, where, offset, strict=True):
            fitting = [r for r in room if r >= n]
            if w == len(room):
                assert not fitting
                room.append(32)
            else:
                assert room[w] == min(fitting)
            assert o == 32 - room[w]
            room[w] -= n


# near-duplicates ---------------------------------------------------------------------------


def test_fingerprints_and_components(spark):
    rnd = random.Random(9)
    base = [prose(rnd, 80) for _ in range(12)]
    rows = []
    for i in range(150):
        words = base[i % 12].split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice("xyz")
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "one two"), (None, base[0]), (0, rows[0][1]), (505, "w " * 20_000)]

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    want = sorted((str(i), prints[k], str(least.get(top(k)))) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("shard_rows", [10_000, 7])
@pytest.mark.parametrize("blocks", [4, 5])
def test_trees_find_every_link(spark, shard_rows, blocks):
    """Random and clustered fingerprints; also where hot keys are cut into parts."""
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(20):
            f = int(c)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, f) for f in signed], "node long, fp long")
    links = simhash.near_links(df, simhash.block_keys(F.col("fp"), 3, blocks), 3, shard_rows=shard_rows)
    labels = {r.node: r.component for r in connected_components(links).collect()}
    arr = np.array(sorted(signed))
    label = {int(a): int(a) for a in arr}
    changed = True
    while changed:
        changed = False
        for a in arr:
            near = arr[np.bitwise_count(arr.view(np.uint64) ^ np.uint64(int(a) & (2**64 - 1))) <= 3]
            least = min(label[int(b)] for b in near)
            for b in near:
                if label[int(b)] != least:
                    label[int(b)], changed = least, True
    assert {f: labels.get(f, f) for f in signed} == label


def test_tasks_follow_the_copies_of_hot_keys(spark):
    """One key with a hundred parts: tasks count its copies, so none gets much more than its share."""
    n, part, share = 2000, 20, 1000
    df = spark.range(n).select(F.col("id").alias("node"), F.lit(5).alias("key"))
    sizes = df.groupBy("key").agg(F.count("*").alias("n"))
    tasks = simhash.tasks_for(sizes, part, share)
    assert tasks == n * (n // part) // share
    dealt = simhash.dealt(df.join(sizes, "key"), part, tasks)
    loads = [r.n for r in dealt.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(loads) == n * (n // part) and max(loads) < 3 * share
    assert dealt.groupBy("cell").count().agg(F.max("count")).first()[0] <= 4 * part


def test_hot_keys_are_spread(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).alias("key"))
    side = spark.range(60).select(F.col("id").cast("int").alias("key"), (F.col("id") * 2).alias("value"))
    got = common.joined_spread(rows.withColumn("key", F.col("key").cast("int")), side, "key", least=500).collect()
    want = rows.where("key is not null").count()
    assert len(got) == want and all(r.value == 2 * r.key for r in got)


@pytest.mark.parametrize("most", [100, 0])
def test_among_numbers(spark, most):
    """By bitmaps and by the semi join: numbers at the ends of a bitmap, far apart, repeated, none, and rows without a number."""
    near = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536]
    numbers = [b + n for b in (0, 1 << 36, 5 << 36) for n in near]
    rows = spark.createDataFrame([(n, str(n)) for n in [*numbers, *numbers, None]], "__row long, text string")
    for chosen in (numbers, numbers[::2], numbers[1::2] * 2, numbers[3:4], []):
        side = spark.createDataFrame([(n, "x") for n in chosen], "__row long, text string")
        got = common.among(rows, side, "__row", most)
        assert got.columns == rows.columns
        assert sorted(map(tuple, got.collect())) == sorted((n, str(n)) for n in set(chosen) for _ in range(2))


def test_similar_copies(spark):
    rnd = random.Random(10)
    rows, groups = [], []
    for g in range(15):
        words = prose(rnd, 200).split()
        rows.append((10 * g, " ".join(words)))
        near = list(words)
        near[rnd.randrange(200)] = "changed"
        rows.append((10 * g + 1, " ".join(near)))
        rows.append((10 * g + 2, " ".join(words).upper()))
        half = words[:100] + prose(rnd, 100).split()
        rows.append((10 * g + 3, " ".join(half)))  # not a copy: a third is shared
        groups.append(10 * g)
    rows += [(900, None), (901, ""), (None, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_copies(docs(spark, rows)).collect()}
    for g in groups:
        assert (got[g], got[g + 1], got[g + 2], got[g + 3]) == (g, g, g, g + 3)
    assert got[900] == got[901] == got[None] == 900
    assert simhash.similar_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("length", "pairs"), [(45, 40), (225, 40), (1250, 40)])
def test_similar_copies_are_exact(spark, length, pairs):
    """Pairs from 0.75 to 0.87, short and long; also where keys and classes are cut into parts."""
    rnd, rows, want = random.Random(length), [], {}
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(0, 2 * pairs, 2):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
        change = round(length * rnd.uniform(0.075, 0.136))
        b = a[:-change] + [f"w{rnd.randrange(10**6)}" for _ in range(change)]
        true = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        want[i + 1] = i if true >= 0.8 else i + 1
    assert 5 < sum(k != v for k, v in want.items()) < pairs - 5
    for bounds in ({}, {"shard_rows": 1, "exact_rows": 1}):
        got = {r.doc_id: r.component_id for r in simhash.similar_copies(docs(spark, rows), **bounds).collect()}
        assert {i: got[i] for i in want} == want


def test_wide_fingerprints_stay_within_the_radius():
    """Sets at a similarity of 0.8, small and large, of one size and nested; others are far apart."""
    rng = np.random.default_rng(12)
    radius = simhash.radius_for(0.8)
    assert radius < 100 and simhash.radius_for(1.0) == 0
    words = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    fp = lambda h: np.frombuffer(simhash.wide_fingerprint(np.unique(h)), np.uint64)[None]
    far = []
    for shared, a, b in [(4, 0, 1), (8, 1, 1), (20, 0, 5), (80, 10, 10), (400, 0, 100), (4000, 500, 500)]:
        for _ in range(200 if shared < 1000 else 20):
            both = words(shared)
            far.append(simhash.distance(fp(np.concatenate([both, words(a)])), fp(np.concatenate([both, words(b)])))[0])
            assert simhash.distance(fp(both), fp(words(shared)))[0] > 80
    assert 45 < max(far) <= radius
    assert simhash.wide_fingerprint(words(0)) == bytes(8 * simhash.WORDS)


@pytest.mark.parametrize("visits", [1 << 19, 50])
def test_likely_links_come_from_the_trees_of_fingerprints(monkeypatch, visits):
    """Cells beside plain loops, where sizes and histograms let all pairs pass; of two parts of a cell every link between them is found."""
    within, radius = simhash.BKForest.within, simhash.radius_for(0.8)
    monkeypatch.setattr(simhash.BKForest, "within", lambda *a, **k: within(*a, **k, visits=visits))
    rng = np.random.default_rng(13)
    fps, rows = [], []
    for node in range(150):
        fp = fps[rng.integers(node)].copy() if node and rng.random() < 0.7 else rng.integers(0, 1 << 64, simhash.WORDS, dtype=np.uint64)
        for bit in rng.choice(256, rng.choice([0, 40, radius, radius + 1]), replace=False):
            fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        fps.append(fp)
        rows += [(cell, int(rng.integers(2)) if cell % 2 else 0, node, 9, fp.tobytes(), bytes([9] + [0] * 63), None) for cell in rng.choice(6, 2, replace=False)]
    cells = pd.DataFrame(rows, columns=["cell", "side", "node", "n", "fp", "hist", "sig"])

    def classes(pairs):
        label = list(range(150))
        while any(label[a] != label[b] for a, b in pairs):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    near = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)) <= radius
    whole = [(r[2], q[2]) for r in rows for q in rows if r[0] == q[0] and r[0] % 2 == 0 and near(r[2], q[2])]
    across = [(r[2], q[2]) for r in rows for q in rows if r[0] == q[0] and r[1] != q[1] and near(r[2], q[2])]
    links = lambda df: list(simhash.likely_links(df, 0.8, 0.58).itertuples(index=False, name=None))
    assert classes(links(cells[cells["cell"] % 2 == 0])) == classes(whole) and 20 < len(set(classes(whole))) < 150
    got = classes(links(cells))
    assert all(got[a] == got[b] for a, b in whole + across) and all(any(near(a, b) for b in range(150) if b != a and got[b] == got[a]) for a in range(150) if got[a] != a)


def test_rows_are_judged_by_their_texts(spark):
    """Rows that share an id and differ stay; of a class one row stays, whatever repeats."""
    rnd = random.Random(3)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (2, c), (3, c), (3, c), (None, c), (None, b + " x"), (4, None), (5, ""), (None, " ")]
    before = docs(spark, rows)
    kept = simhash.without_copies(before)
    assert kept.columns == before.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, a), (1, b), (2, c), (4, None)]))
    assert simhash.without_copies(docs(spark, [(None, a), (None, a)])).count() == 1
    assert simhash.without_copies(docs(spark, [])).count() == 0


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(11)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            n = 400
            both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
            true = len(both) / len(np.union1d(a, b))
            sigs = [np.frombuffer(simhash.signature(x), np.uint64)[None] for x in (a, b)]
            errors.append(simhash.resemblance(*sigs)[0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 9), (9, 7), (None, 3), (4, None)]
    labels = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert labels == {**{i: 100 for i in range(100, 161)}, 7: 7, 9: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# quality and toxicity -----------------------------------------------------------------------


def marked(spark, n=400):
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(n):
        words = prose(rnd, rnd.randint(30, 80)).split()
        poor, toxic = i % 7 == 0, i % 5 == 0
        if poor:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zzgrub", "zzgrubber", "qqvile"]))
        rows.append((i, " ".join(words), "en" if i % 3 else None, f"host{i % 4}", 1, 1, "x", "y", 2))
        labels.append((i, int(not poor), int(toxic), 0.5))
    rows += [(None, None, None, None, 0, 1, "x", "y", 2), (9000, "", "en", "host1", 0, 1, "x", "y", 2), (9001, "word " * 30_000, "en", "rare", 0, 1, "x", "y", 2), rows[3]]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, x double")


def test_quality_on_held_out_rows(spark):
    rows, labels = marked(spark)
    judged = quality.classify(rows, labels, train=F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2)
    assert judged.count() == rows.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(bool(truth[r.doc_id]), r.keep) for r in judged.where(quality.held_out("doc_id")).collect() if r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    # the columns of documents that have the added names stay where a prefix is given
    other = quality.classify(rows, labels, prefix="__q_")
    assert other.columns[: len(rows.columns)] == rows.columns and other.where("evidence = 'x'").count() == rows.count()
    unlabelled = quality.classify(rows, labels.limit(0))
    assert unlabelled.where("keep").count() == rows.count()
    assert quality.classify(rows.limit(0), labels).count() == 0


def plain_sites(rows):
    """(host, path) -> (n, s, nh, sh), both strengths, the mean; rows: (host, path, evidence)."""
    n, s = {}, {}
    for h, p, e in rows:
        for key in ((h, p), (h,), ()):
            n[key], s[key] = n.get(key, 0) + 1, s.get(key, 0) + e
    mean = min(max(s[()] / n[()], 1e-4), 1 - 1e-4)
    hosts, paths = [k for k in n if len(k) == 1], [k for k in n if len(k) == 2]

    def strength(sites, parent, inside, lost):
        total = sum(n[k] for k in sites)
        spread = sum(n[k] * (s[k] / n[k] - parent(k)) ** 2 for k in sites)
        scale = total - sum(n[k] ** 2 / n[k[:-1]] for k in sites)
        between = (spread - (len(sites) - lost) * inside) / scale if scale > 0 else 0
        return min(10_000, max(2, inside / between - 1)) if between > 0 else 10_000

    kh = strength(hosts, lambda k: mean, mean * (1 - mean), 1)
    inside = sum(n[k] * s[k[:1]] / n[k[:1]] * (1 - s[k[:1]] / n[k[:1]]) for k in paths) / n[()]
    kp = strength(paths, lambda k: s[k[:1]] / n[k[:1]], inside, len(hosts))
    return {k: (n[k], s[k], n[k[:1]], s[k[:1]]) for k in paths}, kh, kp, mean


@pytest.mark.parametrize("broadcast_sites", [0, 1000])
def test_quality_beside_plain_python(spark, broadcast_sites):
    rows, labels = marked(spark)
    model = quality.QualityModel.fit(rows, labels).model
    judged = quality.classify(rows, labels, prefix="q_", broadcast_sites=broadcast_sites).collect()
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    own = [float(np.clip(model.predict(np.array([quality.shape((r.text or "").encode())])), 1e-6, 1 - 1e-6)[0]) for r in judged]
    sites, kh, kp, mean = plain_sites([(r.source, r.lang, e) for r, e in zip(judged, own, strict=True)])
    assert len(judged) == rows.count() and 2 <= kp <= 10_000
    for r, e in zip(judged, own, strict=True):
        n, s, nh, sh = sites[r.source, r.lang]
        up = (sh - e + kh * mean) / (nh - 1 + kh)
        site = (s - e + kp * up) / (n - 1 + kp)
        both = 1 / (1 + math.exp(-(logit(e) - math.log(mean / (1 - mean)) + logit(site))))
        assert (r.q_evidence, r.q_site, r.q_quality) == pytest.approx((e, site, both)) and r.q_keep == (r.q_quality >= 0.5)


def test_strengths_of_paths_are_about_their_hosts(spark):
    """Hosts differ, paths within a host do not: hosts stand for themselves, paths lean on their host."""
    rng = np.random.default_rng(3)
    rows = [(f"h{h}", f"p{p}", float(rng.random() < 0.1 + 0.2 * h)) for h in range(5) for p in range(4) for _ in range(50)]
    sites, _ = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), "host", "path")
    got = sites.first()
    _, kh, kp, _ = plain_sites(rows)
    assert (got.kh, got.kp) == pytest.approx((kh, kp)) and got.kh < 10 < 50 < got.kp


def test_sites_shrink_toward_their_parents(spark):
    """A site's posterior, without the document, by hand."""
    rows = spark.createDataFrame([("a", "x", p) for p in [0.9] * 50 + [0.8] * 50] + [("b", "x", 0.1)] * 40 + [("b", "y", 0.3), (None, None, 0.5)], "host string, path string, evidence double")
    sites, mean = quality.site_posteriors(rows, "host", "path")
    by = {(r.site_host, r.site_path): r for r in sites.collect()}
    assert len(by) == 4 and by["b", "y"].n == 1 and by["b", "y"].nh == 41 and by["b", "y"].sh == pytest.approx(4.3)
    assert mean == pytest.approx((45 + 40 + 4 + 0.3 + 0.5) / 142)
    assert 2 <= by["a", "x"].kh < 100  # hosts differ, so the prior is weak


def test_toxicity_on_held_out_rows(spark):
    rows, labels = marked(spark)
    model = toxicity.ToxicityModel.fit(rows, labels, train=F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2)
    scored = model.score(rows).collect()
    assert len(scored) == rows.count() and all(0 <= r.score <= 1 for r in scored)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.score >= 0.3) for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert {"zzgrub", "qqvil*"} & set(model.lexicon.counts)
    assert model.score(rows.limit(0)).count() == 0
    none = toxicity.ToxicityModel.fit(rows, labels.limit(0)).score(rows).collect()
    assert len({r.score for r in none}) == 1


def test_toxicity_keeps_the_balance_of_classes(spark, monkeypatch):
    """A fifth of the labelled rows is toxic; so is it by weight, also where the bounds of the sample bind."""
    rows, labels = marked(spark)
    seen = []
    monkeypatch.setattr(toxicity.Calibrated, "fit", lambda x, y, fold, weight=None: seen.append((y, np.ones(len(y)) if weight is None else weight)))
    for sample_rows in (12_000, 100):
        toxicity.ToxicityModel.fit(rows, labels, sample_rows=sample_rows)
    assert [len(y) for y, _ in seen] == [400, 150]
    for y, weight in seen:
        assert (weight * y).sum() / weight.sum() == pytest.approx(0.2)


def plain_features(text, lexicon, weight):
    """The dense features by their definitions; lexicon: whole words, starts: word beginnings."""
    words = text.split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    low = [toxicity.plain(w) for w in words]
    whole = [w in lexicon for w in low]
    begin = [any(w[:n] + "*" in lexicon for n in (4, 5, 6) if len(w) >= n) for w in low]
    either = [a or b for a, b in zip(whole, begin, strict=True)]
    you = [w in toxicity.SECOND for w in low]
    near = sum(any(you[max(0, i - 5) : i + 6]) for i, e in enumerate(either) if e)
    core = [w.strip(toxicity.EDGES) for w in words]
    masked = [any(c in "@4013$5!7*" for c in c0) and any(c.isalpha() for c in c0) for c0 in core]
    found = {w for w, e in zip(words, either, strict=True) if e}
    best = {w: max([weight.get(toxicity.plain(w), 0)] + [weight.get(toxicity.plain(w)[:n] + "*", 0) for n in (4, 5, 6) if len(toxicity.plain(w)) >= n]) for w in found}
    n, at = len(words), [i for i, e in enumerate(either) if e]
    return [
        100 * sum(whole) / n, math.log1p(sum(whole)), 100 * sum(begin) / n, math.log1p(sum(begin)), 100 * near / n, 100 * sum(you) / n, sum(len(c) > 2 and c.isupper() for c in core) / n, sum(masked) / n,
        math.log1p(sum(m and e for m, e in zip(masked, either, strict=True))), sum(w.endswith("!") for w in words) / n, sum("A" <= c <= "Z" for c in text) / len(text.encode()),
        sum(c in ".,;:?!\"'()[]{}<>#%&*$+=|/\\~^_-@" for c in text) / len(text.encode()), math.log1p(n), math.log1p(len(found)), (at[-1] - at[0]) / n if at else 0.0, sum(best.values()) / (1 + len(found)),
    ]


def test_toxic_features_beside_plain_ones():
    long = "x" * 300
    counts = {"moron": (9, 0), "stup*": (9, 1), "rare": (2, 0), "even": (9, 9), toxicity.terms(long)[0]: (8, 0)}
    lexicon = toxicity.Lexicon(counts, 10, 100)
    weight = {t: lexicon.weight(t) for t in counts}
    assert weight["rare"] == weight["even"] == 0 and weight["moron"] > weight["stup*"] > 0 and len(toxicity.terms(long)[0]) < 40
    lex = {t for t, w in weight.items() if w}
    codes = toxicity.WordCodes(lexicon)
    for text in ("", "you M0R0N, you STUPID thing!! rare even é", "a b c d e f g moron h i j k you", "Stu stup stupefied MORON moron! m*ron @$5", "you " * 9000 + "moron"):
        assert toxicity.features(text.encode(), codes) == pytest.approx(plain_features(text, lex, weight)), text
    # a word of any length can be in the lexicon
    assert toxicity.features(long.encode(), codes)[0] == 100


def test_lexicon_counts_documents(spark):
    """Rows that repeat an id count in sums and totals alike, long words as well."""
    long = "q" * 60
    rows = [(i, f"zzgrub {long} " + "word " * (i % 3), *["s"] * 2, 1, 1, "x", "y", 2) for i in range(8)] * 3 + [(i, "word other", "s", "s", 1, 1, "x", "y", 2) for i in range(20, 40)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.ToxicityModel.fit(spark.createDataFrame(rows, SCHEMA), labels).lexicon
    assert (lexicon.toxic, lexicon.clean) == (24, 20) and lexicon.counts["zzgrub"] == (24, 0) and lexicon.counts[toxicity.terms(long)[0]] == (24, 0)


def test_calibration_is_monotone():
    from weftgraph.llm.trees import BoostedTrees, Isotonic

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    trees = BoostedTrees(rounds=30).fit(x, y)
    curve = Isotonic().fit(trees.margin(x), y)
    p = curve.apply(np.linspace(-9, 9, 200))
    assert (np.diff(p) >= 0).all() and 0 < p[0] < p[-1] < 1
    for low in np.arange(0, 1, 0.25):
        inside = (curve.apply(trees.margin(x)) >= low) & (curve.apply(trees.margin(x)) < low + 0.25)
        assert abs(y[inside].mean() - curve.apply(trees.margin(x))[inside].mean()) < 0.05


def test_plain_words():
    assert toxicity.plain("M0r0n!!") == "moron" and toxicity.plain("1234") == "1234" and toxicity.plain("...") == "..."
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
