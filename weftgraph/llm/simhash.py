"""SimHash near-duplicate groups: BK-trees over shards of the fingerprints.

A fingerprint has bit i set where over half of the shingles' XXH64 values have
it. Two fingerprints that differ in at most r bits agree in some b - r of b bit
blocks, whatever b > r; every such choice of blocks is one table, its bits one
key, and each (table, key) owns a shard tree. In a BK-tree a child hangs from its
parent by the edge of their Hamming distance; a search at distance d from a node
follows only the edges d - r .. d + r. A key that holds more than `shard_rows`
fingerprints is cut into parts: one cell per pair of parts holds a tree of the
one and searches it for the other, so that no task gets an unbounded group and no
link is lost. Cells return spanning links only, and the components are joined in
Spark.

Texts of a given Jaccard similarity (similar_copies) have fingerprints too far apart
for blocks that surely agree. There fingerprints have 256 bits, the shards' keys are
rare shingles, of which such texts surely share one, the trees are searched at the
radius that such texts do not exceed, and an exact check of the shingles follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import RowNumbers, among, chunks, dropped, hashed_sample, joined_spread, mix, picked, record_batch, saved, text_bytes
from weftgraph.llm.components import connected_components

_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    n = len(hashes)
    if not n:
        return 0
    # eight one-byte counters in a word; 255 rows cannot overflow them
    spread = _SPREAD[hashes.view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(spread, np.arange(0, n, 255), axis=0)
    counts = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of width words, A-Z lower-cased; fewer words: of all of them."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, n)


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (long: the 64 bits) for every row of docs, in one pass without a shuffle."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = picked(batch, "doc_id", "text")
            found = np.fromiter((majority(shingle_hashes(t, width)) for t in texts), np.uint64, len(texts))
            yield record_batch(out, [ids, pa.array(found.view(np.int64))])

    return source.mapInArrow(run, "doc_id long, fp long")


#: 64-bit words of a wide fingerprint.
WORDS = 4


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The majorities of the hashes and of three remixes of them: 256 bits."""
    return np.array([majority(mix(hashes, np.uint64(i)) if i else hashes) for i in range(WORDS)], np.uint64).tobytes()


def radius_for(similarity: float, bits: int = 64 * WORDS, missed: float = 1e-12) -> int:
    """The distance that fingerprints of sets at that Jaccard similarity exceed with a chance of at most `missed`.

    Counts of two sets have a correlation of 2j / (1 + j) at least, so a bit differs
    with a chance of acos(2j / (1 + j)) / pi; small sets, whose counts tie, come to at
    most sqrt(pi / 2) as much.
    """
    chance = min(0.5, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi * 1.26)
    beyond = 0.0
    for far in range(bits, 0, -1):
        beyond += math.comb(bits, far) * chance**far * (1 - chance) ** (bits - far)
        if beyond > missed:
            return far
    return 0


#: Bytes of a signature: 128 bins of four bits.
SIGNATURE, BINS = 64, 128
#: Fewest hashes for which a signature is used, and fewest for which it is used alone (512 / 0.8).
SIGNED, ONLY_SIGNED = 512, 640
_NIBBLES = np.uint64(0x1111_1111_1111_1111)


def signature(hashes: np.ndarray) -> bytes:
    """Of the shingles' hashes in each of 128 bins the least one's lowest four bits; an empty bin takes the next one's."""
    if not len(hashes):
        return bytes(SIGNATURE)
    shift = np.uint64(57)
    keys = np.sort(hashes << shift | hashes >> np.uint64(7))  # the bin on top, then the rest
    at = np.searchsorted(keys, np.arange(BINS, dtype=np.uint64) << shift)
    full = np.zeros(BINS, bool)
    inside = at < len(keys)
    full[inside] = keys[at[inside]] >> shift == np.flatnonzero(inside).astype(np.uint64)
    places = np.flatnonzero(full)
    following = places[np.searchsorted(places, np.arange(BINS)) % len(places)]
    nibbles = (keys[at[following]] & np.uint64(15)).astype(np.uint8)
    return (nibbles[0::2] | nibbles[1::2] << 4).tobytes()


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that rows of signatures (as uint64) show: equal bins beyond the 1/16 that agree by chance."""
    x = a ^ b
    differ = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & _NIBBLES
    equal = 1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / BINS
    return (equal - 1 / 16) / (15 / 16)


def histogram(hashes: np.ndarray) -> bytes:
    """How many of the hashes each 64th part of their range holds, up to 255."""
    return np.minimum(np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """So many of the distinct, sorted hashes, rare before common ones, that any set at `similarity` shares one of its own."""
    if len(common) and len(hashes):
        known = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~known], hashes[known]])
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


#: More than any distance.
_EDGES = 1 << 10


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The differing bits of fingerprints of one uint64, or of a row of them each."""
    bits = np.bitwise_count(x ^ y)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees over groups of fingerprints, built and searched level by level in arrays."""

    def __init__(self, group: np.ndarray, fps: np.ndarray) -> None:
        """group: sorted group numbers, one tree each; fps: uint64 (or a row of them each), distinct within a group."""
        n = len(fps)
        self.fps = fps
        self.edge = np.zeros(n, np.int64)  # distance to the parent
        self.parent = parent = np.full(n, -1, np.int64)
        self.levels: list[np.ndarray] = []
        rows, owner = np.arange(n), group.astype(np.int64)
        first = np.ones(n, bool)
        first[1:] = owner[1:] != owner[:-1]
        self.roots = np.flatnonzero(first)
        self.tree = np.cumsum(first) - 1
        up = np.full(n, -1, np.int64)
        while len(rows):
            # rows are sorted by owner; the first of each owner becomes a node
            head = np.ones(len(rows), bool)
            head[1:] = owner[1:] != owner[:-1]
            heads = rows[head]
            parent[heads] = up[heads]
            self.levels.append(heads)
            node = heads[np.cumsum(head) - 1]
            keep = ~head
            rows, node = rows[keep], node[keep]
            if not len(rows):
                break
            far = distance(fps[rows], fps[node])
            self.edge[rows] = far
            up[rows] = node
            owner = node * _EDGES + far
            order = np.argsort(owner, kind="stable")
            rows, owner = rows[order], owner[order]
        # children of each node, by distance
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.lexsort((self.edge[kids], parent[kids]))]
        self.kids = kids
        self.start = np.searchsorted(parent[kids], np.arange(n))
        self.end = np.searchsorted(parent[kids], np.arange(n), side="right")
        self.kid_key = parent[kids] * _EDGES + self.edge[kids]

    def alike(self, label: np.ndarray) -> np.ndarray:
        """Whether all below a node, itself included, have one label."""
        low, high = label.copy(), label.copy()
        for nodes in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return low == high

    def within(self, tree: np.ndarray, wanted: np.ndarray, radius: int, block: int = 1 << 14, joined: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, visits: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index in wanted, index of node) at most radius apart; tree: the tree of each.

        joined: labels, and the places in them of wanted and of nodes. The caller may
        join labels meanwhile; what is below a node and all in the query's class is
        then left out. As wide radii visit most of a tree, blocks are then cut at
        `visits` nodes.
        """
        if joined is None:
            cuts = np.arange(0, len(wanted), block)
        else:
            label, places, node_places = joined
            owner = np.cumsum(np.bincount(self.tree)[tree] if len(tree) else tree) // visits
            cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(tree) else tree
        for at, end in zip(cuts, [*cuts[1:], len(wanted)], strict=False):
            query = np.arange(at, end)
            node = self.roots[tree[query]]
            whole = None if joined is None else self.alike(label[node_places])
            while len(query):
                if joined is not None:
                    keep = ~(whole[node] & (label[places[query]] == label[node_places[node]]))
                    query, node = query[keep], node[keep]
                far = distance(wanted[query], self.fps[node])
                hit = far <= radius
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.kid_key, node * _EDGES + np.maximum(far - radius, 0))
                high = np.searchsorted(self.kid_key, node * _EDGES + np.minimum(far + radius, _EDGES - 1), side="right")
                count = high - low
                query = np.repeat(query, count)
                node = self.kids[np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], holds: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, label: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """The least index of each index's component, joining pairs block by block.

    Pairs that are joined already cannot change anything and are left out before
    `holds` is asked which of the others count. label: where to keep the state (at
    first 0 .. n - 1), for `pairs` that look at it. of: the indexes that pairs (and
    `holds`) speak of by their places in it.
    """
    label = np.arange(n) if label is None else label
    for a, b in pairs:
        if holds is not None:
            for at in range(0, len(a), 1 << 18):
                part = slice(at, at + (1 << 18))
                x, y = a[part], b[part]
                apart = label[x if of is None else of[x]] != label[y if of is None else of[y]]
                x, y = x[apart], y[apart]
                good = holds(x, y)
                x, y = x[good], y[good]
                label[:] = _joined(label, x if of is None else of[x], y if of is None else of[y])
        else:
            label[:] = _joined(label, a, b)
    return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
        if np.array_equal(before, label):
            break
    return label


def cell_links(cells: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning links a, b between nodes of every cell.

    Columns: cell, side (0 in the tree, 1 searches), node, fp.
    """
    # a node that is in the tree of its cell needs no second row
    cells = cells.sort_values(["cell", "side", "fp", "node"]).drop_duplicates(["cell", "node"])
    group, number = np.unique(cells["cell"].to_numpy(), return_inverse=True)
    fps, side, node = cells["fp"].to_numpy().view(np.uint64), cells["side"].to_numpy(), cells["node"].to_numpy()
    inside = side == 0
    owned, split = np.zeros(len(group), bool), np.zeros(len(group), bool)
    owned[number[inside]] = True
    split[number[~inside]] = True
    forest = BKForest(number[inside], fps[inside])
    tree_of, node_row = np.cumsum(owned) - 1, np.flatnonzero(inside)
    rows = np.flatnonzero(owned[number] & (~split[number] | ~inside))  # a cell of two parts only crosses them
    label = spanning(len(fps), ((rows[q], node_row[v]) for q, v in forest.within(tree_of[number[rows]], fps[rows], radius)))
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})


def within_cells(cell: np.ndarray, node: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of node numbers that share a cell and whose set sizes allow the similarity. Sorted by cell, then size."""
    last = np.searchsorted(cell, cell, side="right")
    at, lag = np.arange(len(cell)), 1
    while len(at := at[at + lag < last[at]]):
        at = at[size[at] >= similarity * size[at + lag] - 1e-9]  # the following ones are larger still
        yield node[at], node[at + lag]
        lag += 1


def likely_links(cells: pd.DataFrame, similarity: float, cut: float) -> pd.DataFrame:
    """Links a, b that span what in each cell may be at `similarity`. Columns: cell, side (0 in the tree, 1 searches), node, n, fp, hist, sig.

    BK-trees of the wide fingerprints give the pairs within the radius of that
    similarity. Of these, for sets under SIGNED hashes histograms tell surely: their
    parts' differences add up to no more than the sets'. The signatures of others
    show at least `cut`. Equal fingerprints are linked and searched once.
    """
    cells = cells.sort_values(["cell", "side"]).drop_duplicates(["cell", "node"])
    nodes, first, number = np.unique(cells["node"].to_numpy(), return_index=True, return_inverse=True)
    one = cells.iloc[first]
    size = one["n"].to_numpy()
    hists = np.frombuffer(b"".join(h or bytes(64) for h in one["hist"]), np.uint8).reshape(len(one), 64)
    sigs = np.frombuffer(b"".join(h or bytes(SIGNATURE) for h in one["sig"]), np.uint64).reshape(len(one), SIGNATURE // 8)
    prints = np.frombuffer(b"".join(one["fp"]), np.uint64).reshape(len(one), WORDS)
    group, side = np.unique(cells["cell"].to_numpy(), return_inverse=True)[1], cells["side"].to_numpy()
    order = np.lexsort((*prints[number].T, side, group))
    group, side, number = group[order], side[order], number[order]
    fps = prints[number]
    head = np.ones(len(group), bool)  # rows with a fingerprint not yet seen in their part of the cell
    head[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (fps[1:] != fps[:-1]).any(axis=1)
    leader = np.flatnonzero(head)[np.cumsum(head) - 1]
    several = np.bincount(leader, minlength=len(group)) > 1

    inside = side == 0
    cells_at = np.arange(group[-1] + 1 if len(group) else 0)
    owned, split = np.isin(cells_at, group[inside]), np.isin(cells_at, group[~inside])
    node_row = np.flatnonzero(inside & head)
    forest = BKForest(group[node_row], fps[node_row])
    rows = np.flatnonzero(head & owned[group] & (~split[group] | ~inside))  # a cell of two parts only crosses them
    radius, label = radius_for(similarity), np.arange(len(nodes))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield leader[~head], np.flatnonzero(~head)
        below = np.flatnonzero((forest.parent >= 0) & (forest.edge <= radius))
        yield node_row[forest.parent[below]], node_row[below]
        tree = (np.cumsum(owned) - 1)[group[rows]]
        for q, v in forest.within(tree, fps[rows], radius, joined=(label, number[rows], number[node_row])):
            yield rows[q], node_row[v]

    def holds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # rows that stand for others as well are linked by their fingerprints alone
        good, alone = np.ones(len(x), bool), np.flatnonzero(~(several[x] | several[y]))
        x, y = number[x[alone]], number[y[alone]]
        near = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
        good[alone[~near]] = False
        alone, x, y = alone[near], x[near], y[near]
        signed = np.minimum(size[x], size[y]) >= SIGNED
        good[alone[signed]] = resemblance(sigs[x[signed]], sigs[y[signed]]) >= cut
        x, y = x[~signed], y[~signed]
        apart = np.abs(hists[x].astype(np.int16) - hists[y]).sum(axis=1)
        good[alone[~signed]] = apart <= (size[x] + size[y]) * (1 - similarity) / (1 + similarity) + 1e-9
        return good

    spanning(len(nodes), pairs(), holds, label, number)
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})


def exact_links(cells: pd.DataFrame, width: int, similarity: float) -> pd.DataFrame:
    """Links a, b that span the pairs of each cell whose shingles have at least that Jaccard similarity. Columns: cell, node, n, text."""
    cells = cells.sort_values(["cell", "n", "node"])
    nodes, first, number = np.unique(cells["node"].to_numpy(), return_index=True, return_inverse=True)
    sets = [np.unique(shingle_hashes(t, width)) for t in cells["text"].iloc[first]]

    def alike(a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return shared >= similarity * (len(a) + len(b) - shared) - 1e-9

    holds = lambda x, y: np.fromiter((alike(sets[i], sets[j]) for i, j in zip(x, y, strict=True)), bool, len(x))
    label = spanning(len(nodes), within_cells(np.unique(cells["cell"], return_inverse=True)[1], number, cells["n"].to_numpy(), similarity), holds)
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})


def blocks_for(n: int, radius: int) -> int:
    """Bit blocks such that a key of random fingerprints has few members; any number is exact."""
    return radius + 1 + (n > 1 << 22) + (n > 1 << 28)


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """An array with the key of each table: the bits of blocks - radius chosen blocks."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])


def dealt(keyed: DataFrame, shard_rows: int, tasks: int) -> DataFrame:
    """The rows (node, key, n: rows of the key, and others) in cells of bounded size: with cell, side and task instead of key and n."""
    # the cells (i, j), i <= j, of a key: tree of part i, searched for part j
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j"), (F.col("part") > j).cast("int").alias("side")))
    rest = [c for c in keyed.columns if c not in ("key", "n")]
    return (
        keyed.withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
        .select(*rest, "key", F.explode(other).alias("c"))
        .select(*rest, F.xxhash64("key", "c.i", "c.j").alias("cell"), F.col("c.side").alias("side"))
        .withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int"))
    )


def tasks_for(sizes: DataFrame, shard_rows: int, rows_per_task: int) -> int:
    """Tasks for the cells of keys (column n: rows of each): a row is copied once for each part of its key, and the copies count."""
    copies = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / shard_rows))).first()[0] or 0
    return int(max(sizes.sparkSession.sparkContext.defaultParallelism, -(-copies // rows_per_task)))


def near_links(nodes: DataFrame, keys: Column, radius: int = 3, shard_rows: int = 20_000, rows_per_task: int = 200_000) -> DataFrame:
    """Links a, b between nodes (columns node, fp) that span every class within radius.

    keys: an array of keys; nodes meet where they share one. A task gets about
    `rows_per_task` rows, at most some cells of 2 * shard_rows above that.

    All links of at most radius bits are looked at; of those, each cell returns
    as many as join its members. A hash that two keys share joins their cells,
    which costs time and changes nothing, as every link is measured.
    """
    keyed = nodes.select("node", "fp", F.explode(keys).alias("key"))
    sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    cells = dealt(joined_spread(keyed, sizes, "key"), shard_rows, tasks_for(sizes, shard_rows, rows_per_task))
    return cells.groupBy("task").applyInPandas(lambda pdf: cell_links(pdf, radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the smallest doc_id reachable over links of at most radius
    bits. Null and wordless texts have fingerprint 0 and link like any other;
    equal fingerprints (exact copies, repeated rows) meet in one pre-aggregated
    row; a null doc_id gets the smallest doc_id of its class, or null if none.
    An empty table returns no rows.
    """
    rows = saved(fingerprints(docs, width, id_column, text_column), "fingerprints")
    least = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    blocks = blocks_for(least.count(), radius)
    nodes = least.select(F.col("fp").alias("node"), "fp")
    classes = connected_components(near_links(nodes, block_keys(F.col("fp"), radius, blocks), radius))
    classes = least.join(classes, least.fp == classes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = classes.join(ids, "component").select("fp", "component_id")
    return joined_spread(rows, linked, "fp").select("doc_id", "fp", "component_id")


def _similar(source: DataFrame, width: int, similarity: float, slack: float, shard_rows: int, exact_rows: int, text: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, classes) of source (columns of any name, then __id and __text); text: a written column with the text's bytes.

    rows: source with __row (a number) and __node (a hash of the text's shingle
    set), written once. nodes: a row for each node, written as well. classes: node, component (the least node of its class),
    first (the least id of the node with its row: struct missing, id, row).
    """
    spark = source.sparkSession
    sample = hashed_sample(source.select("__text"), F.xxhash64("__text"), 2_000)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (text,) in zip(*picked(batch, "__text"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, width)).view(np.int64))], names=["key"])

    often = sample.mapInArrow(distinct, "key long").groupBy("key").count().where("count >= 3").select("key")
    common = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in often.collect()], np.int64).view(np.uint64)))
    names = source.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    more = ["__row", "__node", "__size", "__keys", "__fp", "__hist", "__sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        numbers = RowNumbers()
        for batch in batches:
            for part in chunks(batch.num_rows, 500):
                some = batch.slice(part.start, part.stop - part.start)
                sets = [np.unique(shingle_hashes(t, width)) for t in some.column(len(names) - 1).to_pylist()]
                node = np.fromiter((xxhash.xxh64_intdigest(h.tobytes()) for h in sets), np.uint64, len(sets)).view(np.int64)
                keys = [prefix(h, similarity, common.value).view(np.int64) for h in sets]
                fps = [wide_fingerprint(h) for h in sets]
                hists = [histogram(h) if len(h) < ONLY_SIGNED else None for h in sets]
                sigs = [signature(h) if len(h) >= SIGNED else None for h in sets]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                made = [numbers.take(some.num_rows), pa.array(node), pa.array([len(h) for h in sets], pa.int64()), flat, pa.array(fps, pa.binary()), pa.array(hists, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], names=[*names, *more])

    made = source.mapInArrow(run, f"{kept}, __row long, __node long, __size long, __keys array<long>, __fp binary, __hist binary, __sig binary")
    rows = saved(made if names == ["__id", "__text"] else made.drop("__text"), "shingles")
    # facts of a node are the same in all its rows, so the first ones do
    facts = [F.first(c).alias(n) for c, n in (("__size", "n"), ("__fp", "fp"), ("__hist", "hist"), ("__sig", "sig"), ("__keys", "keys"))]
    least = F.min(F.struct(F.col("__id").isNull().alias("missing"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("first")
    nodes = saved(rows.groupBy(F.col("__node").alias("node")).agg(*facts, least), "distinct_shingles")
    keyed = nodes.select("node", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    met = saved(keyed.where("n > 1"), "keys")
    copies = met.agg(F.sum(F.ceil(F.col("n") / shard_rows))).first()[0] or 0
    tasks = int(max(spark.sparkContext.defaultParallelism, -(-copies // 100_000)))
    cells = dealt(met, shard_rows, tasks).join(nodes.select("node", "n", "fp", "hist", "sig"), "node")
    coarse = connected_components(cells.groupBy("task").applyInPandas(lambda pdf: likely_links(pdf, similarity, similarity - slack), "a long, b long"))
    dropped(met)
    # one text for each node of a coarse class; the others are left out before the shuffle
    members = coarse.select("node", F.col("component").alias("key"))
    sizes = saved(members.groupBy("key").agg(F.count("*").alias("n")), "class_sizes")
    of = saved(nodes.select("node", "n", F.col("first.row").alias("__row")).join(members.select("node"), "node"), "class_rows")
    texts = among(rows.select("__row", text.alias("text")), of, "__row")
    cells = dealt(joined_spread(members, sizes, "key"), exact_rows, tasks_for(sizes, exact_rows, 1_000)).join(of, "node").join(texts, "__row").drop("__row")
    classes = connected_components(cells.groupBy("task").applyInPandas(lambda pdf: exact_links(pdf, width, similarity), "a long, b long"))
    classes = nodes.join(classes, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    return rows, nodes, classes


def similar_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, slack: float = 0.22, id_column: str = "doc_id", text_column: str = "text", shard_rows: int = 20_000, exact_rows: int = 2_000) -> DataFrame:
    """doc_id, component_id for every row of docs: classes of texts whose shingle sets have a Jaccard similarity of `similarity`.

    Every pair that is linked is measured on the sets themselves. Texts of such a
    pair share a hash of their sets' prefixes (a fifth of the hashes, in one order
    for all), so each prefix hash is the key of a BK-tree over the 256-bit fingerprints
    of the sets, searched at radius_for(similarity), which one such pair in 10^12
    exceeds. What is found is compared by size and by histogram, which lose nothing,
    or, from SIGNED hashes on, by size and by a 128-bin signature that shows at least
    `similarity` less `slack`, six standard errors of that estimate. Such links give
    coarse classes, in which the texts meet and are compared. Hashes found often in a sample come last in the order,
    which keeps keys small and changes no result. Nulls, ties, repeated rows and
    empty tables: as in near_duplicates.
    """
    source = docs.select(F.col(id_column).alias("__id"), text_bytes(text_column).alias("__text"))
    rows, _, classes = _similar(source, width, similarity, slack, shard_rows, exact_rows, F.col("__text"))
    ids = classes.groupBy("component").agg(F.min("first").alias("least"))
    linked = classes.join(ids, "component").select("node", F.col("least.id").alias("component_id"))
    return joined_spread(rows.select(F.col("__id").alias("doc_id"), F.col("__node").alias("node")), linked, "node").select("doc_id", "component_id")


def without_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, slack: float = 0.22, id_column: str = "doc_id", text_column: str = "text", shard_rows: int = 20_000, exact_rows: int = 2_000) -> DataFrame:
    """docs with one row of each class of similar_copies, as it is: that with the smallest id, nulls last, then any one.

    The classes come from the same fingerprints, BK-trees and exact check (see _similar).
    Rows are judged by their texts, never by their ids: rows that share an id and
    differ in text stay both. Null and wordless texts are one class. The rows are
    numbered and written once; bitmaps of the numbers that stay go to the texts, which
    are shuffled only where those are too many (see among).
    """
    names = docs.columns
    source = docs.select(*names, F.col(id_column).alias("__id"), text_bytes(text_column).alias("__text"))
    rows, nodes, classes = _similar(source, width, similarity, slack, shard_rows, exact_rows, text_bytes(text_column))
    stay = saved(classes.groupBy("component").agg(F.min("first").alias("least")).select(F.col("least.row").alias("__row")), "rows_that_stay")
    dropped(nodes)
    return among(rows.select(*names, "__row"), stay, "__row").select(*names)
