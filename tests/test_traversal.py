import random

import pytest
from graphs import graph, greedy_prune, queue_bfs
from pyspark.sql import functions as F

from weftgraph.functions.text import heuristic_tokens
from weftgraph.operators.pruning import prune
from weftgraph.operators.scoring import Subgraph, extract_subgraph, hybrid_scores
from weftgraph.operators.traversal import bfs
from weftgraph.plans.config import Direction, HybridScoreConfig, TraversalConfig

TWO_CYCLES = [(1, 0, 1, 0.9), (2, 1, 2, 0.9), (3, 2, 0, 0.9), (4, 2, 3, 0.8), (5, 3, 4, 0.7), (6, 4, 5, 0.7), (7, 5, 3, 0.7)]


def seeds_of(spark, rows):
    return spark.createDataFrame([(q, n, float(s), p) for q, n, s, p in rows], "query_id long, node_id long, score double, pos int")


def run(spark, g, seeds, config):
    return [tuple(r) for r in bfs(g.nodes, g.edges, seeds_of(spark, seeds), config).orderBy("query_id", "rank").select("node_id", "depth").collect()]


def test_two_cycles(spark):
    g = graph(spark, range(6), TWO_CYCLES)
    assert run(spark, g, [(0, 0, 1, 0)], TraversalConfig(3, 0.5, 50)) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_islands_weak_edges_and_cycles(spark):
    g = graph(spark, [0, 1, 10, 11], [(1, 0, 1, 0.95), (2, 10, 11, 0.95)])
    assert run(spark, g, [(0, 0, 1, 0)], TraversalConfig()) == [(0, 0), (1, 1)]
    weak = graph(spark, range(5), [(1, 0, 1, 0.9), (2, 1, 2, 0.8), (3, 2, 3, 0.3), (4, 0, 4, 0.95)])
    assert {n for n, _ in run(spark, weak, [(0, 0, 1, 0)], TraversalConfig(3, 0.5))} == {0, 1, 2, 4}
    ring = graph(spark, range(3), [(1, 0, 1, 1), (2, 1, 2, 1), (3, 2, 0, 1)])
    assert len(run(spark, ring, [(0, 0, 1, 0)], TraversalConfig(max_depth=10))) == 3


def test_edges_of_the_input(spark):
    g = graph(spark, range(3), [(1, 0, 1, 1)])
    assert run(spark, g, [], TraversalConfig()) == []
    assert run(spark, g, [(0, 0, 1, 0)], TraversalConfig(max_nodes=0)) == []
    assert run(spark, g, [(0, 77, 1, 0)], TraversalConfig()) == []  # a seed that is no node
    assert run(spark, g, [(0, 0, 1, 0)], TraversalConfig(max_depth=0)) == [(0, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    """Several random multigraphs are queries of one batch, each with ids of its own."""
    rnd = random.Random(seed)
    config = TraversalConfig(rnd.randint(1, 3), rnd.choice([0.0, 0.4]), rnd.choice([3, 8, 100]), rnd.choice(list(Direction)))
    nodes, edges, seeds, want = [], [], [], []
    for q in range(8):
        base, n = 100 * q, rnd.randint(1, 9)
        own = list(range(base, base + n))
        links = [(len(edges) + i, rnd.choice(own), rnd.choice(own), round(rnd.random(), 2)) for i in range(rnd.randint(0, 25))]
        starts = [rnd.choice(own) for _ in range(rnd.randint(1, 4))]
        nodes += own
        edges += links
        seeds += [(q, s, 1.0, i) for i, s in enumerate(starts)]
        want += [(q, *r) for r in queue_bfs(set(own), links, starts, config)]
    g = graph(spark, nodes, edges)
    got = sorted(tuple(r) for r in bfs(g.nodes, g.edges, seeds_of(spark, seeds), config).select("query_id", "rank", "node_id", "depth", "path_edge_id", "path_weight").collect())
    assert [r[:5] for r in got] == sorted((q, rank, node, depth, e) for q, node, rank, depth, _, e in want)
    for row, (_, _, _, _, w, _) in zip(got, sorted(want, key=lambda r: (r[0], r[2])), strict=True):
        assert row[5] == pytest.approx(w, abs=1e-4)


def test_hybrid_scores(spark):
    traversed = spark.createDataFrame([(0, 1, 0, 0, 1.0, None), (0, 3, 1, 1, 0.95, 5)], "query_id long, node_id long, rank long, depth int, path_weight double, path_edge_id long")
    seeds = seeds_of(spark, [(0, 1, 0.9, 0), (0, 2, 0.8, 1)])
    rows = {r.node_id: r.final_score for r in hybrid_scores(seeds, traversed, HybridScoreConfig(0.6, 0.8, 0.0)).collect()}
    assert rows[1] == pytest.approx(0.94) and rows[3] == pytest.approx(0.304)
    low = traversed.where("node_id = 3").withColumn("path_weight", F.lit(0.1))
    assert hybrid_scores(seeds_of(spark, [(0, 3, 0.1, 0)]), low, HybridScoreConfig(0.5, 0.8, 0.5)).count() == 0


def test_triangle_subgraph(spark):
    g = graph(spark, range(4), [(10, 0, 1, 0.9), (20, 1, 2, 0.8), (30, 0, 2, 0.95)])
    sub = extract_subgraph(g.nodes, g.edges, seeds_of(spark, [(0, 0, 0.95, 0)]), TraversalConfig(2, 0.5), HybridScoreConfig())
    scores = [r.final_score for r in sub.entities.orderBy("place").collect()]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)
    assert {r.edge_id for r in sub.edges.collect()} == {10, 20, 30}
    assert sub.counts().first().edge_count == 3
    assert {r.edge_id for r in sub.outgoing(0).collect()} == {10, 30} and {r.edge_id for r in sub.incoming(2).collect()} == {20, 30}


def test_dropped_nodes_may_bridge(spark):
    g = graph(spark, range(3), [(1, 0, 1, 0.9), (2, 1, 2, 0.9)])
    seeds = seeds_of(spark, [(0, 0, 1.0, 0), (0, 1, -1.0, 1)])
    sub = extract_subgraph(g.nodes, g.edges, seeds, TraversalConfig(2), HybridScoreConfig())
    assert {r.node_id for r in sub.entities.collect()} == {0, 2}


@pytest.mark.parametrize("seed", range(3))
def test_prune_is_the_greedy_one(spark, seed):
    rnd = random.Random(100 + seed)
    nodes, edges, entities, cases = [], [], [], {}
    for q in range(12):
        base, n = 50 * q, rnd.randint(1, 7)
        own = list(range(base, base + n))
        names = {i: "x" * rnd.randint(1, 60) for i in own}
        nodes += [(i, names[i], None, None) for i in own]
        links = [(len(edges) + i, rnd.choice(own), rnd.choice(own), rnd.random(), "R" * rnd.randint(1, 40)) for i in range(rnd.randint(0, 10))]
        edges += links
        places = {node: p for p, node in enumerate(rnd.sample(own, n))}
        entities += [(q, i, 0.5, p) for i, p in places.items()]
        cases[q] = (places, names, links)
    g = graph(spark, nodes, edges)
    scored = spark.createDataFrame(entities, "query_id long, node_id long, final_score double, place int")
    ends = lambda node, place: scored.select("query_id", F.col("node_id").alias(node), F.col("place").alias(place))
    links = g.edges.join(ends("src", "src_place"), "src").join(ends("dst", "dst_place"), ["query_id", "dst"]).withColumn("weight", F.col("weight").cast("double"))
    budget = rnd.choice([25, 60, 90])
    kept = prune(Subgraph(scored, links, scored), g.nodes, budget)
    got_nodes = {(r.query_id, r.node_id) for r in kept.entities.collect()}
    got_edges = {(r.query_id, r.edge_id) for r in kept.edges.collect()}
    totals = {r.query_id: r for r in kept.totals.collect()}
    count = lambda text: max(len(text.split()), -(-len(text) // 4))
    for q, (places, names, own) in cases.items():
        costs = {i: count(f"- [{names[i]}] (Relevância: 0.50)\n") for i in places}
        edge_costs = {e[0]: count(f"  - {e[4]} -> [{names[e[2]]}] (Confiança: {e[3]:.2f})\n") for e in own}
        want, want_edges, spent = greedy_prune(places, costs, own, edge_costs, count("# Contexto Recuperado do Conhecimento:\n"), budget)
        assert {n for p, n in got_nodes if p == q} == set(want)
        assert {e for p, e in got_edges if p == q} == set(want_edges)
        assert totals[q].total_tokens == spent


def test_heuristic_tokens(spark):
    texts = ["", "hello", "hello world", "a b c", "   "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(heuristic_tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0, 2, 3, 3, 1]
