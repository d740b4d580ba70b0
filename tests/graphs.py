"""Small graphs, and plain sequential versions of the operators to hold results against."""

from __future__ import annotations

from collections import deque

from weftgraph.operators.graph import PropertyGraph
from weftgraph.plans.config import EDGES, NODES, VECTORS, Direction, TraversalConfig


def graph(spark, nodes, edges, vectors=()):
    """nodes: ids or (id, name, type, description); edges: (id, src, dst, weight[, relation]); vectors: (id, list)."""
    rows = [(n, f"n{n}", "t", None, True) if isinstance(n, int) else (*n, True) for n in nodes]
    links = [(e[0], e[1], e[2], e[4] if len(e) > 4 else "R", float(e[3]), True, True, e[0]) for e in edges]
    return PropertyGraph(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES), spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], VECTORS))


def queue_bfs(nodes: set[int], edges: list[tuple], seeds: list[int], config: TraversalConfig) -> list[tuple]:
    """(node, rank, depth, weight, edge) of a first-in-first-out search."""
    usable = sorted(e for e in edges if e[3] >= config.min_edge_weight)
    found, seen, queue = [], set(), deque()

    def visit(node, depth, weight, edge):
        if node in seen or node not in nodes or len(found) >= config.max_nodes:
            return
        seen.add(node)
        found.append((node, len(found), depth, weight, edge))
        queue.append((node, depth, weight))

    for s in seeds:
        visit(s, 0, 1.0, None)
    while queue:
        node, depth, weight = queue.popleft()
        if depth >= config.max_depth:
            continue
        out = [(e[2], e) for e in usable if e[1] == node]
        back = [(e[1], e) for e in usable if e[2] == node]
        for other, e in {Direction.OUTGOING: out, Direction.INCOMING: back, Direction.UNDIRECTED: out + back}[config.direction]:
            visit(other, depth + 1, weight * e[3], e[0])
    return found


def greedy_prune(places: dict[int, int], costs: dict[int, int], edges: list[tuple], edge_costs: dict[int, int], title: int, budget: int) -> tuple[list, list, int]:
    """Entities by place until one does not fit; after each, its edges to accepted ones where they fit."""
    if title >= budget:
        return [], [], 0
    spent, kept, links = title, [], []
    order = sorted(edges, key=lambda e: (places[e[1]], e[0]))
    for node in sorted(places, key=places.get):
        if spent + costs[node] > budget:
            break
        spent += costs[node]
        kept.append(node)
        for e in order:
            if node in e[1:3] and e[1] in kept and e[2] in kept and e[0] not in links and spent + edge_costs[e[0]] <= budget:
                spent += edge_costs[e[0]]
                links.append(e[0])
    return kept, links, spent
