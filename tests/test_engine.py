import json

import pytest
from graphs import graph
from pyspark.sql import functions as F

from weftgraph.functions.text import bpe_counter
from weftgraph.operators import mutation as mut
from weftgraph.operators.dictionary import dictionary, dictionary_stats, encoded, resolved
from weftgraph.operators.resolution import resolve_entities
from weftgraph.plans.config import (
    ChecksumMismatch,
    DimensionMismatch,
    DuplicateId,
    EngineConfig,
    InvalidConfig,
    MarkdownStyle,
    NodeNotFound,
    QueryOptions,
    Quantization,
    ResolutionConfig,
    SnapshotCorrupt,
    UnsupportedVersion,
)
from weftgraph.plans.retriever import Engine
from weftgraph.sources import graph_file, snapshot
from weftgraph.streaming.ingest import ingest_edges, ingest_nodes

NODES = [
    ("Projeto Titan", "Projeto", "IA Generativa e RAG", [1, 0, 0, 0]),
    ("Ana Silva", "Pessoa", "Tech Lead de IA", [0.95, 0.05, 0, 0]),
    ("Carlos Dev", "Pessoa", "Engenheiro Rust", [0.9, 0.1, 0, 0]),
    ("Motor de Grafos", "Tecnologia", "Banco de Grafos Embutido", [0.85, 0.15, 0, 0]),
    ("Loja Online", "Projeto", "Plataforma E-Commerce", [0, 0, 1, 0]),
    ("Mariana PM", "Pessoa", "Gerente de Produto", [0, 0, 0.95, 0.05]),
    ("PostgreSQL", "Tecnologia", "Banco Relacional", [0, 0, 0.9, 0.1]),
]
EDGES = [
    (0, 1, "LIDERADO_POR", 0.95, True),
    (0, 2, "DESENVOLVIDO_POR", 0.90, True),
    (0, 3, "UTILIZA", 0.99, True),
    (1, 2, "COORDENA", 0.85, False),
    (4, 5, "GERENCIADO_POR", 0.90, True),
    (4, 6, "UTILIZA", 0.95, True),
]
CONFIG = EngineConfig(dim=4, alpha=0.65, max_depth=2)


def node_rows(spark, rows, start=0):
    return spark.createDataFrame([(n, t, d, None if v is None else [float(x) for x in v], start + i) for i, (n, t, d, v) in enumerate(rows)], "name string, type string, description string, embedding array<float>, seq long")


def edge_rows(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src long, dst long, relation string, weight double, directed boolean, seq long")


def assistant(spark, path=None, config=CONFIG):
    engine = Engine.open_or_create(spark, path, config) if path else Engine.in_memory(spark, config)
    engine.upsert_nodes(node_rows(spark, NODES))
    engine.add_edges(edge_rows(spark, EDGES))
    return engine


def query(spark, v):
    return spark.createDataFrame([(0, [float(x) for x in v])], "query_id long, embedding array<float>")


def test_assistant_after_reopening(spark, tmp_path):
    path = str(tmp_path / "graph")
    assistant(spark, path)
    engine = Engine.open_or_create(spark, path, CONFIG)
    found = engine.retrieve(query(spark, [0.98, 0.02, 0, 0]), QueryOptions(2, 500, 2, 0.1, 0.6))
    text = found.markdown().first().text
    for name, *_ in NODES[:4]:
        assert f"[{name}]" in text
    assert "Loja Online" not in text and "PostgreSQL" not in text
    total = found.pruned.totals.first()
    assert 0 < total.total_tokens <= 500 and total.entity_count >= 3
    payload = json.loads(found.json().first().text)
    assert {e["name"] for e in payload["entities"]} == {n for n, *_ in NODES[:4]}
    assert payload["budget"] == 500 and payload["relations"][0]["weight"] in (0.95, 0.9, 0.99, 0.85)
    assert "(Projeto Titan, UTILIZA, Motor de Grafos)\n" in found.triples().first().text
    separated = engine.retrieve(query(spark, [0.98, 0.02, 0, 0]), QueryOptions(2, 500, 2, 0.1, 0.6, MarkdownStyle.SEPARATED)).markdown().first().text
    assert separated.startswith("# Contexto Recuperado do Conhecimento:\n\n## Entidades:\n- [Projeto Titan] (Score: ") and "\n## Relações Estruturais:\n- [Projeto Titan] --LIDERADO_POR (0.95)--> [Ana Silva]\n" in separated
    stats = engine.stats().first()
    assert (stats.node_count, stats.edge_count, stats.vector_count) == (7, 6, 7)
    # the vector of each node is its own after reopening
    assert [r.node_id for r in engine.search(query(spark, [0, 0, 1, 0]), 1).collect()] == [4]


def test_names_and_budgets(spark):
    engine = assistant(spark)
    names = spark.createDataFrame([(0, " Projeto Titan ", 0), (0, "nobody", 1)], "query_id long, name string, pos int")
    found = engine.retrieve_by_names(names)
    first = found.scored_entities.orderBy("place").first()
    assert first.node_id == 0 and first.final_score == pytest.approx(1.0)
    last = 0
    for budget in (5, 15, 30, 60, 500):
        totals = engine.retrieve_by_names(names, QueryOptions(max_tokens=budget)).pruned.totals.first()
        assert totals.total_tokens <= budget and totals.total_tokens >= last
        last = totals.total_tokens
    nobody = engine.retrieve_by_names(names.where("name = 'nobody'"))
    assert nobody.scored_entities.count() == 0
    # a query that finds nothing has its row all the same
    assert [(r.query_id, r.text) for r in nobody.markdown().collect()] == [(0, "")] and nobody.triples().first().text == ""
    empty = nobody.payload().first()
    assert (empty.entities, empty.relations, empty.total_tokens, empty.budget) == ([], [], 0, CONFIG.max_tokens)
    both = engine.retrieve_by_names(spark.createDataFrame([(0, "Ana Silva", 0), (7, "nobody", 0)], "query_id long, name string, pos int"))
    assert {r.query_id: r.text != "" for r in both.markdown().collect()} == {0: True, 7: False}


def test_counter_with_public_ranks(spark):
    P = pytest.importorskip("public_tokenizers")
    count = bpe_counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    engine = assistant(spark)
    engine.counter = count
    totals = engine.retrieve(query(spark, [1, 0, 0, 0]), QueryOptions(max_tokens=80)).pruned.totals.first()
    assert 0 < totals.total_tokens <= 80


def test_upsert(spark):
    g = graph(spark, [(0, "a", "t", "d"), (1, "b", "t", "d")], [], [(0, [1, 0])])
    changed = mut.upsert_nodes(g, node_rows(spark, [(" a ", "new", "", None), ("c", "", None, [0, 1]), ("c", "late", "text", None)]), dim=2)
    rows = {r.name: r for r in changed.nodes.collect()}
    assert (rows["a"].node_id, rows["a"].type, rows["a"].description) == (0, "new", None)
    assert (rows["c"].node_id, rows["c"].type, rows["c"].description) == (2, "late", "text")
    assert {r.node_id: list(r.embedding) for r in changed.vectors.collect()} == {0: [1.0, 0.0], 2: [0.0, 1.0]}
    with pytest.raises(InvalidConfig):
        mut.upsert_nodes(g, node_rows(spark, [("  ", "t", "d", None)]))
    with pytest.raises(DimensionMismatch):
        mut.upsert_nodes(g, node_rows(spark, [("x", "t", "d", [1, 2, 3])]), dim=2)


def test_white_space_is_no_text(spark):
    """A description of blanks is empty: it overwrites nothing in a resolved upsert and is null in a plain one."""
    g = graph(spark, [(0, "a", "t", "d")], [], [(0, [1, 0])])
    blank = node_rows(spark, [(" a ", " u ", "  \t", None)])
    same = resolve_entities(g, blank)[0].nodes.first()
    assert (same.type, same.description) == ("t", "d")
    plain = mut.upsert_nodes(g, blank).nodes.first()
    assert (plain.type, plain.description) == ("u", None)
    twice, _ = resolve_entities(g, node_rows(spark, [("b", "t", " d\n", [1, 0])]), ResolutionConfig(threshold=0.9))
    assert twice.nodes.first().description == "d"


def test_a_retrieval_reads_the_graph_once(spark, tmp_path):
    """What is rendered comes from rows that were written: no file of the graph is in the plan, and few exchanges are."""
    path = str(tmp_path / "graph")
    assistant(spark, path)
    found = Engine.open_or_create(spark, path, CONFIG).retrieve(query(spark, [0.98, 0.02, 0, 0]), QueryOptions(2, 500))
    for df in (found.markdown(), found.json(), found.triples()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and plan.count("Exchange") < 25


def test_named_counters_do_not_fall_back():
    from weftgraph.functions.text import named_bpe_counter

    with pytest.raises(Exception):
        named_bpe_counter("no such encoding")


def test_edges_and_deletes(spark):
    g = graph(spark, range(4), [(1, 1, 2, 0.5), (2, 2, 3, 0.5), (3, 3, 3, 0.5)], [(i, [1, 0]) for i in range(4)])
    more = mut.add_edges(mut.remove_edges(g, spark.createDataFrame([(2,)], "edge_id long")), edge_rows(spark, [(0, 1, " X ", 7.0, True), (1, 0, "Y", -1.0, False)]))
    # ids go on from the largest, whatever was deleted
    assert {(r.edge_id, r.relation, r.weight) for r in more.edges.where("edge_id > 3").collect()} == {(4, "X", 1.0), (5, "Y", 0.0)}
    with pytest.raises(NodeNotFound):
        mut.add_edges(g, edge_rows(spark, [(0, 99, "X", 1.0, True)]))
    with pytest.raises(InvalidConfig):
        mut.add_edges(g, edge_rows(spark, [(0, 1, " ", 1.0, True)]))
    left = mut.remove_nodes(g, spark.createDataFrame([(2,)], "node_id long"))
    assert left.nodes.count() == 3 and [r.edge_id for r in left.edges.collect()] == [3]
    assert 2 not in {r.node_id for r in left.vectors.collect()}  # no ghost can be found
    quiet = mut.set_edges_active(g, spark.createDataFrame([(1,)], "edge_id long"), False)
    assert quiet.out_neighbors().count() == 2 and quiet.out_edges(quiet.nodes).count() == 3
    assert mut.set_nodes_active(g, g.nodes.where("node_id = 1"), False).active_nodes().count() == 3
    put = mut.put_vectors(g, spark.createDataFrame([(1, [5.0, 5.0])], "node_id long, embedding array<float>"))
    assert put.vectors.count() == 4 and list(put.vector(1).first().embedding) == [5.0, 5.0]
    with pytest.raises(DuplicateId):
        mut.check_unique(g.nodes.union(g.nodes), "node_id")


def test_topology(spark):
    g = graph(spark, range(3), [(1, 0, 1, 0.9), (2, 0, 2, 0.8), (3, 1, 2, 0.7), (4, 2, 2, 0.1)])
    assert [r.degree for r in g.out_degree().orderBy("node_id").collect()] == [2, 1, 1]
    assert [r.offset for r in g.csr_offsets().orderBy("node_id").collect()] == [0, 2, 3, 4]
    assert g.all_neighbors().where("node_id = 2").count() == 4
    assert [r.pos for r in g.in_edges(g.node(2)).orderBy("pos").collect()] == [0, 1, 2]
    assert g.empty(spark).csr_offsets().count() == 1 and g.edge(3).first().dst == 2 and g.node_by_name(" n1 ").first().node_id == 1
    assert g.stats().first().csr_bytes == 8 * 4 + 32 * 4


def test_resolution(spark):
    empty = graph(spark, [], [])
    rows = node_rows(spark, [("Ana", "P", "first", [1, 0, 0, 0]), ("Aninha", "P", "second", [0.999, 0.001, 0, 0]), ("Other", "P", "x", [0, 1, 0, 0]), ("Thing", "T", "y", [1, 0, 0, 0]), ("Ana", "Q", "", [0, 0, 1, 0])])
    for by_type in (False, True):
        g, results = resolve_entities(empty, rows.where("seq < 4") if by_type else rows, ResolutionConfig(threshold=0.95), by_type=by_type)
        out = {r.seq: r for r in results.collect()}
        assert out[1].merged and out[1].node_id == out[0].node_id and not out[2].merged and not out[3].merged
        nodes = {r.name: r for r in g.nodes.collect()}
        assert set(nodes) == {"Ana", "Other", "Thing"} and nodes["Ana"].description == "first; second" and nodes["Ana"].type == "P"
    more, again = resolve_entities(g, node_rows(spark, [("New", "P", "first", [1, 0, 0, 0])], 9), ResolutionConfig(threshold=0.9))
    assert again.first().merged and {r.name: r.description for r in more.nodes.collect()}["Ana"] == "first; second"
    off, _ = resolve_entities(empty, rows.where("seq < 2"), ResolutionConfig(threshold=0.95, merge_descriptions=False))
    assert off.nodes.first().description == "first"


def test_three_nearest_of_any_type(spark):
    """Three closer entities of another type hide a match; folds by type do not know them."""
    rows = node_rows(spark, [*[(f"t{i}", "T", "d", [1, 0.01 * i, 0, 0]) for i in range(3)], ("p", "P", "d", [1, 0.2, 0, 0]), ("q", "P", "d", [1, 0, 0, 0])])
    empty = graph(spark, [], [])
    config = ResolutionConfig(threshold=0.9)
    merged = lambda by_type: {r.name: r.merged for r in resolve_entities(empty, rows.where("type = 'P' or seq = 0") if by_type else rows.where("type = 'P'").unionByName(rows.where("type = 'T'").withColumn("type", F.concat(F.lit("T"), F.col("seq").cast("string")))), config, by_type=by_type)[1].collect()}
    assert not merged(False)["q"] and merged(True)["q"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    names = [(i, f"Entidade_{i:03}_🚀_SãoPaulo_東京", "t", "d") for i in range(50)]
    g = graph(spark, names, [(i, i, (i + 1) % 50, 0.9) for i in range(50)], [(i, [i, 1, 2, 3]) for i in range(50)])
    config = EngineConfig(dim=4, quantization=Quantization.NONE)
    assert snapshot.load(spark, path) is None
    assert snapshot.save(g, path, config) == 1
    back = snapshot.load(spark, path, config)
    for a, b in ((g.nodes, back.nodes), (g.edges, back.edges), (g.vectors, back.vectors)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert snapshot.save(mut.remove_nodes(back, back.nodes.where("node_id > 9")), path, config) == 2
    assert snapshot.load(spark, path).nodes.count() == 10 and snapshot.load(spark, path, version=1).nodes.count() == 50
    with pytest.raises(SnapshotCorrupt):
        snapshot.load(spark, path, EngineConfig(dim=5))
    manifest = tmp_path / "s" / "v=2" / "MANIFEST.json"
    good = manifest.read_text()
    for old, new, error in (('"rows": 10', '"rows": 11', ChecksumMismatch), ('"format": 1', '"format": 9', UnsupportedVersion), ("{", "[", SnapshotCorrupt)):
        (tmp_path / "s" / "v=2" / ".MANIFEST.json.crc").unlink(missing_ok=True)
        manifest.write_text(good.replace(old, new, 1))
        with pytest.raises(error):
            snapshot.load(spark, path)


def test_graph_files(spark, tmp_path):
    nodes = [{"node_id": i * 3, "name": f"n{i}é", "type": "t" if i % 2 else None, "description": None, "active": i != 2} for i in range(5)]
    edges = [{"edge_id": i, "src": 3 * (4 - i), "dst": 0, "relation": "R", "weight": 0.5, "directed": i % 2 == 0, "active": True, "edge_seq": i} for i in range(4)]
    vectors = {3: ([1, -2, 127], 0.5, 2.0), 12: ([0, 0, 1], 1.0, 1.0)}
    data = graph_file.encode(nodes, edges, vectors, 3)
    path = tmp_path / "a.graph"
    path.write_bytes(data)
    g = graph_file.read_graph(spark, str(path))
    assert {(r.node_id, r.name, r.type, r.active) for r in g.nodes.collect()} == {(n["node_id"], n["name"], n["type"], n["active"]) for n in nodes}
    assert {(r.edge_id, r.src, r.directed) for r in g.edges.collect()} == {(e["edge_id"], e["src"], e["directed"]) for e in edges}
    # vectors belong to the ids that have them, not to the first ids
    assert {r.node_id: list(r.embedding) for r in g.vectors.collect()} == {3: [0.5, -1.0, 63.5], 12: [0.0, 0.0, 1.0]}
    head = graph_file.Header.parse(data)
    sums = graph_file.file_checksums(spark, str(path)).first()
    assert sums.checksum == head.checksum == graph_file.checksum(data) and sums.length == len(data)
    assert graph_file.read_section(spark, str(path), "strings").count() == 7
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ChecksumMismatch):
        graph_file.GraphFile.parse(bytes(broken))
    for bad, error in ((b"XXXX" + data[4:], SnapshotCorrupt), (data[:4] + b"\x09\x00" + data[6:], UnsupportedVersion), (data[:10], SnapshotCorrupt)):
        with pytest.raises(error):
            graph_file.GraphFile.parse(bad)
    empty = graph_file.GraphFile.parse(graph_file.encode([], [], {}, 3))
    assert len(empty.nodes) == len(empty.edges) == len(empty.vectors) == 0


def test_graph_file_of_an_engine(spark, tmp_path):
    engine = assistant(spark)
    path = str(tmp_path / "out.graph")
    size = graph_file.write_graph(engine.graph, path, 4)
    back = graph_file.read_graph(spark, path)
    assert {(r.node_id, r.name, r.type, r.description) for r in back.nodes.collect()} == {(i, n, t, d) for i, (n, t, d, _) in enumerate(NODES)}
    assert {(r.src, r.dst, r.relation, r.directed) for r in back.edges.collect()} == {(s, d, r, way) for s, d, r, _, way in EDGES}
    assert graph_file.file_checksums(spark, path).first().length == size
    found = Engine(back, CONFIG).retrieve(query(spark, [0.98, 0.02, 0, 0]), QueryOptions(2, 500)).scored_entities
    assert found.where("node_id = 0").count() == 1
    with pytest.raises(InvalidConfig):
        graph_file.write_graph(engine.graph, path, 4, most=3)
    engine.clear()
    assert engine.graph.nodes.count() == 0 and engine.dirty


def test_command_line(capsys):
    from weftgraph import VERSION
    from weftgraph.__main__ import main

    main([])
    assert VERSION in capsys.readouterr().out


def test_crc32(spark):
    rows = spark.createDataFrame([(b"123456789",), (b"The quick brown fox jumps over the lazy dog",)], "b binary").select(snapshot.crc32(F.col("b"))).collect()
    assert [r[0] for r in rows] == [0xCBF43926, 0x414FA339]


def test_dictionary(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["b", "a", "b", "é🚀", None])], "seq long, text string")
    words = dictionary(rows)
    assert {r.text: r.string_id for r in words.collect()} == {"b": 0, "a": 1, "é🚀": 2}
    ids = encoded(rows, words).orderBy("seq")
    assert [r.string_id for r in ids.collect()] == [0, 1, 0, 2, None]
    assert [r.back for r in resolved(ids, words, "string_id", "back").orderBy("seq").collect()] == ["b", "a", "b", "é🚀", None]
    stats = dictionary_stats(words).first()
    assert (stats.strings, stats.total_bytes) == (3, 8)


def test_config():
    assert EngineConfig().having(alpha=7.0).alpha == 1.0
    for bad in ({"dim": 0}, {"max_tokens": 0}, {"alpha": 2.0}):
        with pytest.raises(InvalidConfig):
            EngineConfig(**bad)


def test_streaming_ingest(spark, tmp_path):
    engine = Engine.open_or_create(spark, str(tmp_path / "g"), CONFIG)
    node_rows(spark, NODES[:4]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(node_rows(spark, NODES).schema).parquet(str(tmp_path / "in"))
    ingest_nodes(stream, engine, str(tmp_path / "c")).awaitTermination()
    assert engine.graph.nodes.count() == 4
    node_rows(spark, NODES[4:], 10).write.mode("append").parquet(str(tmp_path / "in"))
    ingest_nodes(stream, engine, str(tmp_path / "c")).awaitTermination()
    assert engine.graph.nodes.count() == 7
    edge_rows(spark, EDGES).write.parquet(str(tmp_path / "edges"))
    links = spark.readStream.schema(edge_rows(spark, EDGES).schema).parquet(str(tmp_path / "edges"))
    ingest_edges(links, engine, str(tmp_path / "ce")).awaitTermination()
    ingest_edges(links, engine, str(tmp_path / "ce2")).awaitTermination()  # a replay
    assert engine.graph.edges.count() == 6
    # a parallel edge is no replay
    edge_rows(spark, [(0, 1, " LIDERADO_POR ", 0.5, True)]).write.mode("append").parquet(str(tmp_path / "edges"))
    ingest_edges(links, engine, str(tmp_path / "ce")).awaitTermination()
    again = Engine.open_or_create(spark, str(tmp_path / "g"), CONFIG)
    assert engine.graph.edges.count() == 7 and again.graph.edges.where("src = 0 and dst = 1").count() == 2 and again.ingested == {"edges": 1}
    assert sorted(map(str, again.graph.incoming().collect())) == sorted(map(str, again.graph.edges.collect()))
