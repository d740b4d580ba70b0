"""The stages of the pipeline, and the registered queries on the smallest tables."""

import os
import random

import pytest

import corpus_pipeline
from weftgraph.llm import queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rnd = random.Random(1)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 6))) for _ in range(n))
    leak = prose(30)
    rows, labels = [], []
    for i in range(200):
        text = prose(60)
        if i % 8 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append([i, text, "en", f"h{i % 3}"])
        labels.append((i, int(i % 8 != 0), 0))
    rows[11][1] = rows[10][1]
    rows[13][1] = rows[10][1] + " more"
    rows[21][1] += " " + leak
    rows[31][1] += " password = hunter2222 end"
    rows += [[None, prose(20), None, None], [None, None, None, None], [50, rows[50][1], "en", "h0"], [300, "", "en", "h0"]]
    spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in rows], SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_stages(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    kept, seen = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, tables)
        assert kept.columns == df.columns
        kept = kept.checkpoint()
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    clean = {i for i in range(200) if i % 8}
    assert {i for i in seen["quality"] if i is not None and i < 200} == clean
    after = seen["near_duplicates"]
    assert 10 in after and 11 not in after and 13 not in after and None in after
    assert {i for i in after if i is not None and i < 200} == clean - {11, 13}
    assert 21 not in seen["decontamination"] and set(after) - set(seen["decontamination"]) == {21}
    assert seen["secrets"][31].endswith("[assign] end") and seen["secrets"].keys() == seen["decontamination"].keys()
    assert kept.where("doc_id = 50").count() == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, tables)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    whole = corpus_pipeline.run(spark, tables)
    assert sorted(map(str, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_empty_tables(spark, tables):
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered_queries(spark, name):
    df = queries.queries()[name](spark, DATA)
    got = df.collect()
    assert got and len(df.columns) == len(set(df.columns))
    if sql := queries.oracle_sql().get(name):
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "conversations", "labels", "embeddings"):
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(str(tuple(r[c] for c in columns)) for r in got) == sorted(str(tuple(r)) for r in want.fetchall())
