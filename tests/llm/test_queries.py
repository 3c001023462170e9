"""Registered queries against their SQL, and the pipeline against brute force."""

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storefront.llm import byte_bpe, catalogue, toxicity


@pytest.fixture(scope="module")
def duck(sf001):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, sf001, name):
    got, rel = catalogue.QUERIES[name](spark, sf001), duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(got.columns)
    assert brute.class_sort(tuple(r) for r in got.select(*columns).collect()) == brute.class_sort(rel.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]

    kept = corpus_pipeline.toxicity(spark, docs, sf001)
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, toxicity._fitted(docs, labels)).filter("score >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == names and {d for d, _ in rows} == {r.doc_id for r in docs.collect()} - bad

    lines = {d: t for d, _, _, t in brute.line_dedup(rows)}
    near = [(d, t) for d, t in sorted(lines.items())]
    found = brute.components(near, 5)
    stays = [near[i] for i in range(len(near)) if not found[i][0] or found[i][1] == near[i][0]]
    clean = {d for d, _, hit, _ in brute.contamination(stays, bench) if not hit}
    want = {d: t for d, t in stays if d in clean}

    out = corpus_pipeline.run(spark, sf001).collect()
    assert {r.doc_id: r.text for r in out} == want
    coder = byte_bpe.bpe(None, None)
    for r in out[:40]:
        ids, _ = coder.encode([r.text])
        assert r.ids == ids.tolist() and r.n_tokens == len(r.ids)


def test_pipeline_stages_take_edge_cases(spark, edge, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "several documents share")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for table in (edge, empty):
        docs = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            if i < 4:
                assert out.columns == edge.columns
            out.write.parquet(path := f"{sf}/{table.count()}-{i}")
            docs = spark.read.schema(out.schema).parquet(path)
        assert docs.select(F.count("ids")).first()[0] == docs.count()
