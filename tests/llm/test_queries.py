"""Every query of the package over the smallest tables; SQL where there is some, and the pipeline stage by stage."""

import duckdb
import pytest
from conftest import words

import __spark_entry__
import corpus_pipeline
from rollbook.llm.line_quality import quality
from rollbook.llm.queries import QUERIES, SQL

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name, tmp_path):
    df = QUERIES[name](spark, sf)
    df.write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    con.execute(f"create table got as select * from '{tmp_path}/out/*.parquet'")
    assert con.execute("select count(*) from got").fetchall()[0][0] > 0
    if name in SQL:
        con.execute(f"create table want as {SQL[name]}")
        columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
        assert sorted(df.columns) == sorted(r[0] for r in con.execute("describe want").fetchall())
        for a, b in (("want", "got"), ("got", "want")):
            assert con.execute(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert seen[-1].dtypes == docs.dtypes
    good, unique, clean, mixed, packed = (x.collect() for x in seen[1:])
    kept = {r.doc_id for r in quality(docs, copies=False).where("kept").collect()}
    assert sorted(r.doc_id for r in good) == sorted(kept)
    sets = {}
    for r in good:
        w = [x.lower() for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    left = {r.doc_id for r in unique}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in left for b in left if a < b)
    assert all(any(near(a, b) for b in kept if b != a) for a in kept - left)
    assert {r.doc_id for r in clean} == left and not any("@mail" in r.text for r in clean)
    assert {r.doc_id for r in mixed} <= left and len(mixed) > len({r.doc_id for r in mixed})
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_pipeline_takes_odd_documents(spark, odd_docs, no_docs, tmp_path):
    for name, frame in (("odd", odd_docs), ("none", no_docs)):
        docs = frame.select(corpus_pipeline.COLUMNS)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, None).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert (docs.count() > 0) == (name == "odd")
