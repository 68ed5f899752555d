"""The entry module: every registered query runs on the smallest tables, and agrees with its SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from rollbook.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf, duck, name, tmp_path):
    df = QUERIES[name](spark, sf)
    df.write.parquet(f"{tmp_path}/out")
    if name not in SQL:
        return
    duck.execute(f"create or replace temp table want as {SQL[name]}")
    duck.execute(f"create or replace temp table got as select * from '{tmp_path}/out/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    assert sorted(df.columns) == sorted(r[0] for r in duck.execute("describe want").fetchall())
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_works_without_the_llm_folders(tmp_path, with_pipeline):
    home = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{home}/rollbook", tmp_path / "rollbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        shutil.copy(f"{home}/{name}", tmp_path)
    # without the pipeline two queries are run as well, of which one writes to the shared folder
    runs = "" if with_pipeline else "; from pyspark.sql import SparkSession; spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(spark).count() > 0 and q['issue_pages'](spark, '/root/testdata/sf0.001').count() > 0"
    check = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)" + runs
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, env=environment, check=True, timeout=300)
