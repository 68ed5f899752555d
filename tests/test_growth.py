"""Steps that grew to much over large tables: what they write, sort and trim."""

import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates, schema, text
from rollbook.operators import extraction, issue, ranges, state
from rollbook.plans import queries
from rollbook.plans import standins as s
from rollbook.sources import tolerant


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that are written as steps."""
    names = []
    for module in (tolerant, ranges, issue, queries):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, real=real: names.append(name) or real(df, name))
    return names


def test_records_are_found_by_one_sort_of_their_lines(spark, tmp_path, written):
    want = [(str(i), f'a\n"{i}"\n\nb' if i % 3 else "plain") for i in range(300)]
    for kind in ("utf-8", "utf-16"):
        quote = lambda v: '"' + v.replace('"', '""') + '"' if "\n" in v else v
        (tmp_path / f"{kind}.csv").write_bytes(("k,v\n" + "".join(f"{k},{quote(v)}\n" for k, v in want)).encode(kind))
    sizes = tolerant.lines(spark, str(tmp_path), 50).where("source like '%utf-16%'").groupBy("source", "block").count()
    assert sizes.count() > 10 and sizes.where("count > 50").isEmpty()
    written.clear()
    got = sorted((int(r.k), r.v) for r in tolerant.read_csv(spark, str(tmp_path), ["k", "v"], 50).collect())
    assert got == sorted((int(k), v) for k, v in want * 2)
    assert "ranges" not in written


def test_last_changes_are_hashed_not_sorted(spark):
    keys, rules = state.TABLES["report_entry"]
    log = spark.createDataFrame([("r", "l", "2024-01-01", 1), ("r", "l", None, 2), ("r", "m", None, 1), ("r", "m", "2024-01-02", 2)], "report_id string, license_key string, created string, seq int").withColumn("created", F.col("created").cast("date"))
    old = log.select(*keys, "created").where("false")
    out = state.applied(old, log, keys, rules)
    assert sorted((r.license_key, str(r.created)) for r in out.collect()) == [("l", "None"), ("m", "2024-01-02")]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_counts_of_sheets_put_nothing_into_pages(spark, sf, written):
    own = schema.ensure_columns(queries.due_rows(spark, sf), schema.ROSTER, True)
    only = issue.context(own, **s.flags(spark, sf), parts=("sheets",))
    assert list(only) == ["sheets"] and written == []
    whole = issue.context(own, **s.flags(spark, sf))["sheets"]
    assert sorted(map(tuple, only["sheets"].collect())) == sorted(map(tuple, whole.collect()))


def test_texts_are_trimmed_only_where_white_space_is(spark):
    edges = [*text.WHITE_SPACE, "!", "~", "a", "\x7f", "\u3001", "登", "\U0010ffff", "\u200b", "é"]
    values = [a + m + b for a in edges for m in ("", "x", "none", "long enough") for b in edges]
    both = spark.createDataFrame([(v,) for v in values], "x string").select("x", text.clean("x").alias("by_name"), text.clean(F.col("x")).alias("by_column"), text.untrimmed(F.col("x")).alias("fast"))
    for r in both.collect():
        want = r.x.strip(text.WHITE_SPACE)
        want = None if want.lower() in text.EMPTY_WORDS else want
        assert r.by_name == want and r.by_column == want, repr(r.x)
        assert not (r.fast and r.x != r.x.strip(text.WHITE_SPACE))
        assert r.fast or not all(e in "!~a登\u3001" for e in (r.x[0], r.x[-1]))
    assert both.where("x = 'along enougha'").first().fast


def test_a_schedule_makes_its_stage_once(spark, sf, written):
    queries.star_schedule(spark, sf)
    assert written == ["stage"]


def test_days_are_read_alike_with_and_without_taking_them_apart(spark):
    want = {"2024/9/1": "2024-09-01", "2024年09月01日": "2024-09-01", "2024.02.30": None, "R6.9.1": "2024-09-01", "令和 6年9月1日": "2024-09-01", "24.9.1": "2024-09-01", "79/9/1": "1979-09-01", "2024-09-01": None, "2024 /9/1": None, "24年9月1日": None, "R6-9-1": None}
    got = spark.createDataFrame([(x,) for x in want], "x string").select("x", dates.signed_day(F.col("x")).alias("d")).select("x", F.when(F.col("d.form").isNotNull(), F.col("d.day")).cast("string").alias("d"))
    assert {r.x: r.d for r in got.collect()} == want


def test_tokens_are_made_once(spark):
    pages = spark.createDataFrame([("a", "on 2024/09/01 and R6.9.1")], "source string, text string")
    out = extraction.date_candidates(pages, normal=True)
    assert sorted(r.token for r in out.collect()) == ["2024/09/01", "R6.9.1"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp_extract_all" in line for line in plan.splitlines())
