"""Expressions against literal values: keys, dates, stages, positions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates, headers, schema, text


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "key"), [(" ab-123  45 ", "AB12345"), ("ＡＢ－１２３", "AB123"), ("ab　123", "AB123")])
def test_license_key(spark, raw, key):
    assert one(spark, raw, text.license_key) == key


@pytest.mark.parametrize(("raw", "key"), [("山田　太郎", "山田太郎"), ("ﾔﾏﾀﾞ ﾀﾛｳ", "ヤマダタロウ")])
def test_name_key(spark, raw, key):
    assert one(spark, raw, text.name_key) == key


@pytest.mark.parametrize(("raw", "clean"), [(None, None), ("", None), (" NaN ", None), ("<NA>", None), ("　x ", "x"), ("none such", "none such")])
def test_clean(spark, raw, clean):
    assert one(spark, raw, text.clean) == clean


@pytest.mark.parametrize(("raw", "want"), [("12.0", "12"), ("007", "7"), ("12.5", "12.5"), ("1e3", "1000"), ("A-1", "A-1"), ("12345678901234567890", "12345678901234567890")])
def test_whole_number(spark, raw, want):
    assert one(spark, raw, text.whole_number) == want


@pytest.mark.parametrize(("raw", "want"), [("山田 太郎", "山田太郎"), ("12345", None), ("a1234", None), ("--", None), ("ab1", None), ("abc1", "abc1")])
def test_clean_name(spark, raw, want):
    assert one(spark, raw, text.clean_name) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("2024年4月1日", dt.date(2024, 4, 1)), ("2024/4/1", dt.date(2024, 4, 1)), ("R6.09.01", dt.date(2024, 9, 1)), ("令和6年9月1日", dt.date(2024, 9, 1)),
    ("S49. 8.22", dt.date(1974, 8, 22)), ("h23.2.5", dt.date(2011, 2, 5)), ("25.9.10", dt.date(2025, 9, 10)), ("74.9.10", dt.date(1974, 9, 10)), ("2025-09-10", dt.date(2025, 9, 10)),
    ("2025/02/30", None), ("no date", None), (None, None), ("20250910", dt.date(2025, 9, 10)), ("2025-09-10 12:00:00", dt.date(2025, 9, 10))])
def test_dates(spark, raw, want):
    assert one(spark, raw, dates.jp_date) == want


def test_years_in_parentheses(spark):
    assert one(spark, "26.07.31(23)", dates.paren_year) == 2023
    assert one(spark, "26.07.31（2023）", dates.paren_year) == 2023
    assert one(spark, "26.07.31", dates.paren_year) is None
    assert one(spark, "26.07.31(23)", dates.any_date) == dt.date(2026, 7, 31)


def test_29_february_has_an_anniversary(spark):
    assert one(spark, "2024-02-29", lambda c: dates.add_years(c.cast("date"), 1)) == dt.date(2025, 2, 28)


def test_due_stages(spark):
    day = dt.date(2025, 1, 1)
    rows = [("a", day - dt.timedelta(10)), ("b", day + dt.timedelta(10)), ("c", day + dt.timedelta(90)), ("d", None), ("e", day + dt.timedelta(30))]
    df = spark.createDataFrame(rows, "name string, expiry_date date")
    got = {r.name: r for r in df.withColumns(dates.due_columns("expiry_date", "2025-01-01", dates.DueConfig(window=30))).collect()}
    assert [got[n].due_within_window for n in "abcde"] == [True, True, False, False, True]
    assert [got[n].days_to_expiry for n in "abcde"] == [-10, 10, 90, None, 30]
    assert [got[n].notice_stage for n in "abcde"] == ["expired", "same-day", "", "", "final"]
    assert [got[n].next_notice_date for n in "abcde"] == ["", "2025-01-01", "", "", "2025-01-01"]
    kept = df.withColumns(dates.due_columns("expiry_date", "2025-01-01", dates.DueConfig(overdue=False))).where("name = 'a'").first()
    assert not kept.due_within_window and kept.notice_stage == ""


@pytest.mark.parametrize(("raw", "flags"), [("全姿勢", (1, 1, 1, 1)), ("下向・立向", (1, 0, 1, 0)), ("SN-3F", (0, 0, 1, 0)), ("v, oh", (0, 0, 1, 1)), ("O/H", (0, 1, 0, 0)), ("縦 方向", (0, 0, 1, 0)), ("", (0, 0, 0, 0)), (None, (0, 0, 0, 0))])
def test_positions(spark, raw, flags):
    row = spark.createDataFrame([(raw,)], "x string").withColumns(text.position_columns("x")).first()
    assert (row.pos_flat, row.pos_horizontal, row.pos_vertical, row.pos_overhead) == flags
    if sum(flags) == 4:
        assert (row.positions_jp, row.positions_en, row.positions_code) == ("全姿勢", "all", "F/H/V/OH")


@pytest.mark.parametrize(("header", "name"), [
    ("No.", "row_no"), ("証明番号", "license_no"), ("資格", "qualification"), ("資格種類", "category"), ("氏名", "name"), ("登録年月日", "registration_date"), ("登録日", "first_issue_date"),
    ("次回サーベイランス/再評価受験期間", "next_exam_period"), ("Web 番号", "web_control_no"), ("免許証番号", "license_no"), ("有効満了", "expiry_date"), ("unknown", "unknown"), ("資格の番号", "qualification")])
def test_headers(header, name):
    assert headers.canonical_name(header, headers.header_map()) == name


def test_more_headers_may_be_given():
    assert headers.canonical_name("Holder", headers.header_map({"name": ["Holder"]})) == "name"


def test_doubled_columns(spark):
    df = spark.createDataFrame([(" ", "b", None), ("a", "x", 1), (None, "nan", 2)], "p string, q string, n int")
    got = schema.coalesce_doubles(df, ["v", "v", "n"]).collect()
    assert [tuple(r) for r in got] == [("b", None), ("a", 1), (None, 2)]


def test_missing_columns(spark):
    got = schema.ensure_columns(spark.createDataFrame([("x", 1)], "name string, other int"), schema.SNAPSHOT, True)
    assert got.columns == [*schema.SNAPSHOT.names, "other"] and got.first().expiry_date is None
    assert schema.chosen_columns(["z", "name", "a"], None, ["name"]) == ["name", "a", "z"]


def test_escapes(spark):
    assert one(spark, "a;b,c\\d\ne", text.ics_escape) == "a\\;b\\,c\\\\d\\ne"
    assert one(spark, " A b/c? ", text.slug) == "A-b-c"
