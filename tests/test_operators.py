"""Operators on small tables with known results, and properties on the test tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rollbook.functions import schema
from rollbook.operators import due, extraction, identity, issue, layout, runs, star, state, versioned
from rollbook.operators import roster as roster_ops
from rollbook.plans import standins
from rollbook.sources import files, jdbc
from rollbook.streaming import feeds

NOW = "2025-01-01 00:00:00"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def roster_frame(spark, data, columns):
    own = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], columns + ", row_seq long")
    return schema.ensure_columns(own, schema.ROSTER)


D = dt.date


def test_keys_differ_without_a_licence(spark):
    df = spark.createDataFrame([("A", "L-1", "Q", D(2025, 1, 1)), ("A", None, "Q", D(2025, 1, 1))], "name string, license_no string, qualification string, expiry_date date")
    got = identity.attach_keys(df).collect()
    assert len({r.license_key for r in got}) == 2 and all(r.person_key == "name:A" for r in got)


def test_manual_rows_fill_but_do_not_win(spark):
    ingest = roster_frame(spark, [("山田", "A-1", "JIS", D(2026, 1, 1)), ("佐藤", "A-2", "JIS", D(2026, 2, 1))], "name string, license_no string, qualification string, expiry_date date")
    hand = roster_frame(spark, [("山田", "A1", "other", D(2024, 1, 1), D(2027, 1, 1), "P1", "S1")], "name string, license_no string, qualification string, registration_date date, expiry_date date, print_sheet string, source_sheet string")
    got = {r.license_key: r for r in roster_ops.current_roster(ingest, hand, NOW).collect()}
    assert set(got) == {"lic:A1", "lic:A2"}
    r = got["lic:A1"]
    assert (r.qualification, r.expiry_date, r.source) == ("JIS", D(2026, 1, 1), "ingest")
    assert (r.print_sheet, r.source_sheet, r.sheet_source, r.registration_date) == ("P1", "S1", "manual", D(2024, 1, 1))
    assert got["lic:A2"].sheet_source == "auto" and got["lic:A2"].display_name == "佐藤"


def test_latest_row_of_a_licence_wins(spark):
    ingest = roster_frame(spark, [("x y", "1", "old", D(2020, 1, 1)), ("x y", "1", "new", D(2024, 1, 1))], "name string, license_no string, qualification string, issue_date date")
    got = roster_ops.current_roster(ingest, ingest.limit(0), NOW).collect()
    assert [(r.qualification, r.issue_date, r.name) for r in got] == [("new", D(2024, 1, 1), "xy")]


def test_one_row_for_each_licence(spark, sf):
    from rollbook.plans.queries import roster_inputs

    got = roster_ops.current_roster(*roster_inputs(spark, sf), NOW, normal=True)
    assert got.count() == got.select("license_key").distinct().count()


def test_overrides_blank_means_no_change(spark):
    df = spark.createDataFrame([("p", "n", "1")], "person_key string, name string, employee_id string")
    changed = spark.createDataFrame([("p", " ", "2")], "person_key string, display_name string, employee_id string")
    assert rows(roster_ops.with_overrides(df, changed), "name", "employee_id") == [("n", "2")]


def test_reimport_fills_blanks(spark):
    new = spark.createDataFrame([("k", None, "default", 1)], "license_key string, issue_date date, print_sheet string, row_seq long")
    old = spark.createDataFrame([("k", D(2020, 1, 1), "P", 1)], "license_key string, issue_date date, print_sheet string, row_seq long")
    assert rows(roster_ops.reimported(new, old), "issue_date", "print_sheet") == [(D(2020, 1, 1), "P")]


def test_names_are_profiled(spark):
    data = [(f"{i:05d}", "".join(chr(97 + int(x)) for x in f"{i:04d}"), "x-1") for i in range(40)]
    df = spark.createDataFrame(data, "code string, person string, kind string")
    assert identity.name_columns(df) == ["person"]


def test_sort_by_two_columns(spark):
    data = [("A-010", D(2025, 1, 1), 0), ("A-002", D(2026, 1, 1), 1), ("A-001", D(2026, 1, 1), 2)]
    df = spark.createDataFrame(data, "license_no string, expiry_date date, row_seq long")
    got = [r.license_no for r in roster_ops.sorted_by(df, (("expiry_date", False), ("license_no", True))).collect()]
    assert got == ["A-001", "A-002", "A-010"]


def test_expiry_rule_needs_a_table_without_any(spark):
    df = spark.createDataFrame([("JIS 1", D(2024, 2, 29), None), ("ボイラー", D(2024, 2, 29), None), ("x", D(2024, 2, 29), None)], "qualification string, issue_date date, expiry_date date")
    assert [r.expiry_date for r in due.expiry_by_rule(df, "issue_date").collect()] == [D(2025, 2, 28), D(2026, 2, 28), D(2027, 2, 28)]
    some = df.withColumn("expiry_date", F.when(F.col("qualification") == "x", F.col("issue_date")))
    assert due.expiry_by_rule(some, "issue_date").where("expiry_date is null").count() == 2


def test_guessed_dates(spark):
    data = [(D(2020, 1, 1 + i), D(2023, 1, 1 + i), D(2021, 1, 1 + i)) for i in range(5)]
    assert due.guessed_dates(spark.createDataFrame(data, "a date, b date, c date"), ["a", "b", "c"]) == {"first_issue_date": "a", "issue_date": "b", "expiry_date": "b"}


def test_scanned_dates_fan_out_unless_latest(spark):
    df = spark.createDataFrame([("n", "A-1", None, D(2020, 1, 1))], "name string, license_no string, issue_date date, expiry_date date")
    scan = spark.createDataFrame([("a1", D(2021, 1, 1), D(2024, 1, 1)), ("A1", D(2022, 1, 1), D(2025, 1, 1))], "license_no string, issue_date date, expiry_date date")
    assert due.with_scanned(df, scan).count() == 2
    assert rows(due.with_scanned(df, scan, latest=True), "expiry_date") == [(D(2025, 1, 1),)]


def test_issue_flags_and_sheets(spark):
    listed = spark.createDataFrame([("p1", "l1", "A", "n1", "1", "q", 1), ("p2", "l2", "A", "n2", "2", "q", 2), ("p3", "l3", "B", "n3", "3", "q", 3)], "person_key string, license_key string, print_sheet string, name string, license_no string, qualification string, row_seq long")
    none = lambda c: spark.createDataFrame([], f"{c} string, include boolean")
    member = spark.createDataFrame([("l1", "P1", True), ("l1", " ", None), ("l2", "P1", False)], "license_key string, print_sheet string, include boolean")
    assert rows(issue.expanded(listed, member), "license_key", "print_sheet") == [("l1", "P1"), ("l1", "default"), ("l2", "A"), ("l3", "B")]
    people = spark.createDataFrame([("p2", False), ("p3", None)], "person_key string, include boolean")
    got = issue.filtered(listed, people, none("license_key"), none("print_sheet"), spark.createDataFrame([], "license_key string, print_sheet string, include boolean"))
    assert rows(got, "license_key") == [("l1",), ("l3",)]


def test_pages_partition_the_list(spark, sf):
    own = standins.roster(spark, sf)
    paged = issue.pages(own, "expiry_date", "row_seq", rows=7)
    assert paged.count() == own.count()
    sizes = paged.groupBy("page", "print_sheet").count().collect()
    assert max(r["count"] for r in sizes) == 7 and len({r.page for r in sizes}) == len(sizes)
    assert {r.page for r in sizes} == set(range(1, len(sizes) + 1))
    assert {r.total_pages for r in paged.select("total_pages").distinct().collect()} == {len(sizes)}
    small = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3), (None, 4)], "print_sheet string, row_seq long")
    got = rows(issue.pages(small, "row_seq", rows=1, most=2), "page", "print_sheet", "sheet_page", "sheet_total", "total_pages")
    assert got == [(1, "A", 1, 1, 4), (2, "B", 1, 2, 4)]
    assert issue.pages(small.limit(0), "row_seq").count() == 0
    assert issue.pages(small, "row_seq", rows=0).select("sheet_total").distinct().count() == 1


def snapshots(spark):
    days = {"2025-09-01": "a", "2025-10-01": "ab", "2025-11-01": "b", "2025-12-01": "ab"}
    return spark.createDataFrame([(k, D.fromisoformat(d), d) for d, keys in days.items() for k in keys], "rec_key string, snapshot_date date, seen string")


def test_intervals_close_and_reopen(spark):
    got = rows(versioned.intervals(snapshots(spark), ("seen",)), "rec_key", "valid_from", "valid_to", "seen")
    assert got == [("a", D(2025, 12, 1), None, "2025-12-01"), ("a", D(2025, 9, 1), D(2025, 10, 31), "2025-10-01"), ("b", D(2025, 10, 1), None, "2025-12-01")]
    runs_ = versioned.intervals(snapshots(spark))
    for date, n in (("2025-08-31", 0), ("2025-09-15", 1), ("2025-10-15", 2), ("2025-10-31", 2), ("2025-11-15", 1), ("2026-01-01", 2)):
        assert versioned.as_of(runs_, date).count() == n


def test_state_at_each_snapshot_is_that_snapshot(spark, sf):
    own = standins.snapshots(spark, sf)
    runs_ = versioned.intervals(own)
    days = own.select(F.col("snapshot_date").alias("as_of")).distinct()
    got = versioned.as_of_dates(runs_, days).select("as_of", "rec_key")
    want = own.select("snapshot_date", "rec_key").distinct()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_differences(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "rec_key string, category string")
    new = spark.createDataFrame([("b", "y"), ("c", None), ("d", "x")], "rec_key string, category string")
    assert rows(versioned.diff(old, new), "rec_key", "change") == [("a", "removed"), ("d", "added")]
    assert rows(versioned.preview(old, new, ("category",)), "rec_key", "change", "changes") == [("a", "removed", ""), ("b", "changed", "category: x -> y"), ("d", "added", "")]


def test_change_logs(spark):
    keys, rules = state.TABLES["sheet_membership"]
    old = spark.createDataFrame([("l", "A", True, "n", "p0"), ("l", "B", True, None, "p0")], "license_key string, print_sheet string, include boolean, notes string, person_key string")
    log = spark.createDataFrame([("l", "A", False, None, "p1", 1, False), ("l", "C", True, None, "p1", 2, False), ("l", "C", False, "z", "p2", 3, False), ("l", "B", True, None, None, 4, True)], "license_key string, print_sheet string, include boolean, notes string, person_key string, seq long, gone boolean")
    once = state.applied(old, log, keys, rules, "gone")
    want = [("l", "A", False, None, "p0"), ("l", "C", False, "z", "p1")]
    assert rows(once, *once.columns) == want
    assert rows(state.applied(once, log, keys, rules, "gone"), *once.columns) == want


def test_seeds_keep_what_is_there(spark):
    old = spark.createDataFrame([("a", False)], "person_key string, include boolean")
    new = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "person_key string")
    assert rows(state.seeded(old, new, ["person_key"], include=True), "person_key", "include") == [("a", False), ("b", True)]


def test_manual_rows(spark):
    kind = "license_no string, name string, qualification string"
    old = spark.createDataFrame([("1", "n", "q")], kind)
    change = spark.createDataFrame([("1", "n", None, 1), ("2", "m", "r", 2), ("", "x", "r", 3)], kind + ", seq long")
    added, bad = state.manual_rows(old, change)
    assert rows(added, "license_no", "qualification") == [("1", None), ("2", "r")] and bad.count() == 1
    updated, bad = state.manual_rows(old, change, update=True)
    assert rows(updated, "license_no", "qualification") == [("1", "q")] and bad.count() == 2


def test_entries_need_report_and_licence(spark):
    entry = spark.createDataFrame([("r", "l", 1, 1), ("x", "l", 1, 2), ("r", "x", 1, 3)], "report_id string, license_key string, created int, seq int")
    good, bad = state.report_entries_added(entry.limit(0), entry, spark.createDataFrame([("r",)], "report_id string"), spark.createDataFrame([("l",)], "license_key string"))
    assert rows(good, "report_id", "license_key") == [("r", "l")] and bad.count() == 2


def test_content_hash_ignores_order_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    h = lambda d: runs.content_hash(d).first()[0]
    assert h(df) == h(df.orderBy(F.desc("x"))) != h(df.distinct())
    assert len(h(df.limit(0))) == 64
    back = runs.run_rows(runs.run_items(df.withColumn("print_sheet", F.lit("A")), "r", "x"), "x int, y string")
    assert rows(back, "x", "y") == [(1, "a"), (2, None), (2, None)]


def test_star_schema(spark):
    columns = ", ".join(f"{c} string" for c in star.STAGE)
    base = ["1", "A-1", "q", "k", "2024/01/02", "1", "2027-01-02", "n", "1970/1/1", " ", "e", "b", "s", "2026/01/01～2026/03/31", "d", "w"]
    second = list(base)
    second[0], second[1] = "2", " "
    tables = star.split(star.staged(spark.createDataFrame([tuple(base), tuple(second)], columns)))
    assert tables["dim_person"].count() == 1 and tables["dim_license"].count() == 2 and tables["fact_qualification"].count() == 2
    r = star.schedule(tables, "2027-01-01").where("row_no = 1").first()
    assert (r.window_start, r.window_end, r.days_to_expiry, r.name) == (D(2026, 1, 1), D(2026, 3, 31), 1, "n")
    with pytest.raises(ValueError, match="columns are missing"):
        star.staged(spark.createDataFrame([("1",)], "row_no string"))


TEXT = "免許証\n登録番号: AB-12345\n資格: 溶接\n交付日: R6.09.01 \n有効期限: 2028/09/01 \n"


def test_certificate_text(spark):
    pages = spark.createDataFrame([("f", 1, TEXT), ("g", 1, "登録番号: ZX-999 / 有効期限: 2027/01/31 "), ("h", 1, "nothing"), ("i", 1, None)], "source string, page int, text string")
    got = {r.source: r for r in extraction.certificates(pages).collect()}
    assert (got["f"].license_no, got["f"].qualification, got["f"].issue_date, got["f"].expiry_date) == ("AB-12345", "溶接", D(2024, 9, 1), D(2028, 9, 1))
    assert got["g"].license_no == "ZX-999" and got["g"].expiry_date == D(2027, 1, 31) and "h" not in got
    assert rows(extraction.date_candidates(pages.where("source = 'f'")), "token", "iso") == [("2028/09/01", "2028-09-01"), ("R6.09.01", "2024-09-01")]
    assert rows(extraction.labelled_dates(pages), "source", "issue_date", "expiry_date") == [("f", D(2024, 9, 1), D(2028, 9, 1)), ("g", None, D(2027, 1, 31))]
    assert rows(extraction.names(spark.createDataFrame([("f", 1, "x #61松岡正 #114内田浩\n氏名: 松岡正")], "source string, page int, text string")), "name") == [("内田浩",), ("松岡正",)]


def test_certificate_numbers_in_other_writings(spark):
    texts = ["証第 X-77 号", "登録第 123 號", "記号 K-0001", "1a-4567", "No. 55\n資格: 溶接", "JIS 氏名: 山田太郎", "氏名: 佐藤花子", "nothing"]
    pages = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string")
    got = {r.source: (r.license_no, r.name, r.qualification) for r in extraction.certificates(pages, listed=True).collect()}
    assert got == {"0": ("X-77", None, None), "1": ("123", None, None), "2": ("K-0001", None, None), "3": ("1a-4567", None, None), "4": ("55", None, "溶接"), "5": (None, "山田太郎", "JIS 溶接士"), "6": (None, "佐藤花子", None)}
    assert {r.source for r in extraction.certificates(pages).collect()} == {"0", "1", "2", "3", "4"}


@pytest.mark.parametrize(("text", "issue", "expiry"), [
    ("有効期間: 2024/04/01〜2027/03/31", D(2024, 4, 1), D(2027, 3, 31)), ("有効期間 2024/04/01 〜 2027/03/31 ", D(2024, 4, 1), D(2027, 3, 31)),
    ("有効期間：R6.4.1～R9.3.31\n", D(2024, 4, 1), D(2027, 3, 31)), ("有効 令和6年4月1日から令和9年3月31日まで", D(2024, 4, 1), D(2027, 3, 31)), ("有効期間 2024-04-01-2027-03-31", D(2024, 4, 1), D(2027, 3, 31)),
    ("有効期間 20240401 - 20270331", D(2024, 4, 1), D(2027, 3, 31)), ("有効期限: 2028/01/01\n有効期間: 2024/04/01〜2027/03/31", D(2024, 4, 1), D(2027, 3, 31)),
    ("交付日: R6.09.01  有効期限: 2028/09/01\n有効期間: 2024/09/01〜2028/09/01", D(2024, 9, 1), D(2028, 9, 1)), ("交付日: 2023/01/01\n有効期間: 24.04.01〜27.03.31", D(2024, 4, 1), D(2027, 3, 31)),
    ("交付日: 2024/04/01", D(2024, 4, 1), D(2024, 4, 1)), ("有効期限: 2027/03/31", None, D(2027, 3, 31)), ("on 2024/04/01", D(2024, 4, 1), D(2024, 4, 1)), ("2027/03/31 2024/04/01 2025/01/01", D(2024, 4, 1), D(2027, 3, 31)),
    ("登録年月日: 2020/01/01\n有効期限: 2027/03/31", None, D(2027, 3, 31)), ("有効期間満了日 2027/03/31", None, D(2027, 3, 31)), ("有効期間: なし\n2024/04/01", D(2024, 4, 1), D(2024, 4, 1)), ("有効期間: 2027/13/31〜2027/14/31 no", None, None)])
def test_certificate_days(spark, text, issue, expiry):
    got = extraction.certificates(spark.createDataFrame([("f", "No. A-1\n" + text)], "source string, text string")).collect()
    assert [(r.issue_date, r.expiry_date) for r in got] == [(issue, expiry)]


def test_columns_by_letters(spark):
    assert [layout.column_number(x) for x in ("A", "c", "Z", "AA", "ZZ", "AAA")] == [0, 2, 25, 26, 701, 702]
    assert layout.column_range("H:C") == (2, 7) and layout.column_range(" b ") == (1, 1)
    with pytest.raises(ValueError):
        layout.column_range("1:2")
    numbers = [0, 25, 26, 51, 52, 701, 702, 703, 16383]
    got = [r.x for r in spark.createDataFrame([(n,) for n in numbers], "n int").select(layout.column_letters("n").alias("x")).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAB", "XFD"] and [layout.column_number(x) for x in got] == numbers


def test_content_hashes_tell_tables_apart(spark):
    hashed = lambda rows: runs.content_hash(spark.createDataFrame(rows, "a int, b string")).first()[0]
    one = [(1, "x"), (2, None), (2, None)]
    assert hashed(one) == hashed(one[::-1]) and len({hashed(one), hashed(one[:2]), hashed([(1, "x")]), hashed([]), hashed([(1, "x"), (2, "")])}) == 5


def test_names_are_filled_by_licence_and_employee(spark):
    rows = [(1, "A 1", "山田 太郎", None), (2, "A 1", None, "7"), (3, "B", " ", "7"), (4, "C", "123", "9"), (5, "D", "佐藤", "9.0"), (6, None, None, None), (7, None, "nan", None)]
    got = identity.fill_names(spark.createDataFrame(rows, "row_seq long, license_no string, name string, employee_id string"), seed="s")
    assert {r.row_seq: r.name for r in got.collect()} == {1: "山田太郎", 2: "山田太郎", 3: "免許:B", 4: "佐藤", 5: "佐藤", 6: "s:6", 7: "s:7"}


def test_licence_candidate_reasons(spark):
    text = "登録番号: AB-12345\nXY999\n\n\nQR1234\n\n1234567\n発行 7654321\n2024-01-02 99"
    pages = spark.createDataFrame([("f", 1, text)], "source string, page int, text string")
    got = {r.candidate: (r.line_no, r.reason, r.confidence) for r in extraction.license_candidates(pages, rejected=True).collect()}
    assert got["AB-12345"] == (1, "accept:labeled", "high") and got["XY999"] == (2, "accept:adjacent_label", "medium")
    assert got["QR1234"] == (5, "accept:pattern", "medium") and got["7654321"] == (8, "accept:numeric_long", "low")


def cells(spark, grid, sheet="s"):
    data = [("b", sheet, r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(data, "source string, sheet string, row int, col int, value string")


def test_header_rows(spark):
    grid = [["title"], ["氏名", "番号", "x"], ["a", "1", "2"]]
    tokens = spark.createDataFrame([("氏名",), ("番号",)], "token string")
    assert rows(layout.header_rows(cells(spark, grid), tokens), "header_row") == [(1,)]
    assert rows(layout.header_rows(cells(spark, [[None], ["a", "b"]]), tokens), "header_row") == [(1,)]


def test_vertical_layout(spark):
    day = ["2020/01/01", "2022/01/01", "2025/01/01"]
    grid = [["氏名", "番号", None, "JIS", None, None, None, None, None, "boiler", None]]
    grid += [["山田", "101", None, "1-2", "溶接 A", *day[:2], None, None, day[2], None], [None, None, None, None, "溶接 B", *day, None, None, None], ["佐藤", "102", None, None, "plate", day[0], None, None, None, "kind", None]]
    own = cells(spark, grid)
    found = layout.blocks(layout.column_scores(own), own)
    assert rows(found, "person_col", "number_col", "first", "last", "label") == [(0, 1, 3, 7, "JIS"), (0, 1, 9, 9, "BOILER")]
    got = {(r.row, r.first): r for r in layout.vertical_records(own, found, 0, 1).collect()}
    r = got[2, 3]
    assert (r.name, r.registration, r.first_issue_date, r.issue_date, r.expiry_date, r.qualification) == ("山田", "101", D(2020, 1, 1), D(2022, 1, 1), D(2025, 1, 1), "溶接 B")
    assert (got[1, 3].license_no, got[1, 3].sequence, got[1, 9].license_no, got[1, 9].issue_date, got[1, 9].expiry_date) == ("1-2", "101", "101", D(2025, 1, 1), None)
    assert got[3, 3].issue_date == D(2020, 1, 1) and got[3, 3].expiry_date == D(2021, 1, 1)
    assert json.loads(layout.raw_json(layout.vertical_records(own, found, 0, 1)).where("row = 2").first()["values"])


def test_print_areas(spark):
    some = spark.createDataFrame([("s", 1, 0), ("s", 9, 0), ("s", 2, 7), ("t", 1, 0)], "sheet string, row int, first_col int")
    areas = spark.createDataFrame([("s", 0, 3, 0, 5)], "sheet string, r0 int, r1 int, c0 int, c1 int")
    assert rows(layout.areas_marked(some, areas), "sheet", "row", "area", "history") == [("s", 1, "active", 0), ("s", 2, "active", 1), ("s", 9, "retired", 0), ("t", 1, "retired", 0)]
    assert layout.areas_marked(some, areas, True).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes("氏名,登録番号\n山田,1\n".encode("cp932"))
    (tmp_path / "in/b.csv").write_bytes("﻿氏名,登録番号\r\n佐藤,2\r\n".encode())
    read = files.parsed_csv(files.read_text_files(spark, f"file://{tmp_path}/in"), "name string, license_no string")
    assert rows(read, "name", "license_no") == [("佐藤", "2"), ("山田", "1")]
    df = spark.createDataFrame([("n", "q", D(2025, 1, 1))], "name string, qualification string, expiry_date date")
    for date in ("2025-01-01", "2025-02-01"):
        files.write_as_of(df, f"{tmp_path}/asof", date)
    files.write_as_of(df.union(df), f"{tmp_path}/asof", "2025-02-01")
    assert files.read_as_of(spark, f"{tmp_path}/asof").count() == 3
    assert rows(files.read_as_of(spark, f"{tmp_path}/asof", "2025-02-01"), "name", "expiry_date") == [("n", D(2025, 1, 1))] * 2
    assert files.read_version(spark, f"{tmp_path}/t", df.schema, "1").count() == 0
    files.write_version(df, f"{tmp_path}/t", "1")
    assert files.read_version(spark, f"{tmp_path}/t", df.schema, "1").count() == 1
    files.write_export(df, f"{tmp_path}/out")
    assert "氏名" in spark.read.csv(f"{tmp_path}/out", header=True).columns
    files.write_calendar(due.calendar_lines(df.withColumn("license_no", F.lit("1"))), f"{tmp_path}/ics")
    assert spark.read.text(f"{tmp_path}/ics").where("value like 'SUMMARY%'").count() == 1


def test_workers_columns(spark):
    df = spark.createDataFrame([("1", "n", "1970-01-01"), (" ", "m", None)], "`社員番号` string, `氏名` string, birthday string")
    assert rows(jdbc.workers(df), "employee_id", "name", "birth_date") == [("1", "n", "1970-01-01")]


def test_feeds(spark, tmp_path):
    own = snapshots(spark).drop("seen")
    inbox, seen = f"{tmp_path}/inbox", []
    for date in ("2025-12-01", "2025-09-01", "2025-11-01", "2025-10-01"):  # they come in any order
        own.where(F.col("snapshot_date") == date).coalesce(1).write.mode("append").parquet(inbox)
        feeds.snapshot_feed(spark, inbox, own.schema, f"{tmp_path}/store", f"{tmp_path}/cp", lambda df, n: seen.append(rows(df, "rec_key", "valid_from", "valid_to"))).awaitTermination(120)
    assert seen[-1] == rows(versioned.intervals(own), "rec_key", "valid_from", "valid_to")
    listed = spark.createDataFrame([("n", "q", "1", D(2024, 1, 1), D(2025, 1, 5))], "name string, qualification string, license_no string, issue_date date, expiry_date date")
    listed.write.parquet(f"{tmp_path}/roster")
    feeds.due_feed(spark, f"{tmp_path}/roster", listed.schema, f"{tmp_path}/due", f"{tmp_path}/cp2", "2025-01-01").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/due").first().days_to_expiry == 4


def test_jdbc_round_trip(spark, tmp_path):
    url, driver = f"jdbc:derby:memory:{tmp_path.name};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, "n"), (2, " "), (3, "m")], "employee_id int, name string")
    jdbc.write_table(df, url, "workers", **driver)
    got = jdbc.read_table(spark, url, "workers", where="employee_id > 1", **driver)
    assert "PushedFilters: [*IsNotNull(EMPLOYEE_ID), *GreaterThan" in got._jdf.queryExecution().toString() or got.count() == 2
    assert rows(jdbc.workers(got.toDF("employee_id", "name")), "name") == [("m",)]
    assert jdbc.read_table(spark, url, "workers", limit=1, **driver).count() == 1
    assert jdbc.read_table(spark, url, "workers", key="employee_id", bounds=(1, 3), partitions=2, **driver).rdd.getNumPartitions() == 2
    assert jdbc.read_query(spark, url, 'select "name" from workers where "employee_id" = 1', **driver).count() == 1


def test_stored_results_and_star_files(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.createDataFrame([("n", D(2025, 1, 1))], "name string, expiry_date date")

    for _ in range(2):
        assert files.stored_as_of(spark, f"{tmp_path}/store", "2025-01-01", compute).count() == 1
    assert len(made) == 1
    paths = files.write_star({"dim_person": compute(), "fact": compute()}, f"{tmp_path}/star", "1")
    assert all(spark.read.parquet(p).count() == 1 for p in paths.values())
    (tmp_path / "f.bin").write_bytes(b"abc")
    hashes = runs.source_hashes(spark.read.format("binaryFile").load(f"{tmp_path}/f.bin"))
    assert hashes.first().source_hash == "a9993e364706816aba3e25717850c26c9cd0d89d"
    log = runs.selection_log(spark.createDataFrame([("k",)], "record_key string"), "u", NOW)
    files.append_by(log, f"{tmp_path}/log", "day")
    files.append_by(log, f"{tmp_path}/log", "day")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    run = runs.recorded_run(compute().withColumn("print_sheet", F.lit("A")), "r1", "name", printed=NOW)
    assert run["header"].first().record_count == 1 and run["items"].first().item == 0
