"""Issue lists: who and what is included, on which sheets, in which order, on which pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.schema import chosen_columns
from rollbook.functions.text import clean, either
from rollbook.operators.identity import keep_first
from rollbook.operators.ranges import ROWS_PER_RANGE, ranked
from rollbook.operators.roster import sheet
from rollbook.sources.shared import stored

# What a continuation code stands for.
CONTINUATION = {"0": "新規", "1": "継続", "2": "再試験"}
# Headers that the list renames, and the words of the one that holds two windows.
RENAMED = {"次回区分": "next_stage_label", "次回手続状況": "next_procedure_status"}
COMBINED = ("次回受検期間", "再試験猶予")
ROWS_PER_PAGE, PREVIEW_PAGES, EVERY_SHEET = 40, 12, "all"
CONTEXT = ("rows", "digests", "sheets", "reports")


def on_sheet(df: DataFrame, name: str | None) -> DataFrame:
    """The rows of one sheet; of all for none, a blank or the word for all."""
    return df if name is None or name.strip().lower() in ("", EVERY_SHEET) else df.where(F.col("print_sheet") == name)


def searched(df: DataFrame, text: str) -> DataFrame:
    """Rows with a text in name, licence or qualification, in any case; the text is no pattern."""
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return df.where(has("name") | has("license_no") | has("qualification"))


def selected(df: DataFrame, names: list[str] | None = None, kinds: list[str] | None = None, text: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows chosen by person or else by qualification; with neither, rows that have a name. text and record keys narrow it."""
    if names:
        out = df.where(F.col("name").isin(names))
    elif kinds:
        out = df.where(F.col("qualification").isin(kinds))
    else:
        out = df.where(clean("name").isNotNull())
    out = out if not text else out.where(F.coalesce("qualification", F.lit("")).contains(text))
    return out if not keys else out.where(F.col("record_key").isin(keys))


def continuation(code: Column, text: Column) -> Column:
    """The code's meaning, else the text."""
    meaning = F.try_element_at(F.create_map(*[F.lit(x) for pair in CONTINUATION.items() for x in pair]), F.regexp_replace(clean(code), r"\.0$", ""))
    return F.coalesce(meaning, clean(text))


def included(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(True))


def filtered(due: DataFrame, people: DataFrame, licences: DataFrame, sheets: DataFrame, membership: DataFrame) -> DataFrame:
    """Due rows that no flag excludes: of the person, the licence, the sheet, or the licence on the sheet. No flag is true.

    The state tables have one row for each key; Spark broadcasts those that are small when it runs.
    """
    out = due.join(people.select("person_key", F.col("include").alias("_p")), "person_key", "left")
    out = out.join(licences.select("license_key", F.col("include").alias("_l")), "license_key", "left")
    out = out.join(sheets.select("print_sheet", F.col("include").alias("_s")), "print_sheet", "left")
    out = out.join(membership.select("license_key", "print_sheet", F.col("include").alias("_m")), ["license_key", "print_sheet"], "left")
    return out.where(included("_p") & included("_l") & included("_s") & included("_m")).drop("_p", "_l", "_s", "_m")


def expanded(due: DataFrame, membership: DataFrame) -> DataFrame:
    """One row for each sheet that a licence is a member of; a licence without membership keeps its own sheet."""
    member = membership.where(included("include") & clean("license_key").isNotNull()).select("license_key", sheet("print_sheet").alias("_sheet")).distinct()
    out = due.join(member, "license_key", "left").withColumn("print_sheet", F.coalesce("_sheet", sheet("print_sheet"))).drop("_sheet")
    return keep_first(out, ["license_key", "print_sheet", "person_key", "license_no", "qualification"], "row_seq")


def member_sheets(membership: DataFrame) -> DataFrame:
    """(license_key, sheets) in first-seen order; membership has row_seq."""
    first = keep_first(membership.select("license_key", sheet("print_sheet").alias("print_sheet"), "row_seq"), ["license_key", "print_sheet"], "row_seq")
    lists = first.groupBy("license_key").agg(F.array_sort(F.collect_list(F.struct("row_seq", "print_sheet"))).alias("l"))
    return lists.select("license_key", F.col("l.print_sheet").alias("sheets"))


def renamed(df: DataFrame) -> DataFrame:
    """Columns under their own names; a column for both the exam window and the time of grace fills both. An exam window
    stands for the surveillance window where there is none."""
    out = df.withColumnsRenamed({c: name for c, name in RENAMED.items() if c in df.columns and name not in df.columns})
    if "next_exam_window" in out.columns and "next_surveillance_window" not in out.columns:
        out = out.withColumnRenamed("next_exam_window", "next_surveillance_window")
    both = next((c for c in out.columns if all(word in c for word in COMBINED)), None)
    if both is None:
        return out
    window = F.coalesce(F.col(f"`{both}`").cast("string"), F.lit(""))
    return out.withColumns({"next_surveillance_window": window, "retest_window": window}).drop(both)


def context(due: DataFrame, people: DataFrame, licences: DataFrame, sheets: DataFrame, membership: DataFrame, definitions: DataFrame | None = None, name: str | None = None, wanted: list[str] | None = None, rows: int = 40, parts: tuple[str, ...] = CONTEXT) -> dict[str, DataFrame]:
    """What the list's page shows: the chosen columns of one sheet's rows by page, pages' digests, rows on each sheet, and
    members of each report; or some of these parts. The list is put into pages, and so written, only for rows and digests."""
    listed, out = issued(due, people, licences, sheets, membership), {}
    if "rows" in parts or "digests" in parts:
        shown = pages(on_sheet(listed, name), "expiry_date", "name", "row_seq", rows=rows)
        columns = chosen_columns(listed.columns, wanted, ("name", "license_no", "qualification", "category", "expiry_date"))
        keep = ["page", "sheet_page", "sheet_total", "total_pages", "print_sheet", "row_seq"]
        out |= {"rows": shown.select(*keep, *(c for c in columns if c not in keep)), "digests": page_digests(shown, columns)}
    if "sheets" in parts:
        out["sheets"] = sheet_counts(listed, membership)
    if "reports" in parts and definitions is not None and "report_ids" in listed.columns:
        out["reports"] = report_counts(listed, definitions)
    return out


def issue_rows(due: DataFrame) -> DataFrame:
    """The list's columns: continuation text, exam windows and display names filled, sheets defaulted."""
    due = renamed(due)
    code = F.col("continuation_code") if "continuation_code" in due.columns else F.lit(None).cast("string")
    out = due.withColumn("category", F.coalesce(clean("category"), continuation(code, F.col("continuation_status"))))
    out = out.withColumn("next_surveillance_window", F.coalesce(either("next_surveillance_window", "next_exam_window", "next_exam_period"), F.lit("")))
    out = out.withColumn("next_exam_period", F.coalesce(either("next_exam_period", "next_surveillance_window"), F.lit("")))
    return out.withColumn("display_name", F.coalesce(clean("display_name"), "name")).withColumn("print_sheet", sheet("print_sheet"))


def issued(due: DataFrame, people: DataFrame, licences: DataFrame, sheets: DataFrame, membership: DataFrame) -> DataFrame:
    """Expanded and filtered, in no order."""
    return filtered(expanded(issue_rows(due), membership), people, licences, sheets, membership)


def issue_list(due: DataFrame, people: DataFrame, licences: DataFrame, sheets: DataFrame, membership: DataFrame) -> DataFrame:
    """Expanded, filtered and in order of sheet, expiry and name."""
    out = issued(due, people, licences, sheets, membership)
    return out.orderBy("print_sheet", "expiry_date", "name", "row_seq")


def pages(df: DataFrame, *order: str, rows: int = ROWS_PER_PAGE, most: int | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """page (over all), sheet_page, sheet_total and total_pages of each row; sheets in order, rows of a sheet by `order`.

    A row's number in its sheet comes range by range, so a sheet may have any number of rows; pages before a sheet come from
    one row for each sheet. With `most`, only so many pages are given, while total_pages counts all.
    """
    rows = ROWS_PER_PAGE if rows <= 0 else rows
    own = stored(df.withColumn("print_sheet", sheet("print_sheet")), "pages")
    totals = own.groupBy("print_sheet").agg(F.ceil(F.count("*") / rows).alias("sheet_total"))
    before = Window.orderBy("print_sheet").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.withColumn("_before", F.coalesce(F.sum("sheet_total").over(before), F.lit(0))).withColumn("total_pages", F.sum("sheet_total").over(everything))
    placed = ranked(own, ["print_sheet"], list(order), rows_per_range).withColumn("sheet_page", F.ceil(F.col("place") / rows)).drop("place", "total")
    out = placed.join(totals, "print_sheet").withColumn("page", F.col("_before") + F.col("sheet_page")).drop("_before")
    return out if most is None else out.where(F.col("page") <= most)


def sheet_totals(df: DataFrame, rows: int = ROWS_PER_PAGE) -> DataFrame:
    return df.groupBy(sheet("print_sheet").alias("print_sheet")).agg(F.ceil(F.count("*") / rows).alias("pages"), F.count("*").alias("rows"))


def sheet_counts(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows on each sheet; known sheets without rows have 0."""
    counts = df.groupBy(sheet("print_sheet").alias("print_sheet")).agg(F.count("*").alias("n"))
    if known is None:
        return counts
    return known.select("print_sheet").distinct().join(counts, "print_sheet", "full").withColumn("n", F.coalesce("n", F.lit(0)))


def report_counts(roster: DataFrame, definitions: DataFrame) -> DataFrame:
    """(report_id, label, n) of defined reports, and of undefined ones that rows name, whose label is their id."""
    counts = roster.select(F.explode("report_ids").alias("report_id")).groupBy("report_id").agg(F.count("*").alias("n"))
    out = definitions.select("report_id", "label").join(counts, "report_id", "full")
    return out.select("report_id", F.coalesce(clean("label"), "report_id").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("source") == "manual").alias("manual"))


def page_digests(paged: DataFrame, columns: list[str]) -> DataFrame:
    """(page, digest) of the rows of each page, as text of sorted columns in the page's order."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    rows = paged.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row_seq", text.alias("t")))).alias("l"))  # a page is a bounded group
    return rows.select("page", F.sha2(F.array_join("l.t", "\n"), 256).alias("digest"))


def samples(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows of each group, the first in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")
