"""Sheets as cells: headers, vertical layouts and print areas over a table (source, sheet, row, col, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.dates import any_date, paren_year
from rollbook.functions.headers import DATE_COLUMNS, canonical_name, header_map
from rollbook.functions.schema import coalesce_doubles
from rollbook.functions.text import clean, position_columns, strip_whitespace
from rollbook.operators.due import missing_expiry
from rollbook.operators.ranges import ROWS_PER_RANGE, carried_down
from rollbook.sources.shared import stored

SHEET = ["source", "sheet"]
REGISTRATION = r"^(?:[A-Z]{1,2}\d{6,}|\d{1,6}(?:-\d{1,6})?)$"
DATE_LIKE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{2}[./]\d{1,2}[./]\d{1,2}|年.*[月日]"
HEADER_WORDS = "氏名|生年|備考|計画|資格"
PROBED_ROWS, LEAST_DENSITY = 10, 0.1


def filled(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", clean("value")).where("value is not null")


def header_rows(cells: DataFrame, tokens: DataFrame, first: int = 20, least: int = 2) -> DataFrame:
    """(source, sheet, header_row): the first of the first rows with enough known header tokens, else the first row not empty."""
    own = filled(cells)
    known = own.where(F.col("row") < first).join(tokens.select(F.col("token").alias("value")).distinct(), "value")
    good = known.groupBy(*SHEET, "row").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= least).groupBy(*SHEET).agg(F.min("row").alias("_good"))
    start = own.groupBy(*SHEET).agg(F.min("row").alias("_start"))
    return start.join(good, SHEET, "left").select(*SHEET, F.coalesce("_good", "_start").alias("header_row"))


def summary(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(source, sheet, rows, columns, headers) of each sheet."""
    own = filled(cells).join(headers, SHEET)
    head = F.collect_set(F.when(F.col("row") == F.col("header_row"), F.col("value")))
    return own.groupBy(*SHEET).agg(F.countDistinct(F.when(F.col("row") > F.col("header_row"), F.col("row"))).alias("rows"), F.countDistinct("col").alias("columns"), F.array_sort(head).alias("headers"))


def header_frequency(cells: DataFrame, headers: DataFrame, n: int = 50) -> DataFrame:
    own = filled(cells).join(headers, SHEET).where(F.col("row") == F.col("header_row"))
    return own.groupBy(F.col("value").alias("token")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(n)


def sheet_table(cells: DataFrame, columns: int, names: list[str] | None = None) -> DataFrame:
    """One sheet's cells as rows with columns c0, c1, ... (or names); empty rows go. columns: how many the sheet has."""
    wide = filled(cells).groupBy(*SHEET, "row").pivot("col", list(range(columns))).agg(F.first("value"))
    return wide.toDF(*SHEET, "row", *(names or [f"c{i}" for i in range(columns)]))


def canonical(df: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Canonical column names, doubled columns merged, dates typed; a year in parentheses of the expiry is issue_year.

    Headers that look like dates are no headers and become unnamed. Unknown columns stay.
    """
    known = known or header_map()
    names = [canonical_name(c, known) for c in df.columns]
    out = coalesce_doubles(df, names)
    if "expiry_date" in out.columns:
        out = out.withColumn("issue_year", paren_year("expiry_date"))
    return out.withColumns({c: any_date(c) for c in DATE_COLUMNS if c in out.columns})


def ingested(df: DataFrame, known: dict[str, str] | None = None, position_from: str = "qualification") -> DataFrame:
    """A sheet's rows as roster rows: canonical columns, positions, tidy text, ISO dates."""
    out = canonical(df, known)
    if position_from in out.columns:
        out = out.withColumns(position_columns(position_from))
    return normalised(out)


def normalised(df: DataFrame) -> DataFrame:
    """Text without stray white space, dates as ISO text."""
    return df.withColumns({c: strip_whitespace(c) if k == "string" else F.date_format(c, "yyyy-MM-dd") for c, k in df.dtypes if k in ("string", "date")})


def areas_marked(cells_or_rows: DataFrame, areas: DataFrame, keep_active_current: bool = False) -> DataFrame:
    """area: active for rows inside any print area of their sheet, else retired; history: 1 for rows whose first used
    column lies at or beyond the sheet's largest right edge. areas: sheet, r0, r1, c0, c1 (few for each sheet).

    Rows meet the areas of their own sheet only, which are collected into one array of bounded size beside them.
    """
    per = areas.groupBy("sheet").agg(F.collect_list(F.struct("r0", "r1")).alias("_areas"), F.max("c1").alias("_edge"))
    out = cells_or_rows.join(per, "sheet", "left")
    inside = F.coalesce(F.exists("_areas", lambda a: (F.col("row") >= a["r0"]) & (F.col("row") < a["r1"])), F.lit(False))
    out = out.withColumn("area", F.when(inside, "active").otherwise("retired")).withColumn("history", F.coalesce(F.col("first_col") >= F.col("_edge"), F.lit(False)).cast("int")).drop("_areas", "_edge")
    return out.where("area = 'active' and history = 0") if keep_active_current else out


def column_scores(cells: DataFrame, registration: str = REGISTRATION) -> DataFrame:
    """(source, sheet, col, density, registration, name): shares of rows, and of values that look like numbers or names.

    registration, here and below: the form of the sheets' registration numbers; by default those of the reference, whose
    numbers without letters have six digits at most. Sheets with longer ones need a form of their own.
    """
    own = filled(cells)
    rows = own.groupBy(*SHEET).agg(F.countDistinct("row").alias("_rows"))
    value = F.regexp_replace("value", r"(?U)\s", "")
    person = (~value.rlike(DATE_LIKE) & ~value.rlike(HEADER_WORDS) & ~value.rlike(registration) & ~value.rlike(r"^\(.*\)$") & (F.length("value") <= 20)).cast("int")
    score = own.groupBy(*SHEET, "col").agg(F.count("*").alias("_n"), F.avg(value.rlike(registration).cast("int")).alias("registration"), F.avg(person).alias("name"))
    return score.join(rows, SHEET).select(*SHEET, "col", (F.col("_n") / F.col("_rows")).alias("density"), "registration", "name")


def blocks(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """(source, sheet, person_col, number_col, first, last, label): dense ranges of columns right of the registration number.

    Scores, a row for each column, are written once for their readers; cells are worth storing by the caller.
    """
    scores = stored(scores, "scores")
    number = scores.groupBy(*SHEET).agg(F.max_by("col", F.struct("registration", -F.col("col"))).alias("number_col"))
    left = scores.join(number, SHEET)
    person = left.where("col < number_col").groupBy(*SHEET).agg(F.max_by("col", F.struct("name", -F.col("col"))).alias("person_col"))
    dense = left.where((F.col("col") > F.col("number_col")) & (F.col("density") >= LEAST_DENSITY))
    island = F.col("col") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("col"))
    ranges = dense.withColumn("_i", island).groupBy(*SHEET, "number_col", "_i").agg(F.min("col").alias("first"), F.max("col").alias("last")).join(person, SHEET)
    early = filled(cells).where(F.col("row") < 50).select(*SHEET, "col", F.lower("value").alias("v"))
    words = early.join(ranges, SHEET).where("col between first and last").groupBy(*SHEET, "first").agg(F.max(F.col("v").rlike("ボイラ|boiler|ﾎﾞｲﾗ")).alias("_boiler"), F.max(F.col("v").rlike("jis|ｊｉｓ")).alias("_jis"))
    label = F.when(F.col("_boiler"), "BOILER").when(F.col("_jis"), "JIS").otherwise("BLOCK")
    return ranges.join(words, [*SHEET, "first"], "left").select(*SHEET, "person_col", "number_col", "first", "last", label.alias("label"))


def carried(cells: DataFrame, person: int, number: int, rows_per_range: int = ROWS_PER_RANGE, registration: str = REGISTRATION) -> DataFrame:
    """(source, sheet, row, name, registration): both carried down from the row where a registration number stands.

    A name on that row counts unless it is a header; else the earlier one goes on. Values go on from range to range, so a
    sheet may have any number of rows.
    """
    own = filled(cells)
    at = lambda col: F.max(F.when(F.col("col") == col, F.col("value")))
    wide = own.groupBy(*SHEET, "row").agg(at(person).alias("p"), F.regexp_replace(at(number), r"(?U)\s", "").alias("n"))
    start = F.col("n").rlike(registration)
    name = F.when(start & ~F.col("p").rlike(HEADER_WORDS), F.col("p"))
    found = wide.select(*SHEET, "row", name.alias("name"), F.when(start, F.col("n")).alias("registration"))
    return carried_down(found, SHEET, ["row"], ["name", "registration"], rows_per_range)


def assigned_dates(days: Column, label: Column) -> dict[str, Column]:
    """first_issue_date, issue_date and expiry_date from a block's distinct sorted days, by how many there are."""
    n = F.size(days)
    at = lambda i: F.try_element_at(days, F.lit(i))
    one = F.when((n == 1) & (label == "JIS"), F.add_months(at(1), 12))
    return {"first_issue_date": F.when(n >= 2, at(1)), "issue_date": F.when(n >= 3, at(-2)).when(n == 1, at(1)), "expiry_date": F.when(n >= 2, at(-1)).otherwise(one)}


def vertical_records(cells: DataFrame, found: DataFrame, person: int, number: int, registration: str = REGISTRATION) -> DataFrame:
    """One record for each row and block with any value: name, registration, raw values (a map), dates, qualification, licence."""
    cells, found = stored(cells, "cells"), stored(found, "blocks")
    who = carried(cells, person, number, registration=registration).where("name is not null and registration is not null")
    own = filled(cells).join(found, SHEET).where("col between first and last")
    own = own.withColumn("head", F.when(F.col("value").rlike(DATE_LIKE), F.regexp_extract("value", r"^([^(（]*)", 1)))
    own = own.withColumn("day", F.when(F.col("head").isNotNull(), any_date("head"))).withColumn("place", F.col("col") - F.col("first"))
    text = F.when(F.col("day").isNull() & ~F.col("value").rlike(DATE_LIKE) & ~F.col("value").rlike(HEADER_WORDS), F.col("value"))
    rows = own.groupBy(*SHEET, "row", "first", "label").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("c"), "place").alias("key"), "value")))).alias("values"),
        F.array_sort(F.collect_set("day")).alias("days"), F.max_by(text, F.when(text.isNotNull(), F.struct(F.length(text).alias("n"), (-F.col("place")).alias("p")))).alias("qualification"),
        F.max(paren_year("value")).alias("issue_year"))
    rows = rows.withColumns(assigned_dates(F.col("days"), F.col("label"))).join(who, [*SHEET, "row"])
    pick = lambda k: F.when(F.regexp_replace(F.try_element_at("values", F.lit(k)), r"(?U)\s", "").rlike(registration), F.regexp_replace(F.try_element_at("values", F.lit(k)), r"(?U)\s", ""))
    rows = rows.withColumn("license_no", F.coalesce(*(pick(k) for k in ("c1", "c2", "c0", "c3")), "registration"))
    rows = rows.withColumn("sequence", F.when(F.col("license_no") != F.col("registration"), F.col("registration")))
    return rows.select(*SHEET, "row", "first", "label", "name", "registration", "license_no", "sequence", "qualification", "first_issue_date", "issue_date", "expiry_date", "issue_year", "values")


def column_number(letters: str) -> int:
    """The number, from 0, of a column that is named by letters."""
    text = letters.strip().upper()
    if not text or not all("A" <= x <= "Z" for x in text):
        raise ValueError(f"{letters!r} names no column")
    return reduce(lambda n, x: 26 * n + ord(x) - ord("A") + 1, text, 0) - 1


def column_range(text: str) -> tuple[int, int]:
    """First and last column of 'C:H', in either order, or of 'C'."""
    first, _, last = text.partition(":")
    a, b = column_number(first), column_number(last or first)
    return min(a, b), max(a, b)


def column_letters(c: Column | str) -> Column:
    """The letters that name a column by its number, up to three of them."""
    n = F.col(c) if isinstance(c, str) else c
    letter = lambda x: F.char(F.lit(ord("A")) + F.pmod(x, F.lit(26)))
    return F.concat(F.when(n >= 702, letter(F.floor((n - 702) / 676))).otherwise(""), F.when(n >= 26, letter(F.floor((n - 26) / 26))).otherwise(""), letter(n))


def in_columns(cells: DataFrame, text: str) -> DataFrame:
    """The cells in a range of columns such as 'C:H'."""
    first, last = column_range(text)
    return cells.where(F.col("col").between(first, last))


def ingest(rows: DataFrame, areas: DataFrame | None = None, known: dict[str, str] | None = None, years: int | None = None, base: str = "issue_date") -> DataFrame:
    """A sheet's rows (with its own headers; sheet, row and first_col too if areas are given) as roster rows: canonical
    columns, of print areas only the active and current rows, positions, missing expiry dates by years, tidy text and days."""
    place = ["sheet", "row", "first_col"] if areas is not None else []
    out = canonical(rows, known)
    if areas is not None:
        out = areas_marked(out, areas, keep_active_current=True).drop("area", "history")
    if "qualification" in out.columns:
        out = out.withColumns(position_columns("qualification"))
    if years is not None and "expiry_date" in out.columns:
        out = missing_expiry(out, base, years)
    return normalised(out.drop(*place))


def ingest_vertical(cells: DataFrame, person: int, number: int, columns: str | None = None, areas: DataFrame | None = None, tables: DataFrame | None = None, registration: str = REGISTRATION) -> DataFrame:
    """Sheets in blocks as roster rows: records of the blocks found (in a range of columns, if one is given), those in active
    print areas, with positions and raw values as JSON; then the rows of ingested tables."""
    some = cells if columns is None else cells.where(F.col("col").isin(person, number)).unionByName(in_columns(cells.where(~F.col("col").isin(person, number)), columns))
    some = stored(some, "cells")
    out = vertical_records(some, blocks(column_scores(some, registration), some), person, number, registration)
    if areas is not None:
        out = areas_marked(out.withColumn("first_col", F.lit(person)), areas, keep_active_current=True).drop("area", "history", "first_col")
    out = raw_json(out.withColumns(position_columns("qualification")))
    return normalised(out if tables is None else out.unionByName(tables, allowMissingColumns=True))


def raw_json(records: DataFrame) -> DataFrame:
    return records.withColumn("values", F.to_json("values"))
