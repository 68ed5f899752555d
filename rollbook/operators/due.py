"""What expires when: missing expiry dates, notice stages, due lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.dates import DueConfig, add_years, due_columns, validity_years
from rollbook.functions.text import clean, ics_escape, license_key, name_key
from rollbook.operators.identity import keep_first
from rollbook.operators.issue import pages, searched
from rollbook.operators.roster import active_only


def missing_expiry(df: DataFrame, base: str, years: int) -> DataFrame:
    """expiry_date, where it is missing, as so many years after a base date."""
    return df.withColumn("expiry_date", F.coalesce("expiry_date", add_years(base, years)))


def expiry_by_rule(df: DataFrame, base: str) -> DataFrame:
    """expiry_date by the qualification's validity, only if the whole table has no expiry date."""
    known = df.agg(F.count("expiry_date").alias("_known"))  # one row
    ruled = df.crossJoin(F.broadcast(known)).withColumn("expiry_date", F.when(F.col("_known") == 0, add_years(base, validity_years("qualification"))).otherwise(F.col("expiry_date")))
    return ruled.drop("_known")


def guessed_dates(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Which date columns are first issue, issue and expiry: date-like ones (at least 3 values and 20 % of rows) by median.

    One aggregation; a row for each column comes to the driver.
    """
    if not columns:
        return {}
    long = df.select(*(F.col(c).cast("date").alias(c) for c in columns)).unpivot([], columns, "column", "day")
    rows = long.groupBy("column").agg(F.count("day").alias("n"), F.count("*").alias("rows"), F.percentile_approx(F.unix_date("day"), 0.5).alias("median")).collect()
    good = sorted((r.median, r.column) for r in rows if r.n >= max(3, 0.2 * r.rows))
    return {"first_issue_date": good[0][1], "issue_date": good[-1][1], "expiry_date": good[-1][1]} if good else {}


def annotated(df: DataFrame, as_of: Column | str, config: DueConfig = DueConfig(), expiry: str = "expiry_date") -> DataFrame:
    return df.withColumns(due_columns(expiry, as_of, config))


def due_list(df: DataFrame, as_of: Column | str, config: DueConfig = DueConfig()) -> DataFrame:
    """Rows within the window, by days and name."""
    return annotated(df, as_of, config).where("due_within_window").orderBy("days_to_expiry", "name")


def with_scanned(roster: DataFrame, scanned: DataFrame, by_name: bool = False, latest: bool = False, normal: bool = False) -> DataFrame:
    """Dates read from certificates win over the roster's, by licence key or else name key.

    A licence with several scanned expiries has a row for each, unless only the latest is wanted.
    """
    key = (lambda: name_key(clean("name"), normal)) if by_name else (lambda: license_key(clean("license_no"), normal))
    own = scanned.select(key().alias("_key"), F.col("issue_date").alias("_issue"), F.col("expiry_date").alias("_expiry")).where("_key is not null")
    own = keep_first(own, ["_key"], F.col("_expiry").desc_nulls_last(), F.col("_issue").desc_nulls_last()) if latest else own.distinct()
    out = roster.withColumn("_key", key()).join(own, "_key", "left")
    return out.withColumn("issue_date", F.coalesce("_issue", "issue_date")).withColumn("expiry_date", F.coalesce("_expiry", "expiry_date")).drop("_key", "_issue", "_expiry")


def due(roster: DataFrame, as_of: Column | str, config: DueConfig = DueConfig(), scanned: DataFrame | None = None, workers: DataFrame | None = None, base: str = "issue_date", normal: bool = False) -> DataFrame:
    """The due list of a roster; without an expiry column, of the scanned licences alone."""
    df = roster if "expiry_date" in roster.columns or scanned is None else scanned
    if "expiry_date" in roster.columns:
        df = expiry_by_rule(df, base)
        df = df if scanned is None else with_scanned(df, scanned, normal=normal)
    df = df if workers is None else active_only(df, workers, normal=normal)
    return due_list(df, as_of, config)


def stage_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("notice_stage").agg(F.count("*").alias("n"))


def report(roster: DataFrame, as_of: Column | str, born: DataFrame | None = None, config: DueConfig = DueConfig()) -> DataFrame:
    """Due rows with the person's birth year, display columns as text."""
    out = due_list(roster, as_of, config)
    if born is not None:
        small = keep_first(born.select("name", F.col("birth_year_west").cast("string").alias("_year")).where("_year is not null"), ["name"], "_year")
        out = out.join(small, "name", "left").withColumn("birth_year_west", F.coalesce(F.col("_year"), F.lit(""))).drop("_year")
    return out


def printed(roster: DataFrame, as_of: Column | str, born: DataFrame | None = None, workers: DataFrame | None = None, search: str | None = None, order: tuple[str, ...] = ("expiry_date", "name", "row_seq"), rows: int = 35, config: DueConfig = DueConfig(), normal: bool = False) -> DataFrame:
    """The report as it is printed: due rows of active workers, with a text in them, in order, `rows` to a page."""
    out = report(roster, as_of, born, config)
    out = out if workers is None else active_only(out, workers, normal=normal)
    out = out if not search else searched(out, search)
    return pages(out.withColumn("print_sheet", F.lit("")), *order, rows=rows).drop("print_sheet", "sheet_page", "sheet_total")


def calendar_lines(df: DataFrame, expiry: str = "expiry_date", summary: str = "{name} {license_no}") -> DataFrame:
    """One all-day event (text in column value) for each row with an expiry date; it ends on the day after, as the standard
    has it, and blocks no time."""
    text: list[Column] = []
    for i, part in enumerate(summary.replace("}", "{").split("{")):
        text.append(F.coalesce(F.col(part).cast("string"), F.lit("")) if i % 2 else F.lit(part))
    day = F.date_format(expiry, "yyyyMMdd")
    uid = F.sha1(F.concat_ws("-", "name", day, "license_no"))
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), day), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(expiry, 1), "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), ics_escape(F.concat(*text))), F.lit("TRANSP:TRANSPARENT"), F.lit("END:VEVENT")]
    return df.where(F.col(expiry).isNotNull()).select(F.concat_ws("\r\n", *lines).alias("value"))
