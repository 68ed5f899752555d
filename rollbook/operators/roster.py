"""The current roster: one best row for each licence, with what its other rows know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.schema import ROSTER, ensure_columns, worked_out
from rollbook.functions.text import clean, either, name_key, whole_number
from rollbook.operators.identity import attach_keys, fill_names, keep_first, least_row

# The columns that other rows of a licence fill, and of these the ones in which ingested rows win.
FALLBACK = ("registration_date", "first_issue_date", "issue_date", "expiry_date", "qualification", "category", "continuation_status", "next_stage_label", "next_exam_period", "next_exam_window", "next_surveillance_window", "next_procedure_status", "name", "display_name", "employee_id", "birth_year_west", "birth_date", "address", "web_publish_no", "last_updated")
INGEST_WINS = ("next_surveillance_window", "next_exam_period", "birth_date", "address", "web_publish_no", "birth_year_west")
DEFAULT_SHEET = "default"
KINDS = {f.name: f.dataType.simpleString() for f in ROSTER.fields}


def value(c: str) -> Column:
    """A column's value, null where a text means none."""
    return clean(c) if KINDS.get(c) == "string" else F.col(c)


def sheet(c: Column | str) -> Column:
    return F.coalesce(clean(c), F.lit(DEFAULT_SHEET))


def effective_date(now: Column) -> Column:
    return F.coalesce(*(F.col(c).cast("timestamp") for c in ("registration_date", "issue_date", "expiry_date", "first_issue_date", "last_updated")), now)


def precedence() -> Column:
    """What orders the rows of a licence, least first: ingest before others before manual, then the latest effective date,
    the latest update, and the rows' own order."""
    rank = F.when(F.col("source") == "ingest", 0).when(F.col("source") == "manual", 2).otherwise(1)
    return F.struct(rank.alias("rank"), (-F.unix_micros("effective")).alias("effective"), (-F.unix_micros("last_updated")).alias("updated"), F.col("row_seq").alias("row_seq"))


def sources(ingest: DataFrame, manual: DataFrame, workers: DataFrame | None, now: str, normal: bool) -> DataFrame:
    """Both inputs, with names filled, sheets defaulted, keys, a source tag and the dates that order them."""
    parts = []
    for df, tag in ((ingest, "ingest"), (manual, "manual")):
        own = fill_names(ensure_columns(df, ROSTER), workers, seed=tag)
        parts.append(own.withColumn("print_sheet", sheet("print_sheet")).withColumn("source_sheet", F.coalesce(clean("source_sheet"), F.lit(""))).withColumn("source", F.lit(tag)))
    both = attach_keys(parts[0].unionByName(parts[1], allowMissingColumns=True), normal)
    both = both.withColumn("last_updated", F.coalesce("created", F.lit(now).cast("timestamp")))
    return both.withColumn("effective", effective_date(F.lit(now).cast("timestamp")))


def merged(both: DataFrame) -> DataFrame:
    """The best row of each licence, with what its other rows know.

    One aggregation by licence: the least row, and for each column the value of the least row that has one. It combines
    before its shuffle, so what is shuffled is one row for each licence and task, however many rows a licence has.
    """
    tidy = {c: value(c).alias(f"_v_{c}") for c in FALLBACK if KINDS.get(c) == "string"}
    own = worked_out(both.select("*", precedence().alias("_order"), *tidy.values()))
    known = lambda c: F.col(f"_v_{c}") if c in tidy else F.col(c)

    def first(v: Column, some: Column) -> Column:
        return F.min_by(v, F.when(some & v.isNotNull(), F.col("_order")))

    every, ingest, by_hand = F.lit(True), F.col("source") == "ingest", F.col("source") == "manual"
    columns = [c for c in both.columns if c != "license_key"]
    best = own.groupBy("license_key").agg(
        F.min_by(F.struct(*columns), "_order").alias("_best"),
        *(first(known(c), every).alias(f"_any_{c}") for c in FALLBACK), *(first(known(c), ingest).alias(f"_in_{c}") for c in INGEST_WINS),
        *(first(F.col(c), by_hand & clean(c).isNotNull()).alias(f"_hand_{c}") for c in ("print_sheet", "source_sheet")))
    filled = {c: F.coalesce(f"_in_{c}", f"_any_{c}") if c in INGEST_WINS else F.col(f"_any_{c}") for c in FALLBACK}
    filled |= {c: F.coalesce(f"_hand_{c}", f"_best.{c}") for c in ("print_sheet", "source_sheet")}
    out = best.select("license_key", *(filled.get(c, F.col(f"_best.{c}")).alias(c) for c in columns if c != "effective"), F.when(F.col("_hand_print_sheet").isNotNull(), "manual").otherwise("auto").alias("sheet_source"))
    return out.select(*(c for c in both.columns if c != "effective"), "sheet_source")


def with_windows(df: DataFrame) -> DataFrame:
    """next_surveillance_window from the exam window or period, and the period from it; blank where none is known."""
    out = df.withColumn("next_surveillance_window", F.coalesce(either("next_surveillance_window", "next_exam_window", "next_exam_period"), F.lit("")))
    out = out.withColumn("next_exam_period", F.coalesce(clean("next_exam_period"), F.col("next_surveillance_window")))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("address", "web_publish_no")})


def with_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides (person_key, display_name, employee_id) replace name and employee_id where they are not blank."""
    small = keep_first(overrides.select("person_key", clean("display_name").alias("_name"), clean("employee_id").alias("_id")), ["person_key"], "_name", "_id")
    out = df.join(small, "person_key", "left").withColumn("name", F.coalesce("_name", "name")).withColumn("employee_id", F.coalesce("_id", "employee_id"))
    return out.drop("_name", "_id")


def current_roster(ingest: DataFrame, manual: DataFrame, now: str, workers: DataFrame | None = None, overrides: DataFrame | None = None, normal: bool = False) -> DataFrame:
    """One row for each licence key. now: the time that rows without any date count as."""
    out = with_windows(merged(sources(ingest, manual, workers, now, normal)))
    out = out.withColumn("display_name", F.coalesce(clean("display_name"), "name"))
    return out if overrides is None else with_overrides(out, overrides)


def sheet_pairs(both: DataFrame) -> DataFrame:
    """(license_key, print_sheet, person_key): every sheet on which a licence stands, before rows are merged."""
    return least_row(both.select("license_key", "print_sheet", "person_key", "row_seq"), ["license_key", "print_sheet"], "row_seq").drop("row_seq")


def with_report_ids(roster: DataFrame, entries: DataFrame) -> DataFrame:
    ids = entries.groupBy("license_key").agg(F.array_sort(F.collect_set("report_id")).alias("report_ids"))
    return roster.join(ids, "license_key", "left").withColumn("report_ids", F.coalesce("report_ids", F.array().cast("array<string>")))


def sorted_by(df: DataFrame, by: Sequence[tuple[str, bool]] = (("name", True), ("license_no", True), ("qualification", True))) -> DataFrame:
    """Stable order by (column, ascending) pairs; nulls last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in by), "row_seq")


def qualifications(roster: DataFrame, entries: DataFrame, by: Sequence[tuple[str, bool]] = (("name", True), ("license_no", True), ("qualification", True))) -> DataFrame:
    """The roster as users list it: report ids, fallbacks of exam windows, and their sort order."""
    return sorted_by(with_report_ids(with_windows(roster), entries), by)


def enriched(roster: DataFrame, workers: DataFrame, by_name: bool = False, normal: bool = False) -> DataFrame:
    """Birth date and year from the workers' master data, by employee id, or by name key."""
    key = (lambda: name_key(clean("name"), normal)) if by_name else (lambda: whole_number("employee_id"))
    born = workers.select(key().alias("_key"), F.col("birth_date").cast("date").alias("_born")).where("_key is not null")
    born = keep_first(born, ["_key"], F.col("_born").asc_nulls_last())
    out = roster.withColumn("_key", key()).join(born, "_key", "left")
    own = F.col("birth_date").cast("date") if "birth_date" in roster.columns else F.lit(None).cast("date")
    out = out.withColumn("birth_date", F.coalesce(own, "_born"))
    return out.withColumn("birth_year_west", F.year("birth_date").cast("string")).drop("_key", "_born")


def active_only(df: DataFrame, workers: DataFrame, by_name: bool = False, normal: bool = False) -> DataFrame:
    """The rows of people who are among the workers."""
    key = name_key(clean("name"), normal) if by_name else whole_number("employee_id")
    return df.withColumn("_key", key).join(workers.select(key.alias("_key")).where("_key is not null").distinct(), "_key", "left_semi").drop("_key")


def with_decisions(roster: DataFrame, decisions: DataFrame, normal: bool = False) -> DataFrame:
    """decisions (name_key, license_no, status, notes) onto the roster; a decision without licence has ''."""
    keyed = roster.withColumn("name_key", name_key(clean("name"), normal)).withColumn("_licence", F.coalesce(clean("license_no"), F.lit("")))
    small = decisions.select("name_key", F.col("license_no").alias("_licence"), "status", "notes")
    return keyed.join(small, ["name_key", "_licence"], "left").drop("_licence")


def reimported(new: DataFrame, previous: DataFrame) -> DataFrame:
    """New rows with their blanks filled from the previous roster's row of the same licence; the default sheet is a blank."""
    blank = lambda c: F.when(value(c) != DEFAULT_SHEET, value(c)) if c == "print_sheet" else value(c)
    shared = [c for c in new.columns if c in previous.columns and c not in ("license_key", "row_seq")]
    old = keep_first(previous, ["license_key"], F.col("created").desc_nulls_last() if "created" in previous.columns else F.lit(1), "row_seq").select("license_key", *(value(c).alias(f"_old_{c}") for c in shared))
    out = new.join(old, "license_key", "left")
    fill = lambda c: F.coalesce(blank(c), F.col(f"_old_{c}"), F.col(c))
    return out.withColumns({c: fill(c) for c in shared}).drop(*(f"_old_{c}" for c in shared))


def manual_defaults(asked: DataFrame, current: DataFrame, raw: DataFrame) -> DataFrame:
    """For each licence asked for, the values that a new manual entry starts from: the current roster's row (manual first,
    then the newest), else the raw roster's."""
    columns = [c for c in current.columns if c in raw.columns and c not in ("license_key", "row_seq", "source", "created")]
    known = current.select("license_key", *columns, (F.col("source") != "manual").cast("int").alias("_a"), F.lit(0).alias("_b"), F.col("created").alias("_c"), "row_seq")
    known = known.unionByName(raw.select("license_key", *columns, F.lit(0).alias("_a"), F.lit(1).alias("_b"), F.col("created").alias("_c"), "row_seq"))
    best = keep_first(known.join(asked.select("license_key").distinct(), "license_key", "left_semi"), ["license_key"], "_b", "_a", F.col("_c").desc_nulls_last(), "row_seq")
    return asked.select("license_key").join(best.drop("_a", "_b", "_c", "row_seq"), "license_key", "left")


def people(roster: DataFrame, search: str | None = None, active: DataFrame | None = None, normal: bool = False) -> DataFrame:
    """(name, licences), optionally of active workers only and of names with a text in them."""
    some = roster if active is None else active_only(roster, active, normal=normal)
    some = some if search is None else some.where(F.col("name").contains(search))
    return some.groupBy("name").agg(F.count("*").alias("licences"))


def person_view(roster: DataFrame, manual: DataFrame, name: str) -> DataFrame:
    """A person's rows from both tables, the latest expiry and issue first."""
    both = roster.unionByName(manual, allowMissingColumns=True).where(F.col("name") == name)
    return both.orderBy(F.col("expiry_date").desc_nulls_last(), F.col("issue_date").desc_nulls_last())


def review(roster: DataFrame, manual: DataFrame, decisions: DataFrame, name: str, workers: DataFrame | None = None, normal: bool = False) -> DataFrame:
    """A person's rows from both tables with what was decided about each, of active workers only if they are given."""
    own = roster if workers is None else active_only(roster, workers, normal=normal)
    both = own.unionByName(manual, allowMissingColumns=True).where(F.col("name") == name)
    return with_decisions(both, decisions, normal).orderBy(F.col("expiry_date").desc_nulls_last(), F.col("issue_date").desc_nulls_last())


def with_departments(df: DataFrame, workers: DataFrame) -> DataFrame:
    """department by name, the first of each name."""
    small = keep_first(workers.select("name", "department").where(clean("department").isNotNull()), ["name"], "department")
    return df.join(small, "name", "left")
