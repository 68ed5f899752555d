"""State tables folded from change logs: nothing is updated in place, a new version is written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import clean
from rollbook.operators.identity import keep_first
from rollbook.operators.roster import sheet
from rollbook.sources import buckets

REPLACE, KEEP, INSERT_ONLY = "replace", "keep", "insert only"
#: How each state table's columns follow its log: replaced also by null, kept where the change has null, or set on insert only.
TABLES: Mapping[str, tuple[tuple[str, ...], Mapping[str, str]]] = {
    "person_filter": (("person_key",), {"include": REPLACE, "notes": KEEP}),
    "license_filter": (("license_key",), {"include": REPLACE, "notes": KEEP, "person_key": KEEP}),
    "sheet_filter": (("print_sheet",), {"include": REPLACE, "notes": KEEP}),
    "sheet_membership": (("license_key", "print_sheet"), {"include": REPLACE, "notes": REPLACE, "person_key": INSERT_ONLY}),
    "person_override": (("person_key",), {"display_name": REPLACE, "employee_id": REPLACE}),
    "report_definition": (("report_id",), {"label": REPLACE, "description": REPLACE, "created": INSERT_ONLY}),
    "report_entry": (("report_id", "license_key"), {"created": REPLACE}),
    "decision": (("name_key", "license_no"), {"status": REPLACE, "notes": REPLACE, "ts": REPLACE}),
}


def applied(state: DataFrame, log: DataFrame, keys: Sequence[str], rules: Mapping[str, str], deleted: str | None = None) -> DataFrame:
    """The state after a log (keys, columns, seq and, with `deleted`, a flag). The last change of each key counts for
    replaced columns and deletion, the last value that is not null for kept ones, and the first for insert-only ones.

    Changes are aggregated by key before they meet the state, so keys that change often are combined before the shuffle.
    """
    last = lambda c: F.max_by(c, F.col("seq"))  # noqa: E731 - of the last change, also where it has null
    seen = lambda c, f: f(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))
    pick = {REPLACE: last, KEEP: lambda c: seen(c, F.max_by), INSERT_ONLY: lambda c: seen(c, F.min_by)}
    gone = F.max_by(F.coalesce(F.col(deleted), F.lit(False)), F.col("seq")) if deleted else F.lit(False)
    new = log.groupBy(*keys).agg(*(pick[rule](c).alias(f"_{c}") for c, rule in rules.items()), gone.alias("_gone"), F.lit(True).alias("_new"))
    both = state.withColumn("_old", F.lit(True)).join(new, list(keys), "full").where(~F.coalesce("_gone", F.lit(False)))

    def value(c: str, rule: str):
        if rule == REPLACE:
            return F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
        return F.coalesce(f"_{c}", c) if rule == KEEP else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}"))

    return both.select(*keys, *(value(c, rule).alias(c) for c, rule in rules.items()))


def logged(spark: SparkSession, path: str, table: str, base: int | None, version: int, log: DataFrame, schema: T.StructType, deleted: str | None = None, count: int = buckets.BUCKETS) -> list[int]:
    """Writes a state table's next version after a log of changes, deletions among them; returns the buckets rewritten.

    Only the buckets that the log's keys lie in are read and written; the version before stays as it is. base None: the
    table is empty so far.
    """
    keys, rules = TABLES[table]
    return buckets.merged(spark, path, keys, base, version, log, schema, lambda rows, new: applied(rows, new, keys, rules, deleted), count)


def seeded(state: DataFrame, rows: DataFrame, keys: Sequence[str], **values: object) -> DataFrame:
    """The state and, for keys of rows that it does not have, new rows with default values; null keys seed nothing."""
    new = rows.select(*keys, *(c for c in rows.columns if c in state.columns and c not in keys)).dropna(subset=list(keys)).dropDuplicates(list(keys)).join(state.select(*keys), list(keys), "left_anti")
    return state.unionByName(new.withColumns({c: F.lit(v) for c, v in values.items()}), allowMissingColumns=True)


def refreshed_people(licences: DataFrame, rows: DataFrame) -> DataFrame:
    """Licence filters with the person that rows now name for the licence."""
    now = keep_first(rows.select("license_key", clean("person_key").alias("_person")).where("_person is not null"), ["license_key"], "_person")
    return licences.join(now, "license_key", "left").withColumn("person_key", F.coalesce("_person", "person_key")).drop("_person")


def without(state: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.join(deletes.select(*keys).distinct(), list(keys), "left_anti")


def sheets_deleted(sheets: DataFrame, membership: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sheets go with their memberships; the default sheet stays."""
    some = deletes.where(F.col("print_sheet") != "default")
    return without(sheets, some, ["print_sheet"]), without(membership, some, ["print_sheet"])


def checked(changes: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Changes whose required columns have values, and the rejected rest."""
    ok = F.lit(True)
    for c in required:
        ok = ok & clean(c).isNotNull()
    return changes.where(ok), changes.where(~ok)


def manual_rows(state: DataFrame, changes: DataFrame, update: bool = False) -> tuple[DataFrame, DataFrame]:
    """Manual rows after changes, by licence and name; and rejected changes (no name or licence; an update of no row).

    An update keeps old values where it has null; an addition replaces the whole row.
    """
    keys = ["license_no", "name"]
    good, bad = checked(changes, keys)
    good = good.withColumns({k: clean(k) for k in keys})
    if update:
        bad = bad.unionByName(good.join(state.select(*keys), keys, "left_anti"))
        good = good.join(state.select(*keys), keys, "left_semi")
    return applied(state, good, keys, {c: KEEP if update else REPLACE for c in state.columns if c not in keys}), bad


def report_entries_added(entries: DataFrame, changes: DataFrame, definitions: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries after changes, and changes whose report or licence does not exist."""
    known = changes.join(definitions.select("report_id").distinct(), "report_id", "left_semi").join(roster.select("license_key").distinct(), "license_key", "left_semi")
    bad = changes.join(known.select("report_id", "license_key").distinct(), ["report_id", "license_key"], "left_anti")
    keys, rules = TABLES["report_entry"]
    return applied(entries, known, keys, rules), bad


def report_listing(entries: DataFrame, roster: DataFrame, definitions: DataFrame, report_id: str | None = None) -> DataFrame:
    """Entries with their rows and labels, the newest first."""
    some = entries if report_id is None else entries.where(F.col("report_id") == report_id)
    out = some.join(roster.select("license_key", "name", "license_no", "qualification"), "license_key", "left").join(definitions.select("report_id", "label"), "report_id", "left")
    return out.orderBy(F.col("created").desc(), "report_id", "license_key")


def sheet_membership(roster: DataFrame, membership: DataFrame) -> DataFrame:
    """Sheets of the roster and of the membership table, the table's row where both have one, with the roster's person."""
    own = roster.select("license_key", sheet("print_sheet").alias("print_sheet"), "person_key", F.lit(True).alias("include"), F.lit(0).alias("_o"))
    both = own.unionByName(membership.select("license_key", sheet("print_sheet").alias("print_sheet"), "person_key", "include", F.lit(1).alias("_o")))
    last = keep_first(both, ["license_key", "print_sheet"], F.col("_o").desc(), "person_key").drop("_o")
    person = keep_first(roster.select("license_key", clean("person_key").alias("_p")).where("_p is not null"), ["license_key"], "_p")
    return last.join(person, "license_key", "left").withColumn("person_key", F.coalesce(clean("person_key"), "_p", F.lit(""))).drop("_p")


def known_sheets(roster: DataFrame, sheets: DataFrame) -> DataFrame:
    return roster.select(sheet("print_sheet").alias("print_sheet")).union(sheets.select(sheet("print_sheet"))).distinct()


def nearest(roster: DataFrame) -> DataFrame:
    """The row of each licence that was updated last."""
    return keep_first(roster, ["license_key"], F.col("last_updated").desc_nulls_last(), "row_seq")
