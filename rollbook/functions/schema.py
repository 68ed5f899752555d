"""Declared columns, and what to do with those that are missing, doubled or empty."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import clean

KINDS = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "long": T.LongType()}


def struct(columns: str) -> T.StructType:
    """A schema from names and kinds; needs no session, as Spark's own parser does."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


ROSTER = struct(
    "name string, license_no string, qualification string, category string, registration_date date, first_issue_date date, "
    "issue_date date, expiry_date date, birth_date date, birth_year_west string, employee_id string, display_name string, "
    "continuation_status string, next_stage_label string, next_exam_period string, next_exam_window string, "
    "next_surveillance_window string, next_procedure_status string, address string, web_publish_no string, "
    "print_sheet string, source_sheet string, created timestamp, row_seq long")
SNAPSHOT = struct("name string, license_no string, qualification string, category string, first_issue_date date, issue_date date, expiry_date date")
LABELS = {
    # Headings of exported lists.
    "name": "氏名", "display_name": "表示名", "license_no": "登録番号", "qualification": "資格", "category": "区分", "registration_date": "登録年月日",
    "first_issue_date": "取得年月日", "issue_date": "交付年月日", "expiry_date": "有効期限", "birth_year_west": "生年(西暦)", "continuation_status": "継続",
    "next_stage_label": "次回区分", "next_exam_period": "次回受験期間", "print_sheet": "シート", "address": "住所", "web_publish_no": "WEB申込番号",
}


def worked_out(df: DataFrame) -> DataFrame:
    """df, with its columns made before anything that follows. Spark would put long expressions into each place that names
    their column, filters included, until the generated code is too long to be compiled; it does not move them past this."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def ensure_columns(df: DataFrame, schema: T.StructType, keep_others: bool = False) -> DataFrame:
    """The declared columns in their order and types, null where df has none; others only if wanted."""
    own = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*own, *(F.col(f"`{c}`") for c in df.columns if keep_others and c not in schema.names))


def defaults(df: DataFrame, **values: object) -> DataFrame:
    """Adds the columns that df does not have, with these values."""
    return df.withColumns({name: F.lit(value) for name, value in values.items() if name not in df.columns})


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def chosen_columns(available: Sequence[str], wanted: Sequence[str] | None, order: Sequence[str]) -> list[str]:
    """The columns asked for that there are; those with a place in `order` first, the others sorted after them."""
    some = [c for c in available if wanted is None or c in wanted]
    return [c for c in order if c in some] + sorted(c for c in some if c not in order)


def coalesce_doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df renamed to names; columns that then have one name become one, the first with a value from left to right."""
    by: dict[str, list[str]] = {}
    placed = df.toDF(*(f"_c{i}" for i in range(len(names))))
    for i, name in enumerate(names):
        by.setdefault(name, []).append(f"_c{i}")
    kinds = dict(placed.dtypes)
    value = lambda c: clean(c) if kinds[c] == "string" else F.col(c)
    return placed.select(*(F.col(cs[0]).alias(n) if len(cs) == 1 else F.coalesce(*map(value, cs)).alias(n) for n, cs in by.items()))


def text_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """These columns as text, blank for null."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names if c in df.columns})


def labelled(df: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if c in labels})


def snapshot_columns(df: DataFrame) -> DataFrame:
    """The seven columns of a snapshot, blank text as null; rows without name, licence and qualification go."""
    own = ensure_columns(df, SNAPSHOT)
    own = own.withColumns({f.name: clean(f.name) for f in SNAPSHOT.fields if isinstance(f.dataType, T.StringType)})
    return own.where(F.coalesce("name", "license_no", "qualification").isNotNull())


def serialised(df: DataFrame, date_columns: Sequence[str]) -> DataFrame:
    """Display text of every column, ISO dates, and is_manual."""
    out: list[Column] = [(F.date_format(c, "yyyy-MM-dd") if c in date_columns else F.col(c).cast("string")).alias(c) for c in df.columns]
    manual = (F.coalesce(F.col("source"), F.lit("")) == "manual").alias("is_manual") if "source" in df.columns else F.lit(False).alias("is_manual")
    return df.select(*out, manual).na.fill("", [c for c in df.columns])
