"""The star schema: one staging table, a fact and two dimensions, and the schedule that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.dates import any_date, window_bounds
from rollbook.functions.schema import worked_out
from rollbook.functions.text import clean, star_license_id, star_person_id
from rollbook.operators.identity import least_row

STAGE = ("row_no", "license_no", "qualification", "category", "registration_date", "continuation_code", "expiry_date", "name", "birth_date", "address", "employer", "certifier", "next_stage_label", "next_exam_period", "next_procedure_status", "web_publish_no")
MANDATORY = STAGE[:-1]


def staged(raw: DataFrame) -> DataFrame:
    """Typed staging rows with ids of person and licence and the exam window's bounds; raw has all mandatory columns."""
    missing = [c for c in MANDATORY if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    text = {c: clean(c) for c in STAGE if c in raw.columns}
    out = raw.select(*(v.alias(c) for c, v in text.items()))
    out = out.withColumns({c: any_date(c) for c in ("registration_date", "expiry_date", "birth_date")})
    out = out.withColumns({c: F.col(c).try_cast("int") for c in ("row_no", "continuation_code")})
    out = worked_out(out)
    start, end = window_bounds("next_exam_period")
    return out.withColumns({"window_start": start, "window_end": end, "person_id": star_person_id("name", "birth_date", "row_no"), "license_id": star_license_id("license_no", "row_no")})


def split(stage: DataFrame) -> dict[str, DataFrame]:
    """dim_person and dim_license with one row for each id, fact_qualification with every row.

    Each dimension is an aggregation that combines before its shuffle. Who writes all three tables caches the stage.
    """
    return {
        "dim_person": least_row(stage.select("person_id", "name", "birth_date", "address", "employer", "row_no"), ["person_id"], "row_no").drop("row_no"),
        "dim_license": least_row(stage.select("license_id", "license_no", "qualification", "category", "certifier", "row_no"), ["license_id"], "row_no").drop("row_no"),
        "fact_qualification": stage.select("row_no", "person_id", "license_id", "registration_date", "expiry_date", "continuation_code", "next_stage_label", "window_start", "window_end", "next_procedure_status"),
    }


def schedule(tables: dict[str, DataFrame], as_of: Column | str) -> DataFrame:
    """Facts with names and licences and the days left at as_of."""
    now = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("date")
    out = tables["fact_qualification"].join(tables["dim_person"].select("person_id", "name"), "person_id").join(tables["dim_license"].select("license_id", "license_no", "qualification"), "license_id")
    return out.withColumn("days_to_expiry", F.date_diff("expiry_date", now))
