"""Who a row is about: keys, names and ids with their fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.schema import worked_out
from rollbook.functions.text import clean, clean_name, person_key, row_license_key, whole_number


def attach_keys(df: DataFrame, normal: bool = False) -> DataFrame:
    """Adds person_key and license_key. normal: identity texts are ASCII, so that no NFKC pass through Python is needed."""
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    out = worked_out(df.withColumn("person_key", person_key(c("name"), c("employee_id"), c("license_no"), c("qualification"), c("expiry_date"), normal)))
    return out.withColumn("license_key", row_license_key(c("license_no"), F.col("person_key"), c("qualification"), c("expiry_date"), c("issue_date"), normal))


def keep_first(df: DataFrame, keys: list[str], *order: object) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", first).where("_first = 1").drop("_first")


def least_row(df: DataFrame, keys: list[str], *order: object) -> DataFrame:
    """One row for each key, that with the least of order (ascending, nulls first). Rows combine before the shuffle, so
    a key with very many rows weighs no more there than any other."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def name_columns(df: DataFrame, allowed: tuple[str, ...] = (), least_values: int = 20) -> list[str]:
    """Text columns whose values look like names: many different ones, few digits and hyphens, mostly letters.

    One pass over the table; only the profile, a row for each column, comes to the driver.
    """
    candidates = [c for c, kind in df.dtypes if kind == "string" and c not in allowed]
    found = [c for c in allowed if c in df.columns]
    if not candidates:
        return found
    value = clean("value")
    profile = df.select(*(F.col(f"`{c}`") for c in candidates)).unpivot([], candidates, "column", "value").withColumn("value", value).where("value is not null")
    share = lambda pattern: F.avg(F.col("value").rlike(pattern).cast("int"))
    rows = profile.groupBy("column").agg(F.countDistinct("value").alias("n"), share(r"\p{Nd}").alias("digit"), share("-").alias("hyphen"), share(r"\p{L}").alias("letter")).collect()
    good = {r.column for r in rows if r.n >= least_values and r.digit <= 0.1 and r.hyphen <= 0.2 and r.letter >= 0.7}
    return found + [c for c in candidates if c in good]


def fill_names(df: DataFrame, workers: DataFrame | None = None, names: tuple[str, ...] = ("name",), seed: str = "unknown", fallback_id: str | None = None) -> DataFrame:
    """employee_id and name, filled: a clean name of the row; the worker's; the first of the same licence, then of the same
    employee; then a placeholder of licence, id, or seed and row. Needs row_seq, which orders the rows."""
    ids = [whole_number(c) for c in ("employee_id", fallback_id) if c in df.columns]
    out = df.withColumn("employee_id", F.coalesce(*ids) if ids else F.lit(None).cast("string"))
    own = F.coalesce(*(clean_name(c) for c in names if c in df.columns))
    out = worked_out(out.withColumn("_name", own).withColumn("_licence", whole_number("license_no")))
    if workers is not None:
        named = keep_first(workers.select(whole_number("employee_id").alias("employee_id"), clean_name("name").alias("_worker")).where("employee_id is not null and _worker is not null"), ["employee_id"], "_worker")
        out = out.join(named, "employee_id", "left")
    else:
        out = out.withColumn("_worker", F.lit(None).cast("string"))
    placeholder = F.coalesce(F.concat(F.lit("免許:"), F.col("_licence")), F.concat(F.lit("ID:"), F.col("employee_id")), F.concat(F.lit(f"{seed}:"), F.col("row_seq").cast("string")))
    helpers = ("_name", "_licence", "_worker", "_of_licence", "_of_employee")
    nameless = F.coalesce("_name", "_worker").isNull()
    own, named = out.where(nameless), out.where(~nameless).withColumn("name", F.coalesce("_name", "_worker")).drop(*helpers)
    if own.count() == 0:
        return named
    # only rows without a name are looked up, so the others are not shuffled for it; one row for each licence and employee,
    # combined before its shuffle, is there for both lookups
    marked = lambda key: F.concat(F.lit(f"{key}:"), key)
    first = out.where(F.col("_name").isNotNull()).select("_name", "row_seq", F.explode(F.array(marked("_licence"), marked("employee_id"))).alias("_key")).where("_key is not null")
    first = first.groupBy("_key").agg(F.min_by("_name", "row_seq").alias("_first"))
    for key, column in (("_licence", "_of_licence"), ("employee_id", "_of_employee")):
        # rows without the key get one of their own, which meets nothing, so that they are not all in one task
        wanted = F.when(F.col(key).isNotNull(), marked(key)).otherwise(F.concat(F.lit("row:"), F.coalesce(F.col("row_seq").cast("string"), F.lit(""))))
        own = own.withColumn("_key", wanted).join(first.withColumnRenamed("_first", column), "_key", "left").drop("_key")
    return named.unionByName(own.withColumn("name", F.coalesce("_of_licence", "_of_employee", placeholder)).drop(*helpers))
