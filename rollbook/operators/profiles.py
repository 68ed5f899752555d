"""Profiles of columns that are kept with a table's parts and merged: counts add up, distinct values and medians are sketches.

A new part costs a pass over that part alone. What is decided from a profile is decided as from the whole table: where a
sketch's error leaves a choice open, and only there, the columns in question are counted exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import clean

#: Three standard errors of distinct counts with 2**12 registers, and the rank error of quantiles with k = 200, doubled.
DISTINCT_ERROR, RANK_ERROR, REGISTERS = 0.05, 0.035, 12
SUMS = ("rows", "n", "digit", "hyphen", "letter")


def profile(df: DataFrame, texts: tuple[str, ...] = (), days: tuple[str, ...] = ()) -> DataFrame:
    """One row for each column: rows, values, how many texts hold a digit, a hyphen and a letter, and the sketches."""
    parts = []
    if texts:
        long = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in texts)).unpivot([], list(texts), "column", "value").withColumn("value", clean("value"))
        has = lambda pattern: F.coalesce(F.sum(F.col("value").rlike(pattern).cast("long")), F.lit(0))
        parts.append(long.groupBy("column").agg(F.count("*").alias("rows"), F.count("value").alias("n"), has(r"\p{Nd}").alias("digit"), has("-").alias("hyphen"), has(r"\p{L}").alias("letter"), F.hll_sketch_agg("value", REGISTERS).alias("distinct")))
    if days:
        long = df.select(*(F.unix_date(F.col(f"`{c}`").cast("date")).cast("long").alias(c) for c in days)).unpivot([], list(days), "column", "day")
        parts.append(long.groupBy("column").agg(F.count("*").alias("rows"), F.count("day").alias("n"), F.kll_sketch_agg_bigint("day").alias("days")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(parts: DataFrame) -> DataFrame:
    """One profile of many, a row for each column; parts has a row for each column and part."""
    sums = [F.sum(c).alias(c) for c in SUMS if c in parts.columns]
    out = parts.groupBy("column").agg(*sums, *([F.hll_union_agg("distinct").alias("distinct")] if "distinct" in parts.columns else []), *([F.collect_list("days").alias("_days")] if "days" in parts.columns else []))
    if "days" not in parts.columns:
        return out
    first = F.try_element_at("_days", F.lit(1))
    return out.withColumn("days", F.aggregate(F.slice("_days", 2, F.greatest(F.size("_days"), F.lit(1))), first, lambda a, b: F.kll_sketch_merge_bigint(a, b))).drop("_days")


def name_columns(known: DataFrame, df: DataFrame, allowed: tuple[str, ...] = (), least_values: int = 20) -> list[str]:
    """The columns that identity.name_columns finds in df, from df's profile. df is read only for columns whose number of
    different values is about the least that is asked for."""
    rows = known.where("distinct is not null and n > 0").select("column", "n", "digit", "hyphen", "letter", F.hll_sketch_estimate("distinct").alias("values")).collect()
    good = {r.column: r["values"] for r in rows if r.digit <= 0.1 * r.n and r.hyphen <= 0.2 * r.n and r.letter >= 0.7 * r.n}
    near = [c for c, n in good.items() if abs(n - least_values) <= max(1, DISTINCT_ERROR * least_values)]
    if near:
        exact = df.agg(*(F.countDistinct(clean(c)).alias(c) for c in near)).first()
        good |= {c: exact[c] for c in near}
    found = [c for c in allowed if c in df.columns]
    return found + [c for c in df.columns if c not in found and good.get(c, 0) >= least_values]


def guessed_dates(known: DataFrame, df: DataFrame) -> dict[str, str]:
    """What due.guessed_dates finds in df, from df's profile. df is read only for columns whose medians are too close to tell."""
    at = lambda q: F.kll_sketch_get_quantile_bigint("days", F.lit(q))
    some = known.where("days is not null and n >= greatest(3, 0.2 * rows)")
    rows = some.select("column", at(0.5 - RANK_ERROR).alias("low"), at(0.5 + RANK_ERROR).alias("high")).collect()
    if not rows:
        return {}

    def extreme(least: bool) -> str:
        edge = min(r.high for r in rows) if least else max(r.low for r in rows)
        open_ = sorted(r.column for r in rows if (r.low <= edge if least else r.high >= edge))
        if len(open_) > 1:
            exact = df.agg(*(F.percentile_approx(F.unix_date(F.col(f"`{c}`").cast("date")), 0.5).alias(c) for c in open_)).first()
            open_ = sorted(open_, key=lambda c: (exact[c], c))
        return open_[0] if least else open_[-1]

    last = extreme(False)
    return {"first_issue_date": extreme(True), "issue_date": last, "expiry_date": last}
