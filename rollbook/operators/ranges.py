"""Windows over groups of any size: ranks and carried values, worked out range by range.

A group's rows are cut by their order into ranges of about `rows_per_range` rows, so a group with most of the rows has
most of the ranges and no task holds a group whole. What goes from one range to the next is one row a range: its count,
whose running sum is where its ranks begin, or its last values. Bounds of ranges are sampled keys, looked up in a tree
of comparisons that is part of the row's expression; whatever they are, the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.sources.shared import stored

ROWS_PER_RANGE, MOST_RANGES, SAMPLES = 50_000, 1000, 30


def bounds(rows: DataFrame, keys: list[str], rows_per_range: int) -> list[tuple]:
    """Keys that cut rows into ranges of about equal size, in order: at most MOST_RANGES - 1 of them, from SAMPLES rows a range."""
    n = rows.count()
    parts = min(MOST_RANGES, -(-n // rows_per_range))
    if parts < 2:
        return []
    some = rows.select(*keys).sample(min(1.0, SAMPLES * parts / n), seed=parts).orderBy(*keys).collect()
    cut = [tuple(some[len(some) * i // parts]) for i in range(1, parts)] if some else []
    return list(dict.fromkeys(cut))


def range_of(keys: list[str], types: list[str], cut: list[tuple]) -> Column:
    """How many bounds are at or before a row's key, by halving."""
    key = F.struct(*keys)

    def look(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = F.struct(*(F.lit(v).cast(kind).alias(k) for v, kind, k in zip(cut[middle], types, keys, strict=True)))
        return F.when(key < bound, look(low, middle)).otherwise(look(middle + 1, high))

    return look(0, len(cut))


def ranged(df: DataFrame, group: list[str], order: list[str], rows_per_range: int) -> DataFrame:
    """df, stored, with _group, which tells groups apart though they hold nulls, and _range: rows of a group that come later
    have no lower one."""
    rows, keys = stored(df, "ranges"), [*group, *order]
    types = dict(rows.dtypes)
    place = range_of(keys, [types[k] for k in keys], bounds(rows, keys, rows_per_range))
    return rows.withColumns({"_group": F.struct(*group) if group else F.struct(F.lit(0).alias("all")), "_range": place})


def ranked(df: DataFrame, group: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with place (from 1) and total, the row's number within its group and the group's rows, as long.

    Nulls are one group. Order is ascending, nulls first, and its last column should differ between rows: among rows that
    agree in all of it, any may come first. An empty table gives none. df is evaluated once, when this is called.
    """
    rows, keys = ranged(df, group, order, rows_per_range), ["_group", "_range"]
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    here = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_here", here).join(counts, keys).withColumn("place", F.col("_before") + F.col("_here")).drop("_here", "_before", *keys)


def carried_down(df: DataFrame, group: list[str], order: list[str], values: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with each of `values` filled by the last one in its group that is not null, at or before the row.

    Nulls are one group; order is ascending and tells rows of a group apart. Each range has its own last values at hand,
    and those of the ranges before it come from one row a range.
    """
    rows, keys = ranged(df, group, order, rows_per_range), ["_group", "_range"]
    last = rows.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_c{i}") for i, v in enumerate(values)))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, *(F.last(f"_c{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(values))))
    down = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_d{i}": F.last(v, ignorenulls=True).over(down) for i, v in enumerate(values)}).join(carry, keys)
    out = out.withColumns({v: F.coalesce(f"_d{i}", f"_c{i}") for i, v in enumerate(values)})
    return out.select(*df.columns)
