"""Ranks and carried values by ranges, against windows over whole groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.operators import issue, layout, runs
from rollbook.operators.ranges import bounds, carried_down, ranged, ranked


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds nine tenths of the rows, and one has no name; orders have nulls and ties, ended by a number of the row."""
    id = F.col("id")
    return spark.range(20_000).select(
        F.when(id % 70 == 0, None).when(id % 10 == 0, F.concat(F.lit("g"), (id % 70).cast("string"))).otherwise("hot").alias("g"), F.when(id % 13 > 0, (F.xxhash64("id") % 500)).alias("a"),
        F.concat(F.lit("é"), (id % 7).cast("string")).alias("b"), id.alias("row"), F.when(id % 11 == 0, id.cast("string")).alias("v"), F.when(id % 501 == 0, -id).alias("w")).repartition(7)


def test_ranks_are_those_of_a_window(spark, rows):
    whole = Window.partitionBy("g").orderBy("a", "b", "row")
    want = rows.withColumn("place", F.row_number().over(whole).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("g")))
    for per_range in (700, 10**6):
        got = ranked(rows, ["g"], ["a", "b", "row"], per_range).select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_no_range_holds_much_of_a_hot_group(rows):
    sizes = [r["count"] for r in ranged(rows, ["g"], ["a", "b", "row"], 700).groupBy("_range").count().collect()]
    assert len(sizes) == -(-20_000 // 700) and max(sizes) < 3 * 700


def test_ranks_over_all_rows(rows):
    got = ranked(rows, [], ["row"], 900)
    assert got.where("place <> row + 1 or total <> 20000").isEmpty() and got.count() == 20_000


def test_carried_values_are_those_of_a_window(rows):
    down = Window.partitionBy("g").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({c: F.last(c, ignorenulls=True).over(down) for c in ("v", "w")})
    for per_range in (300, 10**6):
        got = carried_down(rows, ["g"], ["row"], ["v", "w"], per_range)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_empty_tables_and_equal_keys(spark, rows):
    none = rows.where("false")
    assert ranked(none, ["g"], ["row"]).isEmpty() and carried_down(none, ["g"], ["row"], ["v"]).isEmpty() and bounds(none, ["row"], 5) == []
    same = spark.range(1000).select(F.lit("x").alias("g"), F.lit(None).cast("long").alias("a"))
    assert sorted(r.place for r in ranked(same, ["g"], ["a"], 50).collect()) == list(range(1, 1001))


def test_pages_and_items_of_a_hot_sheet(spark):
    own = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit("few")).when(F.col("id") % 10 == 1, None).otherwise("most").alias("print_sheet"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("day"), F.col("id").alias("row_seq"))
    paged = issue.pages(own, "day", "row_seq", rows=7, rows_per_range=100)
    place = F.row_number().over(Window.partitionBy("print_sheet").orderBy("day", "row_seq"))
    assert paged.withColumn("want", F.ceil(place / 7)).where("sheet_page <> want").isEmpty() and paged.count() == 3000
    assert paged.groupBy("page").count().where("count > 7").isEmpty() and paged.agg(F.max("page")).first()[0] == paged.first().total_pages
    items = runs.run_items(own, "r", "day", "row_seq", rows_per_range=100)
    want = own.withColumn("item", place - 1).select("print_sheet", "item", F.concat(F.lit('{"day":'), "day", F.lit(',"print_sheet":'), F.coalesce(F.concat(F.lit('"'), "print_sheet", F.lit('"')), F.lit("null")), F.lit(',"row_seq":'), "row_seq", F.lit("}")).alias("payload"))
    assert items.drop("run_id").exceptAll(want).isEmpty() and items.count() == 3000


def test_carried_names_of_a_long_sheet(spark):
    cells = spark.createDataFrame([("b", "s", r, c, v) for r in range(2000) for c, v in ((0, f"n{r}" if r % 9 == 0 else "x"), (1, f"{r + 1} " if r % 9 == 0 else None), (3, "v")) if v], "source string, sheet string, row int, col int, value string")
    got = {r.row: (r.name, r.registration) for r in layout.carried(cells, 0, 1, rows_per_range=150).collect()}
    assert got == {r: (f"n{r - r % 9}", str(r - r % 9 + 1)) for r in range(2000)}
