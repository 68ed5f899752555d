"""The trigram index against plain search, and profiles against whole columns."""

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import due, identity, issue, profiles, search


@pytest.mark.parametrize("parts", [1, 4])
def test_search_gives_the_rows_of_a_plain_search(spark, tmp_path, parts):
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abAB é山", k=draw.randint(0, 9)))
    rows = spark.createDataFrame([(i, None if i % 17 == 0 else word(), word(), "common text" if i % 2 else word()) for i in range(600)], "id long, name string, license_no string, qualification string")
    search.write_index(rows, "id", f"{tmp_path}/i", parts=parts)
    for text in ("abA", "ÉAB", "山a", "", "ab ab", "common", "mmon tex", "zzz", "b山é"):
        want = sorted(r.id for r in issue.searched(rows, text).collect())
        assert sorted(r.id for r in search.found(spark, f"{tmp_path}/i", rows, "id", text, parts).collect()) == want
    plan = search.candidates(spark, f"{tmp_path}/i", "common", parts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan


@pytest.mark.parametrize("different", [18, 19, 20, 21, 60])
def test_profiles_choose_the_same_columns(spark, different):
    rows = spark.range(3000).select(F.concat(F.lit("name "), F.translate((F.col("id") % different).cast("string"), "0123456789", "abcdefghij")).alias("who"), F.col("id").cast("string").alias("number"), F.lit(None).cast("string").alias("none"), F.lit("same").alias("same"))
    parts = [profiles.profile(rows.where(F.col("number").cast("int") % 3 == n), ("who", "number", "none", "same")) for n in range(3)]
    known = profiles.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert profiles.name_columns(known, rows) == identity.name_columns(rows)


@pytest.mark.parametrize("apart", [0, 1, 400])
def test_profiles_choose_the_same_dates(spark, apart):
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    rows = spark.range(2000).select("id", day(F.col("id") % 1000).alias("a"), day(F.col("id") % 1000 + apart).alias("b"), F.when(F.col("id") < 2, day(F.col("id"))).alias("c"), F.lit(None).cast("date").alias("d"))
    parts = [profiles.profile(rows.where(F.col("id") % 3 == n), days=("a", "b", "c", "d")) for n in range(3)]
    known = profiles.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert profiles.guessed_dates(known, rows) == due.guessed_dates(rows, ["a", "b", "c", "d"])
