"""Versions in buckets, and intervals that follow arriving snapshots, against whole tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import state, versioned
from rollbook.sources import buckets
from rollbook.streaming import feeds

SCHEMA = "k string, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_rewrite_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"))
    buckets.write(first, path, ["k"], 0, buckets=16)
    log = spark.createDataFrame([("3", "b", 1), ("new", "c", 2)], "k string, v string, seq long")
    hit = buckets.merged(spark, path, ["k"], 0, 1, log, first.schema, lambda old, new: state.applied(old, new, ["k"], {"v": state.REPLACE}), 16)
    assert len(hit) <= 2
    assert {r.at for r in buckets.manifest(spark, path, 1).where("level = 0").collect()} == {"0", "1"}
    assert buckets.manifest(spark, path, 1).where("level = 0 and at = '1'").count() == len(hit)
    assert rows(buckets.read(spark, path, 0, first.schema)) == rows(first)
    assert rows(buckets.read(spark, path, 1, first.schema)) == rows(first.where("k <> '3'").union(log.select("k", "v")))
    assert buckets.differing(spark, path, 0, 1) == hit and buckets.differing(spark, path, 1, 1) == []
    assert rows(buckets.diff(spark, path, ["k"], 0, 1, first.schema)) == [("3", "changed"), ("new", "added")]
    read = buckets.diff(spark, path, ["k"], 0, 1, first.schema).inputFiles()
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= set(hit)


def test_roots_are_of_rows_not_of_writes(spark, tmp_path):
    rows_ = spark.range(50).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"))
    buckets.write(rows_, f"{tmp_path}/a", ["k"], 0, buckets=8)
    buckets.write(rows_.where("k < '3'"), f"{tmp_path}/b", ["k"], 0, buckets=8)
    log = rows_.where("k >= '3'").withColumn("seq", F.lit(1)).repartition(3)
    buckets.merged(spark, f"{tmp_path}/b", ["k"], 0, 1, log, rows_.schema, lambda old, new: state.applied(old, new, ["k"], {"v": state.REPLACE}), 8)
    assert buckets.root(spark, f"{tmp_path}/a", 0) == buckets.root(spark, f"{tmp_path}/b", 1) != buckets.root(spark, f"{tmp_path}/b", 0)


def test_a_snapshot_of_one_key_writes_one_bucket(spark, tmp_path):
    """A late date touches the keys it holds and those whose stretches it cuts; a later one only those it holds."""
    schema, seen = "rec_key string, snapshot_date date, name string", {}
    day = lambda n: dt.date(2024, 1, n)
    first = [(f"k{i}", day(n), "x") for i in range(40) for n in (1, 5) if n == 1 or i < 3]
    for part in (first, [("k7", day(9), "x")], [("k7", day(3), "x")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        feeds.snapshot_feed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/store", f"{tmp_path}/c", lambda runs, n: seen.update({n: rows(runs)}), count=64).awaitTermination()
    written = [{r.node for r in buckets.manifest(spark, f"{tmp_path}/store", n).where(f"level = 0 and at = '{n}'").collect()} for n in range(3)]
    of = lambda *keys: set(buckets.touched(spark.createDataFrame([(k,) for k in keys], "k string"), ["k"], 64))
    assert written[1] == of("k7") and written[2] == of("k7", "k0", "k1", "k2")
    every = spark.createDataFrame(first + [("k7", day(9), "x"), ("k7", day(3), "x")], schema)
    assert seen[2] == rows(versioned.intervals(every))


def test_empty_versions_and_removed_rows(spark, tmp_path):
    path, none = f"{tmp_path}/t", spark.createDataFrame([], SCHEMA)
    buckets.write(none, path, ["k"], 0, buckets=4)
    assert buckets.read(spark, path, 0, none.schema).isEmpty() and buckets.read(spark, path, None, none.schema).isEmpty()
    one = spark.createDataFrame([("x", "1"), (None, "2")], SCHEMA)
    buckets.write(one, path, ["k"], 1, 0, buckets.touched(one, ["k"], 4), 4)
    assert rows(buckets.read(spark, path, 1, none.schema)) == rows(one)
    buckets.write(none, path, ["k"], 2, 1, buckets.touched(one.where("k = 'x'"), ["k"], 4), 4)
    assert rows(buckets.read(spark, path, 2, none.schema)) == [(None, "2")]
    buckets.write(none, path, ["k"], 3, 2, [], 4)
    assert buckets.differing(spark, path, 2, 3) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stretches_follow_snapshots_in_any_order(spark, seed):
    """Random snapshots, delivered in random order and some dates twice: the same intervals as of all at once."""
    draw = random.Random(seed)
    days = [dt.date(2024, 1, 1) + dt.timedelta(x) for x in sorted(draw.sample(range(40), 9))]
    every = [(f"k{k}", day, draw.choice("ab")) for day in days for k in range(6) if draw.random() < 0.6]
    schema = "rec_key string, snapshot_date date, category string"
    draw.shuffle(every)
    parts = [every[:10], *([r for r in every[10:] if r[1] in some] for some in (days[1::3], days[::3], days[2::3]))]
    stretches, known = spark.createDataFrame([], "rec_key string, first date, last date, category string"), spark.createDataFrame([], "snapshot_date date")
    for part in parts:
        incoming = spark.createDataFrame(part, schema)
        stretches = spark.createDataFrame(versioned.advanced(stretches, known, incoming, ("category",)).collect(), stretches.schema)
        known = spark.createDataFrame(known.union(incoming.select("snapshot_date")).distinct().collect(), known.schema)
    want = versioned.intervals(spark.createDataFrame(every, schema), ("category",))
    assert rows(versioned.intervals_of(stretches, known, ("category",)).select(want.columns)) == rows(want)
