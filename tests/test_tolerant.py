"""Tolerant CSV against Python's reader, file by file and whatever parts a file is read in; intervals in dyadic pieces."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import versioned
from rollbook.sources import tolerant

CELLS = ["", "a", "山田 太郎", 'say "hi"', "one\ntwo", "x\r\ny", 'odd " quote', ",", "ﾎﾞｲﾗ", "\n\n", '"', "long " * 30]


def made(path, encoding, names, n, draw):
    rows = [[draw.choice(CELLS) or f"r{i}" if j else f"{i}" for j in range(len(names))] for i in range(n)]
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=draw.choice(["\n", "\r\n"])).writerows([names, *rows])
    with open(path, "wb") as f:
        f.write(text.getvalue().encode(encoding))
    return [dict(zip(names, (v.replace("\r\n", "\n") for v in row), strict=True)) for row in rows]


@pytest.mark.parametrize("part_bytes", [1 << 27, 700])
def test_files_in_all_encodings(spark, tmp_path, part_bytes):
    draw, want = random.Random(3), []
    for i, encoding in enumerate(("utf-8", "utf-8-sig", "cp932", "utf-16")):
        names = draw.sample(["番号", "氏名", "資格"], 3)
        want += [(encoding, r["番号"], r["氏名"], r["資格"]) for r in made(tmp_path / f"{i}-{encoding}.csv", encoding, names, 120, draw)]
    (tmp_path / "5-empty.csv").write_bytes(b"")
    (tmp_path / "6-head.csv").write_bytes("番号,other\r\n7,x\r\n".encode())
    want.append(("head", "7", None, None))
    spark.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
    try:
        got = tolerant.read_csv(spark, str(tmp_path), ["番号", "氏名", "資格"], rows_per_range=50)
        got = [(r.source.rsplit("/", 1)[1][2:-4], *(None if r[c] is None else r[c].replace("\r\n", "\n") for c in ("番号", "氏名", "資格"))) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert tolerant.read_csv(spark, str(tmp_path), ["x"]).isEmpty()


def test_dyadic_pieces_make_up_their_days(spark):
    days = spark.createDataFrame([(a, b) for a in range(40) for b in range(a, 40)] + [(0, 3000)], "a int, b int").select(F.date_add(F.lit("2023-12-20").cast("date"), F.col("a")).alias("a"), F.date_add(F.lit("2023-12-20").cast("date"), F.col("b")).alias("b"))
    nodes = days.withColumn("n", versioned.dyadic_nodes(F.col("a"), F.col("b")))
    assert nodes.where(F.size("n") > 2 * (F.floor(F.log2(F.date_diff("b", "a") + F.lit(1))) + 1)).isEmpty()
    held = F.aggregate("n", F.lit(0).cast("double"), lambda s, x: s + F.pow(F.lit(2), x["level"]))
    assert nodes.where(held != F.date_diff("b", "a") + 1).isEmpty()
    probes = nodes.withColumn("d", F.explode(F.sequence(F.date_sub("a", 2), F.date_add("b", 2)))).withColumn("hits", F.size(F.array_intersect("n", versioned.dyadic_ancestors(F.col("d")))))
    assert probes.where(F.col("hits") != F.col("d").between(F.col("a"), F.col("b")).cast("int")).isEmpty()


def test_states_at_dates_are_those_of_brute_force(spark):
    draw = random.Random(1)
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n)
    rows = [(i, a, None if draw.random() < 0.3 else a + draw.choice([0, 1, 40, 900])) for i in range(300) for a in [draw.randrange(2000)]]
    runs = spark.createDataFrame([*rows, (-1, None, 5)], "rec_key int, a int, b int").select("rec_key", day(F.col("a")).alias("valid_from"), day(F.col("b")).alias("valid_to"))
    asked = [0, 1, 500, 501, 1500, 2899]
    dates = spark.createDataFrame([(x,) for x in asked], "x int").select(day(F.col("x")).alias("as_of"), "x")
    got = sorted((r.x, r.rec_key) for r in versioned.as_of_dates(runs, dates.select("as_of")).join(dates, "as_of").collect())
    assert got == sorted((x, i) for x in asked for i, a, b in rows if a <= x and (b is None or b >= x))
    assert versioned.as_of_dates(runs, dates.select("as_of").limit(0)).isEmpty()
