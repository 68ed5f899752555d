"""Calendars in pieces, and hashes of lists in any number of files."""

import glob

from pyspark.sql import functions as F

from rollbook.operators import runs
from rollbook.sources import files


def test_large_calendars_come_in_pieces(spark, tmp_path):
    events = spark.range(1000).select(F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.col("id").cast("string"), F.lit("\r\nEND:VEVENT")).alias("value"))
    files.write_calendar(events, f"{tmp_path}/out", 2, events_per_piece=100)
    read = [open(f, newline="").read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*"))]
    assert max(text.count("UID:") for text in read) < 200
    calendars = "".join(read).split("END:VCALENDAR\r\n")
    assert len(calendars) == 3 and calendars[2] == "" and all(c.startswith("BEGIN:VCALENDAR\r\n") and c.count("BEGIN:VCALENDAR") == 1 for c in calendars[:2])
    assert sorted(int(x) for c in calendars for x in c.replace("\r\n", " ").split() if x.startswith("UID:") for x in [x[4:]]) == list(range(1000))


def test_one_hash_however_a_list_is_cut(spark, tmp_path):
    def put(name, *texts):
        (tmp_path / name).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / name / f"part-{i:05}").write_bytes(text)

    lines = [b"line %d\xff" % i for i in range(500)]
    text = b"\n".join(lines) + b"\n"
    put("whole", text)
    put("cut", text[:text.index(b"line 77")], b"", text[text.index(b"line 77"):])
    put("swapped", b"\n".join([lines[1], lines[0], *lines[2:]]) + b"\n")
    put("open", text[:-1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.source.rsplit("/", 1)[1]: (r.source_hash, r.bytes) for r in runs.folder_hashes(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["whole"] == got["cut"] and got["whole"][1] == len(text)
    assert len({h for h, _ in got.values()}) == 3
