import hashlib
import struct
import uuid

import pytest
import zstandard

from rollbook.llm import warc

KIND = "page_id long, url string, html string, digest string, value int"


def pages(spark):
    big = "<p>é" + "x" * 1200
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "common text of all pages " * 60) for i in range(40)]
    rows += [(50, "u\r\nX-Page-ID: 9", big), (51, None, big), (52, "u%0A", big), (60, "u", "small"), (61, "u", "small"), (62, None, None), (63, "u", ""), (None, "u", big), (52, "u", big), (70, "", "z" * 300_000), (71, "x", "a\r\n\r\nb"), (None, None, None)]
    return rows, spark.createDataFrame([(*r, "d", 1) for r in rows], KIND)


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(df.repartition(3), path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], r[1], hashlib.sha1((r[2] or "").encode()).hexdigest(), len((r[2] or "").encode())) for r in rows), key=str)
    assert sorted(((r.page_id, r.url, r.payload_digest, r.payload_bytes) for r in got), key=str) == want
    by = {(r.page_id, r.url): r for r in got}
    assert by[50, rows[40][1]].refers_to == 52 and by[51, None].record_type == "revisit" and by[None, "u"].record_type == "response"
    assert by[52, "u"].record_type == by[52, "u%0A"].record_type == "response"
    assert all(by[n, u].record_type == "response" for n, u in ((60, "u"), (61, "u"), (62, None), (63, "u")))
    assert bytes(by[70, ""].payload) == b"z" * 300_000 and bytes(by[71, "x"].payload) == b"a\r\n\r\nb"


def test_archives_are_standard(spark, tmp_path):
    _, df = pages(spark)
    warc.write_archives(df.coalesce(1), f"file://{tmp_path}/warc")
    (file,) = (tmp_path / "warc").glob("part-*")
    raw = file.read_bytes()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D and size > 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + size]))
    text = b"".join(warc.archive_records(raw))
    assert text == reader.stream_reader(raw, read_across_frames=True).read()
    assert text.startswith(b"WARC/1.1\r\n") and len(raw) < len(text) / 4
    assert uuid.UUID(warc.record_id(1)[10:-1])


def test_dictionary_helps_small_records(spark, tmp_path):
    rows = [(i, f"http://host/{i}", f"<html><head><title>{i}</title></head><body class='main content'>page number {i} of the site</body></html>") for i in range(400)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/warc")
    (file,) = (tmp_path / "warc").glob("part-*")
    records = list(warc.archive_records(file.read_bytes()))
    alone = sum(len(zstandard.compress(r)) for r in records)
    size = struct.unpack_from("<II", file.read_bytes())[1]
    assert len(file.read_bytes()) - size < 0.7 * alone


def test_broken_archives_are_errors(spark):
    raw = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parsed(raw)["payload"] == b"abc"
    for bad in (raw[:-1], raw.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_no_pages(spark):
    none = spark.createDataFrame([], KIND)
    assert warc.archived(none).collect() == []
