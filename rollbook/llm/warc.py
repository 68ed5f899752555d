"""WARC archives with per-record Zstandard frames and a dictionary of their own.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's first
records; every record is then a frame of its own, compressed with it, so that each can be read alone.

Archives are written by Spark's file writer, so that retried and speculative tasks leave no partial files and any file
system that Spark can write to will do. It ends each row of a text file with a separator; the separator here is an
empty skippable frame, which readers of Zstandard pass over, so the files are valid archives as they lie.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.shared import new_path

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame; all of its bytes are ASCII.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
#: Records from which an archive's dictionary is built, bytes of them at most, and the dictionary's bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 4 << 20, 64 << 10
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def header_text(value: str) -> str:
    """A header's value holds no line breaks; % is escaped with them so that reading gives the same value back."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def header_value(text: str) -> str:
    return re.sub("%(25|0D|0A)", lambda m: chr(int(m[1], 16)), text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit holds no payload; its digest and length are those of the payload it stands for."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    lines += [] if url is None else [f"WARC-Target-URI: {header_text(url)}"]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    block = head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of READ from one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": header_value(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "record_id": fields["WARC-Record-ID"], "payload": payload}


def with_references(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to: the largest page_id with the same payload, if that is another.

    A payload below least_bytes refers to nothing, and so does a row without page_id. Payloads are not shuffled by their
    own: the digests are counted first, combined before their shuffle, and joined back, where AQE may split a hot one.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    large = own.where(F.octet_length("payload") >= least_bytes).select("digest", "page_id")
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    return own.join(last, "digest", "left").withColumn("refers_to", F.when((F.col("last") != F.col("page_id")) & (F.octet_length("payload") >= least_bytes), F.col("last"))).drop("last")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row of pages (page_id, url, html) to archives in the folder path, one for each partition.

    Null html is an empty payload; null url has no target header; rows without page_id are responses; rows with the same
    page_id and payload are all responses if the page_id is the largest. An empty table gives a folder without archives.
    Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        waiting: list[bytes] = []
        held = 0

        def frames(records: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])

        def start() -> list[bytes]:
            nonlocal packer
            try:
                trained = zstandard.train_dictionary(DICTIONARY_BYTES, waiting).as_bytes() if len(waiting) > 8 else b""
            except zstandard.ZstdError:  # too little, or too much alike, to train on
                trained = b""
            trained = trained or b"".join(waiting)[-DICTIONARY_BYTES:]
            dictionary = zstandard.ZstdCompressionDict(trained)
            packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
            return [struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained, *map(packer.compress, waiting)]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)
                if packer is not None:
                    out.append(packer.compress(raw))
                    continue
                waiting.append(raw)
                held += len(raw)
                if len(waiting) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
                    out += start()
            if out:
                yield frames(out)
        if packer is None and waiting:
            yield frames(start())

    frames = with_references(pages, least_bytes).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frame_end(raw: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its header and the headers of its blocks."""
    descriptor = raw[at + 4]
    single = descriptor >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[descriptor >> 6]
    while True:
        block = int.from_bytes(raw[at:at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run of one byte holds that byte alone
        if block & 1:
            return at + 4 * (descriptor >> 2 & 1)


def archive_records(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(raw):
        magic, size = struct.unpack_from("<II", raw, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                if at + 8 + size > len(raw):
                    raise ValueError("the dictionary is cut off")
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[at + 8:at + 8 + size]))
            at += 8 + size
        else:
            end = frame_end(raw, at)
            yield reader.decompress(raw[at:end])
            at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """READ for each record of the archives in the folder path; digests and lengths are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = dict(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=True))
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for raw in archive_records(content.as_py()):
                    rows.append(parsed(raw))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, READ)


def archived(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes pages to new archives in the shared folder and reads them back; see write_archives and read_archives."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
