"""Recorded runs: what was printed when, with hashes, and what of it can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.operators.issue import pages
from rollbook.operators.ranges import ROWS_PER_RANGE, ranked

#: A row's SHA-256 is added up in pieces of so many hexadecimal digits, each below 2**60.
PIECE = 15
RUNS_LISTED = 200


def row_text(df: DataFrame) -> Column:
    """A row as JSON of its columns in order of name, nulls included."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def content_hash(df: DataFrame) -> DataFrame:
    """One row, content_hash: the same for the same rows in any order.

    It is of the number of rows and of the sums of four pieces of their SHA-256, so it takes one aggregation, combined
    before its shuffle, and no list of hashes; repeated rows count as often as they are there. It tells tables apart that
    differ by chance or mistake; it is no proof against someone who makes up rows.
    """
    digest = df.select(F.sha2(row_text(df), 256).alias("h"))
    piece = lambda i: F.conv(F.substring("h", 1 + i * PIECE, PIECE), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(piece(i)), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return digest.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("content_hash"))


def run_header(rows: DataFrame, run_id: str, **values: object) -> DataFrame:
    """One row: run_id, given values, row count and content hash."""
    counted = rows.agg(F.count("*").alias("record_count")).crossJoin(content_hash(rows))
    return counted.select(F.lit(run_id).alias("run_id"), *(F.lit(v).alias(k) for k, v in values.items()), "record_count", "content_hash")


def run_items(rows: DataFrame, run_id: str, *order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(run_id, print_sheet, item, payload): JSON rows, numbered from 0 within a sheet of any size."""
    own = rows.select("print_sheet", *(c for c in order if c != "print_sheet"), row_text(rows).alias("payload"))
    placed = ranked(own, ["print_sheet"], list(order), rows_per_range)
    return placed.select(F.lit(run_id).alias("run_id"), "print_sheet", (F.col("place") - 1).alias("item"), "payload")


def run_rows(items: DataFrame, schema: str) -> DataFrame:
    """Items read back to columns; a broken payload gives a row of nulls."""
    return items.select("run_id", "print_sheet", "item", F.from_json("payload", schema).alias("p")).select("run_id", "item", "p.*") if "print_sheet" in schema else items.select("run_id", "item", F.from_json("payload", schema).alias("p")).select("run_id", "item", "p.*")


def newest_runs(runs: DataFrame, n: int = RUNS_LISTED) -> DataFrame:
    return runs.withColumn("at", F.coalesce("printed", "created")).orderBy(F.col("at").desc(), F.col("run_id").desc()).limit(n)


def reopened(rows: DataFrame, stored: DataFrame | None, *order: str, per_page: int = 40) -> DataFrame:
    """A run's pages: those stored with it, else laid out anew."""
    return stored if stored is not None else pages(rows, *order, rows=per_page)


def source_hashes(content: DataFrame) -> DataFrame:
    """(source, source_hash, bytes) of files read as binaryFile, for the history of loads."""
    return content.select(F.col("path").alias("source"), F.sha1("content").alias("source_hash"), F.col("length").alias("bytes"))


def folder_hashes(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """(source, source_hash, bytes) of folders whose text files, in order of name, are one list of lines each.

    Files are read in as many parts as Spark cuts them into, so no task reads a large one whole. The hash is of the bytes,
    the number of lines and sums of pieces of SHA-256 of each line with its number in the folder: however a list is cut
    into files, which end with a line's end, it has the same one. It tells lists apart that differ by chance or mistake.
    A folder without any line has no row.
    """
    at = [F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("source"), F.col("_metadata.file_path").alias("file")]
    read = spark.read.options(recursiveFileLookup="true", pathGlobFilter=files, lineSep="\n").text(path)
    lines = read.select(*at, F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"))
    # a part's lines have ids that follow one another: a row for each part says what its first line's number is
    parts = lines.groupBy("source", "file", "block").agg(F.min("id").alias("_first"), F.count("*").alias("_n"), F.max("size").alias("size"))
    sizes = parts.groupBy("source", "file").agg(F.max("size").alias("size")).groupBy("source").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("source").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    digest = F.sha2(F.concat((F.col("id") + F.col("_offset")).cast("string").cast("binary"), F.lit(b":"), F.col("line")), 256)
    digests = lines.join(F.broadcast(parts), ["source", "file", "block"]).select("source", digest.alias("h"))
    piece = lambda i: F.conv(F.substring("h", 1 + i * PIECE, PIECE), 16, 10).cast("decimal(38,0)")
    sums = digests.groupBy("source").agg(F.count("*").alias("_n"), *(F.sum(piece(i)).cast("string").alias(f"_s{i}") for i in range(4)))
    texts = (F.col(c).cast("string") for c in ("bytes", "_n", "_s0", "_s1", "_s2", "_s3"))
    return sizes.join(sums, "source").select("source", F.sha1(F.concat_ws(":", *texts).cast("binary")).alias("source_hash"), "bytes")


def load_history(tables: dict[str, DataFrame], source_hash: DataFrame, loaded: str) -> DataFrame:
    """One row for each loaded table: name, rows, when, and the hash of what it came from (one row)."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out.crossJoin(F.broadcast(source_hash.select("source_hash").limit(1))).withColumn("loaded", F.lit(loaded).cast("timestamp"))


def selection_log(rows: DataFrame, user: str, at: str) -> DataFrame:
    """What a user chose to see, to append under the day it was chosen."""
    return rows.select(F.lit(user).alias("user"), F.lit(at).cast("timestamp").alias("at"), F.lit(at).cast("timestamp").cast("date").alias("day"), "record_key")


def recorded_run(rows: DataFrame, run_id: str, *order: str, **values: object) -> dict[str, DataFrame]:
    """A run's header and numbered items, to append under its id."""
    return {"header": run_header(rows, run_id, **values), "items": run_items(rows, run_id, *order)}
