"""CSV files as people make them: in any of several encodings, with line breaks inside quotes, columns known by header.

Files are read as lines, in as many parts as Spark cuts them into; no file is a row of its own but one in UTF-16. Whether
a line begins inside quotes follows from the number of quotes before it: counts of each part are summed over the parts
of a file, then within the part. Lines that belong together meet by where their record begins, all others stay where
they are. A file's encoding is that which fits all its lines.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.operators.ranges import ROWS_PER_RANGE
from rollbook.sources.files import ENCODINGS, decoded
from rollbook.sources.shared import stored

#: Where a line is: the part of its file, by its first byte, and its place there.
PLACE = ["block", "at"]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def fitting(raw: pd.Series) -> pd.Series:
    """Which of the encodings each line fits."""
    def one(line: bytes) -> list[bool]:
        out = []
        for encoding in ENCODINGS:
            try:
                line.decode(encoding)
                out.append(True)
            except UnicodeDecodeError:
                out.append(False)
        return out

    return raw.map(one)


@F.pandas_udf(T.StringType())
def decoded_as(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or e is None else r.decode(e, "replace") for r, e in zip(raw, encoding, strict=True)], dtype=object)


def lines(spark: SparkSession, path: str, rows_per_block: int = ROWS_PER_RANGE) -> DataFrame:
    """(source, block, at, text) of every line of the files, without its end; a file in UTF-16 has a block for so many lines."""
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    wide = F.substring(F.col("value").cast("binary"), 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    start = read.where("block = 0").groupBy("source").agg(F.min_by(wide, "at").alias("_wide"))
    # which files fit what: lines that are UTF-8 fit it in the JVM, and others are tried in Python
    odd = ~F.is_valid_utf8("value")
    tried = read.where(odd).select("source", fitting(F.col("value").cast("binary")).alias("fits")).groupBy("source").agg(*(F.min(F.col("fits")[i]).alias(f"f{i}") for i in range(len(ENCODINGS))))
    chosen = F.coalesce(*(F.when(F.col(f"f{i}"), F.lit(e)) for i, e in enumerate(ENCODINGS)), F.lit("utf-8"))
    kinds = stored(start.join(tried, "source", "left").select("source", "_wide", F.when(F.col("f0").isNotNull(), chosen).alias("_encoding")), "encodings")
    narrow = read.join(kinds, "source").where("not _wide")
    # only bytes of files that are no UTF-8 go to Python
    foreign = F.when(F.col("_encoding").isNotNull(), F.col("value").cast("binary"))
    out = narrow.select("source", "block", "at", F.coalesce(decoded_as(foreign, F.col("_encoding")), "value").alias("text"))
    others = [r.source for r in kinds.where("_wide").collect()]  # names of the files in UTF-16
    if others:
        whole = spark.read.format("binaryFile").load(others).select(F.col("path").alias("source"), F.posexplode(F.split(decoded("content"), "\n")).alias("at", "text"))
        out = out.unionByName(whole.withColumns({"block": F.floor(F.col("at") / rows_per_block), "at": F.col("at").cast("long")}))
    return out.withColumn("text", F.regexp_replace(F.when((F.col("block") == 0), F.ltrim("text", F.lit("﻿"))).otherwise(F.col("text")), "\r$", ""))


def records(found: DataFrame) -> DataFrame:
    """(source, block, at, text): lines (as lines() has them) joined to records, with the place of their first line.

    A line's record begins at the last line before it, in its block, that does not begin inside quotes. Which lines these are
    is known but for the parity of the quotes before the block, so both are worked out by one sort of the block's lines; a
    block without any goes on with the last one of the blocks before it, of which there is one row each.
    A quote that is never closed makes the rest of its file one record, as for any reader.
    """
    own = stored(found.withColumn("_odd", (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))) % 2), "lines")
    blocks = own.groupBy("source", "block").agg(F.sum("_odd").alias("_n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("_n").over(before) % 2, F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "block").orderBy("at")
    placed = own.withColumn("_here", F.coalesce(F.sum("_odd").over(within.rowsBetween(Window.unboundedPreceding, -1)) % 2, F.lit(0)))
    placed = placed.withColumns({f"_start{p}": F.max(F.when(F.col("_here") == p, F.col("at"))).over(within.rowsBetween(Window.unboundedPreceding, 0)) for p in (0, 1)})
    start = F.when(F.col("_before") == 0, F.col("_start0")).otherwise(F.col("_start1"))
    placed = placed.join(blocks, ["source", "block"]).select("source", *PLACE, "text", ((F.col("_here") == F.col("_before")) & (F.col("_odd") == 0)).alias("_single"), start.alias("_at"))
    placed = stored(placed, "placed")
    last = placed.groupBy("source", "block").agg(F.max("_at").alias("_at"))
    carry = last.select("source", "block", F.last(F.when(F.col("_at").isNotNull(), F.struct("block", F.col("_at").alias("at"))), ignorenulls=True).over(before).alias("_carry"))
    several = placed.where("not _single").select("source", *PLACE, "text", "_at").join(carry, ["source", "block"])
    several = several.withColumn("_start", F.when(F.col("_at").isNotNull(), F.struct("block", F.col("_at").alias("at"))).otherwise(F.col("_carry")))
    whole = several.groupBy("source", "_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*PLACE, "text"))), lambda x: x["text"]), "\n").alias("text"))
    return placed.where("_single").select("source", *PLACE, "text").unionByName(whole.select("source", "_start.*", "text"))


def fields(text: Column, width: int) -> Column:
    """A record's fields, as many as there are columns at most."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(text, schema, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(source, block, at, columns) of the files' records below their first one, which names their columns, in any order and
    possibly different ones in each file. A column that a file lacks is null there; blank records are none."""
    some = stored(records(lines(spark, path, rows_per_range)).where(F.trim("text") != ""), "records")
    head = some.groupBy("source").agg(F.min_by("text", F.struct(*PLACE)).alias("_head"), F.min(F.struct(*PLACE)).alias("_first"))
    width = head.agg(F.max(F.length("_head") - F.length(F.replace("_head", F.lit(","), F.lit(""))) + 1)).first()[0]
    if width is None:
        return spark.createDataFrame([], f"source string, block long, at long, {', '.join(f'`{c}` string' for c in columns)}")
    cell = lambda row: F.array(*(F.trim(row[f"c{i}"]) for i in range(width)))
    names = stored(head.select("source", "_first", cell(fields(F.col("_head"), width)).alias("_names")), "headers")
    rows = some.join(names, "source").where(F.struct(*PLACE) != F.col("_first"))
    parsed = rows.select("source", *PLACE, "_names", fields(F.col("text"), width).alias("r")).withColumn("r", F.array(*(F.col(f"r.c{i}") for i in range(width))))
    at = lambda c: F.nullif(F.array_position("_names", F.lit(c)), F.lit(0))
    return parsed.select("source", *PLACE, *(F.element_at("r", at(c).cast("int")).alias(c) for c in columns))
