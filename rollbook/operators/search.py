"""Text search over a table by an index of trigrams: what a text must contain is looked up, what is found is then verified.

Postings (gram, id) lie in parts by gram, in order within a part, so a search reads few files, and of these few row
groups. Of the grams of a text it takes the rarest; rows that have them all are candidates, and only these are read with
their texts. A search for less than three characters has no gram and looks at every row, as without an index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.issue import searched

FIELDS = ("name", "license_no", "qualification")
GRAM, PARTS, USED = 3, 64, 3


def grams(c: Column) -> Column:
    """The distinct trigrams of a text, in lower case."""
    text = F.lower(F.coalesce(c, F.lit("")))
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))), lambda g: F.length(g) == GRAM))


def part_of(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def write_index(rows: DataFrame, id: str, path: str, fields: tuple[str, ...] = FIELDS, parts: int = PARTS) -> None:
    """Postings of every row's fields, and how many rows have each gram. A gram lies within one field. Choose as many parts
    as make one a few hundred MB."""
    found = F.array_distinct(F.flatten(F.array(*(grams(F.col(c).cast("string")) for c in fields))))
    own = rows.select(F.col(id).alias("id"), F.explode(found).alias("gram")).withColumn("part", part_of(F.col("gram"), parts))
    # a frequent gram is spread over several tasks, and with them over several files of its part
    own.repartition("part", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("part", "gram", "id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    stored = rows.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("part", "gram").agg(F.count("*").alias("n")).repartition("part").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, text: str, parts: int = PARTS) -> DataFrame | None:
    """(id) of rows that have the rarest grams of a text; None where it has none."""
    wanted = spark.range(1).select(F.explode(grams(F.lit(text))).alias("gram")).select("gram", part_of(F.col("gram"), parts).alias("part")).collect()
    if not wanted:
        return None
    within = lambda df, some: df.where(F.col("part").isin(*{r.part for r in some}) & F.col("gram").isin(*{r.gram for r in some}))
    known = within(spark.read.schema("gram string, n long, part int").parquet(f"{path}/grams"), wanted).collect()  # a row for each gram of the text
    postings = spark.read.parquet(f"{path}/postings")
    if len(known) < len(wanted):
        return postings.select("id").where("false")
    rare = sorted(known, key=lambda r: (r.n, r.gram))[:USED]
    return within(postings, rare).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(rare)).select("id")


def found(spark: SparkSession, path: str, rows: DataFrame, id: str, text: str, parts: int = PARTS) -> DataFrame:
    """The rows that searched() gives, by the index of their table. Ids are unique and not null."""
    some = candidates(spark, path, text, parts)
    return searched(rows if some is None else rows.join(some.withColumnRenamed("id", id), id, "left_semi"), text)
