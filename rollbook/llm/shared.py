"""What the operators of this package share: the folder for written steps, and links joined to components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master
    (as in tests); on a cluster that is an error, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir names no folder that all machines of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="rollbook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rollbook-{name}-{uuid.uuid4().hex}"


#: For each collecting() under way, the tables written since it began.
_collected: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and its work is done once even if executors are lost later."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    for tables in _collected:
        tables.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def collecting() -> Iterator[list[DataFrame]]:
    """A list of the tables that written() makes inside, for dropping them when their readers are done."""
    tables: list[DataFrame] = []
    _collected.append(tables)
    try:
        yield tables
    finally:
        _collected[:] = [x for x in _collected if x is not tables]


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What build() returns, written; the tables written on the way to it are deleted. For results that are small beside them."""
    with collecting() as tables:
        result = build()
    out = written(result, name)
    for table in tables:
        dropped(table)
    return out


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable by links (a, b), for every id that reaches a smaller one.

    Alternates the large-star and small-star steps until nothing changes. Each step is one aggregation by node, which
    combines before its shuffle, and one join back to the links; a node with very many links is split by AQE.
    A null end of a link is no link. Without links the result is empty.
    """
    now = written(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or tuple(sums) == before:
            break
        before = tuple(sums)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        new = written(small.select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .union(small_least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(now)
        now = new
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
