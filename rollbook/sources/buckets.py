"""Keyed tables in hash buckets, written as versions by copy on write.

A version consists of the buckets that it wrote and, for all others, of those of the version that it is based on; its
manifest says which. A change log of k keys rewrites at most k buckets, and nothing that a reader may hold open is
touched. The manifest also has a hash of each bucket's rows, whatever their order, and a tree of hashes over them: two
versions are compared from the root down, and only buckets that differ are read.

Choose as many buckets as make one a task's worth of data (a few hundred MB); all versions of a table have the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.sources.shared import exists

BUCKETS, FANOUT = 64, 8
#: level 0 has a row for each bucket, with the version that wrote it (null: it is empty); the levels above have nodes.
MANIFEST = "level int, node int, at string, rows long, hash string"
#: A row's SHA-256 is added up in pieces of so many hexadecimal digits, each below 2**60, and each in two halves of so many
#: bits, whose sums are longs up to 2**33 rows in a bucket.
PIECE, HALF = 15, 30


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(keys_of: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets that these keys lie in: at most as many numbers as there are buckets."""
    return sorted(r[0] for r in keys_of.select(bucket_of(keys, buckets)).distinct().collect())


def row_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def bucket_hashes(rows: DataFrame) -> DataFrame:
    """(bucket, rows, hash) of rows with a column bucket; sums of the rows' hashes, so their order counts for nothing."""
    own = rows.select("bucket", row_hash([c for c in rows.columns if c != "bucket"]).alias("h"))
    own = own.select("bucket", *(F.conv(F.substring("h", 1 + i * PIECE, PIECE), 16, 10).cast("long").alias(f"p{i}") for i in range(4)))
    halves = lambda i: (F.sum(F.shiftright(f"p{i}", HALF)).alias(f"h{i}"), F.sum(F.col(f"p{i}").bitwiseAND(2**HALF - 1)).alias(f"l{i}"))
    sums = own.groupBy("bucket").agg(F.count("*").alias("rows"), *(half for i in range(4) for half in halves(i)))
    whole = lambda i: (F.col(f"h{i}").cast("decimal(20,0)") * F.lit(2**HALF).cast("decimal(10,0)") + F.col(f"l{i}").cast("decimal(20,0)")).cast("string").alias(f"s{i}")
    sums = sums.select("bucket", "rows", *(whole(i) for i in range(4)))
    return sums.select("bucket", "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *(f"s{i}" for i in range(4))), 256).alias("hash"))


def tree(leaves: DataFrame, buckets: int) -> DataFrame:
    """A manifest from its level 0: each node's hash is that of its children's, up to one root."""
    out = level = leaves
    n, width = 0, buckets
    while width > 1:
        n, width = n + 1, -(-width // FANOUT)
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"), F.sum("rows").alias("rows"))
        out = out.unionByName(level.select(F.lit(n).alias("level"), "node", F.lit(None).cast("string").alias("at"), "rows", "hash"))
    return out


def manifest(spark: SparkSession, path: str, version: str | int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={version}")


def write(rows: DataFrame, path: str, keys: Sequence[str], version: str | int, base: str | int | None = None, only: Iterable[int] | None = None, buckets: int = BUCKETS) -> None:
    """rows as a new version: all buckets, or, on a base, those in `only`, to which all of rows belong.

    Writing a version again replaces it, so a batch may be repeated. A bucket without rows is empty.
    """
    spark, data = rows.sparkSession, f"{path}/data/version={version}"
    own = rows.withColumn("bucket", bucket_of(keys, buckets))
    own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])
    new = bucket_hashes(spark.read.schema(schema).parquet(data)).select(F.col("bucket").alias("node"), F.lit(str(version)).alias("at"), "rows", "hash")
    mine = spark.range(buckets).select(F.col("id").cast("int").alias("node")) if only is None else spark.createDataFrame([(b,) for b in sorted(set(only))], "node int")
    empty = F.sha2(F.lit(""), 256)
    leaves = mine.join(new, "node", "left").select(F.lit(0).alias("level"), "node", "at", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("hash", empty).alias("hash"))
    if only is not None:
        old = manifest(spark, path, base).where("level = 0") if base is not None else spark.range(buckets).select(F.lit(0).alias("level"), F.col("id").cast("int").alias("node"), F.lit(None).cast("string").alias("at"), F.lit(0).alias("rows"), empty.alias("hash"))
        leaves = leaves.unionByName(old.join(mine, "node", "left_anti"))
    tree(leaves, buckets).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def read(spark: SparkSession, path: str, version: str | int | None, schema: T.StructType | str, only: Iterable[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets, of which alone the files are read; none for no version."""
    if version is None:
        return spark.createDataFrame([], schema)
    wanted = manifest(spark, path, version).where("level = 0 and rows > 0")
    if only is not None:
        wanted = wanted.where(F.col("node").isin(*only)) if (only := list(only)) else wanted.where("false")
    files = [f"{path}/data/version={r.at}/bucket={r.node}" for r in wanted.collect()]  # one for each bucket at most
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def latest(spark: SparkSession, path: str, before: int) -> int | None:
    """The last whole version below a number; versions are numbered from 0 without gaps."""
    return before - 1 if before > 0 and exists(spark, f"{path}/manifest/version={before - 1}/_SUCCESS") else None


def merged(spark: SparkSession, path: str, keys: Sequence[str], base: str | int | None, version: str | int, log: DataFrame, schema: T.StructType | str, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """A new version by change(rows, log), of which rows are those in the buckets that the log's keys lie in. Returns these."""
    hit = touched(log, keys, buckets)
    write(change(read(spark, path, base, schema, hit), log), path, keys, version, base, hit, buckets)
    return hit


def root(spark: SparkSession, path: str, version: str | int) -> str:
    """The hash of a version's rows: equal for the same rows, however they came about and wherever they lie."""
    return manifest(spark, path, version).orderBy(F.col("level").desc()).first().hash


def differing(spark: SparkSession, path: str, one: str | int, other: str | int) -> list[int]:
    """Buckets whose rows differ between versions: from the root down, below nodes with different hashes only."""
    both = manifest(spark, path, one).alias("a").join(manifest(spark, path, other).alias("b"), ["level", "node"]).where("a.hash <> b.hash").select("level", "node")
    nodes = spark.createDataFrame([(0,)], "node int")
    for level in range(both.agg(F.max("level")).first()[0] or 0, -1, -1):
        nodes = both.where(F.col("level") == level).join(nodes, "node", "left_semi").select("node")
        if level:
            nodes = nodes.select(F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
    return sorted(r.node for r in nodes.collect())


def diff(spark: SparkSession, path: str, keys: Sequence[str], one: str | int, other: str | int, schema: T.StructType) -> DataFrame:
    """(keys, change): rows added, removed and changed between two versions; equal buckets are not read. Keys are unique."""
    some = differing(spark, path, one, other)
    side = lambda version, name: read(spark, path, version, schema, some).select(*keys, row_hash(schema.names).alias(name))
    both = side(one, "_a").join(side(other, "_b"), list(keys), "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*keys, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))
