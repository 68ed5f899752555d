"""Feeds of arriving files: due lists and validity intervals that follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollbook.functions.dates import DueConfig
from rollbook.operators.due import due
from rollbook.operators.issue import filtered
from rollbook.operators.versioned import advanced, intervals_of
from rollbook.sources import buckets


def due_feed(spark: SparkSession, inbox: str, schema: T.StructType, out: str, checkpoint: str, as_of: str, config: DueConfig = DueConfig(), keep: str = "90 days", flags: Callable[[], dict[str, DataFrame]] | None = None) -> StreamingQuery:
    """Whenever it is started, turns the roster files that have come since into due rows, appended by batch.

    A row that came before, in the same file or one delivered up to `keep` earlier (by the files' times), is not due again;
    after that its state is given up. flags gives the tables of excluded people, licences, sheets and memberships, and is asked
    anew for every batch, so that changes to them count from the next one on. A batch that is retried replaces itself.
    """
    def batch(df: DataFrame, number: int) -> None:
        rows = due(df, as_of, config)
        rows = rows if flags is None else filtered(rows, **flags())
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    arrived = spark.readStream.schema(schema).parquet(inbox).select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
    fresh = arrived.withColumn("_row", buckets.row_hash(schema.names)).withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(["_row"]).drop("_row", "_arrived")
    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_feed(spark: SparkSession, inbox: str, schema: T.StructType, store: str, checkpoint: str, on_change: Callable[[DataFrame, int], None], attributes: tuple[str, ...] = (), count: int = buckets.BUCKETS) -> StreamingQuery:
    """Keeps the stretches of arriving snapshots (rec_key, snapshot_date, ...) by key, then hands their intervals to on_change.

    Snapshots count by their dates, so one that comes late falls into place. The store holds stretches in buckets by key, and
    the dates. A batch reads and writes the buckets of the keys that it has, and of those whose stretches a late date cuts;
    the snapshots themselves are not kept. Each batch is a version of its own, which a batch that is retried replaces.
    """
    kept = T.StructType([schema["rec_key"], T.StructField("first", T.DateType()), T.StructField("last", T.DateType()), *(schema[c] for c in attributes)])
    day = T.StructType([T.StructField("snapshot_date", T.DateType())])

    def batch(df: DataFrame, number: int) -> None:
        base = buckets.latest(spark, store, number)
        known = spark.createDataFrame([], day) if base is None else spark.read.schema(day).parquet(f"{store}/dates/version={base}")
        own = df.where("rec_key is not null and snapshot_date is not null").persist()
        try:
            late = own.select("snapshot_date").distinct().join(known, "snapshot_date", "left_anti").join(known.agg(F.max("snapshot_date").alias("_last")), F.col("snapshot_date") < F.col("_last"))
            span = late.agg(F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("b")).first()
            keys = own.select("rec_key")
            if span.a is not None:  # stretches around the late dates, of which files' statistics rule most out
                cut = buckets.read(spark, store, base, kept).where((F.col("first") < F.lit(span.b)) & (F.col("last") > F.lit(span.a)))
                keys = keys.union(cut.select("rec_key"))
            hit = buckets.touched(keys, ["rec_key"], count)
            after = advanced(buckets.read(spark, store, base, kept, hit), known, own, attributes)
            buckets.write(after, store, ["rec_key"], number, base, hit, count)
            known.unionByName(own.select("snapshot_date")).distinct().coalesce(1).write.mode("overwrite").parquet(f"{store}/dates/version={number}")
        finally:
            own.unpersist()
        dates = spark.read.schema(day).parquet(f"{store}/dates/version={number}")
        on_change(intervals_of(buckets.read(spark, store, number, kept), dates, attributes), number)

    return spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
