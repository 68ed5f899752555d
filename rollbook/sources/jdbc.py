"""Tables behind JDBC. Filters and limits on the DataFrame are pushed to the server by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.schema import first_present
from rollbook.functions.text import clean

# Names that the workers' table may have for what is needed of it, the first that it has.
WORKER_COLUMNS = {"employee_id": ("employee_id", "社員番号", "code", "emp_no"), "name": ("name", "氏名", "employee_name"), "birth_date": ("birth_date", "生年月日", "birthday"), "department": ("department", "部署", "dept")}


def read_table(spark: SparkSession, url: str, table: str, where: str | None = None, limit: int | None = None, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table or view; with key and bounds it is read by several tasks, each a range of the key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    out = reader.load()
    out = out if where is None else out.where(where)
    return out if limit is None else out.limit(limit)


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_table(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite").save()


def workers(df: DataFrame, candidates: dict[str, Sequence[str]] = WORKER_COLUMNS) -> DataFrame:
    """Workers with canonical columns, of those that df has; rows without id or name go."""
    found = {name: first_present(df, options) for name, options in candidates.items()}
    out = df.select(*(F.col(f"`{c}`").alias(name) for name, c in found.items() if c))
    return out.where(clean("employee_id").isNotNull() & clean("name").isNotNull())
