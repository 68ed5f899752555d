"""Names are looked up for rows that have none; the others are not shuffled for it."""

from pyspark.sql import functions as F

from rollbook.operators import identity


def test_named_rows_are_not_shuffled(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("row_seq"), F.lit("A").alias("license_no"), F.lit("山田 太郎").alias("name"), F.lit("7").alias("employee_id")).write.parquet(f"{tmp_path}/t")
    own = spark.read.parquet(f"{tmp_path}/t")
    whole = identity.fill_names(own)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.where("name = '山田太郎'").count() == 100
    some = identity.fill_names(own.withColumn("name", F.when(F.col("row_seq") % 10 > 0, F.col("name"))))
    assert some.where("name = '山田太郎'").count() == 100 and some.columns == whole.columns
