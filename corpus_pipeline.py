"""A corpus from documents: quality rules, near-duplicates, personal data, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.line_quality import quality
from rollbook.llm.mixing import mix
from rollbook.llm.packing import pack
from rollbook.llm.pii import personal_data
from rollbook.llm.setsketch import near_duplicates
from rollbook.llm.shared import collecting, dropped, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has no tokenizer, no tagger and no Newton steps; the stages are tested against brute-force versions.
ORACLE_SQL = None


def with_verdict(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs joined to a verdict, one row for each doc_id. Rows that share a doc_id, or have none, share its verdict."""
    return docs.select(COLUMNS).join(verdict.withColumnRenamed("doc_id", "judged"), F.col("doc_id").eqNullSafe(F.col("judged")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the frequent lines of their hosts; n_chars follows the text.

    Exact copies count once among the documents with a line, as one of each group has to reach the next stage.
    """
    good = quality(docs, copies=False, cleaned=True, keep=["lang", "source"]).where("kept")
    return good.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id (words of five, similarity 0.8).

    Of rows that share a doc_id the one with the first text stays; all rows without a doc_id stay.
    """
    named, others = docs.where("doc_id is not null"), docs.where("doc_id is null").select(COLUMNS)
    keep = near_duplicates(named).where("kept").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return named.select(COLUMNS).join(keep, "doc_id", "left_semi").withColumn("copy", first).where("copy = 1").select(COLUMNS).unionByName(others)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    seen = personal_data(docs.select("doc_id", "text", "lang", "source"), redact=True, keep=["lang", "source"])
    return seen.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target asks for; none of some."""
    taken = mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    return with_verdict(docs, taken).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their token ids."""
    return pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each but the last written to the shared folder; a stage's input, and the tables that it
    wrote on its way, go when it is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        with collecting() as tables:
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs.written_at = path
        for table in [*tables, before]:
            if table is not None:
                dropped(table)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
