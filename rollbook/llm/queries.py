"""The queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import sql


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.line_quality import quality

    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.mixing import mix

    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.phrases import repeated_phrases

    out = repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.repeats import repeated_bytes

    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.setsketch import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.embedding_dedup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.warc import archived

    out = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.bilstm_crf import KINDS
    from rollbook.llm.pii import personal_data

    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    place = F.array(*[F.lit(k) for k in KINDS])
    everything = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(place, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counted = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [counted(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(everything).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.quotes import linked

    return linked(as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def as_mail(messages: DataFrame) -> DataFrame:
    """The conversations as mail is written, which quotes what is before it in ways that go by turn % 6: the text before, each
    line behind a > sign (0), all of it on one line (1), below the one before that, behind >> (2) or > > (4), or its
    first line only (3); nothing (5). Nothing else quotes in this table."""
    one = messages.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("t1")).groupBy("conv_id", "turn").agg(F.max("t1").alias("t1"))
    two = messages.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("t2")).groupBy("conv_id", "turn").agg(F.max("t2").alias("t2"))
    both = messages.select("conv_id", "turn", "role", "text").join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    quoted = lambda c, mark: F.coalesce(F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n")), F.lit(""))
    t1, t2 = F.col("t1"), F.col("t2")
    ways = {0: quoted(t1, "> "), 1: quoted(F.replace(t1, F.lit("\n"), F.lit(" ")), "> "), 2: F.concat(quoted(t2, ">> "), quoted(t1, "> ")), 3: quoted(F.substring_index(t1, "\n", 1), "> "), 4: F.concat(quoted(t2, "> > "), quoted(t1, "> "))}
    above = F.coalesce(*(F.when(F.col("turn") % 6 == n, way) for n, way in ways.items()), F.lit(""))
    return both.withColumn("text", F.concat(above, F.col("text"))).select("conv_id", "turn", "role", "text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.filter_audit import audit

    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.merkle import FIELDS, leaf, manifest, proofs

    tampered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    claimed = leaf(**{f: tampered if f == "n_chars" else F.col(f) for f in FIELDS})
    out = proofs(manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), carried={"claimed": claimed}), "claimed")
    text = lambda c: F.lower(F.hex(c))
    return out.select(F.col("key").alias("doc_id"), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollbook.llm.bpe import round_trip

    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_quality, op3_embedding_dedup, op4_pii, op5_setsketch, op6_mixing, op7_repeated_phrases, op8_warc, op9_quotes, op10_repeated_bytes, op11_filter_audit, op12_merkle, op13_bpe)}
SQL: dict[str, str] = {
    "op2_line_quality": sql.LINE_QUALITY,
    "op3_embedding_dedup": sql.EMBEDDING_DEDUP,
    "op5_setsketch": sql.SETSKETCH,
    "op7_repeated_phrases": sql.REPEATED_PHRASES,
    "op8_warc": sql.WARC,
    "op9_quotes": sql.QUOTES,
    "op10_repeated_bytes": sql.REPEATED_BYTES,
    "op11_filter_audit": sql.FILTER_AUDIT,
    "op12_merkle": sql.MERKLE,
}
