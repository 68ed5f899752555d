"""Roster inputs derived from the test tables, in Spark and in SQL with the same names.

WITH[name] is the SQL of a stand-in; names that it uses come before it in NEEDS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"
NOW = "2001-08-01 00:00:00"
#: The form of the registration numbers in cells(): order keys, which have more than six digits in large tables.
ORDER_KEYS = r"^\d+$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person(c: str) -> F.Column:
    """Names of the customer table with letters for their digits, as names of people have few."""
    return F.translate(F.replace(F.col(c), F.lit("#"), F.lit(" ")), "0123456789", "abcdefghij")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15,000 licences at sf0.01, many for each person; validity by status gives the expiry date."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    years = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    issue = F.col("o_orderdate").cast("date")
    return both.select(
        person("c_name").alias("name"), F.col("o_custkey").cast("string").alias("employee_id"), F.col("o_orderkey").cast("string").alias("license_no"),
        F.when(F.col("o_orderstatus") == "F", "JIS F").when(F.col("o_orderstatus") == "O", "boiler O").otherwise("other P").alias("qualification"),
        F.col("o_orderpriority").alias("category"), issue.alias("issue_date"), F.add_months(issue, years * 12).alias("expiry_date"),
        F.concat(F.lit("emp:"), F.col("o_custkey").cast("string")).alias("person_key"), F.concat(F.lit("lic:"), F.col("o_orderkey").cast("string")).alias("license_key"),
        F.col("o_orderpriority").alias("print_sheet"), F.col("o_orderkey").alias("row_seq"))


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh licence, with some columns blank."""
    own = roster(spark, sf_dir).where("row_seq % 7 = 0")
    return own.select("name", "employee_id", "license_no", "license_key", "person_key", F.when(F.col("row_seq") % 3 != 0, F.col("qualification")).alias("qualification"), F.when(F.col("row_seq") % 3 == 0, F.date_add("issue_date", 30)).alias("issue_date"),
                      F.when(F.col("row_seq") % 2 == 0, F.lit("manual sheet")).otherwise(F.lit(" ")).alias("print_sheet"), F.lit("addr").alias("address"), "row_seq")


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return own.select(F.col("c_custkey").cast("string").alias("employee_id"), person("c_name").alias("name"), F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 15000).cast("int")).alias("birth_date"), F.col("c_mktsegment").alias("department"))


def flags(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four include tables; keys are left out, and flags are null, on purpose."""
    own = roster(spark, sf_dir)
    flag = lambda key: F.when(key % 5 == 0, F.lit(False)).when(key % 5 == 1, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("include")
    customer = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return {
        "people": customer.select(F.concat(F.lit("emp:"), F.col("c_custkey").cast("string")).alias("person_key"), flag(F.col("c_custkey"))),
        "licences": own.where("row_seq % 4 = 1").select("license_key", flag(F.col("row_seq"))),
        "sheets": own.select("print_sheet").distinct().select("print_sheet", (F.col("print_sheet") != "5-LOW").alias("include")),
        "membership": membership(spark, sf_dir).select("license_key", "print_sheet", "include"),
    }


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as memberships: the sheets of a licence are the priorities numbered by its lines."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    name = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "extra", " ", "other", "5-LOW"))), F.col("l_linenumber"))
    keyed = own.select(F.concat(F.lit("lic:"), F.col("l_orderkey").cast("string")).alias("license_key"), name.alias("print_sheet"), "l_linenumber", F.when(F.col("l_orderkey") % 4 == 0, F.col("l_linenumber") != 2).alias("include"))
    return keyed.distinct().withColumn("row_seq", F.col("l_linenumber").cast("long")).drop("l_linenumber")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate")
    return own.groupBy(F.col("l_suppkey").cast("string").alias("report_id"), F.concat(F.lit("lic:"), F.col("l_orderkey").cast("string")).alias("license_key")).agg(F.max(F.col("l_shipdate").cast("date")).alias("created"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return own.select(F.col("s_suppkey").cast("string").alias("report_id"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise(F.lit(" ")).alias("label"), F.lit("").alias("description"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the events table as snapshots; a user is present on a day with any event."""
    own = table(spark, sf_dir, "events")
    return own.select(F.col("user_id").cast("string").alias("rec_key"), F.col("ts").cast("date").alias("snapshot_date"), F.col("event_type").alias("category"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of person filters: include by kind, notes sometimes, deletion by error."""
    own = table(spark, sf_dir, "events")
    return own.select(F.concat(F.lit("emp:"), F.col("user_id").cast("string")).alias("person_key"), (F.col("event_type") != "click").alias("include"), F.when(F.col("event_type") == "view", F.col("props")).alias("notes"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("seq"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets of cells: a title, a header row, then one row for each order; a sheet for each priority."""
    own = table(spark, sf_dir, "orders")
    place = F.floor(F.col("o_orderkey") / 5).cast("int") + 3
    body = own.select(F.lit("book").alias("source"), F.col("o_orderpriority").alias("sheet"), place.alias("row"), F.col("o_orderkey"), F.explode(F.array(
        F.struct(F.lit(0).alias("col"), F.concat(F.lit("name "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij")).alias("value")),
        F.struct(F.lit(1).alias("col"), F.col("o_orderkey").cast("string").alias("value")),
        F.struct(F.lit(3).alias("col"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("JIS plate")).alias("value")),
        F.struct(F.lit(4).alias("col"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("value")))).alias("x"))
    body = body.where("x.value is not null").groupBy("source", "sheet", "row", F.col("x.col").alias("col")).agg(F.min_by("x.value", "o_orderkey").alias("value"))
    sheets = own.select(F.col("o_orderpriority").alias("sheet")).distinct()
    head = sheets.select(F.lit("book").alias("source"), "sheet", F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in ((0, 0, "List"), (1, 0, "氏名"), (1, 1, "番号"), (1, 3, "資格"), (1, 4, "有効期限"))))).alias("x")).select("source", "sheet", "x.*")
    return body.unionByName(head)


_PERSON = "translate(replace({}, '#', ' '), '0123456789', 'abcdefghij')"
_FLAG = "CASE WHEN {0} % 5 = 0 THEN false WHEN {0} % 5 = 1 THEN NULL ELSE true END AS include"
WITH = {
    "roster": f"""roster AS (
  SELECT {_PERSON.format('c_name')} AS name, CAST(o_custkey AS VARCHAR) AS employee_id, CAST(o_orderkey AS VARCHAR) AS license_no,
         CASE o_orderstatus WHEN 'F' THEN 'JIS F' WHEN 'O' THEN 'boiler O' ELSE 'other P' END AS qualification, o_orderpriority AS category,
         CAST(o_orderdate AS DATE) AS issue_date,
         CAST(CAST(o_orderdate AS DATE) + to_months(12 * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS DATE) AS expiry_date,
         'emp:' || o_custkey AS person_key, 'lic:' || o_orderkey AS license_key, o_orderpriority AS print_sheet, o_orderkey AS row_seq
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "manual": """manual AS (
  SELECT name, employee_id, license_no, license_key, person_key, CASE WHEN row_seq % 3 <> 0 THEN qualification END AS qualification,
         CASE WHEN row_seq % 3 = 0 THEN issue_date + 30 END AS issue_date, CASE WHEN row_seq % 2 = 0 THEN 'manual sheet' ELSE ' ' END AS print_sheet,
         'addr' AS address, row_seq FROM roster WHERE row_seq % 7 = 0)""",
    "workers": f"""workers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS employee_id, {_PERSON.format('c_name')} AS name, DATE '1950-01-01' + CAST(c_custkey % 15000 AS INTEGER) AS birth_date,
         c_mktsegment AS department FROM customer WHERE c_custkey % 2 = 0)""",
    "membership": """membership AS (
  SELECT DISTINCT 'lic:' || l_orderkey AS license_key, ['1-URGENT', '2-HIGH', '3-MEDIUM', 'extra', ' ', 'other', '5-LOW'][l_linenumber] AS print_sheet,
         CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber <> 2 END AS include, CAST(l_linenumber AS BIGINT) AS row_seq FROM lineitem)""",
    "people_flags": f"people_flags AS (SELECT 'emp:' || c_custkey AS person_key, {_FLAG.format('c_custkey')} FROM customer WHERE c_custkey % 3 <> 0)",
    "licence_flags": f"licence_flags AS (SELECT license_key, {_FLAG.format('row_seq')} FROM roster WHERE row_seq % 4 = 1)",
    "sheet_flags": "sheet_flags AS (SELECT DISTINCT print_sheet, print_sheet <> '5-LOW' AS include FROM roster)",
    "entries": "entries AS (SELECT CAST(l_suppkey AS VARCHAR) AS report_id, 'lic:' || l_orderkey AS license_key, max(CAST(l_shipdate AS DATE)) AS created FROM lineitem GROUP BY ALL)",
    "definitions": "definitions AS (SELECT CAST(s_suppkey AS VARCHAR) AS report_id, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE ' ' END AS label, '' AS description FROM supplier WHERE s_suppkey % 2 = 0)",
    "snapshots": "snapshots AS (SELECT CAST(user_id AS VARCHAR) AS rec_key, CAST(ts AS DATE) AS snapshot_date, event_type AS category FROM events)",
    "changes": "changes AS (SELECT 'emp:' || user_id AS person_key, event_type <> 'click' AS include, CASE WHEN event_type = 'view' THEN props END AS notes, event_type = 'error' AS deleted, event_id AS seq FROM events)",
    "due": f"""due AS (
  SELECT *, CAST(date_diff('day', DATE '{AS_OF}', expiry_date) AS INTEGER) AS days_to_expiry FROM roster
  WHERE date_diff('day', DATE '{AS_OF}', expiry_date) <= 90)""",
    "cells": """cells AS (
  SELECT 'book' AS source, sheet, row, col, arg_min(value, o_orderkey) AS value FROM (
    SELECT o_orderpriority AS sheet, CAST(o_orderkey // 5 AS INTEGER) + 3 AS row, o_orderkey, x.col, x.value FROM (
      SELECT *, unnest([{'col': 0, 'value': 'name ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'abcdefghij')}, {'col': 1, 'value': CAST(o_orderkey AS VARCHAR)},
                        {'col': 3, 'value': CASE WHEN o_orderkey % 3 = 0 THEN 'JIS plate' END}, {'col': 4, 'value': strftime(o_orderdate, '%Y/%m/%d')}]) AS x FROM orders))
  WHERE value IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'book', sheet, h.r, h.c, h.v FROM (SELECT DISTINCT o_orderpriority AS sheet FROM orders),
    unnest([{'r': 0, 'c': 0, 'v': 'List'}, {'r': 1, 'c': 0, 'v': '氏名'}, {'r': 1, 'c': 1, 'v': '番号'}, {'r': 1, 'c': 3, 'v': '資格'}, {'r': 1, 'c': 4, 'v': '有効期限'}]) AS t(h))""",
}
NEEDS = {"manual": ("roster",), "licence_flags": ("roster",), "sheet_flags": ("roster",), "due": ("roster",)}


def sql(body: str, *names: str) -> str:
    """body after the stand-ins that it names, and those that they need."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*NEEDS.get(name, ()), name) if n not in order]
    return (("WITH " + ",\n".join(WITH[n] for n in order) + "\n") if order else "") + body
