"""What each filter removes in every order of the filters, from wide packed counters.

A document fails some of the filters: its mask, one bit a filter. For a mask, every one of the orders' steps has a known
outcome. An integer with one field for each order, step and outcome holds all of them, so the counts of a part are the
sum of its documents' integers: one addition for 120 orders of five steps. Fields are as wide as the part's number of
documents needs, so none can overflow into the next; documents that share a mask and labels are counted before, on the
map side, so a part sends at most 128 numbers from each task whatever its size.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in (*OUTCOMES, "shapley"))
BREAK = r"[\x20\x09-\x0D]+"


def failing(text: Column) -> list[Column]:
    """Whether a text, not null, fails each of the filters A to D, which look at nothing but the text."""
    words = F.array_remove(F.split(text, BREAK), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < 200, distinct * 100 < n * 50, capitals.cast("long") * 100 > F.length(text).cast("long") * 2, text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail the filters whose bits mask has.

    E looks at the whole table: rows with one text meet by its hash, as one row for each id, part and label after combining.
    Only rows with the smallest id of a text pass; rows that share it, or have none, are identical to no smaller id's.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [fails.cast("int") * (1 << i) for i, fails in enumerate(failing(F.col("_text")))]
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    own = own.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_hash"), sum(bits[1:], bits[0]).alias("_mask"))
    own = own.groupBy("_id", "_hash", "part", "_mask").agg(F.count("*").alias("n"))  # repeated rows are one from here on
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id have no label, and are dealt out by their text
    own = own.withColumn("_key", F.coalesce("_id", F.xxhash64("_hash"))).withColumn("_named", F.col("_id").isNotNull())
    own = own.join(marks.withColumn("_named", F.lit(True)), ["_key", "_named"], "left")
    own = own.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # of each text: its rows, and those with the smallest id
    kinds = ["part", "good", "toxic"]
    first = own.groupBy("_hash").agg(F.min("_id").alias("_least"))
    alike = own.groupBy("_hash", "_mask", *kinds).agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("_unnamed"), F.min("_id").alias("_own"), F.min_by("n", "_id").alias("_own_n"))
    alike = alike.join(first, "_hash")
    passing = F.col("_unnamed") + F.when(F.col("_own") == F.col("_least"), F.col("_own_n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("_mask").alias("mask"), passing.alias("n")), F.struct((F.col("_mask") + 16).alias("mask"), (F.col("_all") - passing).alias("n"))))
    return alike.select(*kinds, split.alias("s")).select(*kinds, "s.*").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def steps() -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) of every step, and outcomes[mask, step, outcome] in {0, 1} for a document without labels, then with both."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    places = [(order, step) for order in orders for step in range(1, len(FILTERS) + 1)]
    out = np.zeros((2, 1 << len(FILTERS), len(places), len(OUTCOMES)), np.uint8)
    for mask in range(1 << len(FILTERS)):
        failed = {f for i, f in enumerate(FILTERS) if mask >> i & 1}
        for at, (order, step) in enumerate(places):
            gone, fails = not failed.isdisjoint(order[:step - 1]), order[step - 1] in failed
            removed = fails and not gone
            out[:, mask, at] = [not (gone or fails), removed, fails and gone, failed == {order[step - 1]}, 0, 0]
            out[1, mask, at, 4:] = removed
    return places, out


@lru_cache(maxsize=1024)
def packed(mask: int, good: bool, toxic: bool, width: int) -> int:
    """The integer of a mask and labels: fields of `width` bytes for every step and outcome, the first one lowest."""
    outcomes = steps()[1][0, mask].copy()
    labelled = steps()[1][1, mask]
    if good:
        outcomes[:, 4] = labelled[:, 4]
    if toxic:
        outcomes[:, 5] = labelled[:, 5]
    fields = np.zeros((outcomes.size, width), np.uint8)
    fields[:, 0] = outcomes.ravel()
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, width: int) -> np.ndarray:
    """counts[step, outcome] of a sum of integers."""
    n = len(steps()[0]) * len(OUTCOMES)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(total.to_bytes(n * width, "little"), np.uint8).reshape(n, width)
    return wide.view("<u8").reshape(-1, len(OUTCOMES)).astype(np.int64)


def summed(table: pa.Table) -> pa.Table:
    """All steps of one part, from its rows of (part, mask, good, toxic, n), at most 128 of them."""
    places = steps()[0]
    n = table["n"].to_pylist()
    width = max(1, (sum(n).bit_length() + 7) // 8)
    total = sum(k * packed(m, g, t, width) for k, m, g, t in zip(n, *(table[c].to_pylist() for c in ("mask", "good", "toxic")), strict=True))
    counts = unpacked(total, width)
    filters = np.array([order[step - 1] for order, step in places])
    shapley = {f: int(counts[filters == f, 1].sum()) for f in FILTERS}
    columns = [pa.array([table["part"][0].as_py()] * len(places)), pa.array([o for o, _ in places]), pa.array([s for _, s in places], pa.int32())]
    columns += [pa.array(counts[:, i]) for i in range(len(OUTCOMES))] + [pa.array([shapley[f] for f in filters], pa.int64())]
    return pa.table(columns, ["part", "filter_order", "step", *OUTCOMES, "shapley"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null: ''), order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley, counted in documents of the part.

    Null texts are empty. A row without doc_id has no labels and passes E; rows that share an id and a text pass it together.
    Several labels of one id count if any of them does. Other columns are not read. Without documents there are no parts.
    """
    return masks(docs, labels).groupBy("part").applyInArrow(summed, AUDIT)
