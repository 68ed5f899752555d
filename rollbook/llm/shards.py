"""Documents dealt into shards that tasks can hold whole, for operators that look for text shared between documents.

A row is known by (flag, key, dup). For a document with a doc_id, flag is false and key is doc_id; one without is known
by a hash of its text and comes after all others. Rows that agree in both lie in the same shard, where dup numbers
them in the order of their texts; rows that agree in their text too are interchangeable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHO = "flag boolean, key long, dup int"


def sharded(docs: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """(shard, flag, key, doc_id, text) for each document, null text as empty, and the number of shards of about shard_bytes."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    own = own.withColumn("flag", F.col("doc_id").isNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    return own.withColumn("shard", shard_of("key", n)).select("shard", "flag", "key", "doc_id", "text"), n


def shard_of(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A shard's documents in the order of (flag, key, dup), and dup."""
    table = table.combine_chunks()
    flag, key = table["flag"].to_numpy(), table["key"].to_numpy()
    order = np.lexsort((key, flag))
    flag, key = flag[order], key[order]
    same = np.zeros(len(key), bool)
    same[1:] = (flag[1:] == flag[:-1]) & (key[1:] == key[:-1])
    dup = np.zeros(len(key), np.int32)
    if same.any():
        text, at = table["text"], 0
        order = order.copy()
        while at < len(key):
            end = at + 1
            while end < len(key) and same[end]:
                end += 1
            if end > at + 1:
                order[at:end] = sorted(order[at:end].tolist(), key=lambda i: text[i].as_py())
                dup[at:end] = np.arange(end - at)
            at = end
    return table.take(pa.array(order)), dup


def runs_by_document(table: pa.Table, docs: pa.Table, dup: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, n) of the rows that lie in each document. table: flag, key, dup, start, n; docs and dup as ordered() has them."""
    key, flag = table["key"].to_numpy(), table["flag"].to_numpy()
    d, start, n = table["dup"].to_numpy(), table["start"].to_numpy(), table["n"].to_numpy()
    order = np.lexsort((start, d, key, flag))
    names = list(zip(docs["flag"].to_pylist(), docs["key"].to_pylist(), dup.tolist(), strict=True))
    at = {name: i for i, name in enumerate(names)}
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
    if len(order):
        k, f, d, start, n = key[order], flag[order], d[order], start[order].astype(np.int64), n[order].astype(np.int64)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(k)], strict=True):
            out[at[bool(f[a]), int(k[a]), int(d[a])]] = (start[a:b], n[a:b])
    return out


def union_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what [start, end) cover; start is in order."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def combined(keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, shard) and how often each occurs."""
    order = np.lexsort((shard, keys))
    k, s = keys[order], shard[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    return k[first], s[first], np.diff(np.append(first, len(k)))


def recurring(sampled: DataFrame) -> DataFrame:
    """(gram, shard, total) of the grams that occur twice or more, and how often; sampled: gram, shard, n.

    Counting combines before its shuffle. In the join a gram has one row on one side, and the other can be split.
    """
    often = sampled.groupBy("gram").agg(F.sum("n").alias("total")).where("total >= 2")
    return sampled.select("gram", "shard").join(often.hint("shuffle_merge"), "gram").select("shard", "gram", "total")


def strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pc.cast(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, pa.large_string())
