"""Trees, roots and proofs against a plain one in memory; the stored order of nodes; blocks of hot groups."""

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import merkle
from rollbook.operators.ranges import ranked


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, fields=merkle.FIELDS):
    return h(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        yield [(level[at ^ 1], at & 1)] if at ^ 1 < len(level) else []
        at //= 2


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, root with the claimed leaf) with claimed: n_chars one more where the id is even."""
    groups = defaultdict(list)
    for r in rows:
        claimed = dict(r.asDict(), n_chars=r.n_chars + 1 if r.n_chars is not None and r.doc_id is not None and r.doc_id % 2 == 0 else r.n_chars)
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r), leaf_of(claimed)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names]) if names else []
    out = []
    for at, g in enumerate(names):
        for i, (named, doc, leaf, claimed) in enumerate(sorted(groups[g])):
            path = [*siblings(trees[g], i), *siblings(top, at)]
            for step in path:
                claimed = h(*((step[0][0], claimed) if step[0][1] else (claimed, step[0][0]))) if step else h(claimed)
            out.append((doc if named else None, leaf, trees[g][-1][0], top[-1][0], h(*(s[0][0] for s in path if s)), claimed))
    return sorted(out, key=str)


def check(docs, height=merkle.HEIGHT):
    claimed = merkle.leaf(**{f: F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if f == "n_chars" else F.col(f) for f in merkle.FIELDS})
    got = merkle.proofs(merkle.manifest(docs, carried={"claimed": claimed}, height=height), "claimed").collect()
    assert sorted(((r.key, *(r[c].hex() for c in ("digest", "subroot", "root", "proof", "folded"))) for r in got), key=str) == plain(docs.collect())


@pytest.mark.parametrize("height", [1, 2, 12])
def test_given_documents(spark, sf, height):
    check(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60" if height == 1 else "true"), height)


def test_odd_documents(spark, odd_docs, no_docs):
    check(odd_docs, 3)
    check(odd_docs.where("lang is null"))
    check(odd_docs.select("*", F.lit("x").alias("tree"), F.lit(1).alias("place"), F.lit(1).alias("block")))
    assert merkle.proofs(merkle.manifest(no_docs)).isEmpty()


def test_many_trees(spark):
    """More trees than a block has leaves."""
    check(spark.range(90).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 23).alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text")), 2)


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses_are_a_permutation_with_whole_subtrees(levels):
    at = {(d, i): int(a) for d in range(levels) for i, a in enumerate(merkle.address(levels, d, np.arange(1 << d)))}
    assert sorted(at.values()) == list(range((1 << levels) - 1)) and at[0, 0] == 0
    lower = levels - levels // 2
    if levels > 1:
        for j in range(1 << levels // 2):
            own = sorted(at[levels // 2 + d, (j << d) + i] for d in range(lower) for i in range(1 << d))
            assert own == list(range(own[0], own[0] + (1 << lower) - 1)) and own[0] == (1 << levels // 2) - 1 + j * ((1 << lower) - 1)


def test_any_change_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = merkle.manifest(docs).top[-1].first().root
    for column, value in (("text", F.concat("text", F.lit(" "))), ("source", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1)):
        changed = docs.withColumn(column, F.when(F.col("doc_id") == 17, value).otherwise(F.col(column)))
        assert merkle.manifest(changed).top[-1].first().root != one
    assert merkle.manifest(docs.repartition(5)).top[-1].first().root == one


def test_blocks_are_small_whatever_a_group_holds(spark):
    rows = spark.range(1000).select(F.lit("t").alias("tree"), F.lit(None).cast("long").alias("key"), F.col("id").alias("row"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    layers = merkle.built_layers(ranked(rows, ["tree"], ["key", "row"], 90), 4)
    assert [layer.count() for layer in layers] == [63, 4, 1] and layers[0].where("leaves > 16").isEmpty()
