from collections import defaultdict

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from rollbook.llm.mixing import mix, n_words, targets, tilts


def water_level(sizes, total):
    """Targets by resharing the excess over and over."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), total * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_copies(spark, sf, odd_docs):
    for docs, near in ((spark.read.parquet(f"{sf}/documents.parquet"), 0.02), (odd_docs, None)):
        sizes = defaultdict(int)
        for r in docs.collect():
            sizes[r.source] += len(words(r.text))
        want, rows = water_level(sizes, 1.5), mix(docs).collect()
        assert len(rows) == docs.count()
        taken = defaultdict(int)
        for r in rows:
            assert r.copies in (0, 1, 2) and r.source_size == sizes[r.source]
            assert r.target == pytest.approx(want[r.source], rel=1e-9)
            taken[r.source] += r.copies * r.size
        if near:
            for s in sizes:
                assert abs(taken[s] - want[s]) <= max(20, min(near * want[s], max(len(words(r.text)) for r in docs.where(F.col("source") == s).collect())))


def test_tilts_are_those_of_plain_newton_steps(spark, sf):
    sizes = spark.read.parquet(f"{sf}/documents.parquet").select("source", n_words("text").alias("size"))
    goal = targets(sizes)
    cells = sizes.join(goal.select("source", "src"), "source").groupBy("src", "size").agg(F.count("*").alias("n"))
    got = {r.src: r for r in tilts(cells, goal).collect()}
    by = defaultdict(list)
    for r in cells.collect():
        by[r.src].append((r.size, r.n))
    solved = 0
    for r in goal.where("target < source_size * 1.999").collect():
        size, n = np.array(by[r.src], float).T
        x = 0.0
        for _ in range(200):  # damped, so that it ends wherever it starts
            rate = 2 / (1 + np.exp(-x * size))
            x += 0.5 * (r.target - (n * size * rate).sum()) / (n * size * size * rate * (1 - rate / 2)).sum()
        assert (n * size * 2 / (1 + np.exp(-x * size))).sum() == pytest.approx(r.target, rel=1e-6)
        assert got[r.src].tilt / got[r.src].scale == pytest.approx(x, rel=1e-4, abs=1e-9)
        solved += 1
    assert solved > 0


def test_reruns_agree_and_no_rows(spark, odd_docs, no_docs):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(mix(odd_docs).collect(), key=key) == sorted(mix(odd_docs.repartition(3)).collect(), key=key)
    assert mix(no_docs).collect() == []


def test_larger_documents_are_tilted_with_their_source(spark):
    rows = [(i, "w " * (10 if i % 2 else 200), "abc"[i % 3]) for i in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    rate = lambda s, n: (lambda x: sum(x) / len(x))([r.copies for r in got if r.source == s and r.size == n])
    assert rate("c", 200) < rate("c", 10)
