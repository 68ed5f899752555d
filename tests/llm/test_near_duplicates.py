import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import words

from rollbook.llm import embedding_dedup, setsketch
from rollbook.llm.shared import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    w = [x.encode().lower().decode() for x in words(text)]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    at = roots(sets, near)
    return {n: (len(sets[n]), at[n], at[n] == n) for n in sets}


def chain(spark):
    """Chains of near copies whose ends are far apart, groups of copies, and pairs on both sides of the limit."""
    rng = random.Random(5)
    rows, n = [], 0
    for length in (12, 40, 150, 600):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(25):
            rows.append((n, " ".join(base)))
            base = list(base)
            for k in range(max(1, length // 50)):
                base[rng.randrange(length)] = f"v{n}x{k}"
            n += 1
        rows.append((n, " ".join(base).upper()))
        n += 1
    for length in (40, 160):
        one = [f"a{length}_{i}" for i in range(length + 4)]
        for cut in range(0, length // 2, 2):
            rows.append((n, " ".join(one[cut:] + [f"z{n}_{i}" for i in range(cut // 4)])))
            n += 1
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 5, "n") for r in rows], "doc_id long, text string, n long, rep string")


@pytest.mark.parametrize("width", [4, 5])
def test_documents_against_brute_force(spark, sf, width):
    rows, docs = chain(spark)
    given_docs = spark.read.parquet(f"{sf}/documents.parquet")
    for some, frame in ((rows, docs), ([(r.doc_id, r.text) for r in given_docs.collect()], given_docs)):
        got = {r.doc_id: tuple(r)[1:] for r in setsketch.near_duplicates(frame, width).collect()}
        assert got == brute(some, width)


def test_odd_documents(spark, odd_docs, no_docs):
    got = setsketch.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        if r.doc_id in (1, 2):
            assert (r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True)
    assert setsketch.near_duplicates(no_docs).collect() == []


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, share in ((50, 0.8), (400, 0.8), (400, 0.5), (3000, 0.9)):
        both = round(2 * size * share / (1 + share))
        found = []
        for _ in range(20):
            common = rng.integers(0, 2**63, both).astype(np.uint64)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, size - both).astype(np.uint64)])) for _ in range(2)]
            r = setsketch.sketch(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            found.append((r[0] == r[1]).mean())
        assert abs(np.mean(found) - share) < 0.06
    merged = setsketch.sketch(np.unique(np.concatenate(sets)), np.array([0, len(np.unique(np.concatenate(sets)))]))
    assert (merged[0] == np.maximum(r[0], r[1])).all()


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows, docs = chain(spark)
    assert {r.doc_id: tuple(r)[1:] for r in setsketch.near_duplicates(docs, 4).collect()} == brute(rows, 4)
    test_vectors_against_brute_force(spark)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(2000, 2000 + i) for i in range(50)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), "a", "b").collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n != c}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(160):
        v = base[i % 7]
        noise = rng.standard_normal(64)
        noise -= noise @ v / (v @ v) * v
        angle = np.arccos(0.95) + rng.choice([-0.2, -0.1, -1e-6, 1e-6, 0.1])
        rows.append((100 + i, (rng.uniform(0.5, 3) * (np.cos(angle) * v / np.linalg.norm(v) + np.sin(angle) * noise / np.linalg.norm(noise))).tolist()))
    rows += [(400 + i, base[0].tolist()) for i in range(30)] + [(450, (base[0] * 2).tolist())]
    odd = [(500, None), (501, [0.0] * 64), (502, [float("nan")] + [1.0] * 63), (503, [float("inf")] + [1.0] * 63), (504, [None] + [1.0] * 63), (505, []), (506, [1.0, 0.0]), (507, [2.0, 0.1])]
    names, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if unit[a] @ unit[b] >= 0.95]
    degree = defaultdict(int)
    for a, b in near:
        degree[a] += 1
        degree[b] += 1
    at = roots(range(len(rows)), near)
    want = {int(names[i]): (degree[i], int(names[at[i]]), at[i] == i) for i in range(len(rows))}
    want |= {n: (0, n, True) for n in range(500, 506)} | {506: (1, 506, True), 507: (1, 506, False)}
    frame = spark.createDataFrame([(*r, 1, "m") for r in [*rows, *odd]], "vec_id long, embedding array<double>, m int, rep string")
    assert {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_vectors(frame, miss=1e-6).collect()} == want


def test_odd_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(none).collect() == []
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True)] * 2 + [(1, 2, 1, True)] * 2 + [(2, 2, 1, False)]
