import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import words
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import phrases
from rollbook.llm.phrases import repeated_phrases
from rollbook.llm.repeats import intervals, maximal_repeats, repeated_bytes


def family(spark):
    """Documents that share passages, copies, near copies, and runs that repeat in themselves."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefé", k=rng.randint(1, 6))) for _ in range(n))
    shared, rows = text(60), []
    for i in range(60):
        rows.append((i, f"{text(rng.randint(0, 80))} {shared if i % 3 == 0 else text(10)} {text(rng.randint(0, 200))}"))
    near = text(300).split()
    for i in range(60, 90):
        copy = list(near)
        copy[rng.randrange(300)] = f"x{i}"
        rows.append((i, "  \n".join(copy)))
    rows += [(90, "ab " * 600), (91, "ab " * 300), (92, ""), (93, None), (None, rows[3][1]), (None, rows[3][1]), (94, rows[4][1]), (94, rows[4][1]), (94, rows[5][1]), (95, "\x00" * 900)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, shard string")


def brute_phrases(rows, width=20):
    # rows without a doc_id come last; those here are equal
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), Counter()
    for name, text in order:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if key in seen:
                gone |= set(range(i, i + width))
            seen.add(key)
        out[name, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def brute_bytes(rows, length=400):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i:i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = Counter()
    for name, b in raw:
        gone = set()
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone |= set(range(i, i + length))
        runs = sum(i - 1 not in gone for i in gone)
        out[name, len(b), len(gone), runs, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 12, 8 << 20])
def test_phrases_against_brute_force(spark, shard_bytes):
    rows, docs = family(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeated_phrases(docs, shard_bytes=shard_bytes).collect())
    assert got == brute_phrases(rows)
    for r in repeated_phrases(docs).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("shard_bytes", [1 << 12, 8 << 20])
def test_bytes_against_brute_force(spark, shard_bytes):
    rows, docs = family(spark)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeated_bytes(docs, shard_bytes=shard_bytes).collect())
    assert got == brute_bytes(rows)


def test_hot_phrases_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT_PHRASE", 2)
    rows, docs = family(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeated_phrases(docs, shard_bytes=1 << 12).collect())
    assert got == brute_phrases(rows)


def test_the_automaton_finds_phrases_by_their_words():
    rng = np.random.default_rng(4)
    number = rng.integers(0, 3, 4000)
    number[2000:2008], number[3000:3008] = 900, 900
    wanted = np.unique(np.concatenate([number[rng.integers(0, 3990, 50)[:, None] + np.arange(8)], rng.integers(0, 901, (50, 8))]), axis=0)
    which = phrases.located(number, wanted)
    for i in range(len(number)):
        same = np.flatnonzero((wanted == number[i:i + 8]).all(axis=1)) if i + 8 <= len(number) else []
        assert which[i] == (same[0] if len(same) else -1)


def test_nothing_but_the_automaton_locates_phrases(spark, monkeypatch):
    def nowhere(number, wanted):
        return np.full(len(number), -1, np.int64)

    monkeypatch.setattr(phrases, "located", nowhere)
    rows, docs = family(spark)
    assert {r.n_removed for r in repeated_phrases(docs).collect()} == {0}


def test_windows_of_one_hash_are_told_apart_by_their_words():
    number = np.array([1, 2, 3, 4, 1, 2, 3, 9, 1, 2, 3, 4, 9, 9, 1, 2])
    at = np.arange(len(number) - 2)
    seen = [tuple(number[i:i + 3]) for i in at]
    want = [w in seen[:i] for i, w in enumerate(seen)]
    for hashes in (np.zeros(len(at), np.uint64), (at % 3).astype(np.uint64) * 0 + np.array([sum(w) % 4 for w in seen], np.uint64), np.array([hash(w) for w in seen]).astype(np.uint64)):
        assert phrases.not_the_first(hashes, at, number, 3).tolist() == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeated_phrases(odd_docs).collect())
    assert got == brute_phrases(rows)
    assert repeated_bytes(odd_docs).count() == len(rows)
    assert repeated_phrases(no_docs).collect() == [] and repeated_bytes(no_docs).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.text("ab", min_size=1, max_size=8).map(str.encode)), min_size=2, max_size=8), st.integers(1, 8))
def test_every_shared_string_is_in_a_group(contexts, least):
    left, right = [x[0] for x in contexts], [x[1] for x in contexts]
    best: dict[tuple[int, int], int] = {}
    for members, a, b in maximal_repeats(left, right, least):
        assert len({left[m][:a] for m in members}) == 1 and len({right[m][:b] for m in members}) == 1 and a + b >= least
        for m in members:
            for n in members:
                best[m, n] = max(best.get((m, n), 0), a + b)
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    for m in range(len(left)):
        for n in range(len(left)):
            if m != n and (share := common(left[m], left[n]) + common(right[m], right[n])) >= least:
                assert best[m, n] >= share


def test_intervals_are_those_of_a_known_array():
    assert sorted(intervals([-1, 2, 3, 1, 1])) == [(1, 0, 4), (2, 0, 2), (3, 1, 2)]
