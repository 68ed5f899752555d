"""The audit of filters against every document followed through every order, and the packed integers."""

from collections import Counter
from itertools import permutations

import pytest
from conftest import words

from rollbook.llm.filter_audit import OUTCOMES, audit, masks, packed, steps, unpacked


def plain(docs, labels):
    """(part, order, step) -> counts, one document at a time."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    texts = {}
    for d, _, text in docs:
        if d is not None:
            texts[text or ""] = min(d, texts.get(text or "", d))
    out, shapley = Counter(), Counter()
    parts = {s or "" for _, s, _ in docs}
    for d, source, text in docs:
        text, part = text or "", source or ""
        w = words(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = d is not None and d > texts[text]
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                removed = fails[f] and not gone
                found = {"removed": removed, "redundant": fails[f] and gone, "unique_fails": fails[f] and sum(fails.values()) == 1, "good_lost": removed and d in good, "toxic_lost": removed and d in toxic}
                gone = gone or fails[f]
                found["kept"] = not gone
                for k, v in found.items():
                    out[*key, k] += v
                shapley[part, f] += removed
    return {(p, "".join(o), s, *(out[p, "".join(o), s, k] for k in OUTCOMES), shapley[p, o[s - 1]]) for p in parts for o in permutations("ABCDE") for s in range(1, 6)}


def both(docs, labels):
    got = [tuple(r) for r in audit(docs, labels).collect()]
    want = plain([(r.doc_id, r.source, r.text) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert len(got) == len(set(got)) and set(got) == want


def test_given_documents(spark, sf):
    both(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_odd_documents(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(None, "twice", "en", "", 1, 1, "1", 1), (None, "twice", "en", None, 1, 1, "1", 1), (7, "twice", "en", "A|b", 1, 1, "1", 1), (8, "twice", "en", "a", 1, 1, "1", 1),
                                  (8, "twice", "en", "a", 1, 1, "1", 1), (8, "other", "en", "a", 1, 1, "1", 1), (7, "twice", "de", "a", 1, 1, "1", 1)], odd_docs.schema)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (8, 1, 1, "x"), (8, 0, None, "x"), (None, 1, 1, "x"), (4, None, 1, "x"), (100, 1, 0, "x"), (999, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    both(odd_docs.union(more), labels)
    both(odd_docs.union(more), labels.where("false"))
    assert audit(no_docs, labels).isEmpty()


@pytest.mark.parametrize("n", [1, 255, 256, 2**40 - 1, 2**62])
def test_fields_do_not_run_over(n):
    width = (n.bit_length() + 7) // 8
    counts = unpacked(n * packed(31, True, True, width), width)
    assert counts.max() == n and (counts == n * steps()[1][1, 31].astype("int64")).all()
    assert (counts[:, 1].reshape(-1, 5).sum(axis=1) == n).all()  # every order removes all of them once


def test_a_part_sends_few_rows_whatever_its_size(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.unionAll(docs).unionAll(docs)
    assert masks(copies, spark.read.parquet(f"{sf}/labels.parquet")).groupBy("part").count().where("count > 128").isEmpty()
