import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import pii
from rollbook.llm.bilstm_crf import KINDS, Tagger, char_ids, encoded, labelled, luhn

CARD, PHONE = "4111111111111111", "+1 (603) 555-8791"


def plain_rules(text):
    """The rules by their expressions, as they are stated."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", m.start(), m.end())] * (16 <= len(digits) <= 19 and luhn(digits))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab1290.@+-% ()é\n_"), max_size=40) | st.lists(st.sampled_from(["a@b.c", "@", "x.y@z", ".com", "1.2.3.4", "255.", "256.1", CARD, "-", " ", "+1", "(2)", "3456789", "é", "@d.e"]), max_size=10).map("".join))
def test_rules_are_their_expressions(text):
    assert pii.base_spans(text) == plain_rules(text)


def test_long_texts_take_no_longer_than_their_length():
    for piece in ("a", "1", "1.", "@a.", "+1", " @a.b", "a@b.c", "x", "1 @", "(at) "):
        text = piece * (1_000_000 // len(piece)) + "@"
        began = time.process_time()
        pii.base_spans(text)
        pii.windows(text)
        assert time.process_time() - began < 10


def test_gradients_are_those_of_the_loss():
    tagger = Tagger(hidden=4, seed=3, kind=np.float64)
    ids, tags, length = encoded(labelled(6, seed=8))
    ids, tags, length = ids[:, :20], tags[:, :20], np.minimum(length, 20) - np.arange(6)
    assert tagger.loss(ids, tags, length) == pytest.approx(tagger.step(ids, tags, length)[0])
    _, grad = tagger.step(ids, tags, length)
    rng = np.random.default_rng(0)
    for name, p in tagger.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape) if name[0] != "x" else (ids[0, rng.integers(0, length[0])], rng.integers(0, p.shape[1]))
            was = p[at]
            p[at] = was + 1e-5
            up = tagger.step(ids, tags, length)[0]
            p[at] = was - 1e-5
            down = tagger.step(ids, tags, length)[0]
            p[at] = was
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_viterbi_finds_the_best_tagging():
    tagger = Tagger(hidden=3, kind=np.float64)
    rng = np.random.default_rng(1)
    e = rng.normal(0, 2, (4, 3, len(KINDS) * 2 + 1))
    length = np.array([4, 3, 1])
    got = tagger.viterbi(e, length)
    for n in range(3):
        best = max(np.ndindex(*(9,) * length[n]), key=lambda path: sum(e[t, n, k] for t, k in enumerate(path)) + sum(tagger.p["move"][a, b] for a, b in zip(path, path[1:], strict=False)))
        assert tuple(got[n, :length[n]]) == best


def test_held_out_spans_are_found():
    examples = labelled(800, seed=4242)
    found = pii.trained().spans([char_ids(text) for text, _ in examples])
    hit = miss = false = 0
    for (_, want), got in zip(examples, found, strict=True):
        want, got = set(want), {(k, a, b) for k, a, b, sure in got if sure >= pii.SURE}
        hit, miss, false = hit + len(want & got), miss + len(want - got), false + len(got - want)
    assert hit / (hit + false) > 0.95 and hit / (hit + miss) > 0.9


@pytest.mark.parametrize("text", ["call (603) 555-8791 today", "mail joe.x @ foo.com please", "or write to jane (at) foo (dot) com now", "no data here", "token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" x", "Version 2.0 of 2024-05-01"])
def test_added_spans(text):
    added = pii.added_spans([text], [pii.base_spans(text)], pii.trained())[0]
    assert [text[a:b] for _, a, b in added] == {"c": ["(603) 555-8791"], "m": ["joe.x @ foo.com"], "o": ["jane (at) foo (dot) com"]}.get(text[0], [])


def test_windows_cover_every_trigger():
    text = "a" * 200 + "1" * 100 + "b" * 500 + "@" + "c" * 10
    cut = pii.windows(text)
    for m in pii.TRIGGER.finditer(text):
        assert any(a <= m.start() < b for a, b in cut)
    assert all(b - a <= pii.WIDTH for a, b in cut) and pii.windows("") == []


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(KINDS), st.text(st.sampled_from("ab.+- ()[]/dot"), max_size=40))
def test_nothing_can_be_added_where_no_window_is(kind, text):
    assert pii.TRIGGER.search(text) or not text or not pii.valid(kind, text)


def test_spans_that_edges_cut_are_joined():
    assert pii.joined([("email", 10, 64, 0.95, False, True), ("email", 32, 90, 0.95, True, False)]) == [("email", 10, 90, pytest.approx(0.95))]
    assert pii.joined([("email", 10, 64, 0.9, False, True), ("email", 32, 96, 0.9, True, True), ("email", 64, 99, 0.9, True, False)]) == [("email", 10, 99, pytest.approx(0.9))]
    assert pii.joined([("email", 10, 64, 0.9, False, True), ("ip", 32, 90, 0.9, True, False), ("email", 70, 90, 0.9, True, False), ("ip", 95, 99, 0.8, False, False)]) == [("ip", 95, 99, 0.8)]


def unusual(rng):
    """Writings that the rules do not read, put together otherwise than the training texts."""
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(3, 11)))
    part = lambda: rng.randint(1, 254)
    area = rng.choice(["212", "415", "617", "303"])
    long_host = word() + "".join(rng.choice(".-") + word() for _ in range(rng.randint(1, 6)))
    return rng.choice([("email", f"{word()}.{word()} @ {long_host}.edu"), ("email", f"{word()} (at) {word()}.com"), ("ip", f"{part()} . {part()} . {part()} . {part()}"), ("phone", f"({area}) 555-{rng.randint(1000, 9999)}"), ("phone", f"{area}-555-{rng.randint(1000, 9999)}"), ("card", "4111 1111 1111 1111".replace(" ", rng.choice("./")))])


def test_spans_planted_in_documents_are_found(spark, sf):
    """Unusual writings at random places of the given documents: found whole, and little else."""
    rng = random.Random(9)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 100").orderBy("doc_id").collect()]
    planted = []
    for text in texts:
        at = text.find(" ", rng.randrange(len(text) - 50)) + 1
        kind, piece = unusual(rng)
        planted.append((text[:at] + piece + " " + text[at:], (kind, at, at + len(piece))))
    before = pii.added_spans(texts, [pii.base_spans(t) for t in texts], pii.trained())
    after = pii.added_spans([t for t, _ in planted], [pii.base_spans(t) for t, _ in planted], pii.trained())
    assert sum(map(len, before)) <= len(texts) / 50
    assert sum(span in got for (_, span), got in zip(planted, after, strict=True)) > 0.85 * len(texts)


def test_long_spans_are_found_whole_at_any_place(spark, sf):
    """Addresses of up to 200 characters, longer than a window, in the given documents: nine tenths of every class of length."""
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 100").orderBy("doc_id").collect()]
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(3, 11)))
    planted = []
    for _ in range(500):
        local, host, size = word(), word(), rng.choice([20, 50, 80, 120, 180])
        while len(local) + len(host) < size:
            local, host = (local + rng.choice("._") + word(), host) if rng.random() < 0.35 else (local, host + "." + word())
        text, piece = rng.choice(texts), f"{local} @ {host}.edu"
        at = text.find(" ", rng.randrange(len(text) - 50)) + 1
        planted.append((text[:at] + piece + " " + text[at:], at, at + len(piece)))
    got = pii.added_spans([t for t, _, _ in planted], [pii.base_spans(t) for t, _, _ in planted], pii.trained())
    classes = {}
    for (_, a, b), spans in zip(planted, got, strict=True):
        classes.setdefault(min((b - a) // 40, 4), []).append(("email", a, b) in spans)
    assert len(classes) == 5 and all(sum(x) >= 0.9 * len(x) for x in classes.values())


def test_long_runs_are_followed_to_their_ends():
    run = "ab." * 50_000
    text = f"x {run}a @ {run}com y"
    began = time.time()
    assert pii.widened(text, "email", len(text) // 2 - 10, len(text) // 2 + 20, 1.0) == ("email", 2, len(text) - 2, 1.0)
    cut = pii.windows(text)
    assert cut[0][0] <= 2 and cut[-1][1] >= len(text) - 2 and all(b > c for (_, b), (c, _) in zip(cut, cut[1:], strict=False))
    pii.added_spans([text], [pii.base_spans(text)], pii.trained())
    assert time.time() - began < 60


def test_reconciling_takes_the_best_set():
    assert pii.reconciled([("ip", 0, 5, 0.9), ("ip", 0, 5, 0.95), ("card", 3, 20, 0.99), ("phone", 20, 25, 0.9)]) == [("card", 3, 20), ("phone", 20, 25)]
    assert pii.reconciled([]) == []


def test_documents(spark, odd_docs, no_docs):
    rows = [(1, f"x a.b@c.de {CARD} and\n{PHONE} x 1.2.3.4 é a@b.c", 7), (2, None, 7), (3, "", 7), (None, "1.2.3.4", 7), (1, "300.1.1.1 12345", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = pii.personal_data(docs, redact=True).collect()
    first = next(r for r in got if r.doc_id == 1 and r.base)
    assert [(s.kind, rows[0][1][s.start:s.end]) for s in first.base] == [("email", "a.b@c.de"), ("email", "a@b.c"), ("ip", "1.2.3.4"), ("card", CARD), ("phone", PHONE)]
    assert first.text == "x <EMAIL> <CARD> and\n<PHONE> x <IP> é <EMAIL>"
    assert {r.text for r in got} == {first.text, None, "", "<IP>", "300.1.1.1 12345"}
    assert pii.personal_data(odd_docs).count() == odd_docs.count() and pii.personal_data(no_docs).collect() == []
