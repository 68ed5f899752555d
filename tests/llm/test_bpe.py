"""Ids against the tokenizer library text by text, and decoding as an exact round trip."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from rollbook.llm import bpe
from rollbook.llm.hashing import texts


def check(docs, vocabulary="byte_bpe_50k.tiktoken", **options):
    core = bpe.encoding(vocabulary)
    out = bpe.decoded(bpe.encoded(docs, vocabulary, **options), vocabulary)
    both = bpe.round_trip(docs, vocabulary, **options)
    assert both.columns == out.columns and sorted(map(str, both.collect())) == sorted(map(str, out.collect()))
    got = sorted((r.doc_id is None, r.doc_id or 0, list(np.frombuffer(r.ids, "<u4")), r.n_tokens, bytes(r.decoded)) for r in out.collect())
    want = []
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = core.encode_ordinary(r.text)
        want.append((r.doc_id is None, r.doc_id or 0, ids, len(ids), r.text.encode()))
    assert got == sorted(want)


def test_given_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_documents(spark, odd_docs, no_docs):
    check(odd_docs, chunk_bytes=4000)
    check(odd_docs.repartition(5), "byte_bpe_multi_50k.tiktoken", keep=("doc_id", "n_words", "row"), chunk_bytes=1)
    assert bpe.encoded(no_docs).isEmpty()
    assert bpe.encoded(odd_docs.where("text is null")).collect()[0].n_tokens == 0


def test_pretokens_are_those_of_the_pattern():
    """Every mix of endings, blanks, line breaks, letters, numbers and signs, and all old code points between letters."""
    draw, parts = random.Random(5), ["'", "'s", "'re", "'ll", "'d", "'S", "s", "l", "r", " ", "  ", "\n", "\t", " ", "　", "a", "é", "中", "1", "Ⅷ", "!", "$", "😀", "v", "ve", "e", "\x1c", "́", "​"]
    every = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(20000)]
    old = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    every += [f"a{c}a 1{c} {c}{c}'s" for c in old]
    got = []
    for _, _, buf, offs in texts(pa.array(every), 5000):
        start = bpe.pretoken_starts(buf, offs) if len(buf) else np.zeros(0, int)
        whole = np.union1d(start, offs)
        raw = buf.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(whole[:-1], whole[1:])]
        assert set(offs[:-1][np.diff(offs) > 0]) <= set(start)
        got += pieces
    assert got == [x for text in every for x in regex.findall(public_tokenizers.PATTERN, text)]


def test_each_distinct_pretoken_is_encoded_once(monkeypatch):
    words = [b"a", b"a", b"b", b"b", b"c"]
    class Core:
        seen = []
        def encode_single_piece(self, word):
            self.seen.append(word)
            return [1, 2]
    monkeypatch.setattr(bpe, "encoding", lambda name: type("E", (), {"_core_bpe": Core()}))
    batches = [pa.record_batch([pa.array(w, pa.binary()), pa.array([7, 8, 7][:len(w)]), pa.array(range(at, at + len(w)), pa.int32())], ["word", "_chunk", "number"]) for at, w in ((0, words[:3]), (3, words[3:]))]
    out = list(bpe.encoding_by("any")(iter(batches)))
    assert Core.seen == [b"a", b"b", b"c"]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["_chunk"] for r in rows] == [7, 8, 7, 8] and [bpe.from_varints(np.frombuffer(r["numbers"], np.uint8)).tolist() for r in rows] == [[0, 2], [1], [3], [4]]


def test_chunks_are_split_once(spark, sf):
    plan = bpe.encoded(spark.read.parquet(f"{sf}/documents.parquet"))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text


def test_varints():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1] * 3)
    data, size = bpe.varints(numbers)
    assert (bpe.from_varints(data) == numbers).all() and size.sum() == len(data)
    assert len(bpe.from_varints(np.zeros(0, np.uint8))) == 0 and len(bpe.varints(np.zeros(0, np.int64))[0]) == 0


def test_unknown_ids_and_null_ids(spark):
    none = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert [r.decoded for r in bpe.decoded(none).orderBy("doc_id").collect()] == [None, bytearray()]
    with pytest.raises(Exception, match="vocabulary does not have"):
        bpe.decoded(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id long, ids binary")).collect()
