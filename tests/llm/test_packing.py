import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rollbook.llm.packing import best_windows, pack, tokenizer


def tokens(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check(docs, rows, window=1024):
    want = defaultdict(int)
    for r in docs.collect():
        want[(r.doc_id, tuple(tokens(r.text)))] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for (name, ids), times in want.items():
        own = [r for r in by_doc[name] if r.doc_tokens == len(ids)]
        assert sum(r.length for r in own) == times * len(ids) or sum(1 for k in want if k[0] == name) > 1
        for r in own:
            if times == 1 and len([k for k in want if k[0] == name]) == 1:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        end = 0
        for r in own:
            assert r.offset == end and r.length > 0
            end += r.length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    return padding / sum(r.length for r in rows)


def test_every_id_is_packed_once_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check(docs, pack(docs).collect()) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs, pack(odd_docs).collect())
    assert pack(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_windows_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    window = 16
    at = np.unique(np.concatenate([[0, 60], np.arange(0, 60, window), rng.integers(0, 60, 20)]))
    cost = rng.integers(0, 9, len(at)).astype(float)

    def price(chosen):
        lengths = np.diff(chosen)
        return sum((0 if x & (x - 1) == 0 else window - x) + 4 for x in lengths.tolist()) + cost[np.searchsorted(at, chosen[1:])].sum()

    least = {0: 0.0}
    for j in range(1, len(at)):
        least[j] = min(least[i] + (0 if (d := int(at[j] - at[i])) & (d - 1) == 0 else window - d) + 4 + cost[j] for i in range(j) if at[j] - at[i] <= window)
    chosen = np.array(best_windows(at, cost, window, 4))
    assert np.diff(chosen).max() <= window
    assert price(chosen) == pytest.approx(least[len(at) - 1])


def test_fast_ids_are_those_of_the_tokenizer_file(spark, sf):
    encode, _ = tokenizer("byte_bpe_50k")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "\n\n \t", "don't I'LL we're 'S", "１２３ 4567890", "日本語のテキスト。漢字", "é é ﬁ ​", "\x00\x07\x1b", "<|endoftext|> <|x|> <|", "a" * 5000, "🙂👩‍👩‍👧 ok", "x\r\ny\x85z　", "...!!!??", "snake_case CamelCase 3.14e-10"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").limit(200).collect()]
    for text in texts:
        assert list(encode(text)) == whole.encode(text, add_special_tokens=False).ids
