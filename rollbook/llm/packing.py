"""Order-preserving packing of tokenised documents into fixed-length windows.

Documents stay in the order of their input partition. A dynamic programme chooses where windows are cut, among document
ends, sentence ends and a grid of every `window` tokens. f(j), the least cost of packing all tokens before cut j, is

    f(j) = cut(j) + per_window + min over i, with at most `window` tokens between i and j, of f(i) + padding(j - i)

Padding is window - (j - i), but nothing at a power of two. For the former only the least f(i) + i in reach matters,
which a monotone queue keeps; the latter are looked up. Nothing is shuffled: each scan partition packs its own
documents, a bounded segment of tokens at a time, so memory follows the segment and the longest document.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_OF_DOCUMENT = 0


@lru_cache(maxsize=2)
def tokenizer(name: str):
    """encode(text) -> ids, and for each id whether its bytes end a sentence.

    The vocabulary's rank file gives the ids of the tokenizer file, several times faster; texts that spell out the
    special token, which the tokenizer file treats apart, go through the tokenizer file.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(max(ranks.values()) + 2, bool)
    for token, rank in ranks.items():
        ends[rank] = token.rstrip(b" \"')]").endswith((b".", b"!", b"?")) or b"\n" in token
    slow = []

    def encode(text: str) -> list[int]:
        if "<|" not in text:
            return fast.encode_ordinary(text)
        if not slow:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode, ends


def cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, sentence_cost: float, inside_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where n tokens may be cut, in order, and what each cut costs."""
    tail = [n - (n & ((1 << k) - 1)) for k in range(window.bit_length())]
    at = np.unique(np.concatenate([[0, n], np.arange(0, n, window), tail, sentence_ends, doc_ends]).astype(np.int64))
    cost = np.full(len(at), float(inside_cost))
    cost[np.searchsorted(at, sentence_ends)] = sentence_cost
    cost[np.searchsorted(at, doc_ends)] = 0
    cost[[0, -1]] = 0
    return at, cost


def best_windows(at: np.ndarray, cost: np.ndarray, window: int, per_window: float) -> list[int]:
    """The cuts, out of `at`, between which the windows of least total cost lie."""
    number = np.full(int(at[-1]) + 1, -1, np.int64)
    number[at] = np.arange(len(at))
    exact: dict[int, list[int]] = {}
    length = 1
    while length <= window:
        j = np.flatnonzero(at >= length)
        i = number[at[j] - length]
        for a, b in zip(j[i >= 0].tolist(), i[i >= 0].tolist(), strict=True):
            exact.setdefault(a, []).append(b)
        length *= 2
    place, price = at.tolist(), cost.tolist()
    least, back = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f(i) + i, place, number
    for j in range(1, len(place)):
        here = place[j]
        while queue[0][1] < here - window:
            queue.popleft()
        total, _, i = queue[0]
        total += window - here
        for x in exact.get(j, ()):
            if least[x] < total:
                total, i = least[x], x
        least[j] = total = total + per_window + price[j]
        back[j] = i
        total += here
        while queue and queue[-1][0] >= total:
            queue.pop()
        queue.append((total, here, j))
    chosen = [len(place) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return [place[x] for x in reversed(chosen)]


def segment_pieces(ids: list[np.ndarray], window: int, sentence_cost: float, inside_cost: float, per_window: float, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(document's number, start, length, window's number, offset, ids) of each piece of a segment."""
    flat = np.concatenate(ids)
    doc_ends = np.cumsum([len(x) for x in ids])
    sentence = np.flatnonzero(ends[np.minimum(flat, len(ends) - 1)]) + 1
    at, cost = cuts(len(flat), doc_ends, sentence, window, sentence_cost, inside_cost)
    chosen = np.array(best_windows(at, cost, window, per_window))
    bounds = np.unique(np.concatenate([chosen, doc_ends]))
    starts = bounds[:-1]
    doc = np.searchsorted(doc_ends, starts, "right")
    of = np.searchsorted(chosen, starts, "right") - 1
    begin = doc_ends - np.array([len(x) for x in ids])
    for a, b, d, w in zip(starts.tolist(), bounds[1:].tolist(), doc.tolist(), of.tolist(), strict=True):
        yield d, int(a - begin[d]), b - a, w, int(a - chosen[w]), flat[a:b]


def pack(docs: DataFrame, window: int = 1024, segment_tokens: int = 1 << 17, sentence_cost: float = 8, inside_cost: float = 32, per_window: float = 4, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence: PIECES, and `ids` (array<int>) with with_ids.

    A document is its text's token ids, then id 0; null or empty text is that id alone, so every document, whatever
    its doc_id (null and repeated ones too), has at least one piece. A sequence is at most `window` tokens; an empty
    table gives an empty table. Other columns are not looked at. sequence_id holds the scan partition's number and
    the sequence's number in it. A segment ends with the first document at or over segment_tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = tokenizer(vocabulary)
        sequence = TaskContext.get().partitionId() << 36
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            rows: list[list] = [[] for _ in range(7 + with_ids)]
            last = -1
            for d, start, length, w, offset, piece in segment_pieces(ids, window, sentence_cost, inside_cost, per_window, ends):
                for column, x in zip(rows, (names[d], start, length, zlib.crc32(piece.tobytes()), len(ids[d]), sequence + w, offset, piece), strict=False):
                    column.append(x)
                last = w
            sequence += last + 1
            names.clear()
            ids.clear()
            held = 0
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            labels = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=labels)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.array(encode(text.as_py() or "") + [END_OF_DOCUMENT], "<u4")
                names.append(name)
                ids.append(tokens)
                held += len(tokens)
                if held >= segment_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
