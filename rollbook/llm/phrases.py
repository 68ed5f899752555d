"""Removing repeated passages, found by automata over recurring phrases.

Of every window of `width` words one phrase of `phrase` words, the one with the least hash, is its anchor. Equal windows
have equal anchors at the same place, and neighbouring windows mostly share theirs, so about one phrase in seven words
needs counting. Steps:

1. Each anchor phrase is counted by its hash over all documents. One shard that holds it spells out each that recurs, and
   its words are sent to all other shards that hold it.
2. In each shard an Aho-Corasick automaton is compiled of the words sent to it, and of those that it spelt out itself, and
   all its documents are streamed through it. What it finds are the occurrences; no hash is asked. Of the windows around them a shard keeps the first
   of each; later ones are repeats for sure.
3. What shards kept meets by phrase, so a passage in a third of all documents has one row a shard there. All windows
   but the first in the order of (doc_id, start) are repeats. Windows are compared by their words; hashes only bring like
   to like.
4. Repeats return to their documents' shards, where the words that they cover are taken out.

No shard's work sees more than one shard of documents, whatever the size of the corpus. Nothing is removed because of a hash
alone. Of two different recurring phrases with one 64-bit hash, one might not be spelt out (about one such pair is to
be expected among six thousand million recurring phrases).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.hashing import SPACE, anchors, mix, room, segment_hash, texts, window_hash, word_spans
from rollbook.llm.shards import combined, ordered, runs_by_document, shard_of, sharded, strings, union_of

#: A phrase that occurs more often has its windows dealt over many tasks, by a hash of their words.
HOT_PHRASE = 256
SALTS = np.uint64(1 << 20)
#: A shard's distinct words are numbered, and spelt in letters of so many bits: an automaton's state then has few branches.
LETTER_BITS = 6
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept string"


class Words:
    """The words of some texts: `first` has the number of each text's first word, and the end; `hashes` one for each word.

    `norm` holds them one after another with a space behind each, and `begin` where each begins there, and the end.
    """

    def __init__(self, column: pa.Array):
        hashes, first, norm, size, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], 0
        for _, _, buf, offs in texts(column):
            starts, ends, at = word_spans(buf, offs)
            hashes.append(segment_hash(buf, starts, ends))
            first.append(at[1:] + n)
            n += len(starts)
            size.append(ends - starts + 1)
            letters = buf[~SPACE[buf]]
            spaced = np.full(len(letters) + len(starts), 32, np.uint8)
            spaced[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), ends - starts)] = letters
            norm.append(spaced)
        self.hashes, self.first, self.norm, self.begin = np.concatenate(hashes), np.concatenate(first), np.concatenate(norm), np.cumsum(np.concatenate(size))

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.hashes), [None, pa.py_buffer(self.begin), pa.py_buffer(self.norm)])

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words only, and the distinct words in the order of their numbers."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def passages(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Words lo to hi, joined by single spaces, of each passage."""
        norm = self.norm.tobytes()
        return pa.array([norm[a:b - 1] for a, b in zip(self.begin[lo].tolist(), self.begin[hi].tolist(), strict=True)], pa.binary())


def first_places(grams: np.ndarray, place: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The first of the places of each gram that is asked for."""
    place = place[np.isin(grams[place], asked)]
    return place[np.unique(grams[place], return_index=True)[1]]


def located(number: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted phrases (rows of word numbers) begins at each word of a stream, or -1, as their automaton finds them."""
    found = np.full(len(number) + 1, -1, np.int64)
    if not len(wanted) or not len(number):
        return found[:-1]
    size = max(1, -(-int(number.max()).bit_length() // LETTER_BITS))
    spelt = lambda n: (((n[..., None] >> (LETTER_BITS * np.arange(size))) & ((1 << LETTER_BITS) - 1)) + 48).astype(np.uint8).tobytes().decode("ascii")
    stream, phrases, step = spelt(number), spelt(wanted), wanted.shape[1] * size
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n in range(len(wanted)):
        automaton.add_word(phrases[n * step:(n + 1) * step], n)
    automaton.make_automaton()
    for end, n in automaton.iter(stream):
        if (end + 1) % size == 0:
            found[(end + 1 - step) // size] = n
    return found[:-1]


def not_the_first(hashes: np.ndarray, at: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
    """Whether each window has the words of one before it in the arrays.

    at: where windows begin in number, the words' numbers. Hashes sort the windows; each is then compared by its words
    with the one before it. Where windows of one hash differ, all of that hash are told apart by their words alone.
    """
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    a, b = order[same], order[same + 1]
    alike = np.ones(len(same), bool)
    for k in range(width):
        alike &= number[at[a] + k] == number[at[b] + k]
    later = np.zeros(len(at), bool)
    later[b] = True
    if not alike.all():
        some = np.flatnonzero(np.isin(hashes, hashes[a[~alike]]))
        _, first = np.unique(number[at[some][:, None] + np.arange(width)], axis=0, return_index=True)
        later[some] = True
        later[some[first]] = False
    return later


def runs(index: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (in index) of each run of consecutive values of one group."""
    if not len(index):
        return index, index
    new = np.ones(len(index), bool)
    new[1:] = (index[1:] != index[:-1] + 1) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(index)) - 1


def repeated_phrases(docs: DataFrame, width: int = 20, phrase: int = 8, shard_bytes: int = 8 << 20) -> DataFrame:
    """RESULT for each document: how many words [^\\x20\\x09-\\x0D]+ it has, how many of them, and which, lie in a window
    of `width` words that also starts earlier (in a smaller doc_id, or before in the same document), and what is left,
    words joined by one space. Windows are judged on the input and do not cross documents.

    Null and empty texts have no words and stay, with an empty text left. Rows without a doc_id come after all others, in
    the order of a hash of their texts; rows with the same doc_id follow each other in the order of their texts, so
    that of rows that are repeated whole one is kept. An empty table gives an empty table. Other columns are not
    looked at. A text is handled whole, in one task.
    """
    own, shards = sharded(docs, shard_bytes)
    span = width - phrase + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, shard = [], []
            of = batch.column(0).to_numpy()
            for lo, hi, buf, offs in texts(batch.column(1)):
                starts, ends, first = word_spans(buf, offs)
                g = window_hash(segment_hash(buf, starts, ends), phrase)
                place, _, _ = anchors(g, span, room(first, width))
                grams.append(g[place])
                shard.append(of[lo:hi][np.searchsorted(first, place, "right") - 1])
            if grams:
                k, s, n = combined(np.concatenate(grams), np.concatenate(shard))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["gram", "shard", "n"])

    def spell(docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The words of the phrases that this shard is asked for."""
        names, kinds = ["gram", "teller", "hot", "words"], [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        if not docs.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        docs, _ = ordered(docs)
        words = Words(strings(docs["text"]))
        grams = window_hash(words.hashes, phrase)
        place, _, _ = anchors(grams, span, room(words.first, width))
        asked_grams = asked["gram"].to_numpy().view(np.uint64)
        place = first_places(grams, place, asked_grams)
        gram = grams[place]
        hot = np.isin(gram, asked_grams[asked["total"].to_numpy() > HOT_PHRASE])
        shard = np.full(len(place), docs["shard"][0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(gram.view(np.int64)), pa.array(shard), pa.array(hot), words.passages(place, place + phrase)], names=names)

    def first_here(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        """Rows with words: windows that are the shard's first of their kind. Rows without: n windows that are not."""
        names = ["gram", "salt", "flag", "key", "dup", "start", "n", "words"]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        empty = pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        if not docs.num_rows or not wanted.num_rows:
            return empty
        docs, dup = ordered(docs)
        words = Words(strings(docs["text"]))
        first, (number, distinct) = words.first, words.numbered()
        grams = window_hash(words.hashes, phrase)
        place, lo, hi = anchors(grams, span, room(first, width))
        told = wanted.filter(pc.is_valid(wanted["told"]))
        told_grams = told["told"].to_numpy().view(np.uint64)
        own = first_places(grams, place, told_grams)
        own_hot = np.isin(grams[own], told_grams[told["hot"].to_numpy(zero_copy_only=False)])
        sent = wanted.filter(pc.is_null(wanted["told"]))
        phrases = pc.fill_null(pc.index_in(Words(strings(sent["words"])).array(), value_set=distinct), -1).to_numpy().reshape(-1, phrase)
        known = np.flatnonzero((phrases >= 0).all(axis=1))  # a phrase with a word that the shard does not have is none of its own
        phrases = np.concatenate([number[own[:, None] + np.arange(phrase)], phrases[known]])
        hot_phrase = np.concatenate([own_hot, sent["hot"].to_numpy(zero_copy_only=False)[known]])
        which = located(number, phrases)
        hit = which[place] >= 0
        place, lo, hi = place[hit], lo[hit], hi[hit]
        if not len(place):
            return empty
        count = hi - lo + 1
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        owner = np.repeat(np.arange(len(place)), count)
        whole = window_hash(words.hashes, width)[at]
        later = not_the_first(whole, at, number, width)
        doc = np.searchsorted(first, lo, "right") - 1
        hot = hot_phrase[which[place]][owner]
        salt = np.where(hot, whole % SALTS, np.uint64(0)).astype(np.int64)
        parts = []
        key, flag = docs["key"].to_numpy(), docs["flag"].to_numpy()
        for is_later in (False, True):
            index = np.flatnonzero(later == is_later)
            group = doc[owner[index]] if is_later else np.where(hot[index], -1 - index, owner[index])  # windows of hot phrases go alone
            a, b = runs(at[index] if is_later else index, group)
            d = doc[owner[index[a]]]
            g = mix(key[d].view(np.uint64)) if is_later else grams[place[owner[index[a]]]]  # later ones meet nothing: they are spread by document
            n = b - a + 1
            text = pa.nulls(len(a), pa.binary()) if is_later else words.passages(at[index[a]], at[index[a]] + n + width - 1)
            parts.append(pa.Table.from_arrays([pa.array(g.view(np.int64)), pa.array(np.where(is_later, 0, salt[index[a]]).astype(np.int32)), pa.array(flag[d]), pa.array(key[d]), pa.array(dup[d]), pa.array((at[index[a]] - first[d]).astype(np.int32)), pa.array((n if is_later else 0 * n).astype(np.int32)), text], names=names))
        return pa.concat_tables(parts)

    def not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["flag", "key", "dup", "start", "n"]
        held = []
        for batch in batches:
            known = batch.column("words").is_null()
            yield batch.filter(known).select(names)
            held.append(batch.filter(pc.invert(known)))
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        order = np.lexsort(tuple(table[c].to_numpy() for c in ("start", "dup", "key", "flag")))
        table = table.take(pa.array(order)).combine_chunks()
        if not table.num_rows:
            return
        words = Words(strings(table["words"]))
        count = np.diff(words.first) - (width - 1)  # a passage of n windows has n + width - 1 words
        row = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = inner + np.repeat(table["start"].to_numpy().astype(np.int64), count)
        place = inner + words.first[:-1][row]
        later = not_the_first(window_hash(words.hashes, width)[place], place, words.numbered()[0], width)
        index = np.flatnonzero(later)
        a, b = runs(at[index], row[index])
        out = table.take(pa.array(row[index[a]])).select(names[:3]).append_column("start", pa.array(at[index[a]].astype(np.int32))).append_column("n", pa.array((b - a + 1).astype(np.int32)))
        yield from out.combine_chunks().to_batches()

    def take_out(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs, dup = ordered(docs)
        by_doc = runs_by_document(found, docs, dup)
        n_words, n_removed, spans, kept = [], [], [], []
        for text, (start, n) in zip(docs["text"], by_doc, strict=True):
            words = text.as_py().encode().split()
            a, b = union_of(start, start + n + width - 1)
            n_words.append(len(words))
            n_removed.append(int((b - a).sum()))
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            left, at = [], 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                left += words[at:x]
                at = y
            kept.append(b" ".join(left + words[at:]).decode())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        return pa.Table.from_arrays([docs["doc_id"].combine_chunks(), *(pa.array(x, k) for x, k in zip((n_words, n_removed, spans, kept), kinds[1:], strict=True))], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    sampled = own.select("shard", "text").mapInArrow(sample, "gram long, shard int, n int")
    dealt = own.repartition(shards, "shard")
    asked = sampled.groupBy("gram").agg(F.sum("n").alias("total"), F.min("shard").alias("shard")).where("total >= 2")
    spelt = dealt.groupBy("shard").cogroup(asked.repartition(shards, "shard").groupBy("shard")).applyInArrow(spell, "gram long, teller int, hot boolean, words binary")
    # in this join a phrase has one row on one side, and the other can be split
    both = sampled.select("gram", "shard").join(spelt.hint("shuffle_merge"), "gram")
    mine = F.col("shard") == F.col("teller")
    wanted = both.select("shard", "hot", F.when(~mine, F.col("words")).alias("words"), F.when(mine, F.col("gram")).alias("told"))
    found = dealt.groupBy("shard").cogroup(wanted.repartition(shards, "shard").groupBy("shard")).applyInArrow(first_here, "gram long, salt int, flag boolean, key long, dup int, start int, n int, words binary")
    repeats = found.repartition(shards, "gram", "salt").mapInArrow(not_first, "flag boolean, key long, dup int, start int, n int").withColumn("shard", shard_of("key", shards))
    return dealt.groupBy("shard").cogroup(repeats.repartition(shards, "shard").groupBy("shard")).applyInArrow(take_out, RESULT)
