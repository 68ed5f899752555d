"""Quality rules: per-document statistics, and lines that stand in too many documents of their host.

A line is normalised (a-z for A-Z, digits as 0, single spaces) and hashed. For each host (the source of a document)
the distinct documents with a line are counted; with `copies` false, exact copies count as one document. Lines above the
limit are taken out of the text (`cleaned`), and a document with too little left is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.hashing import LOWER, room, segment_hash, texts, window_hash, word_spans
from rollbook.llm.shared import settled, written

STATS = "doc_id long, host string, copy_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: int>>"
REPEAT_WIDTH = 8
_FOLD = LOWER.copy()
_FOLD[48:58] = 48
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values (one for each token) from at[i] to at[i + 1]."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether its owner has it twice or more, and whether it is not the owner's first."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]  # lexsort is stable: equal keys keep their order
    return twice, later


def lines_of(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where lines begin and stop, the number of their first word and of the word after their last."""
    # a text begins a line, and so does what follows a line feed
    breaks = np.flatnonzero(buf == 10)
    begin = np.concatenate([offs[:-1], breaks + 1])
    stop = np.concatenate([offs[1:], breaks])
    begin, stop = np.sort(begin, kind="stable"), np.sort(stop, kind="stable")
    return begin, stop, np.searchsorted(starts, begin), np.searchsorted(starts, stop)


def line_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each normalised line, from its words lo to hi."""
    return segment_hash(segment_hash(_FOLD[buf], starts, ends), lo, hi)


def text_stats(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Statistics by text; then the normalised lines that have words: their text, hash and number of words."""
    n = len(offs) - 1
    starts, ends, first = word_spans(buf, offs)
    words = np.diff(first)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    out = {"n_words": words, "word_chars": per_text(lead[ends] - lead[starts], first), "n_symbols": per_text(_SYMBOL[buf], offs)}
    owner = np.repeat(np.arange(n), words)
    fits = room(first, REPEAT_WIDTH)
    windows = window_hash(segment_hash(buf, starts, ends), REPEAT_WIDTH)
    at = np.flatnonzero(fits)
    twice, _ = repeated(windows[at], owner[at])
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + REPEAT_WIDTH, -1)
    out["n_repeat_words"] = per_text(np.cumsum(change[:-1]) > 0, first)
    begin, stop, lo, hi = lines_of(buf, offs, starts)
    kept = hi > lo
    begin, stop, lo, hi = begin[kept], stop[kept], lo[kept], hi[kept]
    line_owner = owner[lo] if len(lo) else np.zeros(0, np.int64)
    _, later = repeated(segment_hash(buf, begin, stop), line_owner)
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n)
    return out, line_owner, line_hashes(buf, starts, ends, lo, hi), hi - lo


def among(owner: np.ndarray, keys: np.ndarray, some_owner: np.ndarray, some_keys: np.ndarray) -> np.ndarray:
    """Whether each (owner, key) is one of some."""
    o, k = np.concatenate([some_owner, owner]), np.concatenate([some_keys, keys])
    other = np.arange(len(o)) >= len(some_owner)
    order = np.lexsort((other, k, o))  # of equal pairs those of some come first
    o, k = o[order], k[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    found = np.zeros(len(o), bool)
    found[order] = ~other[order][first]
    return found[len(some_owner):]


def without_lines(buf: np.ndarray, offs: np.ndarray, gone_owner: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """buf and offs of the texts joined from the lines whose hash is not among their text's gone ones."""
    starts, ends, _ = word_spans(buf, offs)
    begin, stop, lo, hi = lines_of(buf, offs, starts)
    owner = np.repeat(np.arange(len(offs) - 1), 1 + per_text(buf == 10, offs))
    stays = (hi == lo) | ~among(owner, line_hashes(buf, starts, ends, lo, hi), gone_owner, gone)
    at = np.flatnonzero(stays)
    change = np.zeros(len(buf) + 1, np.int64)
    np.add.at(change, begin[at], 1)
    np.add.at(change, stop[at], -1)
    held = np.cumsum(change[:-1]) > 0
    followed = at[:-1][owner[at[:-1]] == owner[at[1:]]]  # the last line that stays loses its line feed
    held[stop[followed]] = True
    return buf[held], np.concatenate([[0], np.cumsum(per_text(held, offs))])


def cleaned_texts(column: pa.Array, gone: pa.Array) -> pa.Array:
    """A string column without the lines whose hashes are in gone, a list for each text; a null list takes nothing."""
    some = pc.fill_null(pc.greater(pc.list_value_length(gone), 0), False)
    lists = gone.filter(some)
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    hashes = np.asarray(lists.flatten()).view(np.uint64)
    parts = []
    for lo, hi, buf, offs in texts(column.filter(some)):
        a, b = np.searchsorted(owner, [lo, hi])
        data, at = without_lines(buf, offs, owner[a:b] - lo, hashes[a:b])
        parts.append(pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(column.type))
    return pc.replace_with_mask(column, some, pa.concat_arrays(parts)) if parts else column


def document_stats(docs: DataFrame, along: list[str] | None = None) -> DataFrame:
    """STATS for each document; lines has every distinct normalised line once, with the words that it has in all.

    Unless `along` is None, the text goes along too, and the columns named in it as own_0, own_1 and so on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(2)):
                out, owner, line, words = text_stats(buf, offs)
                order = np.lexsort((line, owner))
                owner, line, words = owner[order], line[order], words[order]
                new = np.ones(len(line), bool)
                new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                sums = np.add.reduceat(words, first) if len(first) else words
                pairs = pa.StructArray.from_arrays([pa.array(line[first].view(np.int64)), pa.array(sums.astype(np.int32))], names=["line", "words"])
                where = np.searchsorted(owner[first], np.arange(hi - lo + 1)).astype(np.int32)
                copy = segment_hash(buf, offs[:-1], offs[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(copy),
                    *(pa.array(out[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.ListArray.from_arrays(pa.array(where), pairs), *(c.slice(lo, hi - lo) for c in batch.columns[2:] if along is not None)],
                    names=[x.split()[0] for x in STATS.split(", ")[:8]] + ["lines"] + [n for n in batch.schema.names[2:] if along is not None])

    used = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(along or [])))
    return used.mapInArrow(run, STATS + "".join(f", {f.name} {f.dataType.simpleString()}" for f in used.schema.fields[2:] if along is not None))


def quality(docs: DataFrame, least_words: int = 20, most_repeat_percent: int = 30, line_limit: int = 20, line_percent: float = 2, line_most: int = 5000, least_left_percent: float = 30,
            copies: bool = True, cleaned: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Statistics and verdict for each document; without cleaned, written in the shared folder.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, frequent_words, base_failed, kept.
    A line is frequent in its host when more than line_limit documents have it, and more than line_percent of the host's
    documents or more than line_most of them. Without copies, documents with the same text count once, so that not all of
    a large group of copies are rejected where duplicates are still to be removed. frequent_words counts the words on
    such lines. A document is kept if it passes the base
    rules and has least_left_percent of its words without its frequent lines, so a short text under a footer stays.

    With cleaned, also `text`: the lines that are not frequent in the document's host, joined by line feeds (a null text
    stays null; a text without frequent lines stays as it is, and lines without words stay), and the columns named in
    `keep` as they are. Texts then go through the shuffle by row.

    Null and empty texts have no words and fail; null source is a host of its own; repeated rows (and null doc_ids) are
    each judged; an empty table gives an empty table; other columns are not looked at. A hot host or line is
    pre-aggregated before its shuffle; the join that brings counts back is one AQE can split.
    """
    if not cleaned:
        return settled(lambda: _quality(docs, least_words, most_repeat_percent, line_limit, line_percent, line_most, least_left_percent, copies, False, []), "quality")
    return _quality(docs, least_words, most_repeat_percent, line_limit, line_percent, line_most, least_left_percent, copies, True, keep or [])


def _quality(docs: DataFrame, least_words: int, most_repeat_percent: int, line_limit: int, line_percent: float, line_most: int, least_left_percent: float, copies: bool, cleaned: bool, keep: list[str]) -> DataFrame:
    stats = written(document_stats(docs, keep if cleaned else None).withColumn("row", F.monotonically_increasing_id()), "stats")
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))
    stats = stats.withColumn("host", host)
    lines = stats.select("host", "row", "copy_hash", F.explode("lines").alias("l")).select("host", "row", "copy_hash", "l.line", "l.words")
    # a document has each line once in `lines`, so documents with a line are counted without a distinct
    each = (lambda df, *by: df.select(*by)) if copies else (lambda df, *by: df.select(*by, "copy_hash").distinct())
    texts_of = each(stats, "host").groupBy("host").agg(F.count("*").alias("texts"))
    often = each(lines, "host", "line").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_limit)
    often = often.join(texts_of, "host").where((F.col("n") * 100 > F.col("texts") * line_percent) | (F.col("n") > line_most)).select("host", "line")
    taken = lines.join(often, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("frequent_words"), *[F.collect_list("line").alias("gone")] * cleaned)
    out = stats.drop("lines").join(taken, "row", "left").withColumn("frequent_words", F.coalesce("frequent_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("frequent_words")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    result = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "frequent_words", failed.alias("base_failed"),
              (~failed & (100 * left >= least_left_percent * F.col("n_words"))).alias("kept")]
    if not cleaned:
        return out.select(*result)
    out = out.select("gone", "text", *result, *(F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, text, *others = batch.columns
            yield pa.RecordBatch.from_arrays([cleaned_texts(text, gone), *others], names=batch.schema.names[1:])

    return out.mapInArrow(run, out.drop("gone").schema)

