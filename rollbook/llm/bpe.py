"""Byte-level BPE encoding and decoding by a rank file, with each distinct pre-token encoded once.

A task splits its texts into pre-tokens and gives those of a chunk of texts numbers, the most frequent first; a
document is then its pre-tokens' numbers in order. The chunks' pre-tokens are exploded, with the chunk and number that
stand for their positions, and shuffled by their bytes: whoever meets one first encodes it, and its ids go back to
every chunk that has it. There documents are put together from ids by the numbers at their positions. What is shuffled
is a chunk's distinct pre-tokens and one to three bytes a position, never a row for each position.

Decoding joins ids to the table of token bytes, which the vocabulary bounds, where they lie.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.hashing import texts

#: Texts of about so many bytes make a chunk, unless one text is longer.
CHUNK_BYTES = 32 << 20
#: They are split into pre-tokens so many bytes at a time.
PIECE_BYTES = 1 << 20
#: Their numbers, and the ids of these, are worked out for about so many positions at a time.
SLICE = 1 << 19
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# Endings that are split from words, by the letters behind the apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")
INNER = "_chunk long, _numbers binary, _words binary"
CODE = np.dtype("<u4")


@lru_cache(maxsize=4)
def ranks(vocabulary: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point, as the tokenizer's own expressions have them."""
    import tiktoken

    every = np.concatenate([np.arange(0xD800, dtype=CODE), np.arange(0xE000, 0x110000, dtype=CODE)]).tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, expression in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("classes", pat_str=expression, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(found.encode_ordinary(every)).decode().encode("utf-32-le"), CODE)] = kind
    return out


def pretoken_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in buf, which they fill; texts begin at offs[:-1].

    They are runs of one class with at most one blank before. Of white space before something else the last character
    stands apart, and a blank there belongs to what follows; an apostrophe that opens a pre-token takes an ending with it.
    """
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), CODE)
    n, kind = len(code), classes()[code]
    first = np.zeros(n + 3, bool)
    first[np.searchsorted(at, offs[:-1])] = True
    first[n:] = True
    changes = first[:n].copy()
    changes[1:] |= kind[1:] != kind[:-1]
    start = changes.copy()
    after = np.flatnonzero(~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[code[after - 1] == ord(" ")]] = False
    quote = np.flatnonzero((code == ord("'")) & changes)
    quote = quote[first[quote] | (code[quote - 1] != ord(" "))]
    padded = np.append(code, np.zeros(3, code.dtype))
    one, two = np.where(first[quote + 1], 0, padded[quote + 1]), np.where(first[quote + 1] | first[quote + 2], 0, padded[quote + 2])
    for length, ending in ((2, np.isin(one, [ord(x) for x in SHORT_ENDINGS])), (3, np.logical_or.reduce([(one == ord(x[0])) & (two == ord(x[1])) for x in LONG_ENDINGS]))):
        p = quote[ending]
        start[p + 1] = False
        p = p[p + length < n]
        start[p + length] = True
    return at[start]


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**28 as groups of seven bits, the lowest first, the last marked; and how many bytes each takes."""
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(4):
        some = size > i
        out[(end - size)[some] + i] = (numbers[some] >> (7 * i)) & 127
    out[end - 1] |= 128
    return out, size


def from_varints(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data & 128)
    first = np.append(0, last[:-1] + 1)[: len(last)]
    out = np.zeros(len(last), np.int64)
    for i in range(4):
        some = first + i <= last
        out[some] |= (data[first[some] + i] & 127).astype(np.int64) << (7 * i)
    return out


def gathered(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[w]:offsets[w + 1]] for each w of which, one after another, and where each begins."""
    size = offsets[which + 1] - offsets[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(offsets[which] - ends[:-1], size) + np.arange(ends[-1])], ends


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def large(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offs[0]:offs[-1]], offs - offs[0]


def zipped(array: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", array.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([array], ["w"]))
    return sink.getvalue().to_pybytes()


def numbered(column: pa.Array) -> tuple[list[bytes], pa.Array]:
    """For each text the bytes of its pre-tokens' numbers, and the pre-tokens by number, frequent ones first."""
    starts, ends, done = [], [np.zeros(1, np.int64)], 0
    for _, _, buf, offs in texts(column, PIECE_BYTES):
        if len(buf):
            starts.append(pretoken_starts(buf, offs) + done)
        ends.append(offs[1:] + done)
        done += len(buf)
    _, _, buf, _ = next(texts(column, 1 << 62))
    start = np.concatenate([*starts, [done]])
    del starts
    cut = np.searchsorted(start, np.concatenate(ends))
    words = binaries(buf, start).dictionary_encode()
    del start
    index = words.indices.to_numpy(zero_copy_only=False)
    counts = sum(np.bincount(index[i:i + SLICE], minlength=len(words.dictionary)) for i in range(0, len(index), SLICE)) if len(index) else np.zeros(0, np.int64)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    out = []
    for low, high in slices(cut):
        data, size = varints(number[index[cut[low]:cut[high]]])
        place = np.concatenate([[0], np.cumsum(size)])[cut[low:high + 1] - cut[low]]
        out += [data[a:b].tobytes() for a, b in zip(place[:-1], place[1:], strict=True)]
    return out, words.dictionary.take(pa.array(order))


def slices(cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with about SLICE positions together; cut: where each text's positions begin, and the end."""
    low = 0
    while low < len(cut) - 1:
        high = min(max(low + 1, int(np.searchsorted(cut, cut[low] + SLICE, "right")) - 1), len(cut) - 1)
        yield low, high
        low = high


def in_chunks(batches: Iterator[pa.RecordBatch], text: str, chunk_bytes: int) -> Iterator[pa.Table]:
    """Rows whose texts have about so many bytes together."""
    held, size = [], 0
    for batch in batches:
        for low, high, buf, _ in texts(batch.column(text), chunk_bytes):
            held.append(batch.slice(low, high - low))
            size += len(buf)
            if size >= chunk_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def splitting(keep: list[str], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents, with the numbers of their pre-tokens, then a row with the chunk's pre-tokens."""
        part, n = TaskContext.get().partitionId(), 0
        for table in in_chunks(batches, "_text", chunk_bytes):
            numbers, words = numbered(table["_text"].combine_chunks())
            spelt = zipped(words)
            # two readings of a chunk agree in its name only if they agree in its words
            chunk = name_of(part, n, spelt)
            n += 1
            rows = table.select(keep).append_column("_chunk", pa.array([chunk] * len(table))).append_column("_numbers", pa.array(numbers, pa.binary()))
            yield from rows.append_column("_words", pa.nulls(len(table), pa.binary())).to_batches()
            row = [pa.nulls(1, table.schema.field(c).type) for c in keep] + [pa.array([chunk]), pa.nulls(1, pa.binary()), pa.array([spelt], pa.binary())]
            yield pa.record_batch(row, [*keep, "_chunk", "_numbers", "_words"])

    return run


def name_of(part: int, n: int, spelt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d-%d-" % (part, n) + spelt, digest_size=8).digest(), "little", signed=True)


def spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, chunk, number) for each pre-token of each chunk."""
    for batch in batches:
        for chunk, spelt in zip(batch["_chunk"].to_pylist(), batch["_words"], strict=True):
            if spelt.is_valid:
                words = pa.ipc.open_stream(spelt.as_buffer()).read_all()["w"].combine_chunks().cast(pa.binary())
                table = pa.table([words, pa.array([chunk] * len(words)), pa.array(np.arange(len(words), dtype=np.int32))], ["word", "_chunk", "number"])
                yield from table.to_batches(max_chunksize=1 << 16)


def encoding_by(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For rows in the order of their words, of which equal ones are encoded once: a row for each chunk that a batch has,
        with the steps between its numbers, how many ids each has, and the ids."""
        core, last, ids = encoding(vocabulary)._core_bpe, None, []
        for batch in batches:
            found = []
            for word in batch["word"].to_pylist():
                if word != last:
                    last, ids = word, core.encode_single_piece(word)
                found.append(ids)
            size = np.array([len(x) for x in found], np.int64)
            flat, offs = np.fromiter((i for x in found for i in x), np.int64, int(size.sum())), np.concatenate([[0], np.cumsum(size)])
            chunk, number = batch["_chunk"].to_numpy(), batch["number"].to_numpy()
            order = np.lexsort((number, chunk))
            first = np.flatnonzero(np.diff(chunk[order], prepend=chunk[order[:1]] - 1))
            rows = [(chunk[own[0]], *(varints(x)[0].tobytes() for x in (np.diff(number[own], prepend=0), size[own], gathered(flat, offs, own)[0]))) for own in np.split(order, first[1:]) if len(own)]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["_chunk", "numbers", "sizes", "ids"])

    return run


def ids_by_number(words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's pre-tokens by number, one after another, and where each begins; from rows as encoding_by() has them."""
    number = [np.cumsum(from_varints(np.frombuffer(x, np.uint8))) for x in words["numbers"].to_pylist()]
    size, ids = (from_varints(large(words[c])[0]) for c in ("sizes", "ids"))
    number = np.concatenate(number) if number else np.zeros(0, np.int64)
    order = np.argsort(number, kind="stable")
    if not (number[order] == np.arange(len(order))).all():
        raise RuntimeError("a chunk's pre-tokens do not have one row each: its texts were read twice, and not alike")
    return gathered(ids.astype(CODE), np.concatenate([[0], np.cumsum(size)]), order)


def joining(keep: list[str]):
    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        """A chunk's documents, with the ids of the pre-tokens at their positions."""
        documents = documents.filter(pc.is_null(documents["_words"]))
        flat, offs = ids_by_number(words)
        numbers, places = large(documents["_numbers"])
        counts, ids = [np.zeros(0, np.int64)], []
        for low, high in slices(places):
            own = numbers[places[low]:places[high]]
            which = from_varints(own)
            if len(which) and which.max() >= len(offs) - 1:
                raise RuntimeError("a chunk lacks pre-tokens: its texts were read twice, and not alike")
            found, ends = gathered(flat, offs, which)
            cut = ends[np.concatenate([[0], np.cumsum(own >> 7, dtype=np.int64)])[places[low:high + 1] - places[low]]]
            counts.append(np.diff(cut))
            ids += [found[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return documents.select(keep).append_column("n_tokens", pa.array(np.concatenate(counts))).append_column("ids", pa.array(ids, pa.binary()))

    return run


def decoding(vocabulary: str, ids: str = "ids"):
    """For tables with a column of ids: their bytes, row by row, from the table of token bytes."""
    table = ranks(vocabulary)
    size = np.full(max(table.values()) + 1, -1, np.int64)
    for word, rank in table.items():
        size[rank] = len(word)
    known = size >= 0
    offs = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    flat = np.frombuffer(b"".join(word for word, _ in sorted(table.items(), key=lambda x: x[1])), np.uint8)

    def run(rows: pa.Table | pa.RecordBatch) -> pa.Array:
        lost = pc.is_null(rows[ids])
        data, at = large(pc.fill_null(rows[ids], b""))
        which, places, out = data.view(CODE), at // CODE.itemsize, []
        for low, high in slices(places):
            own = which[places[low]:places[high]].astype(np.int64)
            if len(own) and (own.max() >= len(known) or not known[own].all()):
                raise ValueError("ids that the vocabulary does not have")
            text, ends = gathered(flat, offs, own)
            cut = ends[places[low:high + 1] - places[low]]
            out += [text[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.array(out, pa.binary(), mask=lost.to_numpy(zero_copy_only=False) if isinstance(lost, pa.Array) else lost.to_numpy())

    return run


def chunked(docs: DataFrame, vocabulary: str, keep: tuple[str, ...], chunk_bytes: int, decode: bool) -> DataFrame:
    own = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([own.schema[c] for c in keep])
    inner = T.StructType(schema.fields + T._parse_datatype_string(INNER).fields)
    # both readers of this exchange use the same one
    chunks = own.mapInArrow(splitting(list(keep), chunk_bytes), inner).repartition("_chunk")
    words = chunks.mapInArrow(spelling, "word binary, _chunk long, number int")
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(encoding_by(vocabulary), "_chunk long, numbers binary, sizes binary, ids binary")
    join = joining(list(keep))

    def run(documents: pa.Table, spelt: pa.Table) -> pa.Table:
        out = join(documents, spelt)
        return out.append_column("decoded", decoding(vocabulary)(out)) if decode else out

    out = T.StructType(schema.fields + T._parse_datatype_string("n_tokens long, ids binary" + ", decoded binary" * decode).fields)
    return chunks.groupBy("_chunk").cogroup(ids.groupBy("_chunk")).applyInArrow(run, out)


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns in `keep`, n_tokens, and ids: a binary of little-endian unsigned 32-bit token ids, without special ones.

    One row for each row of docs. A null text is empty and has no ids. Rows without doc_id or with repeated ones stay apart;
    other columns are not read. Texts that spell out a special token are ordinary text. An empty table gives none.
    """
    return chunked(docs, vocabulary, keep, chunk_bytes, False)


def decoded(tokens: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ids: str = "ids") -> DataFrame:
    """tokens with a column decoded, the bytes of its ids (a binary as encoded() has it); null for null.

    An id that the vocabulary lacks is an error.
    """
    columns = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoding(vocabulary, ids)
        for batch in batches:
            yield pa.record_batch([*(batch[c] for c in columns), decode(batch)], [*columns, "decoded"])

    return tokens.mapInArrow(run, T.StructType(tokens.schema.fields + [T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """decoded(encoded(docs)), each chunk in one task, so that ids do not go to a second Python process."""
    return chunked(docs, vocabulary, keep, chunk_bytes, True)
