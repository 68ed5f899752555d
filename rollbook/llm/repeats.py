"""Repeated byte strings, found in a tree of common-prefix intervals over a sparse, enhanced suffix array.

Every window of `length` bytes has an anchor, the string of `gram` bytes in it with the least hash; equal windows have
equal anchors at the same place. The suffix array holds the suffixes that begin at recurring anchors only, with as much
text around each as its windows take (its context). Suffixes that share no anchor share no window, so the array
falls into independent parts by anchor, which are sorted where they meet.

A stack scan over the common prefixes of neighbouring suffixes gives the interval tree: each node is a set of suffixes
with a common prefix that no larger set has. A node whose suffixes are preceded by different bytes is a maximal repeat;
one whose suffixes all go on to the left alike is widened to the left first. All occurrences of a group are reported.

Equal contexts are one row for each shard before the shuffle, however many documents hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollbook.llm.hashing import BASE, Powers, anchors, mix, segment_hash, texts
from rollbook.llm.shards import combined, ordered, recurring, runs_by_document, sharded, strings, union_of

RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: int, end: int>>, kept binary"
WHO = pa.struct([("flag", pa.bool_()), ("key", pa.int64()), ("dup", pa.int32()), ("start", pa.int32())])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of two suffixes or more; lcp[i] is of suffixes i - 1 and i, lcp[0] is -1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp[1:], -1], 1):
        first = i - 1
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[list[int], int, int]]:
    """Groups of contexts with a common string of `least` bytes or more around the anchor, with all their members.

    left: the bytes before each anchor, backwards; right: those from the anchor on. Yields (members, bytes to the left,
    bytes to the right); every pair of members that share a longer string is also in a group of that string.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [-1, *(common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False))]
    widest = max(map(len, left))
    for prefix, first, last in intervals(lcp):
        if prefix + widest < least:
            continue
        members = sorted(order[first:last + 1], key=left.__getitem__)
        before = [-1, *(common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False))]
        for reach, a, b in intervals(before):
            if reach + prefix >= least:  # the members go on differently to the left of `reach` bytes, and to the right of `prefix`
                yield members[a:b + 1], reach, prefix


def windows_of(buf: np.ndarray, offs: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in some texts: place, first and last window start, hash."""
    n = len(buf) - gram + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    up, down = Powers.get(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[:n])
    fits = np.zeros(len(buf), bool)
    size = np.diff(offs)
    change = np.zeros(len(buf) + 1, np.int8)
    some = size >= length
    np.add.at(change, offs[:-1][some], 1)
    np.add.at(change, offs[1:][some] - length + 1, -1)
    fits = np.cumsum(change[:-1], dtype=np.int8) > 0
    place, lo, hi = anchors(grams, length - gram + 1, fits)
    return place, lo, hi, grams[place]


def repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 100, shard_bytes: int = 8 << 20) -> DataFrame:
    """RESULT for each document: its UTF-8 bytes, how many of them, and which, lie in a string of `length` bytes that also
    starts elsewhere (in any document, or elsewhere in the same one), and the bytes left. Every occurrence goes, the first
    too. Strings are judged on the input and do not cross documents; they may overlap.

    Null and empty texts have no bytes and stay. Rows that are repeated whole, with or without doc_id, repeat each other.
    An empty table gives an empty table. Other columns are not looked at. A text is handled whole, in one task.
    """
    own, shards = sharded(docs, shard_bytes)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, shard = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            of = batch.column(0).to_numpy()
            for lo, hi, buf, offs in texts(batch.column(1)):
                place, _, _, hashes = windows_of(buf, offs, gram, length)
                grams.append(hashes)
                shard.append(of[lo:hi][np.searchsorted(offs, place, "right") - 1])
            k, s, n = combined(np.concatenate(grams), np.concatenate(shard))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["gram", "shard", "n"])

    def contexts(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        """For each context of the shard, once: anchor, its place in it, the text, and the windows' starts in documents."""
        names = ["gram", "shard", "left", "text", "who"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(WHO)]
        parts: list[tuple] = []
        if docs.num_rows and wanted.num_rows:
            docs, dup = ordered(docs)
            wanted_grams = wanted["gram"].to_numpy().view(np.uint64)
            for row, _, buf, offs in texts(strings(docs["text"])):
                place, lo, hi, hashes = windows_of(buf, offs, gram, length)
                some = np.isin(hashes, wanted_grams)
                place, lo, hi, hashes = place[some], lo[some], hi[some], hashes[some]
                if len(place):
                    doc = np.searchsorted(offs, lo, "right") - 1
                    same = segment_hash(buf, lo, hi + length) * np.uint64(BASE) + (place - lo).astype(np.uint64)
                    parts.append((hashes, same, place - lo, [buf[a:b].tobytes() for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)], doc + row, lo - offs[doc]))
        if not parts:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        hashes, same, left, doc, start = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 4, 5))
        text = [x for p in parts for x in p[3]]
        order = np.lexsort((same, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (same[order[1:]] != same[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
        first = np.flatnonzero(new)
        one = order[first]
        d = doc[order]
        who = pa.StructArray.from_arrays([pa.array(docs["flag"].to_numpy()[d]), pa.array(docs["key"].to_numpy()[d]), pa.array(dup[d]), pa.array(start[order].astype(np.int32))], fields=list(WHO))
        shard = int(docs["shard"][0].as_py())
        return pa.Table.from_arrays([pa.array(hashes[one].view(np.int64)), pa.array(np.full(len(one), shard, np.int32)), pa.array(left[one].astype(np.int32)), pa.array([text[i] for i in one.tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), who)], names=names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        grams, left = table["gram"].to_numpy(), table["left"].to_numpy()
        order = np.argsort(grams, kind="stable")
        edge = np.flatnonzero(np.append(True, grams[order[1:]] != grams[order[:-1]]))
        many = table["who"].combine_chunks().value_lengths().to_numpy()
        text = table["text"]
        rows, starts, ends = [], [], []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            group: dict[tuple[int, bytes], list[int]] = {}
            for row in order[a:b].tolist():
                group.setdefault((int(left[row]), text[row].as_py()), []).append(row)
            alone = {}
            for number, ((n, string), own_rows) in enumerate(group.items()):
                if len(own_rows) > 1 or many[own_rows[0]] > 1:
                    rows += own_rows
                    starts += [0] * len(own_rows)
                    ends += [len(string)] * len(own_rows)
                else:
                    alone[number] = [own_rows[0], n, n]
            if alone and len(group) > 1:
                before, after = [s[:n][::-1] for n, s in group], [s[n:] for n, s in group]
                for members, to_left, to_right in maximal_repeats(before, after, length):
                    for m in members:
                        if m in alone:  # all of a context's repeats hold its anchor, so together they are one run
                            seen, n = alone[m], len(before[m])
                            seen[1] = min(seen[1], n - to_left)
                            seen[2] = max(seen[2], n + to_right)
                for row, start, end in alone.values():
                    if end > start:
                        rows.append(row)
                        starts.append(start)
                        ends.append(end)
        if not rows:
            return
        took = table.select(["shard", "who"]).take(pa.array(rows))
        who = took["who"].combine_chunks()
        per = who.value_lengths().to_numpy()
        who, row = who.flatten(), np.repeat(np.arange(len(rows)), per)
        yield pa.RecordBatch.from_arrays([pa.array(took["shard"].to_numpy()[row]), who.field("flag"), who.field("key"), who.field("dup"), pa.array((who.field("start").to_numpy() + np.array(starts)[row]).astype(np.int32)), pa.array((np.array(ends) - np.array(starts))[row].astype(np.int32))], names=["shard", "flag", "key", "dup", "start", "n"])

    def take_out(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs, dup = ordered(docs)
        n_bytes, n_removed, spans, kept = [], [], [], []
        for text, (start, n) in zip(docs["text"], runs_by_document(found, docs, dup), strict=True):
            raw = text.as_py().encode()
            a, b = union_of(start, start + n)
            n_bytes.append(len(raw))
            n_removed.append(int((b - a).sum()))
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            left, at = [], 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                left.append(raw[at:x])
                at = y
            kept.append(b"".join([*left, raw[at:]]))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
        return pa.Table.from_arrays([docs["doc_id"].combine_chunks(), *(pa.array(x, k) for x, k in zip((n_bytes, n_removed, spans, kept), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    sampled = own.select("shard", "text").mapInArrow(sample, "gram long, shard int, n int")
    dealt = own.repartition(shards, "shard")
    held = dealt.groupBy("shard").cogroup(recurring(sampled).repartition(shards, "shard").groupBy("shard")).applyInArrow(contexts, "gram long, shard int, left int, text binary, who array<struct<flag: boolean, key: long, dup: int, start: int>>")
    runs = held.repartition(shards, "gram").mapInArrow(found, "shard int, flag boolean, key long, dup int, start int, n int")
    return dealt.groupBy("shard").cogroup(runs.repartition(shards, "shard").groupBy("shard")).applyInArrow(take_out, RESULT)
