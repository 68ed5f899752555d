"""Near-duplicate documents by SetSketch registers.

A document's set is its word shingles. Each element draws exponentially distributed points over REGISTERS registers; a
register keeps the least, truncated to a power of BASE (register value = 1 - log of it, rounded down). Such sketches can
be merged by taking the larger register, and the more similar two sets are, the more registers agree.

1. Documents with equal sets form a class, with one sketch and one representative, the smallest doc_id.
2. Registers are banded, four to a band. Each class is compared with the first class of every bucket it lies in.
3. A pair goes on if the joint likelihood of its registers does not speak against a similarity over the limit, and is
   then verified on the full sets. Confirmed links are joined to components.
   Joins that carry texts and registers are asked to sort and merge, whatever the number of pairs: their cost then
   follows the input, and nothing that grows with the data is broadcast.
4. Buckets whose classes are then still in several components are gone through again, in blocks, all against all, so
   that no link is lost; classes already joined need no more links. No list of pairs is made of a large group.

Pairs of sets at the limit miss all bands with a probability of (1 - 0.8**4)**32, under 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.hashing import LOWER, mix, room, segment_hash, texts, window_hash, word_spans
from rollbook.llm.shared import components, settled, written

REGISTERS, PER_BAND = 128, 4
BANDS = REGISTERS // PER_BAND
BASE, RATE = 1.02, 20.0
#: A pair is dropped unverified if a similarity over the limit is less likely than the likeliest one by e**-EVIDENCE.
EVIDENCE = 12.0
#: Classes of one bucket that meet in one block.
BLOCK = 512


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in order, and where each text's begin. A text of fewer words is one shingle."""
    starts, ends, first = word_spans(buf, offs)
    words = segment_hash(LOWER[buf], starts, ends)
    fits = np.flatnonzero(room(first, width))
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))
    hashes = np.concatenate([window_hash(words, width)[fits], segment_hash(words, first[short], first[short + 1])])
    owner = np.concatenate([np.searchsorted(first, fits, "right") - 1, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def sketch(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each set; at: where each begins in hashes. An empty set has zeros.

    An element's points come in rising order, so those above what fills all registers of its set are never drawn.
    """
    size = np.diff(at)
    out = np.full((len(size), REGISTERS), np.inf)
    need = np.log(REGISTERS) + 8
    todo = np.flatnonzero(size > 0)
    while len(todo):
        horizon = np.zeros(len(size))
        horizon[todo] = REGISTERS * need / size[todo]
        owner = np.repeat(np.arange(len(size)), size)
        live = np.flatnonzero(horizon[owner] > 0)
        owner, element, t, drawn, block = owner[live], hashes[live], np.zeros(len(live)), 0, 4
        while len(element):
            keys = mix(element[:, None] + (np.arange(drawn, drawn + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
            register = (keys & np.uint64(REGISTERS - 1)).astype(np.int64)
            t = t[:, None] + np.cumsum(-np.log(((keys >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1)
            good = t <= horizon[owner][:, None]
            row = np.broadcast_to(owner[:, None], t.shape)[good]
            np.minimum.at(out.reshape(-1), row * REGISTERS + register[good], t[good])
            drawn += block
            on = good[:, -1]
            owner, element, t = owner[on], element[on], t[on, -1]
            block = min(block * 4, 1024)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        need *= 4
    registers = np.zeros(out.shape, np.uint16)
    full = size > 0
    registers[full] = np.clip(np.floor(1 - np.log(out[full] / (RATE * REGISTERS)) / np.log(BASE)) + 1024, 0, 65535)
    return registers


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (of the set), bands (the registers, PER_BAND in each long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                hashes, at = shingle_sets(buf, offs, width)
                bands = sketch(hashes, at).view(np.int64)
                both = [segment_hash(x, at[:-1], at[1:]).view(np.int64) for x in (hashes, mix(hashes))]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), *map(pa.array, both),
                    pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))], names=["doc_id", "n", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>")


def likelihoods(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: float, steps: int = 64) -> np.ndarray:
    """Log likelihood of the likeliest similarity over the limit, less that of the likeliest of all.

    more, less: how many registers of a are larger or smaller than those of b; na, nb: sizes of the sets.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
        top = np.minimum(u / v, v / u)
        j = np.linspace(0, 1, steps)[None, :] * top
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        same = np.clip(1 - up - down, 1e-12, 1)
        up, down = np.maximum(up, 1e-12), np.maximum(down, 1e-12)
        value = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(same)
        over = np.where(j >= limit - 1e-9, value, -np.inf)
        over[:, -1] = np.where(top[:, 0] >= limit - 1e-9, value[:, -1], -np.inf)
    return over.max(axis=1) - value.max(axis=1)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: float) -> np.ndarray:
    """Whether each pair of rows of registers a and b may have a similarity of `limit` or more."""
    fits = np.minimum(na, nb) >= limit * np.maximum(na, nb) - 1e-6
    out = np.zeros(len(na), bool)
    at = np.flatnonzero(fits)
    for i in range(0, len(at), 1 << 14):
        k = at[i:i + (1 << 14)]
        more, less = (a[k] > b[k]).sum(axis=1), (a[k] < b[k]).sum(axis=1)
        out[k] = likelihoods(more, less, na[k].astype(float), nb[k].astype(float), limit) >= -EVIDENCE
    return out


def registers_of(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy()).view(np.uint16).reshape(-1, REGISTERS)


def likely_pairs(pairs: DataFrame, classes: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) of classes that go on to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = plausible(registers_of(batch.column(4)), registers_of(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), limit)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"bands{x}"))
    return pairs.join(side("a").hint("shuffle_merge"), "a").join(side("b").hint("shuffle_merge"), "b").select("a", "b", "na", "nb", "bandsa", "bandsb").mapInArrow(run, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of a partition that is sorted by key."""
    held, name = [], None
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in key]
        edge = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
            now = tuple(int(c[lo]) for c in cols)
            if now != name and held:
                yield pa.Table.from_batches(held)
                held = []
            name = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def block_links(mixed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between classes that share a bucket but no component yet; enough of them to join what is linked.

    mixed: band, value, rep, leader, component, n, bands, text. A bucket's classes are dealt into blocks by a hash, as many
    as its size asks for; each two blocks meet in one place, where plausible pairs are verified on their full sets, and
    only what joins two components is put out. A pair is looked at in the first bucket that it shares, and not
    with the bucket's leader, with which all were compared before.
    """
    key = ["band", "value"]
    size = mixed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = mixed.join(size, key).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "component", "n", "bands", "text")
    dealt = dealt.repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y")

    def meet(rows: pa.Table) -> pa.RecordBatch:
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        registers, n = registers_of(rows["bands"].combine_chunks()), rows["n"].to_numpy()
        rep, label, own = rows["rep"].to_numpy(), rows["component"].to_numpy().copy(), rows["own"].to_numpy()
        band, one_block = rows["band"][0].as_py(), rows["x"][0].as_py() == rows["y"][0].as_py()
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                raw = np.frombuffer((rows["text"][i].as_py() or "").encode(), np.uint8)
                sets[i] = shingle_sets(raw, np.array([0, len(raw)]), width)[0]
            return sets[i]

        links: list[tuple[int, int]] = []
        for i in range(len(rep)):
            other = np.flatnonzero((label != label[i]) & (rep > rep[i]) & ((own != own[i]) | one_block))
            other = other[~(bands[other, :band] == bands[i, :band]).any(axis=1)]
            if not len(other):
                continue
            ok = plausible(np.broadcast_to(registers[i], (len(other), REGISTERS)), registers[other], np.full(len(other), n[i]), n[other], percent / 100)
            for j in other[ok].tolist():
                if label[i] != label[j] and similar(set_of(i), set_of(j), percent):
                    links.append((int(rep[i]), int(rep[j])))
                    label[label == label[j]] = label[i]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(meet, grouped(batches, [*key, "x", "y"]))

    return dealt.mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have 100 * intersection >= percent * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents named in the only column of ids, written."""
    need = ids.toDF("doc_id").distinct()
    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(need.hint("shuffle_merge"), "doc_id", "left_semi"), "texts")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    held = texts_of(docs, pairs.select("a").union(pairs.select("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for column, out in ((2, a), (3, b)):
                for lo, hi, buf, offs in texts(batch.column(column)):
                    hashes, at = shingle_sets(buf, offs, width)
                    out += [hashes[at[i]:at[i + 1]] for i in range(hi - lo)]
            keep = [similar(x, y, percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("shuffle_merge"), "a")
    two = one.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("shuffle_merge"), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document, written in the shared folder.

    Words are [^\\x20\\x09-\\x0D]+ with a-z for A-Z; shingles have `width` words, and a text of fewer words is one shingle.
    Documents are linked if 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id
    reachable by links, and that document is kept.

    Null, empty and wordless texts have no shingles and are linked with nothing. Rows that share a doc_id are one document
    with the links of each, and all have its verdict. A row without doc_id is linked with nothing, has no component_id
    and is kept. An empty table gives an empty table. Other columns are not looked at.
    """
    return settled(lambda: _near_duplicates(docs, width, percent), "near-duplicates")


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    limit = percent / 100
    drawn = written(sketches(docs, width), "sketches")
    classes = written(drawn.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("h1", "h2", F.col("r.doc_id").alias("rep"), "n", F.col("r.bands").alias("bands")), "classes")
    spread = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    leaders = spread.groupBy("band", "value").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader != last").drop("last")
    shared = written(spread.join(leaders, ["band", "value"]), "buckets")
    pairs = shared.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(verified(written(likely_pairs(pairs, classes, limit), "pairs"), docs, width, percent), "links")
    joined = components(links, "a", "b")
    placed = shared.join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    others = placed.where("rep != leader")
    mixed = others.groupBy("band", "value").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("band", "value")
    left = written(others.join(mixed, ["band", "value"]), "mixed")
    held = texts_of(docs, left.select("rep"))
    left = left.join(classes.select("rep", "n", "bands").hint("shuffle_merge"), "rep").join(held.withColumnRenamed("doc_id", "rep").hint("shuffle_merge"), "rep")
    more = written(block_links(left, width, percent), "links")
    twins = drawn.where("n > 0 and doc_id is not null").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep").distinct()
    final = components(links.union(more).union(twins.where("doc_id != rep")), "a", "b")
    out = drawn.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
