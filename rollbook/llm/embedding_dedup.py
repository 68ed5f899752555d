"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is turned by a random rotation and kept as the signs of its coordinates, a code, with the correction factor
f = <signs / sqrt(d), rotated vector>. Two rotations give every vector two codes. The product of the first code of a with
the second of b, both turned back, over f(a) * f(b) * d, is an unbiased estimate of the cosine c of a and b. With
t = 1 / f**2 - 1 it is off by more than confidence * sqrt(((t(a) + t(b)) * (1 - c**2) + t(a) * t(b)) / (d - 1)) with next to
no chance. A pair whose estimate is below the limit less that error at the limit is let go.

Vectors meet in hash tables, each keyed by the signs of `bits` random projections. The number of bits follows the number
of vectors, so that buckets stay small, and the number of tables follows the bits, so that a pair right at the limit
is missed with a chance of `miss` at most, and closer pairs with far less.

1. Codes and factors meet in all tables; what has a partner that its estimate does not rule out is put down.
2. Only these meet again, in the buckets where they have one, with their vectors. One code against the other's full
   vector gives a closer estimate, and what that leaves is recomputed in double precision. A pair is counted in the
   first table where it meets.

Equal vectors are one class from the start. A bucket of many different vectors is dealt into blocks; each two blocks
meet in one place, where links are counted and reduced to a spanning forest, so that no list of all pairs is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from rollbook.llm.shared import components, settled, written

#: Different vectors of one bucket that meet in one block, and rows of it that are multiplied at a time.
BLOCK, STRIP = 8192, 512
#: Different vectors that a bucket of unlike vectors has on average.
IN_BUCKET = 512
CONFIDENCE = 5.0
#: So many large buckets at most are broadcast; more are joined by merging.
LISTED = 100_000
#: Vectors of a task that are hashed at a time.
HASHED = 1024


@lru_cache(maxsize=16)
def rotation(dim: int, number: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20240501 + number).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(7919).standard_normal((count, dim)).T


def plan(n: int, limit: float, miss: float) -> tuple[int, int]:
    """Bits of a table's key for n vectors, and how many tables."""
    bits = min(48, max(4, math.ceil(math.log2(max(n, 1) / IN_BUCKET))))
    same = (1 - math.acos(limit) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def buckets(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each vector's bucket in every table."""
    signs = (unit @ planes(unit.shape[1], bits * tables) > 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column in which all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_vectors(column: pa.Array) -> np.ndarray:
    vector = vectors_of(column)
    vector = vector / np.abs(vector).max(axis=1, keepdims=True)
    return vector / np.linalg.norm(vector, axis=1, keepdims=True)


def encode(unit: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Code (packed signs) and correction factor of each unit vector."""
    turned = unit @ rotation(unit.shape[1], number).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def packed(unit: np.ndarray) -> list[bytes]:
    """Both codes and both factors of each unit vector."""
    both = [encode(unit, number) for number in (0, 1)]
    factors = np.stack([f for _, f in both], axis=1).astype("<f4")
    return [a.tobytes() + b.tobytes() + f.tobytes() for a, b, f in zip(both[0][0], both[1][0], factors, strict=True)]


def have_partners(codes: list[bytes], dim: int, first: np.ndarray, second: np.ndarray, limit: float) -> np.ndarray:
    """Which of the vectors known by their packed codes have one of the other side that the estimate does not rule out.

    first and second are places in codes: disjoint, or both one array of all places; a vector is no partner of itself.
    """
    size = -(-dim // 8)
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    factor = np.ascontiguousarray(raw[:, 2 * size:]).view("<f4").astype(np.float64)
    signs = [np.unpackbits(raw[:, k * size:(k + 1) * size], axis=1, count=dim).astype(np.float32) * 2 - 1 for k in (0, 1)]
    turn = (rotation(dim, 0) @ rotation(dim, 1).T / dim).astype(np.float32)
    left = (signs[0][first] @ turn) / factor[first, :1].astype(np.float32)
    right = (signs[1][second] / factor[second, 1:].astype(np.float32)).T
    t = np.maximum(1 / factor**2 - 1, 0)
    worst, rest = t[second, 1].max(initial=0), 1 - limit**2
    error = CONFIDENCE * np.sqrt(((t[first, 0] + worst) * rest + t[first, 0] * worst) / max(dim - 1, 1))
    least = (limit - error - 1e-5).astype(np.float32)[:, None]
    out = np.zeros(len(codes), bool)
    for at in range(0, len(first), STRIP):
        near = left[at:at + STRIP] @ right >= least[at:at + STRIP]
        if first is second:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        out[first[at:at + STRIP][near.any(axis=1)]] = True
        out[second[near.any(axis=0)]] = True
    return out


def linked(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, first: np.ndarray, second: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of first, j of second, i < j) with a cosine of `limit` or more."""
    dim = unit.shape[1]
    turned = unit[second] @ rotation(dim).T
    out = []
    for at in range(0, len(first), STRIP):
        i = first[at:at + STRIP]
        signs = np.unpackbits(code[i], axis=1, count=dim).astype(np.float64) * 2 - 1
        estimate = signs @ turned.T / (math.sqrt(dim) * factor[i])[:, None]
        error = CONFIDENCE * np.sqrt(np.maximum(1 - factor[i] ** 2, 0) / (factor[i] ** 2 * max(dim - 1, 1)) * (1 - limit**2))
        a, b = np.nonzero((estimate >= (limit - error)[:, None] - 1e-9) & (i[:, None] < second[None, :]))
        a, b = i[a], second[b]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
            exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= limit
            out.append((x[exact], y[exact]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number reachable from each of n nodes by links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
        a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    while (label[label] != label).any():
        label = label[label]
    return label


def dealt(rows: DataFrame) -> DataFrame:
    """rows (dim, place, id, ...) with part and side, sorted for meetings of (dim, place, part).

    A bucket of more than BLOCK rows is dealt into blocks by a hash. Each two blocks meet in one part, where side says which
    of them a row is of (it is null where a block meets itself).
    """
    large = written(rows.groupBy("dim", "place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large")
    listed = F.broadcast(large) if large.count() <= LISTED else large.hint("shuffle_merge")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(listed, ["dim", "place"], "left").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    part = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    rows = rows.withColumn("part", part).withColumn("side", F.when(F.col("own") != F.col("other"), F.col("own") < F.col("other"))).drop("own", "other", "blocks")
    return rows.repartition("dim", "place", "part").sortWithinPartitions("dim", "place", "part")


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (dim, place, part) of a partition that is sorted by them, as dealt() leaves it."""
    held, name = [], None
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("dim", "place", "part")]
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


def sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows of either side of a meeting; of all rows, twice, where a block meets itself."""
    if rows["side"].null_count:
        return (np.arange(rows.num_rows),) * 2
    side = rows["side"].to_numpy()
    return np.flatnonzero(side), np.flatnonzero(~side)


def near_vectors(vectors: DataFrame, limit: float = 0.95, miss: float = 1e-4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding), written in the shared folder.

    Two vectors of the same length are linked if their cosine in double precision is `limit` or more; n_links counts the
    other rows that a row is linked with directly, equal vectors included, component_id is the smallest vec_id reachable,
    and that row is kept. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Rows that share a vec_id are one node of the components. A row without vec_id links with nothing, has no
    component_id and is kept. An empty table gives an empty table. Other columns are not looked at.
    """
    return settled(lambda: _near_vectors(vectors, limit, miss), "near-vectors")


def _near_vectors(vectors: DataFrame, limit: float, miss: float) -> DataFrame:
    kind = vectors.schema["embedding"].dataType
    kind = "array<float>" if isinstance(getattr(kind, "elementType", None), FloatType) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding"))
    whole = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # a class of equal vectors is known by 128 bits
    rows = rows.withColumn("embedding", F.when(whole, F.col("embedding"))).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7919), "embedding"))
    sound = rows.where("embedding is not null")
    classes = sound.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
    coded = written(classes.withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(coded.count(), limit, miss)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, HASHED) for whole in batches for at in range(0, whole.num_rows, HASHED)):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                unit = unit_vectors(part.column("embedding"))
                place = buckets(unit, bits, tables) + (np.arange(tables, dtype=np.int64) << bits)
                row = np.repeat(np.arange(len(unit)), tables)
                yield pa.RecordBatch.from_arrays([part.column("dim").take(pa.array(row)), pa.array(place.reshape(-1)), part.column("id").take(pa.array(row)), pa.array(packed(unit), pa.binary()).take(pa.array(row))], names=["dim", "place", "id", "codes"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in meetings(batches):
            if rows.num_rows > 1:
                some = have_partners(rows["codes"].to_pylist(), rows["dim"][0].as_py(), *sides(rows), limit)
                yield from rows.select(["dim", "place", "id"]).filter(pa.array(some)).combine_chunks().to_batches()

    coded_rows = coded.select("dim", "id", "embedding").mapInArrow(keys, "dim int, place long, id long, codes binary")
    likely = written(dealt(coded_rows).mapInArrow(look, "dim int, place long, id long").distinct(), "likely")

    def meet(rows: pa.Table) -> pa.RecordBatch | None:
        first, second = sides(rows)
        alone = first is second
        order = first if alone else np.concatenate([first, second])  # so that every one of the first comes before every one of the second
        unit = unit_vectors(rows["embedding"].combine_chunks())[order]
        m, rep, name = (rows[c].to_numpy()[order] for c in ("m", "rep", "id"))
        everyone, tab = np.arange(len(unit)), rows["place"][0].as_py() >> bits
        a, b = linked(unit, *encode(unit), everyone if alone else everyone[:len(first)], everyone if alone else everyone[len(first):], limit)
        if not len(a):
            return None
        label = forest(len(unit), a, b)
        if tab:
            some = np.unique(np.concatenate([a, b]))
            before = np.zeros((len(unit), tab), np.int64)
            before[some] = buckets(unit[some], bits, tables)[:, :tab]
            new = np.concatenate([~(before[a[k:k + 4096]] == before[b[k:k + 4096]]).any(axis=1) for k in range(0, len(a), 4096)])
            a, b = a[new], b[new]
        count = np.bincount(a, m[b], len(unit)) + np.bincount(b, m[a], len(unit))
        some = np.flatnonzero((count > 0) | (label != everyone))
        return pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(rep[some]), pa.array(rep[label[some]]), pa.array(count[some].astype(np.int64))], names=["id", "rep", "with", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (out for out in map(meet, meetings(batches)) if out is not None)

    again = dealt(likely).join(coded.select("id", "rep", "m", "embedding").hint("shuffle_merge"), "id")
    again = again.repartition("dim", "place", "part").sortWithinPartitions("dim", "place", "part").select("dim", "place", "part", "side", "id", "rep", "m", "embedding")
    met = written(again.mapInArrow(run, "id long, rep long, with long, n long"), "links")
    counts = met.groupBy("id").agg(F.sum("n").alias("n"))
    known = written(coded.join(counts, "id", "left").select("h1", "h2", "rep", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "counts")
    numbered = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    repeats = numbered.where("vec_id != rep").select("vec_id", "rep")
    joined = components(met.select("rep", "with").where(F.col("rep") != F.col("with")).union(repeats).distinct(), "rep", "with")
    out = numbered.join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
