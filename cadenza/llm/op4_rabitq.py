"""Near-duplicate embeddings: binary codes of randomly rotated vectors, with correction factors, decide what is computed exactly.

Every distinct vector is normalised and rotated at random; its code is the signs of the rotated components, its correction factor the
inner product of the vector and its code. As the other side of a pair a vector is its rotated components in LEVELS steps, rounded at
random. <code, steps> / factor is an unbiased estimate of the inner product, with an error of about sqrt(1 / factor**2 - 1) / sqrt(D - 1)
in standard deviations, and of half a step over the factor for the rounding. Pairs whose estimate is more than CONFIDENCE of these below
the threshold are left out; all others are computed in double precision.

Pairs come from hash tables on signs of further rotations. Bits and tables follow the number of vectors: buckets hold about TARGET
rows, and there are so many tables that a pair at the threshold itself shares no bucket with a probability of at most MISS. Only codes,
factors and steps go through the tables, about 2/3 of a byte a component; a vector goes only to the buckets where an estimate keeps one of its pairs. A
pair counts in the first table that it shares. Buckets of more than BLOCK rows are split into cells of BLOCK x BLOCK; a cell gives each
vector's number of links and one link to its cell's component, never its pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different dimension never
do; repeated rows are vectors of their own. Rows without a vec_id take no part: 0 links, null component, not kept. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, mix, read
from .components import components
from .vectors import kind_of, matrix, packed, rotation

THRESHOLD, CONFIDENCE, MISS = 0.95, 5.0, 1e-4
TARGET, BLOCK, LEVELS = 256, 2048, 15
SKETCHED = "rep long, sketch binary, keys array<long>"
CELL = "tab int, bucket long, i int, j int, side int, rep long"


def shape(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a key, and tables."""
    bits = max(4, round(math.log2(max(rows, 1) / TARGET))) if rows > TARGET else 1
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - shared))


@functools.lru_cache(maxsize=8)
def planes(dim: int, count: int) -> np.ndarray:
    """`count` directions, rows of random rotations."""
    return np.concatenate([rotation(dim, 1 + i) for i in range(-(-count // dim))])[:count]


def padded(x: np.ndarray) -> np.ndarray:
    """Components up to a multiple of 64 with zeros: short vectors get codes of 64 bits."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 64)))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (signs, as bits) and correction factors of normalised vectors."""
    wide = padded(x)
    turned = wide @ rotation(wide.shape[1], 0).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(wide.shape[1])


def sketches(x: np.ndarray) -> np.ndarray:
    """Codes, factors and steps of normalised vectors as rows of bytes: code, then factor, least component and step as float32, then two steps a byte."""
    wide = padded(x)
    turned = wide @ rotation(wide.shape[1], 0).T
    code, factor = coded(x)
    low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
    step = np.maximum((high - low) / LEVELS, 1e-30)
    shift = np.random.default_rng(1).random(turned.shape)  # rounding up or down at random keeps the estimate unbiased
    steps = np.clip(np.floor((turned - low) / step + shift), 0, LEVELS).astype(np.uint8)
    numbers = np.concatenate([factor[:, None], low, step], axis=1).astype("<f4").view(np.uint8)
    return np.concatenate([code, numbers, steps[:, ::2] << 4 | steps[:, 1::2]], axis=1)


def estimate(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of sketched vectors (rows) and coded ones (columns), and the standard deviation of their errors."""
    d = (one.shape[1] - 12) * 8 // 5
    split = lambda rows: (rows[:, : d // 8], np.ascontiguousarray(rows[:, d // 8 : d // 8 + 12]).view("<f4").astype(np.float64), rows[:, d // 8 + 12 :])
    _, (_, low, step), packed_steps = (lambda t: (t[0], t[1].T, t[2]))(split(one))
    codes, numbers, _ = split(other)
    factor = numbers[:, 0]
    steps = np.empty((len(one), d), np.float32)
    steps[:, ::2], steps[:, 1::2] = packed_steps >> 4, packed_steps & 15
    turned = steps * step[:, None].astype(np.float32) + low[:, None].astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    about = turned @ (signs / (math.sqrt(d) * factor[:, None]).astype(np.float32)).T
    own = np.maximum(1 / factor**2 - 1, 0) / max(d - 1, 1)
    return about, np.sqrt(own[None, :] + (step[:, None] / (2 * factor[None, :])) ** 2)


def keys_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each normalised vector in each table."""
    signs = (x @ planes(x.shape[1], bits * tables).T > 0).reshape(len(x), tables, bits)
    key = (signs << np.arange(bits)).sum(axis=2).astype(U64)
    return mix(mix(key + U64(x.shape[1] << 40)) ^ np.arange(tables, dtype=U64)[None, :]).view(np.int64)


def sketch(kind: str, bits: int, tables: int):
    """A mapInArrow function: (rep, vector) to SKETCHED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            rows, keys = [b""] * len(vectors), [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size).tolist()
                x = unit(matrix([vectors[i] for i in at], kind))
                for i, row, key in zip(at, sketches(x), keys_of(x, bits, tables)):
                    rows[i], keys[i] = row.tobytes(), key
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "sketch", "keys"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Normalised vectors; scaling first keeps squares of very large and very small components finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, by repeated minimum over links (a, b) of n."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Cells of sorted rows (tab, bucket, i, j, ...) and their rows, if they have several."""
    held, rows = None, []
    for batch in batches:
        for table, bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (table, bucket, i, j) != held:
                if len(rows) > 1:
                    yield held, rows
                held, rows = (table, bucket, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield held, rows


def kept_pairs(one: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    about, error = estimate(one, other)
    return about >= threshold - CONFIDENCE * error


def with_candidates(threshold: float):
    """A mapInArrow function: of sorted rows (CELL, sketch) those that an estimate keeps a pair of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for held, rows in by_cell(batches):
            parts = [[r for r in rows if r[0] == side] for side in (0, 1)]
            one, other = (np.frombuffer(b"".join(r[2] for r in part), np.uint8).reshape(len(part), -1) if part else None for part in parts)
            if held[2] == held[3]:
                kept = kept_pairs(one, one, threshold)
                np.fill_diagonal(kept, False)
                hits = [(kept & kept.T).any(axis=1)]
            elif one is not None and other is not None:
                kept = kept_pairs(one, other, threshold)
                hits = [kept.any(axis=1), kept.any(axis=0)]
            else:
                continue
            out += [(*held, part[k][0], part[k][1]) for part, hit in zip(parts, hits) for k in np.flatnonzero(hit).tolist()]
            if len(out) > 20_000:
                yield sent(out)
                out = []
        yield sent(out)

    def sent(out: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=CELL.replace(",", "").split()[::2])

    return run


class Side:
    """Rows (rep, m, vector) of one side of a cell."""

    def __init__(self, rows: list, kind: str, bits: int, tables: int):
        ids, m, vectors = zip(*rows)
        self.ids, self.m = np.array(ids), np.array(m)
        self.x = unit(matrix(list(vectors), kind))
        self.sketches, self.keys = sketches(self.x), keys_of(self.x, bits, tables)


def linked(x: Side, y: Side, table: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sides that share a bucket of `table` and of no table before it."""
    kept = kept_pairs(x.sketches, y.sketches, threshold)
    if same:
        kept = np.triu(kept & kept.T, 1)
    a, b = np.nonzero(kept)
    out = []
    for i in range(0, len(a), 200_000):
        p, q = a[i : i + 200_000], b[i : i + 200_000]
        if table:
            first = ~(x.keys[p, :table] == y.keys[q, :table]).any(axis=1)
            p, q = p[first], q[first]
        exact = np.einsum("ij,ij->i", x.x[p], y.x[q]) >= threshold
        out.append((p[exact], q[exact]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (a, b)


def cells(kind: str, threshold: float, bits: int, tables: int):
    """A mapInArrow function over sorted rows (CELL, m, vector): each vector's links in a cell, and its component's smallest there."""

    def links(key: tuple, rows: list) -> list[tuple[int, int, int]]:
        table, _, i, j = key
        out = []
        if i == j:
            x = Side([r[1:] for r in rows], kind, bits, tables)
            a, b = linked(x, x, table, threshold, True)
            ids, m = x.ids, x.m
        else:
            left, right = [r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0]]
            if not left or not right:
                return out
            x, y = Side(left, kind, bits, tables), Side(right, kind, bits, tables)
            a, b = linked(x, y, table, threshold, False)
            b = b + len(left)
            ids, m = np.append(x.ids, y.ids), np.append(x.m, y.m)
        if len(a):
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, a, m[b])
            np.add.at(count, b, m[a])
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            root = ids[order][roots(len(ids), rank[a], rank[b])][rank]
            hit = np.flatnonzero(count)
            out = list(zip(ids[hit].tolist(), count[hit].tolist(), root[hit].tolist()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for held, rows in by_cell(batches):
            out += links(held, rows)
            if len(out) > 20_000:
                yield sent(out)
                out = []
        yield sent(out)

    def sent(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least `threshold`), component_id (smallest vec_id that links reach), kept."""
    kind = kind_of(vectors)
    rows = packed(vectors)
    classes = cut(rows.filter("vec_id is not null and vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")))
    bits, tables = shape(classes.count(), threshold)
    keyed = cut(classes.select("rep", "vector").mapInArrow(sketch(kind, bits, tables), SKETCHED)).select("rep", "sketch", F.posexplode("keys").alias("tab", "bucket"))
    large = cut(keyed.groupBy("tab", "bucket").agg(F.count("*").alias("n")).filter(f"n > {BLOCK}"))
    whole = lambda rows: rows.select("tab", "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "rep", "sketch")
    if large.isEmpty():
        dealt = whole(keyed)
    else:
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.floor(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) * blocks / F.lit(1 << 30)).cast("int")
        split = keyed.join(large, ["tab", "bucket"]).select("tab", "bucket", "rep", "sketch", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        split = split.select("tab", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "sketch")
        dealt = split.unionByName(whole(keyed.join(large, ["tab", "bucket"], "left_anti")))
    in_cells = lambda rows: rows.repartition("tab", "bucket", "i", "j").sortWithinPartitions("tab", "bucket", "i", "j")
    near = in_cells(dealt).mapInArrow(with_candidates(threshold), CELL).join(classes.select("rep", "m", "vector"), "rep").select("tab", "bucket", "i", "j", "side", "rep", "m", "vector")
    found = cut(in_cells(near).mapInArrow(cells(kind, threshold, bits, tables), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), "component")
    known = cut(classes.join(links, "rep", "left").join(label, "rep", "left").select("vector", "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    named = F.col("vec_id").isNotNull()
    out = rows.join(known, (rows.vector == known.vector) & named, "left")
    component = F.when(named, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
