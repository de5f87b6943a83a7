"""Near-duplicate documents: DartMinHash signatures of word shingles, banded joining, exact verification, components.

Signature: every weighted element owns a region of unit width for each unit of weight, dyadic beyond the first. Darts hit a region as a
Poisson process in time that the element's hash alone decides; a dart has a coordinate of the signature and a place in the region, and
counts if its place is below the element's weight. The earliest dart of each coordinate is kept; two sets agree in a coordinate with
their weighted Jaccard similarity as probability. Work is in the darts, about K ln K, and not in K times the elements.

Links: documents whose lower-cased words give the same sequence are one class; its smallest doc_id stands for it. Classes that share a
band of ROWS coordinates are candidates. In each bucket they are compared with one pivot, the member that meets most others; where a
bucket then still holds several components, those outside the largest are held against all others there, in cells of BLOCK x BLOCK rows:
first by signature alone, then the rows that are close to another one in their cell get their texts and are compared exactly. A cell
gives a forest of its links and never its pairs. A link is a Jaccard similarity of the sets of WORDS-word shingles of at least
SIMILARITY. Near-duplicate classes are the components of the links. No bucket, partner or candidate is capped.

Texts of fewer than WORDS words are one shingle. Texts without a word, null and empty ones too, link with nothing. Repeated rows of a
doc_id share their class; rows with a null doc_id are kept, with a null class. An empty table gives no rows. Of the input's columns
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, doc_texts, lean, mix, read
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Signatures that agree in a smaller share of coordinates aren't verified: at a similarity of 0.8 that is 4.5 standard deviations.
LOOSE = 0.6
#: Rows of a block in which signatures are held against each other.
BLOCK = 256
#: Darts that are expected for a document, so that most signatures are full at once.
DARTS = K * math.log(K) + 2 * K
CELL = "bucket long, i int, j int, rep long, component long, left boolean, signature binary, bands array<long>"
SIGNED = "doc_id long, same binary, bands array<long>, signature binary"


class WordHashes(dict):
    """Hashes of words, remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(words: list[str], hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the shingles of WORDS consecutive words."""
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    if len(h) < WORDS:
        h = np.pad(h, (0, WORDS - len(h)))
    n = len(h) - WORDS + 1
    out = np.zeros(n, U64)
    for i in range(WORDS):
        out = mix(out ^ h[i : i + n])
    return np.unique(out)


def unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((h >> U64(11)).astype(np.float64) + 1) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and identities of all darts before `until` that count."""
    times, names = [], []
    band, low = 0, 0.0
    while len(elements):
        width = 1.0 if band == 0 else float(2 ** (band - 1))
        x, w, at, round_ = mix(elements ^ U64(0xA0761D64 + band)), weights, np.zeros(len(elements)), 0
        if len(x) < 64:  # few elements, many darts each: all at once
            mean = until * width
            j = np.arange(int(mean + 6 * math.sqrt(mean) + 10)).astype(U64)
            h = mix(x[:, None] + mix(j + U64(1))[None, :])
            time = np.cumsum(-np.log(unit(h)), axis=1) / width
            found = (time < until) & (low + width * unit(mix(h + U64(3))) <= w[:, None])
            times.append(time[found])
            names.append(h[found])
        else:
            while len(x):
                h = mix(x + mix(np.array([round_ + 1], U64)))
                at = at - np.log(unit(h)) / width
                alive = at < until
                x, w, at, h = x[alive], w[alive], at[alive], h[alive]
                counts = low + width * unit(mix(h + U64(3))) <= w
                times.append(at[counts])
                names.append(h[counts])
                round_ += 1
        low += width
        more = weights > low
        elements, weights, band = elements[more], weights[more], band + 1
    return (np.concatenate(times), np.concatenate(names)) if times else (np.empty(0), np.empty(0, U64))


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """The signature of a non-empty weighted set: for each coordinate the identity of its earliest dart."""
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    until = (k * math.log(k) + 2 * k) / weights.sum()
    while True:
        time, name = darts(elements, weights, until)
        coordinate = (mix(name + U64(7)) % U64(k)).astype(np.int64)
        order = np.argsort(-time, kind="stable")
        signature, hit = np.zeros(k, U64), np.zeros(k, bool)
        signature[coordinate[order]] = name[order]  # the earliest is written last
        hit[coordinate] = True
        if hit.all():
            return signature
        until *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    out = mix(np.arange(BANDS, dtype=U64))
    for i in range(ROWS):
        out = mix(out ^ rows[:, i])
    return out.view(np.int64)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        same, bands, signatures = [], [], []
        for text in batch.column(1):
            words = text.as_py().lower().split()
            same.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None)
            signature = dart_minhash(shingles(words, hashes)) if words else None
            bands.append(None if signature is None else band_keys(signature))
            signatures.append(None if signature is None else (signature >> U64(48)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=["doc_id", "same", "bands", "signature"])


def verify(least: float):
    """A mapInArrow function: of rows (a, b, x, y), x and y the compressed texts of a and b, the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes, coder, last = WordHashes(), zstandard.ZstdDecompressor(), {}

        def of(doc: int, data: bytes) -> np.ndarray:
            if doc not in last:
                if len(last) > 32:
                    last.clear()
                last[doc] = shingles(coder.decompress(data).decode("utf-8", "surrogatepass").split(), hashes)
            return last[doc]

        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            held = []
            for i in range(len(a)):
                s, t = of(a[i], x[i]), of(b[i], y[i])
                both = len(np.intersect1d(s, t, assume_unique=True))
                held.append(both >= least * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    return run


def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    for batch in batches:
        coder = zstandard.ZstdCompressor(level=3)
        data = [coder.compress(t.as_py().lower().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])


class Cell:
    """Rows (rep, component, left, signature, bands, ...) of a cell (bucket, i, j): the left ones and the right ones, as arrays."""

    def __init__(self, bucket: int, rows: list):
        self.bucket = bucket
        self.left, self.right = [r for r in rows if r[2]], [r for r in rows if not r[2]]
        if self.left and self.right:
            (self.one, self.other) = (np.frombuffer(b"".join(r[3] for r in side), "<u2").reshape(len(side), K) for side in (self.left, self.right))
            (self.mine, self.theirs) = (np.array([r[4] for r in side], np.int64) for side in (self.left, self.right))
            self.theirs_in = np.array([r[1] for r in self.right], np.int64)

    def candidates(self, i: int) -> np.ndarray:
        """Places on the right that the left row i is held against, best agreement first: of another component, close by signature, and in no bucket before this one together."""
        near = np.flatnonzero(self.theirs_in != self.left[i][1])
        agree = (self.other[near] == self.one[i]).sum(axis=1)
        close = agree >= LOOSE * K
        near, agree = near[close], agree[close]
        if len(near):
            first = (self.theirs[near] == self.mine[i]).argmax(axis=1)
            here = self.mine[i][first] == self.bucket
            near = near[here][np.argsort(-agree[here], kind="stable")]
        return near


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Cells of sorted rows (bucket, i, j, ...) and their rows."""
    held, rows = None, []
    for batch in batches:
        for bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, i, j) != held:
                if rows:
                    yield held, rows
                held, rows = (bucket, i, j), []
            rows.append(row)
    if rows:
        yield held, rows


def with_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (bucket, i, j, rep, component, left, signature, bands) those that have a candidate in their cell."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))
    for held, rows in by_cell(batches):
        cell, kept = Cell(held[0], rows), []
        if not cell.left or not cell.right:
            continue
        hit = np.zeros(len(cell.right), bool)
        for i, row in enumerate(cell.left):
            near = cell.candidates(i)
            if len(near):
                kept.append((*held, *row))
                hit[near] = True
        kept += [(*held, *cell.right[j]) for j in np.flatnonzero(hit).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], t) for c, t in enumerate(kinds)], names=CELL.replace(",", "").split()[::2])


def alike(least: float):
    """A mapInArrow function over sorted rows (CELL and data): links that join components; pairs that are joined already aren't compared."""

    def links(bucket: int, rows: list, hashes: WordHashes, coder) -> list[tuple[int, int]]:
        cell = Cell(bucket, rows)
        if not cell.left or not cell.right:
            return []
        parent: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}

        def root(c: int) -> int:
            while parent.setdefault(c, c) != c:
                c = parent[c] = parent[parent[c]]
            return c

        def of(row: list) -> np.ndarray:
            if row[0] not in sets:
                sets[row[0]] = shingles(coder.decompress(row[5]).decode("utf-8", "surrogatepass").split(), hashes)
            return sets[row[0]]

        found = []
        for i, row in enumerate(cell.left):
            for j in cell.candidates(i).tolist():
                a, b = root(row[1]), root(cell.right[j][1])
                if a != b:
                    s, t = of(row), of(cell.right[j])
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if common >= least * (len(s) + len(t) - common):
                        parent[a] = b
                        found.append((row[0], cell.right[j][0]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes, coder = WordHashes(), zstandard.ZstdDecompressor()
        for held, rows in by_cell(batches):
            found = links(held[0], rows, hashes, coder)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the near-duplicate class) and kept (doc_id = class_id), one row per input row."""
    texts = doc_texts(docs)
    named = texts.filter(F.col("doc_id").isNotNull())
    signed = cut(named.mapInArrow(lean(sign), SIGNED))
    classes = cut(signed.filter(F.col("same").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("rep")))
    members = cut(signed.join(classes, "same", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
    reps = cut(signed.join(classes.select(F.col("rep").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi").groupBy("doc_id").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature")))

    banded = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket"))
    buckets = cut(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    met = cut(banded.join(buckets, "bucket"))
    degree = cut(met.groupBy("rep").agg(F.sum("n").alias("degree")))
    met = cut(met.join(degree, "rep"))
    pivots = cut(met.groupBy("bucket").agg(F.min(F.struct(-F.col("degree"), F.col("rep"))).alias("p")).select("bucket", F.col("p.rep").alias("pivot")))
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    tried = cut(met.join(pivots, "bucket").filter("rep <> pivot").select(*ordered("rep", "pivot")).distinct())

    def with_texts(ids: DataFrame) -> DataFrame:
        return cut(named.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(lean(compress), "doc_id long, data binary"))

    needed = with_texts(cut(tried.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    one, two = needed.select(F.col("doc_id").alias("a"), F.col("data").alias("x")), needed.select(F.col("doc_id").alias("b"), F.col("data").alias("y"))
    links = cut(tried.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lean(verify(SIMILARITY)), "a long, b long"))
    label = components(links)
    placed = cut(met.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component")))
    shares = cut(placed.groupBy("bucket", "component").agg(F.count("*").alias("m")))
    mixed = cut(shares.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("top")).filter("parts > 1 and n > 2").select("bucket", F.col("top.component").alias("largest"), (F.col("n") - F.col("top.m")).alias("rest")))
    if not mixed.isEmpty():
        open_ = cut(placed.join(mixed, "bucket"))  # its members have been tried, so their texts are at hand
        carried = reps.select(F.col("doc_id").alias("rep"), "signature", "bands")
        cell = lambda count: F.floor(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) * F.ceil(F.col(count) / BLOCK) / F.lit(1 << 30)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(count) / BLOCK) - 1).cast("int")))
        minor = open_.filter("component <> largest").withColumn("i", cell("rest")).withColumn("j", every("n")).withColumn("left", F.lit(True))
        major = open_.withColumn("j", cell("n")).withColumn("i", every("rest")).withColumn("left", F.lit(False))
        in_cells = lambda rows: rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        cells = minor.unionByName(major).select("bucket", "i", "j", "rep", "component", "left").join(carried, "rep").select(*CELL.replace(",", "").split()[::2])
        near = cut(in_cells(cells).mapInArrow(lean(with_candidates), CELL))  # texts go where a candidate is
        texts_of = needed.select(F.col("doc_id").alias("rep"), "data")
        links = cut(links.unionByName(in_cells(near.join(texts_of, "rep").select(*near.columns, "data")).mapInArrow(lean(alike(SIMILARITY)), "a long, b long")))
        label = components(links)
    final = members.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    nameless = texts.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("bigint").alias("class_id"))
    return final.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op2_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
