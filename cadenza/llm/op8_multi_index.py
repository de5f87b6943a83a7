"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own, so K centroids a half make K * K cells. A query orders the cells by the sum of its
two distances, with a heap over the two sorted lists of centroids, and visits cells until they hold a share of all vectors; the
vectors in them are ranked by their exact distance in double precision.

Centroids come from SAMPLE vectors at most, chosen by a hash of vec_id; every vector is indexed. The share is calibrated on the same
sample: the least one that reaches RECALL of PROBES sample vectors' true neighbours there. Structure in the data makes it small; data
without structure make it large, and recall is kept.

Equal vectors are one entry with their NEAREST + 1 smallest vec_ids, which is enough for any result. Cells are dealt in groups of about
GROUP entries; a larger cell is split. A task holds one group's entries and streams the queries that visit it.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a vec_id. Each dimension has
an index of its own, with its part of the sample, and its vectors find only each other; one that the sample misses is a single cell,
which every query of it visits. Repeated rows of a vec_id and vector count once; a query never finds its own vec_id; a vec_id with
several vectors asks with the one whose bytes sort first. Fewer candidates than NEAREST: all are found. An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read
from .vectors import kind_of, matrix, packed

NEAREST, SAMPLE, PROBES, RECALL = 10, 20_000, 300, 0.98
#: Entries of a group; entries of a cell that are aimed at; centroids of a half at most; entries that a query sees at least.
GROUP, CELL, MOST, LEAST = 4096, 32, 512, 256
FOUND = "query_id long, vec_id long, score double"


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(axis=1)[None, :] - 2 * x @ centroids.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; a centroid that loses all rows moves to a random one."""
    rng = np.random.default_rng(len(x))
    x = x[rng.permutation(len(x))]
    centroids = np.unique(x[: 4 * k], axis=0)
    centroids = centroids[rng.permutation(len(centroids))[:k]].copy()
    for _ in range(rounds):
        own = nearest_centroid(x, centroids)
        count = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=len(centroids))])
    return centroids


class Index:
    """Centroids of both halves and the entries of each cell."""

    def __init__(self, sample: np.ndarray, entries: int, first_cell: int):
        """`sample` may be empty; `entries` vectors of its dimension are indexed, in cells numbered from `first_cell` on."""
        size = sample.shape[1]
        self.half, self.entries, self.first_cell = size - size // 2, entries, first_cell
        k = int(min(MOST, max(2, math.sqrt(entries / CELL))))
        halves = sample[:, : self.half], sample[:, self.half :]
        self.first, self.second = (k_means(x, k) if x.size else np.zeros((1, x.shape[1])) for x in halves)
        self.counts = np.zeros(len(self.first) * len(self.second), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest_centroid(x[:, : self.half], self.first) * len(self.second) + nearest_centroid(x[:, self.half :], self.second)

    def visits(self, q: np.ndarray, wanted: int) -> Iterator[int]:
        """Cells with entries in the order of summed squared distances, until they hold `wanted` entries."""
        a, b = ((self.first - q[: self.half]) ** 2).sum(axis=1), ((self.second - q[self.half :]) ** 2).sum(axis=1)
        order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b, counts, width = np.sort(a).tolist(), np.sort(b).tolist(), self.counts, len(self.second)
        heap, held = [(a[0] + b[0], 0, 0)], 0
        reached = [0] * len(a)  # of each row of the table of sums, the columns pushed so far
        reached[0] = 1
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = order_a[i] * width + order_b[j]
            if counts[cell]:
                held += int(counts[cell])
                yield cell
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))

    def share(self, sample: np.ndarray) -> float:
        """The share of entries to visit, found on a sample against brute force there."""
        n = len(sample)
        if n <= LEAST or self.entries <= LEAST:
            return 1.0
        own = self.cells(sample)
        kept, self.counts = self.counts, np.bincount(own, minlength=len(self.counts))
        squares = (sample * sample).sum(axis=1)
        needed = []
        for i in np.linspace(0, n - 1, min(PROBES, n)).astype(int).tolist():
            d = squares - 2 * sample @ sample[i]
            d[i] = np.inf
            true = np.argpartition(d, NEAREST)[:NEAREST]
            cells = list(self.visits(sample[i], n))
            seen = np.zeros(len(self.counts))
            seen[cells] = np.cumsum(self.counts[cells])
            needed += (seen[own[true]] / n).tolist()
        self.counts = kept
        return float(np.quantile(needed, RECALL))


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance): the nearest of `vectors` for each row of `queries`; both (vec_id, embedding)."""
    kind = kind_of(vectors)
    rows = packed(vectors).filter("vec_id is not null and vector is not null").groupBy("vector", "vec_id").agg(F.lit(1))
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vector", "vec_id", F.row_number().over(first).alias("no")).filter(F.col("no") <= nearest + 1)
    entries = cut(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    hashed = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << 40))
    sample = [r[0] for r in entries.filter(hashed < int(min(1.0, 0.95 * SAMPLE / max(n, 1)) * (1 << 40))).orderBy(hashed, F.col("ids")[0]).select("vector").limit(SAMPLE).collect()]
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_size: dict[int, list[bytes]] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    indexes: dict[int, Index] = {}  # by bytes of a vector; a row for each dimension reaches the driver
    cells = 0
    for size, entries_of in entries.groupBy(F.octet_length("vector").alias("size")).count().orderBy("size").collect():
        known = matrix(by_size[size], kind) if size in by_size else np.zeros((0, size // np.dtype(kind).itemsize))
        indexes[size] = Index(known, entries_of, cells)
        cells += len(indexes[size].counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0).to_pylist()
            sizes, found = np.array([len(v) for v in vectors]), np.zeros(len(vectors), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                found[at] = indexes[size].cells(matrix([vectors[i] for i in at.tolist()], kind)) + indexes[size].first_cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["vector", "ids", "cell"])

    placed = cut(entries.mapInArrow(place, "vector binary, ids array<long>, cell long"))
    counts = np.zeros(cells, np.int64)
    for cell, count in placed.groupBy("cell").count().collect():  # K * K rows a dimension at most
        counts[cell] = count
    wanted: dict[int, int] = {}
    for size, index in indexes.items():
        index.counts = counts[index.first_cell : index.first_cell + len(index.counts)]
        known = matrix(by_size[size], kind) if size in by_size else np.zeros((0, 1))
        wanted[size] = max(math.ceil(index.share(known) * index.entries), LEAST)

    groups: list[list[int]] = []  # of each cell, first group and number of groups
    now, held = 0, 0
    for count in counts.tolist():
        parts = max(1, -(-count // GROUP))
        if held and held + count > GROUP:
            now, held = now + 1, 0
        groups.append([now, parts])
        held += count
        if parts > 1:
            now, held = now + parts, 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [groups[c][0] + (hash(ids[0]) % groups[c][1] if groups[c][1] > 1 else 0) for c, ids in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), batch.column(0), batch.column(1), pa.array([[c] for c in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["at", "part", "query_id", "vector", "ids", "cells"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for query, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by: dict[int, list[int]] = {}
                index = indexes[len(vector)]
                for cell in index.visits(matrix([vector], kind)[0], wanted[len(vector)]):
                    cell += index.first_cell
                    for g in range(groups[cell][0], groups[cell][0] + groups[cell][1]):
                        by.setdefault(g, []).append(cell)
                out += [(g, 1, query, vector, [], cells) for g, cells in by.items()]
                if len(out) > 20_000:
                    yield rows_of(out)
                    out = []
            yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["at", "part", "query_id", "vector", "ids", "cells"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, x, squares, cell = None, [], None, None, None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for g, part, query, vector, ids, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, len(vector)) != at:
                    at, own, x = (g, len(vector)), [], None
                if part == 0:
                    own.append((vector, ids, cells[0]))
                    continue
                if not own:
                    continue
                if x is None:
                    x, cell = matrix([o[0] for o in own], kind), np.array([o[2] for o in own])
                    squares = (x * x).sum(axis=1)
                q = matrix([vector], kind)[0]
                here = np.flatnonzero(np.isin(cell, cells))
                if len(here) > nearest + 1:
                    about = squares[here] - 2 * (x[here] @ q)
                    edge = np.partition(about, nearest)[nearest]
                    here = here[about <= edge + 1e-9 * (abs(edge) + squares[here].max() + q @ q)]
                exact = np.sqrt(((x[here] - q) ** 2).sum(axis=1))
                found = sorted((d, i) for d, k in zip(exact.tolist(), here.tolist()) for i in own[k][1] if i != query)
                out += [(query, i, d) for d, i in found[:nearest]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    own = packed(queries).filter("vec_id is not null and vector is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = own.filter(F.octet_length("vector").isin(list(indexes)))
    every = "at long, part int, query_id long, vector binary, ids array<long>, cells array<long>"
    dealt = placed.mapInArrow(deal, every).unionByName(asked.mapInArrow(ask, every)).repartition("at").sortWithinPartitions("at", F.octet_length("vector"), "part")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = dealt.mapInArrow(rerank, FOUND).select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return found.filter(F.col("rank") <= nearest)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
