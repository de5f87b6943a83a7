"""Suffix-array deduplication by prefix-free parsing.

Removed is each byte that a string of LENGTH bytes covers which also starts in a document with a smaller doc_id; strings are judged
on the input and never cross documents.

Corpus order (module prefix_free): rolling-hash triggers cut text into phrases; the suffix array of the dictionary of distinct phrases
and the suffix array of the parse combine into the order of all strings' suffixes and what neighbours share. Neighbours that share
LENGTH bytes are one string; the smallest document among their places is where it starts first.

How it is dealt: equal strings must meet, and no task can hold a corpus. So a text is first cut into contexts: a rolling hash of SEED
bytes picks the smallest place of every window of LENGTH bytes; consecutive windows with one such seed form a context, the bytes that
these windows cover. Every window lies in exactly one context, and equal windows have equal seeds wherever they occur. Contexts with one
seed go to one bucket, and each bucket's contexts are parsed and ordered as above; buckets are ranges of the corpus by seed.

Texts lie in blocks, one to a task. A block sends each seed once, with the smallest and largest document that has it, to the seed's
bucket; a bucket tells each block which of its seeds occur in two documents; a block sends each context of these once, and itself
where its contexts lie; a bucket answers with the smallest document of each string. So a passage that every document holds is one
entry a block, and no task holds more than a block's text or a bucket's distinct contexts of each block.

Null and empty texts have nothing removed. Rows that repeat a doc_id are judged each by itself, against smaller doc_ids only; a null
doc_id counts as larger than all. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BASE, BYTE_WORDS, INVERSE, U64, block_count, block_keys, blocks, lean, mix, powers, read, squeeze, unpack, unsqueeze
from .prefix_free import corpus_order, hashed, runs

LENGTH, SEED = 50, 20
#: Bytes that are hashed at a time; longer texts are parsed in overlapping parts.
PART = 1 << 18
#: Buckets of a partition, which are worked on one after the other; contexts whose strings are looked up at a time.
SUB, SLICE = 4, 20_000
LAST = np.iinfo(np.int64).max
#: The bucket of what a block sends to itself.
OWN = -1
RESULT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


class Contexts:
    """The contexts of some texts: for each its text's number, first byte, number of windows, seed and hash of its bytes."""

    def __init__(self, texts: list[bytes]):
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        group: list[tuple[int, int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            for a in range(0, max(len(text) - LENGTH + 1, 0), PART):
                part = text[a : a + PART + LENGTH - 1]
                if size + len(part) > PART and group:
                    self.add(cols, group)
                    group, size = [], 0
                group.append((i, a, part))
                size += len(part)
        if group:
            self.add(cols, group)
        self.text, self.start, self.windows, self.seed, self.name = (np.concatenate(c) if c else np.empty(0, kind) for c, kind in zip(cols, (np.int64, np.int64, np.int64, U64, U64)))

    @staticmethod
    def add(cols: list[list[np.ndarray]], group: list[tuple[int, int, bytes]]) -> None:
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        n = len(data)
        lengths = np.array([len(g[2]) for g in group])
        first = np.cumsum(lengths) - lengths
        word = BYTE_WORDS[data]
        hashes, width = {1: word}, 1
        while width * 2 <= SEED:
            h = hashes[width]
            hashes[width * 2] = h[:-width] * U64(pow(BASE, width, 1 << 64)) + h[width:]
            width *= 2
        rolled, have = hashes[width], width
        while have < SEED:
            step = 1 << (SEED - have).bit_length() - 1
            m = n - have - step + 1
            rolled = rolled[:m] * U64(pow(BASE, step, 1 << 64)) + hashes[step][have : have + m]
            have += step
        least, span, want = mix(rolled) >> U64(16), 1, LENGTH - SEED + 1
        while span < want:
            step = min(span, want - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        inside = np.zeros(len(least) + 1, np.int32)
        inside[first] += 1
        np.add.at(inside, first + lengths - LENGTH + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        fresh = np.ones(len(least), bool)
        fresh[1:] = least[1:] != least[:-1]
        fresh[first] = True
        at = np.flatnonzero(fresh & inside)
        order = np.cumsum(inside)
        windows = np.diff(np.append(order[at] - 1, order[-1]))
        sums = np.zeros(n + 1, U64)
        np.cumsum(word * powers(BASE, n), out=sums[1:])
        end = at + windows + LENGTH - 1
        name = mix((sums[end] - sums[at]) * powers(INVERSE, n)[at] ^ mix((end - at).astype(U64)))
        part = np.searchsorted(first, at, "right") - 1
        cols[0].append(np.array([g[0] for g in group])[part])
        cols[1].append(at - first[part] + np.array([g[1] for g in group])[part])
        cols[2].append(windows)
        cols[3].append(least[at])
        cols[4].append(name)


def load(data) -> tuple[list[tuple], np.ndarray, list[bytes]]:
    """Rows as they are without text, doc_ids as numbers, and texts of a block, by number."""
    rows = sorted(((LAST if r[0] is None else r[0], r[1].encode("utf-8", "surrogatepass"), (r[0], *r[2:])) for r in unpack(data)), key=lambda r: r[:2])
    return [r[2] for r in rows], np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


def found_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def seeds_of(keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(block, []).append(data)
        for block, data in held.items():
            _, docs, texts = load(data)
            p = Contexts(texts)
            order = np.argsort(p.seed, kind="stable")
            key, doc = p.seed[order], docs[p.text[order]]
            at = firsts(key)
            yield dealt(block, key[at], keys, np.minimum.reduceat(doc, at) if len(at) else doc, np.maximum.reduceat(doc, at) if len(at) else doc)

    return run


def dealt(block: int, seed: np.ndarray, keys: list[int], *more: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: key of its partition, bucket, block and the squeezed arrays of its seeds (sent as differences, which are small)."""
    rows = [(b, squeeze(np.diff(seed[i], prepend=U64(0)), *(x[i] for x in more))) for b, i in in_buckets(seed, keys)]
    return pa.RecordBatch.from_arrays([pa.array([keys[b % len(keys)] for b, _ in rows], pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["key", "bucket", "block", "data"])


def in_buckets(seed: np.ndarray, keys: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets that have seeds, and the places of these, in their order."""
    bucket = (seed % U64(SUB * len(keys))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(SUB * len(keys) + 1)).tolist()
    for b, (i, j) in enumerate(zip(ends, ends[1:])):
        if i < j:
            yield b, order[i:j]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """For each bucket the blocks that sent something, and what they sent; the last, bucket OWN, has what blocks sent to themselves."""
    held: dict[int, tuple[list[int], list[bytes]]] = {}
    for batch in batches:
        for bucket, block, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            blocks, sent = held.setdefault(bucket, ([], []))
            blocks.append(block)
            sent.append(data)
    for bucket in sorted(held, reverse=True):
        yield bucket, *held.pop(bucket)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's seeds those that occur in two documents or more."""
    for _, owners, data in by_bucket(batches):
        sent = [unsqueeze(x) for x in data]
        own = [np.cumsum(x[0], dtype=U64) for x in sent]
        key = np.concatenate(own)
        low, high = (np.concatenate([x[i] for x in sent]) for i in (1, 2))
        order = np.argsort(key, kind="stable")
        at = firsts(key[order])
        several = np.minimum.reduceat(low[order], at) < np.maximum.reduceat(high[order], at)
        known = key[order][at][several]
        rows = [(b, squeeze(np.diff(hit, prepend=U64(0)))) for b, k in zip(owners, own) if len(hit := k[found_in(k, known) >= 0])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])


def contexts_of(keys: list[int]):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Each context of a block whose seed is shared, once: its number, smallest and largest document, windows and bytes; and where it lies."""
        parts = [np.cumsum(unsqueeze(x)[0], dtype=U64) for x in right.column("data").to_pylist()]
        known = np.sort(np.concatenate(parts)) if parts else np.empty(0, U64)
        rows: list[tuple[int, int, bytes]] = []
        if len(known) and left.num_rows:
            _, docs, texts = load(left.column("data").to_pylist())
            p = Contexts(texts)
            hit = np.flatnonzero(found_in(p.seed, known) >= 0)
            order = hit[np.argsort(p.name[hit], kind="stable")]
            at = firsts(p.name[order])
            doc = docs[p.text[order]]
            if len(at):
                name, low, high, one = p.name[order][at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), order[at]
                placed = np.argsort(one)  # contexts are numbered by their first place, so that the numbers squeeze well
                number = np.empty(len(one), np.int64)
                number[placed] = np.arange(len(one))
                which = number[found_in(p.name[hit], name)]
                rows.append((key[0].as_py(), OWN, squeeze(which.astype(np.uint32), *(np.diff(x[hit], prepend=0).astype(np.int32) for x in (p.text, p.start)), p.windows[hit].astype(np.uint32))))
                low, high, one = low[placed], high[placed], one[placed]
                for b, i in in_buckets(p.seed[one], keys):
                    own = one[i]
                    data = b"".join([texts[t][s : s + w + LENGTH - 1] for t, s, w in zip(p.text[own].tolist(), p.start[own].tolist(), p.windows[own].tolist())])
                    rows.append((keys[b % len(keys)], b, squeeze(np.diff(i, prepend=0).astype(np.uint32), low[i], high[i] - low[i], p.windows[own].astype(np.uint32), np.frombuffer(data, np.uint8))))
        kinds = (("key", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary()))
        return pa.table({n: pa.array([(r[0], r[1], key[0].as_py(), r[2])[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})

    return run


def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and context of it that loses a string there: the context's number, how many strings it has, their smallest documents."""
    for bucket, owners, raw in by_bucket(batches):
        if bucket == OWN:
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), pa.array([True] * len(raw), pa.bool_()), pa.array(raw, pa.binary())], names=["block", "own", "data"])
            continue
        sent = [unsqueeze(x) for x in raw]
        number = np.concatenate([np.cumsum(x[0], dtype=np.int64) for x in sent])
        low, more, windows = (np.concatenate([x[i] for x in sent]) for i in (1, 2, 3))
        high, sizes = low + more, windows.astype(np.int64) + LENGTH - 1
        data = np.concatenate([x[4] for x in sent])
        begins = np.cumsum(sizes) - sizes
        name = hashed(data, begins, sizes)
        owner = np.repeat(np.arange(len(sent)), [len(x[0]) for x in sent])
        order = np.argsort(name, kind="stable")
        at = firsts(name[order])
        one, least = order[at], np.minimum.reduceat(low[order], at)  # the dictionary
        size = sizes[one] - LENGTH + 1
        base = np.cumsum(size) - size
        which, place, lcp = corpus_order(data[runs(begins[one], sizes[one])], sizes[one], LENGTH)
        doc = np.empty(len(which), np.int64)
        fresh = lcp < LENGTH  # where a string of LENGTH bytes begins that the suffix before doesn't
        doc[base[which] + place] = np.minimum.reduceat(least[which], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        lowest = np.minimum.reduceat(doc, base)
        entry = found_in(name, name[one])
        wanted = lowest[entry] < high
        rows = []
        for k, b in enumerate(owners):
            i = np.flatnonzero(wanted & (owner == k))
            if len(i):
                e = entry[i]
                n = size[e]
                flat = np.repeat(base[e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((b, squeeze(np.diff(number[i], prepend=0).astype(np.uint32), n.astype(np.uint32), doc[flat])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([False] * len(rows), pa.bool_()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "own", "data"])


def remover(schema: pa.Schema):
    """Rows of a block in `schema`: RESULT and what is carried. Where kept is a string, bytes of a character that was cut go with it."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, docs, texts = load(left.column("data").to_pylist())
        sent = list(zip(right.column("own").to_pylist(), right.column("data").to_pylist()))
        spans = removed(docs, [x for own, x in sent if own], [x for own, x in sent if not own])
        cols: list[list] = [[] for _ in schema]
        for i, text in enumerate(texts):
            own = spans.get(i, [])
            kept = b"".join([text[a:b] for a, b in zip([0, *(s[1] for s in own)], [*(s[0] for s in own), len(text)])]) if own else text
            shown = kept.decode("utf-8", "ignore") if pa.types.is_string(schema.field("kept").type) else kept
            for col, x in zip(cols, (rows[i][0], shown, len(text), len(text) - len(kept), len(own), *rows[i][1:])):
                col.append(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def removed(docs: np.ndarray, own: list[bytes], answers: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """The maximal removed runs of each text that has any, from where its contexts lie and what buckets answered."""
    spans: dict[int, list[tuple[int, int]]] = {}
    if answers:
        parts = [unsqueeze(x) for x in answers]
        numbers = np.concatenate([np.cumsum(x[0], dtype=np.int64) for x in parts])
        sizes, mins = (np.concatenate([x[i] for x in parts]).astype(np.int64) for i in (1, 2))
        base = np.cumsum(sizes) - sizes
        (which, of, begin, windows), = map(unsqueeze, own)
        of, begin, windows = np.cumsum(of, dtype=np.int64), np.cumsum(begin, dtype=np.int64), windows.astype(np.int64)
        answer = np.full(int(which.max()) + 1, -1)
        answer[numbers] = np.arange(len(numbers))
        entry = answer[which]
        every = np.flatnonzero(entry >= 0)
        for a in range(0, len(every), SLICE):
            hit = every[a : a + SLICE]
            e = entry[hit]
            n = windows[hit]
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = mins[np.repeat(base[e], n) + where] < np.repeat(docs[of[hit]], n)
            text, start = np.repeat(of[hit], n)[gone], (np.repeat(begin[hit], n) + where)[gone]
            if not len(text):
                continue
            apart = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (start[1:] > start[:-1] + LENGTH)))
            last = np.append(apart[1:], len(text)) - 1
            for t, i, j in zip(text[apart].tolist(), start[apart].tolist(), (start[last] + LENGTH).tolist()):
                own = spans.setdefault(t, [])
                if own and i <= own[-1][1]:
                    own[-1] = (own[-1][0], j)
                else:
                    own.append((i, j))
    return spans


def deduplicate(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, kept (the remaining bytes, concatenated), n_bytes, n_removed and n_spans (maximal removed runs), one row per document.

    Columns named in `carry` come along as __0, __1 and so on. With as_text, kept is a string.
    """
    keys = block_keys(block_count(docs))
    texts = blocks(docs, keys, carry)
    sent = "key int, bucket int, block int, data binary"
    known = texts.mapInArrow(lean(seeds_of(keys)), sent).repartition(len(keys), "key").mapInArrow(lean(shared), "block int, data binary")
    contexts = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lean(contexts_of(keys)), sent)
    answers = contexts.repartition(len(keys), "key").mapInArrow(lean(smallest), "block int, own boolean, data binary")
    own = T.StructType([*T._parse_datatype_string(RESULT.replace("binary", "string") if as_text else RESULT).fields, *(T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(carry))])
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(remover(to_arrow_schema(own))), own)


def deduplicate_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs with what is kept of each text; null texts stay null."""
    others = tuple(c for c in docs.columns if c != "text")
    null = "__null"
    rows = docs.withColumn(null, F.col("text").isNull())
    got = deduplicate(rows, (*others, null), as_text=True)
    own = {c: F.col(f"__{i}") for i, c in enumerate((*others, null))}
    text = F.when(~own[null], F.col("kept")).alias("text")
    return got.select(*(text if c == "text" else own[c].alias(c) for c in docs.columns))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = deduplicate(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
