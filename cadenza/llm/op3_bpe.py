"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern. Distinct words are encoded once: a Spark fold over a word's byte array merges, step
by step, the adjacent pair of the lowest rank, looked up in a literal rank map. Texts are read and split once and never shuffled:
a block of documents becomes its distinct words, which go to the buckets where they are folded, and the documents as numbers of
these words, which wait for the ids. Decoding concatenates the binary pieces of ids.

Null texts are empty and empty texts have no ids (digests of the empty string). Words of any length are folded whole. Repeated
rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, block_keys, doc_texts, lean, murmur, read, release, squeeze, unsqueeze

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No pair has this rank. Ids are below 2**17, so a pair is a number below 2**34.
NONE, BITS = 1 << 40, 17
#: Small maps of the rank map; a power of two.
BUCKETS = 1 << 15
#: Characters of the texts of a block, more if one text has more.
BLOCK_CHARS = 8_000_000
#: Bits of a block's number that hold its place among the keys; 2**24 keys are 500 TB of stored text. The rest numbers blocks.
PLACE = 24
#: A block that waits for a word, and the word's number there.
WAITING = np.dtype([("source", "<i8"), ("number", "<u4")])
TOKENS = "doc_id long, n_tokens long, ids binary, decoded binary"


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> tuple[bytes, ...]:
    """The bytes of each id of a rank file."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return tuple(ranks.get(i, b"") for i in range(max(ranks) + 1))


@functools.lru_cache(maxsize=4)
def merges(path: str) -> dict[int, int]:
    """For every pair of ids whose joint bytes are in the vocabulary, left << BITS | right, the id that it merges to, which is its rank.

    Their number is bounded by the vocabulary: every entry has fewer splits than bytes.
    """
    ids = {p: i for i, p in enumerate(pieces(path)) if p}
    return {ids[p[:k]] << BITS | ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}


@functools.lru_cache(maxsize=4)
def rank_map(path: str) -> str:
    """The rank map as JSON: an array of BUCKETS small maps, a pair's being chosen by its hash (a map is searched from end to end)."""
    pairs = merges(path)
    keys = np.array(list(pairs), np.int64)
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for pair, at in zip(pairs, (murmur([keys & 0xFFFFFFFF, keys >> 32]) & (BUCKETS - 1)).tolist()):
        maps[at][str(pair)] = pairs[pair]
    return json.dumps(maps, separators=(",", ":"))


def literal(numbers) -> Column:
    """An array literal; the optimizer folds the split and the cast."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def rank(held: Column, pair: Column) -> Column:
    """The rank of a pair by the rank map, or NONE."""
    return F.coalesce(F.try_element_at(F.get(held, F.hash(pair).bitwiseAND(F.lit(BUCKETS - 1))), pair), F.lit(NONE))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_word(values: Column, path: str) -> Column:
    """array<bigint>: the ids of one word, given as array<int> of its bytes' values, by a fold over them.

    The fold's state is the ids between two sentinels, which merge with nothing, and the rank of each id with the next one. The rank
    map is folded to a literal by the optimizer; it is bound once, so that a plan holds one copy of it.
    """
    single = {p[0]: i for i, p in enumerate(pieces(path)) if len(p) == 1}
    first = literal([single[b] for b in range(256)])
    ids = F.transform(values, lambda c: F.get(first, c))
    table = F.from_json(F.lit(rank_map(path)), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")
    edge, rest = F.array(F.lit((1 << BITS) - 1).cast("bigint")), F.lit(1 << 30)
    pair = lambda a, b: F.shiftleft(a, BITS) + b
    state = lambda ids, ranks: F.struct(ids.alias("ids"), ranks.alias("ranks"))

    def folded(held: Column) -> Column:
        def merge(x: Column) -> Column:
            """The state after the pair `at` (from 1) merges to `best`: only the ranks beside it change."""
            ids, ranks, best, at = x.ids, x.ranks, x.best, x.at
            beside = F.array(rank(held, pair(F.get(ids, at - 2), best)), rank(held, pair(best, F.get(ids, at + 1))))
            return state(F.concat(F.slice(ids, 1, at - 1), F.array(best), F.slice(ids, at + 2, rest)), F.concat(F.slice(ranks, 1, at - 2), beside, F.slice(ranks, at + 2, rest)))

        def step(acc: Column, _: Column) -> Column:
            best = F.array_min(acc.ranks)
            found = F.struct(acc.ids.alias("ids"), acc.ranks.alias("ranks"), best.alias("best"), F.array_position(acc.ranks, best).cast("int").alias("at"))
            return F.when(best >= NONE, acc).otherwise(let(found, merge))

        def fold(ids: Column) -> Column:
            ranks = F.transform(F.zip_with(ids, F.slice(ids, 2, rest), pair), lambda p: F.when(p.isNull(), F.lit(NONE)).otherwise(rank(held, p)))
            return F.aggregate(values, state(ids, ranks), step, lambda acc: F.slice(acc.ids, 2, F.size(acc.ids) - 2))

        return let(F.concat(edge, ids, edge), fold)

    return F.when(F.size(values) < 2, ids).otherwise(let(table, folded))


def decode_ids(ids: Column, path: str) -> Column:
    """The bytes of an array of ids, by concatenating their binary pieces; ids that the vocabulary lacks and null add nothing."""
    held = F.split(F.lit(",".join(p.hex() for p in pieces(path))), ",")
    return F.unhex(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), lambda i: F.coalesce(F.get(held, i.cast("int")), F.lit(""))), ""))


#: The characters below U+0100 that are letters, numbers and white space.
LETTER, NUMBER, SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r" \t\n\x0b\x0c\r\x85\xa0"


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function from a text to its words. Texts below U+0100 take a faster library, with the usual pattern's classes written out."""
    import regex

    split = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return split
    narrow = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
    beyond = re.compile(r"[^\x00-\xff]").search
    return lambda text: split(text) if beyond(text) else narrow(text)


def scan(pattern: str, keys: list[int]):
    """A mapInArrow function from documents to rows (key, source, data): words (source -1) for a bucket, numbered texts of a block.

    A block's number holds the place in `keys` that its texts wait at, so that a bucket can answer.
    """

    def block(serial: int, docs: list, numbers: dict[str, int], texts: list[np.ndarray]) -> pa.RecordBatch:
        """A block whose words are numbered by their first place in it."""
        place = ((serial >> 12) + 61 * (serial & 4095)) % len(keys)  # blocks of neighbouring partitions lie apart
        source = serial << PLACE | place
        flat = np.concatenate(texts)
        first = np.fromiter(numbers.values(), np.int64, len(numbers))
        often = np.argsort(-np.bincount(flat, minlength=len(flat))[first], kind="stable")  # frequent words get small numbers
        code = np.empty(len(first), np.uint32)
        code[often] = np.arange(len(often))
        renamed = np.zeros(len(flat), np.uint32)
        renamed[first] = code
        flat = renamed[flat]
        rare = flat >= 0xFFFF
        ids = np.array([-1 if d is None else d for d in docs], np.int64)
        null = np.array([d is None for d in docs], np.uint8)
        rows = [(keys[place], source, squeeze(ids, null, np.array([len(t) for t in texts], np.int64), np.where(rare, 0xFFFF, flat).astype(np.uint16), flat[rare]))]
        names = [w.encode("utf-8", "surrogatepass") for w in numbers]
        bucket = np.fromiter(map(zlib.crc32, names), np.uint32, len(names)) % len(keys)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(len(keys) + 1)).tolist()
        sizes = np.fromiter(map(len, names), np.uint32, len(names))
        for b, (i, j) in enumerate(zip(ends, ends[1:])):
            if i < j:
                own = order[i:j]
                rows.append((keys[b], -1, squeeze(np.array([source], np.int64), code[own], sizes[own], np.frombuffer(b"".join([names[k] for k in own.tolist()]), np.uint8))))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["key", "source", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        serial = TaskContext.get().partitionId() << 12  # blocks of a partition; far fewer than that
        docs, numbers, texts, size, place = [], {}, [], 0, itertools.count()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = split(text)
                docs.append(doc)
                texts.append(np.fromiter(map(numbers.setdefault, found, place), np.uint32, len(found)))
                size += len(text)
                if size > BLOCK_CHARS:
                    yield block(serial, docs, numbers, texts)
                    release()
                    docs, numbers, texts, size, place, serial = [], {}, [], 0, itertools.count(), serial + 1
        if docs:
            yield block(serial, docs, numbers, texts)

    return run


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a bucket as its bytes' values, with the blocks and numbers that wait for it."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for key, source, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if source < 0:
                held.setdefault(key, []).append(data)
    for sent in held.values():
        index: dict[bytes, int] = {}
        place = itertools.count()
        which, sources, numbers = [], [], []
        for data in sent:
            source, number, lengths, flat = unsqueeze(data)
            words = cut_up(flat.tobytes(), lengths.astype(np.int64))
            which.append(np.fromiter(map(index.setdefault, words, place), np.int64, len(words)))
            sources.append(np.repeat(source, len(words)))
            numbers.append(number)
        which = np.concatenate(which)
        first = np.fromiter(index.values(), np.int64, len(index))
        dense = np.zeros(len(which), np.int64)
        dense[first] = np.arange(len(first))
        which = dense[which]
        order = np.argsort(which, kind="stable")
        waiting = np.rec.fromarrays([np.concatenate(sources)[order], np.concatenate(numbers)[order]], dtype=WAITING)
        ends = np.append(0, np.cumsum(np.bincount(which)))
        words = list(index)
        for a in range(0, len(words), 10_000):
            part = words[a : a + 10_000]
            cuts = ends[a : a + len(part) + 1]
            values = np.frombuffer(b"".join(part), np.uint8).astype(np.int32)
            starts = np.append(0, np.cumsum([len(w) for w in part])).astype(np.int32)
            raw = waiting[cuts[0] : cuts[-1]].tobytes()
            places = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(((cuts - cuts[0]) * WAITING.itemsize).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts), pa.array(values)), places], names=["word", "places"])


def answers(keys: list[int]):
    """A mapInArrow function from words' ids to rows (key, source, data): for a block, ids of its words in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            places, ids = batch.column(0), batch.column(1)
            flat = ids.flatten().to_numpy().astype(np.uint32)
            size = np.diff(ids.offsets.to_numpy())
            at = np.cumsum(size) - size
            raw = [x.as_py() for x in places]
            waiting = np.frombuffer(b"".join(raw), WAITING)
            word = np.repeat(np.arange(len(raw)), [len(x) // WAITING.itemsize for x in raw])
            order = np.argsort(waiting["source"], kind="stable")
            source, word, number = waiting["source"][order], word[order], waiting["number"][order]
            cuts = np.append(np.flatnonzero(np.append(True, source[1:] != source[:-1])), len(source))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                n = size[word[a:b]]
                pick = np.repeat(at[word[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                held.setdefault(int(source[a]), []).append((number[a:b], n.astype(np.uint16 if n.max() < 65536 else np.uint32), flat[pick]))
        rows = [(keys[source & (1 << PLACE) - 1], source, squeeze(*(np.concatenate(x) for x in zip(*parts)))) for source, parts in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["key", "source", "data"])

    return run


@functools.lru_cache(maxsize=4)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces end to end, and where each id's begins and how long it is."""
    sizes = np.array([len(p) for p in pieces(path)])
    return np.frombuffer(b"".join(pieces(path)), np.uint8), np.cumsum(sizes) - sizes, sizes


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `starts`, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def cut_up(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def coded_words(parts: list[list[np.ndarray]], path: str) -> tuple[list[bytes], list[bytes]]:
    """For the words of a block, by number, their ids as bytes and the bytes that these ids decode to."""
    number, size, ids = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3
    size = size.astype(np.int64)
    order = np.argsort(number, kind="stable")
    ids = gathered(ids, (np.cumsum(size) - size)[order], size[order]).astype("<u4")
    size = size[order]
    flat, starts, lengths = piece_table(path)
    text = gathered(flat, starts[ids], lengths[ids])
    ends = np.append(0, np.cumsum(lengths[ids]))
    last = np.cumsum(size)
    return cut_up(ids.tobytes(), 4 * size), cut_up(text.tobytes(), ends[last] - ends[last - size])


def assemble(path: str):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for source, data in zip(right.column("source").to_pylist(), right.column("data").to_pylist()):
            parts.setdefault(source, []).append(data)
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()}
        tables = [pa.table({n: pa.array([], k) for n, k in kinds.items()})]
        for source, data in zip(left.column("source").to_pylist(), left.column("data").to_pylist()):
            if source < 0:
                continue
            out: list[list] = [[], [], [], []]
            docs, null, lengths, common, rare = unsqueeze(data)
            words = common.astype(np.uint32)
            words[common == 0xFFFF] = rare
            code, plain = coded_words([unsqueeze(x) for x in parts.pop(source, ())], path)
            ends = np.cumsum(lengths)
            for doc, none, a, b in zip(docs.tolist(), null.tolist(), (ends - lengths).tolist(), ends.tolist()):
                own = words[a:b].tolist()
                packed = b"".join(map(code.__getitem__, own))
                for col, x in zip(out, (None if none else doc, len(packed) // 4, packed, b"".join(map(plain.__getitem__, own)))):
                    col.append(x)
            del code, plain
            tables.append(pa.table({n: pa.array(c, k) for c, (n, k) in zip(out, kinds.items())}))
        return pa.concat_tables(tables)

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes), one row per document.

    A task holds one block (BLOCK_CHARS of text and its distinct words), or the distinct words of one bucket, of which there are
    twice as many as shuffle partitions, or more for a large table. A word is in a bucket once for each block that has it, however often that is.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    keys = block_keys(2 * block_count(docs))
    if len(keys) > 1 << PLACE:
        raise ValueError(f"{len(keys)} keys: encode the table in parts")
    row = "key int, source long, data binary"
    sent = doc_texts(docs).mapInArrow(lean(scan(pattern, keys)), row).repartition(len(keys), "key")
    coded = sent.mapInArrow(lean(distinct_words), "word array<int>, places binary").select("places", encode_word(F.col("word"), path).alias("ids"))
    back = coded.mapInArrow(lean(answers(keys)), row)
    return sent.groupBy("key").cogroup(back.groupBy("key")).applyInArrow(lean(assemble(path)), TOKENS)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
