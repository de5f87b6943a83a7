"""Packing: best-fit decreasing of token sequences into windows of a fixed size.

A document's ids (text, then one separator id) are cut into full windows first; the rest of it, shorter than a window, is
placed by best-fit decreasing: a segment tree over remaining capacities finds the tightest open window that holds it.

Null and empty texts are one piece that holds the separator. Repeated rows and repeated or null doc_ids are packed row by row.
An empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark import TaskContext

from .common import doc_texts, lean, read

WINDOW, SEPARATOR, TOKENIZER = 1024, 0, "byte_bpe_50k.json"
#: Characters that are tokenized together at most, unless one text is longer.
BATCH_CHARS = 2_000_000
#: Longest run of white space that goes to tiktoken, whose regular expression overflows its stack on a run of a million.
LONGEST_RUN = 100_000
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
PIECES = ", ".join(f"{c} long" for c in COLUMNS)
PACKED = PIECES + ", sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The ids of the vocabulary file by tiktoken, which takes an added token that a text spells out as ordinary characters."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec["added_tokens"]}
    letters = byte_alphabet()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The vocabulary file as the tokenizers library reads it, and the added tokens that it finds in texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, tuple(x.content for x in t.get_added_tokens_decoder().values())


def text_ids(text: str, path: str) -> list[int]:
    """The ids that tokenizers gives by default, an added token that the text spells out being one id.

    tiktoken, which is faster, gives the same ids unless the text has an added token, or a run of white space that is too long for it.
    """
    tokenizer, added = library(path)
    if any(x in text for x in added) or len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in re.finditer(r"\s+", text)):
        return tokenizer.encode(text, add_special_tokens=False).ids
    return encoder(path).encode_ordinary(text)


def pieces(tokenizer: str, window: int, separator: int):
    """A mapInArrow function: rows (doc_id, text) to the pieces that each document is cut into, numbered by their place in the input."""

    def cut_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*text_ids(text.as_py(), tokenizer), separator], "<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    for col, x in zip(cols, (doc, a, len(part), zlib.crc32(part.tobytes()), len(ids))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(range(serial, serial + len(cols[0])), pa.int64())], names=[*COLUMNS, "place"])
            serial += len(cols[0])

    return cut_documents


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths must not increase.

    Leaf c of the tree counts the open windows with c free places, inner nodes the sum below; the tightest window is the first
    leaf from `length` on that isn't zero. Which of several equally tight windows is taken: the one opened or filled last.
    """
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    open_by: list[list[int]] = [[] for _ in range(window + 1)]
    filled: list[int] = []
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def add(c: int, d: int) -> None:
        c += size
        while c:
            tree[c] += d
            c >>= 1

    def tightest(c: int) -> int:
        i = c + size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - size

    for k, n in enumerate(lengths.tolist()):
        free = tightest(n) if n < window else -1
        if free < 0:
            s, free = len(filled), window
            filled.append(0)
        else:
            s = open_by[free].pop()
            add(free, -1)
        seq[k], off[k] = s, filled[s]
        filled[s] += n
        if free > n:
            open_by[free - n].append(s)
            add(free - n, 1)
    return seq, off


def place(window: int):
    """A mapInArrow function over a partition of pieces, longest first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        t = pa.Table.from_batches(table)
        seq, off = best_fit(t.column("length").to_numpy(), window)
        seq += TaskContext.get().partitionId() << 32
        t = t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
        yield from t.combine_chunks().to_batches(max_chunksize=50_000)

    return pack


def pack_documents(docs: DataFrame, window: int = WINDOW, separator: int = SEPARATOR, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces are dealt by their place in the input, evenly whatever ids and texts repeat, over partitions whose size the engine adapts, and each partition is packed on its own, so memory is bounded by
    a partition's pieces (56 bytes each), and the padding of a partition is that of its last few windows.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    cut = doc_texts(docs).mapInArrow(lean(pieces(path, window, separator)), PIECES + ", place long")
    dealt = cut.repartition("place").sortWithinPartitions(cut.length.desc(), "place").select(*COLUMNS)
    return dealt.mapInArrow(lean(place(window)), PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
