"""What the operators of this subpackage share: checkpoints, column guards, vectorised byte hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of a stored table that go into one block of texts.
STORED = 64 << 20
GOLD = U64(0x9E3779B97F4A7C15)
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def release() -> None:
    """Give freed memory back to the system: Python workers live on and share an executor's memory with what comes next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function for mapInArrow (of batches) or for cogrouped applyInArrow (of key, left, right) that releases memory at its end."""

    @functools.wraps(run)
    def stream(batches):
        try:
            yield from run(batches)
        finally:
            release()

    def group(key, left, right):
        out = run(key, left, right)
        release()
        return out

    return group if run.__code__.co_argcount == 3 else stream


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder of spark.checkpoint.dir, or where driver and executors are one process a temporary one.

    A cluster without that setting is an error: a folder of one machine can't be read by the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder; lineage ends here."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path beside the checkpoints, which all executors see."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """The same rows as a Parquet table, read again."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame) -> int:
    """As many blocks as shuffle partitions, or more, so that a block has STORED bytes of the table as it is stored at most, where that is known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), -(-size // STORED) if size < 1 << 60 else 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns only; columns with clashing names are never carried along."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser on uint64."""
    x = x + GOLD
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    have = 1
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * U64(pow(base, have, 1 << 64))
        have += m
    return out[:n]


#: An odd multiplier of the rolling hashes, and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: A fixed random word for each byte value.
BYTE_WORDS = mix(np.arange(256, dtype=U64) * U64(0x5851F42D4C957F2D))


def murmur(words: list[np.ndarray]) -> np.ndarray:
    """What Spark's hash() gives for an int (one word of 32 bits) or a bigint (the low word, then the high one)."""
    u = np.uint32
    turn = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    h = np.full(len(words[0]), 42, u)
    for k in words:
        k = turn(k.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
        h = turn(h ^ k, 13) * u(5) + u(0xE6546B64)
    h ^= u(4 * len(words))
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def block_keys(n: int) -> list[int]:
    """n whole numbers of which repartition(n, key) deals one to each partition; n is a number of partitions, not of rows."""
    found = np.full(n, -1)
    start = 0
    while (found < 0).any():
        keys = np.arange(start, start + 4 * n + 64)
        found[murmur([keys])[::-1] % n] = keys[::-1]
        start += len(keys)
    return found.tolist()


def blocks(docs: DataFrame, keys: list[int], carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (block, data): compressed documents, dealt over len(keys) blocks by a hash of doc_id. The texts are shuffled once, here.

    Every later pass over a block's texts reads the same exchange, so what is found elsewhere about a block comes to the texts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            parts: dict[int, list] = {}
            more = zip(*(c.to_pylist() for c in batch.columns[2:])) if carry else iter(lambda: (), None)
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), more):
                parts.setdefault(zlib.crc32(b"%d" % (-1 if doc is None else doc)) % len(keys), []).append((doc, text.as_py(), *own))
            coder = zstandard.ZstdCompressor(level=3)
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in parts], pa.int32()), pa.array([coder.compress(pickle.dumps(v)) for v in parts.values()], pa.binary())], names=["block", "data"])

    return doc_texts(docs, *(F.col(c).alias(f"__{i}") for i, c in enumerate(carry))).mapInArrow(lean(pack), "block int, data binary").repartition(len(keys), "block")


def unpack(data) -> Iterator[tuple]:
    """doc_id, text and what is carried of a block's rows."""
    import zstandard

    for x in data:
        yield from pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; the bytes of equal significance lie together, which compresses numbers of a narrow range well."""
    import zstandard

    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    import zstandard

    return [np.frombuffer(raw, np.uint8).reshape(-1, n).T.copy().view(kind).ravel() if n else np.empty(0, kind) for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data))]
