"""What the operators on embeddings share: valid vectors as bytes, one row for each distinct vector, random rotations."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind_of(df: DataFrame, column: str = "embedding") -> str:
    """The numpy type that holds the elements of an array column exactly."""
    return "<f4" if isinstance(df.schema[column].dataType.elementType, T.FloatType) else "<f8"


def packed(df: DataFrame, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(ident, vector): the vector's bytes, or null where it is null, empty, zero or holds null or non-finite components."""
    kind = kind_of(df, column)
    wide = F.col(column).cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.when(~bad & F.exists(wide, lambda x: x != 0), wide)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x.as_py() is None else x.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=[ident, "vector"])

    return df.select(ident, usable.alias("wide")).mapInArrow(pack, f"{ident} long, vector binary")


@functools.lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation of `dim` dimensions, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dim, seed]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one dimension as doubles."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
