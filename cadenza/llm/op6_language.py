"""Language identification by compression.

Each language has a zstandard raw-content dictionary of text in it. A text, reduced to lower-case letters and single spaces,
is compressed block by block with each dictionary; the language whose dictionary leaves the fewest bytes wins. The margin is
the share of bytes by which the runner-up is larger; a text is rejected when its margin is under `MARGIN`, and always when it
is null or has no letter (then the language is `und` and the score 0).

Dictionaries are built from a bounded sample of the labelled rows: the SAMPLE documents of each language that have the smallest hash
of doc_id (of the text, where it is null), each giving one block of BLOCK characters at a place that the same hash chooses, DICTIONARY
bytes in all. At most MOST blocks of a language reach the driver, however often an id repeats. Without labelled rows every text is
`und` and rejected. Ties go to the language with more labelled rows, then to the one that sorts first. Repeated rows give repeated
results; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, read

SAMPLE, BLOCK, DICTIONARY = 160, 1200, 120_000
MOST = 2 * SAMPLE
#: zstandard's level for texts of SHORT bytes and more, and for shorter ones.
LEVEL, SHORT_LEVEL, SHORT = 6, 15, 600
#: Ends every dictionary and starts every block: zstandard stores what it can't shrink by some bytes, and the saving on this
#: text lets the matches of very short texts count.
FILLER = bytes(33 + (i * 37) % 90 for i in range(90))
#: Characters of a text that are compressed at a time; all blocks of a text count.
WINDOW = 6000
#: The least margin that is accepted, and the margin at which the score is one half.
MARGIN, HALF = 0.002, 0.03
NOT_LETTERS = re.compile(r"[\W\d_]+")
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def letters(text: str | None) -> str:
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Dictionary content by language, the most frequent first, from rows (doc_id, text, lang); null languages are left out."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))), F.lit(1 << 40)).alias("h"))
    found = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    lowest = Window.partitionBy("lang").orderBy("h")
    edges = rows.select("lang", "h", F.row_number().over(lowest).alias("no")).filter(F.col("no") <= sample).groupBy("lang").agg(F.max("h")).collect()
    wanted = functools.reduce(Column.__or__, ((F.col("lang") == lang) & (F.col("h") <= h) for lang, h in edges), F.lit(False))
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    blocks = rows.filter(wanted).select("lang", "h", plain.alias("plain")).filter(F.length("plain") > 0)
    starts = F.pmod("h", F.greatest(F.lit(1), F.length("plain") - BLOCK)).cast("int") + 1
    content: dict[str, list[str]] = {}
    first = Window.partitionBy("lang").orderBy("h", "block")
    taken = blocks.select("lang", "h", F.substring("plain", starts, F.lit(BLOCK)).alias("block")).withColumn("no", F.row_number().over(first)).filter(F.col("no") <= MOST)
    for r in taken.orderBy("lang", "h", "block").collect():
        content.setdefault(r.lang, []).append(r.block)
    return {lang: " ".join(content[lang]).encode()[:DICTIONARY] for lang in sorted(content, key=lambda x: (-found[x], x))}


@functools.lru_cache(maxsize=2)
def compressors(content: tuple[tuple[str, bytes], ...]):
    """For each language its name and two compressors: for longer texts, for short ones."""
    import zstandard

    out = []
    for lang, data in content:
        d = zstandard.ZstdCompressionDict(data + FILLER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        sizes = ((LEVEL, WINDOW), (SHORT_LEVEL, SHORT))
        params = [zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(data), source_size=size, **bare) for level, size in sizes]
        out.append((lang, *(zstandard.ZstdCompressor(dict_data=d, compression_params=p) for p in params)))
    return out


def classify(text: str | None, coders, margin: float = MARGIN) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected."""
    plain = letters(text)
    if not plain or not coders:
        return "und", 0.0, True
    sizes = [0] * len(coders)
    for a in range(0, len(plain), WINDOW):
        block = FILLER + plain[a : a + WINDOW].encode()
        for i, (_, long, short) in enumerate(coders):
            sizes[i] += len((long if len(block) >= SHORT else short).compress(block))
    order = sorted(range(len(coders)), key=lambda i: (sizes[i], i))
    best = order[0]
    gap = (sizes[order[1]] - sizes[best]) / sizes[best] if len(order) > 1 else 1.0
    return coders[best][0], gap / (gap + HALF), gap < margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The given columns, which must include text, and lang_pred, score and rejected; text itself decides, no other column."""
    content, kept = tuple(dictionaries.items()), [c for c in docs.columns if c not in RESULT.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = compressors(content)
        at = kept.index("text")
        for batch in batches:
            got = [classify(t.as_py(), coders) for t in batch.column(at)]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, *RESULT.names])

    rows = docs.select(*kept)
    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, *RESULT.fields]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), known)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
