import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Nulls, empty and odd texts, ties, repeated rows; a clashing extra column.
TEXTS = ["", None, " ", "a", "one two three four five six seven", "one two three four five six seven", "日本語のテキスト 🙂", "x" * 3000, "tab\tline\nreturn\r\n", "The quick brown fox's 123 dogs, they'll   jump!!  ", "\x00\x01", "áé ß İ", "word " * 900, "é" * 60 + "same passage of more than fifty bytes that is repeated here"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of hard cases: ids from 0, one null id, one repeated row, extra columns named like results."""
    rows = [(i, t, None if i % 3 else "en", "s", i) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", 1), (None, "no id but some words to read in it", None, "s", 2), (900, "é" * 60 + "same passage of more than fifty bytes that is repeated here", "en", "s", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("kept", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample(spark, sf):
    """The smallest table's documents, as a dictionary by doc_id."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
