"""A training corpus from documents, in five stages; each is a query of the cadenza.llm operators over all that the one before it kept.

1. language: documents whose language the compression classifier rejects go (null texts and texts without a letter with them).
2. near_duplicates: of each class of near-duplicates the document with the smallest doc_id stays.
3. repeated_passages: bytes of strings that a document with a smaller doc_id has are removed; nothing is dropped.
4. personal_data: entities get surrogates.
5. packing: texts become pieces of sequences.

All but the last return the columns of documents. Lengths in n_chars follow the text. Extra columns are carried along. An empty table
passes through all stages; repeated rows of a doc_id stay together.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import op1_pii, op2_dartminhash, op6_language, op7_packing, op10_suffix
from cadenza.llm.common import read, remove, shared_folder, written


def changed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows in the columns of docs, with n_chars of the text as it is now, if docs has that column."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from all labelled documents; labels are no input of a decision. Without any label only texts without a letter go."""
    known = op6_language.learn(docs.select("doc_id", "text", "lang"))
    if not known:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return op6_language.predict(docs, known).filter(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = op2_dartminhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A cut inside a character takes the rest of it along. Null texts stay null."""
    return changed(docs, op10_suffix.deduplicate_texts(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return changed(docs, op1_pii.replace_pii(docs, op1_pii.session_key(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_packing.pack_documents(docs)


LOG = logging.getLogger(__name__)
STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]
#: Compression, signatures and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a Parquet table in the shared folder until the next one is written.

    Rows in and out of each stage are logged. If a stage fails, the tables written so far are removed.
    """
    docs, folder = read(spark, sf_dir, "documents"), shared_folder(spark)
    before = docs.count()
    try:
        for i, (name, stage) in enumerate(STAGES[:-1]):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
            after = docs.count()
            LOG.info("%s: %d rows in, %d out", name, before, after)
            before = after
            if i:
                remove(spark, f"{folder}/{STAGES[i - 1][0]}")
        return STAGES[-1][1](spark, docs, sf_dir)
    except Exception:
        remove(spark, folder)
        raise
