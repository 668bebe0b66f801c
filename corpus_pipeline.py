"""The corpus pipeline: documents to packed sequences in five stages.

Every stage works on all that the one before kept. A stage is a function of
(spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import lines, packing, shingles, substrings, toxicity
from foliant.llm.common import checkpoint_folder, read_table, remove_folder

#: Coded pieces that a worker remembers while packing: less than the operator's own, for workers that serve all stages.
KEPT_PIECES = 250_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame, text) -> DataFrame:
    """The columns of documents with a new text."""
    return rows.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is scored as the empty one; rows without an id are scored too. Equal rows
    stay or go together.
    """
    return toxicity.score(docs, read_table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay in the first of them only: of many copies one keeps its text.

    Texts without such lines, null ones too, stay as they are; a text whose lines all go is empty.
    """
    rows = lines.drop_common_lines(docs, keep_first=True)
    return _documents(rows, F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints, then prefixes, at an exact Jaccard similarity of 0.8 of five-word shingles.

    Null and blank texts are one group. Rows without an id stay; rows that share an id but
    not a text are documents of their own, and repeated rows stay or go together.
    """
    return shingles.keep_one(docs).select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier go; texts without any, null ones too, stay as they are."""
    rows = substrings.drop_repeats(docs)
    return _documents(rows, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is one piece that holds the end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, kept=KEPT_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]

#: Models and packing are not SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again.

    The folder goes when the last stage, which reads its input eagerly, has returned.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove_folder(spark, folder)
