"""Corpus pipeline: toxicity, language, near-duplicates, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and its
result is written as Parquet and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadveil.llm import langid, packing, pii, simhash, toxicity
from roadveil.llm.common import staged, table


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time, not ten thousand: the stages share executors, and a batch is held
    on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain holds for toxic go.

    Null and empty texts are judged by the models' constants, very long ones whole; repeated rows and null ids stay or go by their
    text. Without labels all rows stay. Further columns go along, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go.

    Null texts and texts without a letter go, very long ones are read whole; repeated rows and null ids stay or go by their text. Where
    no language can be learned all rows stay. Further columns go along; an empty table stays empty.
    """
    small_batches(spark)
    return langid.keep_identified(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: of those that SimHash fingerprints link at three bits or fewer, by operator 1's trees.

    The one with the smallest id, and of rows equal in id and text one. Texts without a word, null and empty ones too, are alike: one of them stays.
    Texts of under three words are one shingle, very long ones are read whole. Rows without an id stay. Further columns go along; an empty table
    stays empty.
    """
    small_batches(spark)
    return simhash.keep_first(spark, docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it leave the texts.

    No row goes. Null texts stay null and empty ones empty, very long ones are searched whole; repeated rows count as often as they
    occur and end alike, null ids stay. ``n_chars`` follows the text, other columns are untouched; an empty table stays empty.
    """
    small_batches(spark)
    return pii.sanitise(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each id of a document in one of them.

    Null and empty texts are the end id alone, very long ones full sequences and a rest; repeated rows are packed as often as they occur, null
    ids stay null. Further columns are left behind; an empty table gives no pieces.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_dedup", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: no stage can be said in SQL; tests hold the operators' scores, kept rows, spans and ids against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
