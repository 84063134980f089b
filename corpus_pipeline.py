"""A training corpus from raw documents: five stages, each calling one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All but the last keep the columns of
``documents``.

Defined cases, in all stages: a null doc_id or source is a value like any other; a very
long text is taken as a whole; repeated rows are judged alike; an empty table gives an
empty result; further columns of ``docs``, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, language_id, mixing, near_duplicates, token_files
from quillstone.llm.queries import MIX_WEIGHTS, tokenizer_json
from quillstone.llm.staging import read, stage

#: A document stays if its language is predicted with at least this calibrated probability.
LEAST_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them), and those of no clear language, go.

    The model learns from all labelled rows; a null lang teaches nothing, and without
    any label all documents go.
    """
    found = language_id.predicted(docs, language_id.fit(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest doc_id; of repeated rows one stays.

    Null texts are one class, as are empty ones.
    """
    return near_duplicates.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of ``benchmark`` go; null and empty texts overlap none."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources meet their target weights; the order is shuffled.

    Repeated rows are drawn alike; a null source is one of its own, with weight 1.
    """
    return mixing.replicated(docs, MIX_WEIGHTS).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32; a null or empty text is the end id alone."""
    return token_files.token_files(docs, tokenizer_json())


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The language model can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
