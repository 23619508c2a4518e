"""A corpus pipeline over ``documents``: each stage calls one operator.

Quality rules drop what they reject; of exact copies and of near copies (five
words, similarity 0.8) one stays; sources are mixed to target weights, so a
document may be left out or stand several times; what is left is segmented.
All stages but the last return the columns of their input.

Every stage takes null ids, texts, languages and sources, empty and very long
texts, repeated rows, an empty table and extra columns of any name: a null text
is empty (and falls to the quality rules), equal rows are exact copies of each
other, nulls of a source are a source of their own, and an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import documents, written
from marlstone.llm.exact import distinct_documents
from marlstone.llm.mixing import mixed
from marlstone.llm.near import one_of_each
from marlstone.llm.pieces import segmented
from marlstone.llm.quality import good_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass; null and empty texts do not."""
    return good_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id (null ranks last)."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id; texts without words are in no group."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix passes them, 0 to 3 times; texts without words never."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces and whether they decode to the text, for each row."""
    return segmented(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: The last stage has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and reread."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
