"""The corpus pipeline: quality, near copies, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; docs may have more, under any names, and they stay.
An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import bpe, common, jaccard_join, mixing, pu_quality, substring_dedup
from kiln.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and very long texts are scored like any other, whole; a null id takes no part in the fit; repeated rows are
    judged alike.
    """
    return pu_quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Documents without words stay. Null ids come last in a group. Of rows that repeat an id only those that are near
    copies of one that stays go; of rows that are alike in all one stays. Very long texts are compared whole.
    """
    return jaccard_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a document with a smaller id are cut out; documents stay.

    Null text and null id: the row stays as it is. Rows that repeat an id do not cut each other.
    Very long texts are cut whole. n_chars is counted again.
    """
    cut = substring_dedup.remove_repeats(docs, keep_text=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*[(own[c] if c in own else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents are taken once, twice, in part or not at all.

    Documents without words go, since a mix is made of words. A null source is a source; null ids and repeated rows are
    documents like any other. Very long texts are cut by words like any other. n_chars is counted again.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the text decoded from them, a row for each row.

    Null and empty text: no tokens. Very long texts are encoded whole. Null ids and repeated rows have rows like any other.
    """
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]
#: The classifier cannot be expressed in SQL; tests/llm/test_pipeline_stages.py holds each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
