"""Corpus pipeline: quality filter, near duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadlake.llm.decontaminate import clean_documents
from leadlake.llm.mixing import mixed_documents
from leadlake.llm.quality import good_documents
from leadlake.llm.shingle_join import one_of_each
from leadlake.llm.token_files import encode_documents, word_bpe
from leadlake.llm.work import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null text counts as empty and is judged like one; of rows that repeat a doc_id each is judged
    by its own text, null ids included. No rows give no rows."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies.

    First means the smallest doc_id. Rows without id stay, and so do texts without words; rows
    with one doc_id are one document and stay or go together. No rows give no rows."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs.

    Null or empty text has no words and stays; of rows that repeat a doc_id each is judged by its
    own text, null ids included. No rows give no rows."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it.

    Null source is a source of its own, the last one; rows with one doc_id (null ids too) are each
    repeated as often as the largest draw among them. No rows give no rows."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; their digests, one row per document of the mix.

    Null text is empty: the end id alone. Repeats are encoded each, equal ids in the order of a
    hash of their texts, null ids first. No rows give no rows."""
    return encode_documents(docs, word_bpe())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: The classifier and the tokenizer can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
