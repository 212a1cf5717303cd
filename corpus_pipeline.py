"""From raw documents to token files, in five stages.

Each stage takes the table that the one before it wrote and keeps the columns
of documents; the last one returns what stands in the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm._common import DOCUMENT_COLUMNS, pick, table, written
from strandline.llm.decontaminate import find_items
from strandline.llm.jaccard_join import one_of_each
from strandline.llm.langid import fitted, identify
from strandline.llm.mixing import mixed_rows
from strandline.llm.token_files import token_file_digests

#: Workers that earlier stages have used keep some of their memory, so their caches are small here.
CACHE_ENTRIES = 50_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, those without letters or with too narrow a margin go.

    Repeated rows and equal texts are judged alike; without any labelled
    language nothing is recognised, and nothing stays.
    """
    found = identify(docs, fitted(docs), keep=DOCUMENT_COLUMNS)
    return found.where("not rejected").select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of the least id (null first), then text hash.

    Of repeated rows one stays, the one whose other columns come first; empty
    and null texts are copies of each other.
    """
    return one_of_each(pick(docs, *DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty texts and an empty benchmark leave everything."""
    found = find_items(docs, table(spark, sf_dir, "benchmark"), keep=DOCUMENT_COLUMNS)
    return found.where("not contaminated").select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights.

    A null source is a source, the last; documents without words go where
    their source's share is below one epoch; equal rows count one by one.
    """
    return mixed_rows(pick(docs, *DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the token files, and a digest of its ids read back; a null text has the end id only."""
    return token_file_digests(docs, cache_entries=CACHE_ENTRIES)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Compression and tokenization are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
