"""Corpus pipeline: documents to packed token sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; all but the last return the columns of documents. All
stages read whole texts, keep rows with a null doc_id as rows of their own, ignore
the values of other columns but carry them, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselar.llm import langid, likeness, mixing, packing, substring, tokens
from tesselar.llm.common import Workspace, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null and empty texts and texts without a letter. Repeated rows stay."""
    return langid.keep_identified(docs, langid.vocabulary())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates: five-word Jaccard likeness of 0.8 or more.

    Of repeated rows one stays; a null doc_id stays only where its group has no other.
    """
    return likeness.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that a document with a smaller doc_id has; what loses all its words leaves.

    Null texts and repeated rows of one id stay as they are; equal texts of two ids stay with the smaller.
    """
    return substring.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source the words its target asks for, repeats as rows of their own.

    A null source is a source; null texts and those without words weigh nothing and stay; ties go by digests.
    """
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix's token ids into sequences of 4096: each piece's ids with its sequence and offset.

    A null text is the end id alone; repeated rows and equal lengths are pieces like any other.
    """
    return packing.pack_documents(docs, tokens.vocabulary(), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            ws.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
