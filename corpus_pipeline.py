"""A corpus pipeline of five operators: quality, exact dedup, near dedup, decontamination, packing.

Each stage reads what its predecessor wrote and works on all of it; all but the last return the columns of documents, with
whatever other columns there are, under any names.

Defined cases, of every stage: a null text counts as empty, in its row's favour unless another row has none either; texts
may be of any length; a null doc_id is a value like others, and rows are told apart by their texts too, so what is decided
of one row takes no other with the same doc_id; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontam, exact_dedup, packing, quality, simhash
from lectern.llm._common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents among docs.

    Empty texts are scored like others; equal rows stay or go together; without labels of both classes all rows stay, or go if every label is 0.
    """
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that share it too, one does. A null doc_id is smaller than any other."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays, of its texts one; rows equal in both stay together.

    A null doc_id counts as larger than all; texts without words are near-duplicates of each other.
    """
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go; an empty benchmark leaves all. Texts without words stay; repeated rows stay or go together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty text is one piece, its closing id; repeated rows are packed one by one."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The classifier and the tokenizer have no form in SQL; tests hold run() against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
