"""A training-data pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, folder) and returns all rows it keeps, with the columns of ``documents``; the last returns the pieces and
their places. A stage works on what its predecessor kept.

Edges: documents may have columns of any name besides doc_id and text, null or repeated ids, null or empty texts; rows stay rows, and each is judged by its own text. A text of
any length is judged whole. Of equal texts the stage of near-duplicates keeps one. Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import decontamination, near_duplicates, packing, quality_classifier, quality_rules
from caseweave.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep(docs, table(spark, folder, "labels"))


def rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    return quality_rules.keep(docs, table(spark, folder, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays."""
    return near_duplicates.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that repeat the benchmark go. The row travels whole, so no column of its own can clash."""
    rows = docs.select(F.struct("*").alias("doc"))
    return decontamination.contamination(rows, table(spark, folder, "benchmark"), key="doc.doc_id", text="doc.text").where("not contaminated").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Fitted models, token ids and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again before the next."""
    docs = table(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if number == 0 else materialize(docs), folder)
    return docs
