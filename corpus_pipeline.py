"""Corpus pipeline: toxicity, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``. Models are fitted on the labelled
documents that a stage sees, from the table ``labels``.

Cases: a null or empty text is not toxic; it has no words, so the base rule of the quality stage drops it. Long texts are
read, compared and packed whole. Rows without a doc_id are linked with nothing and kept by the near-duplicate stage; of equal
similarity the smallest id stays, and a row that is repeated stays once. A document that a stage drops takes all rows of its
id and text with it. Further columns pass through all stages but the last, whatever their names. An empty table, or one
without labels, gives the rows that the base rules leave.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spendspark.llm import near_dedup, packing, quality_rules, secrets, toxicity
from spendspark.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.first_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("MinHash near-dedup", drop_copies),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


#: Learned rules, near-duplicates over word shingles and best-fit packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
