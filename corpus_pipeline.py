"""A training corpus from ``documents``: good, unique, mixed to weights, and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.cotraining import good_documents
from tidemark.llm.encoding import public_vocabulary
from tidemark.llm.exact import without_copies
from tidemark.llm.minhash import without_near_copies
from tidemark.llm.mixing import mixed_blocks, mixed_documents
from tidemark.llm.packing import packed
from tidemark.llm.queries import VOCABULARY
from tidemark.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects: documents that score below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_documents(docs, labels, COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return without_copies(docs, COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each class of near duplicates."""
    return without_near_copies(docs, COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their target words.

    A document that the mix takes twice has two rows. Documents of more than 8192 words are
    mixed in parts, and one document per source may be cut where its target ends; such rows
    have the text and the length of their part. Rows lie in the order of the mix: by shard,
    and within it in the shard's own order.
    """
    mixed = mixed_documents(docs, mixed_blocks(docs), COLUMNS)
    order = ["shard", "place"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full windows of token ids, with the ids."""
    return packed(docs, public_vocabulary(VOCABULARY), with_ids=True)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

# Trained classifiers, signatures, seeded draws and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
