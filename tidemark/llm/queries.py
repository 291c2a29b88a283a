"""Every operator applied to its whole table, with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.conversation_sql import REPAIR, TRIE
from tidemark.llm.cotraining import quality_scores
from tidemark.llm.encoding import public_vocabulary
from tidemark.llm.exact import exact_groups
from tidemark.llm.lengths import length_table
from tidemark.llm.licences import licence_labels
from tidemark.llm.minhash import near_groups
from tidemark.llm.mixing import mixed_blocks, taken_words
from tidemark.llm.neighbours import nearest
from tidemark.llm.packing import packed
from tidemark.llm.repair import damaged, repairs, with_all
from tidemark.llm.suffix_tree import scored
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.trie import prefix_trie
from tidemark.llm.urls import Rule, judged

VOCABULARY = "word_bpe_49k.json"

URL_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = mixed_blocks(_table(spark, sf_dir, "documents"))
    return taken_words(blocks).select(
        "doc_id", "size", "source_size", "target", "taken", "shards"
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), public_vocabulary(VOCABULARY))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "kept"
    )


def op5_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(_table(spark, sf_dir, "documents"), public_vocabulary(VOCABULARY))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return with_all(conversations, repairs(damaged(conversations)))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_labels(_table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_mix, op3_pack, op4_near_dedup, op5_lengths, op6_nearest,
        op7_suffix_tree, op8_toxicity, op9_quality, op10_exact_dedup,
        op11_repair, op12_licences, op13_trie,
    )
}

SQL = {
    "op11_repair": REPAIR,
    "op13_trie": TRIE,
    "op10_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY digest) AS group_size,
               row_number() OVER best = 1 AS kept,
               digest AS text_sha256
        FROM normal
        WINDOW best AS (PARTITION BY digest ORDER BY points DESC, doc_id NULLS LAST)
    """,
}
