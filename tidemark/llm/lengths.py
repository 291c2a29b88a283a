"""Exact length histogram: documents by encoded length, and what follows for any limit.

Tasks count the lengths of their own documents, so the shuffle carries a row per task and
distinct length. Suffix sums over the histogram then answer, for every context limit at once,
how many documents and tokens lie at or above it and what a cut at the limit would leave.
Sums run in two steps, within ranges of lengths and over the ranges, so no task sees the
whole histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import encoder
from tidemark.llm.rows import ship, slices, texts, written

# Lengths that one task sums up.
RANGE = 4096


def histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """length (token ids of the text, none added) and docs, for every length that occurs."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(vocabulary), Counter()
        for batch in slices(batches, "text"):
            seen.update(own.encode(texts(batch.column("text")))[1].tolist())
        yield pa.RecordBatch.from_pydict({
            "length": pa.array(list(seen), pa.int64()),
            "docs": pa.array(list(seen.values()), pa.int64()),
        })

    counted = docs.select("text").mapInArrow(count, "length long, docs long")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def length_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The histogram with its suffix sums; a row per length that occurs.

    docs: documents of that length; docs_up_to: of that length or less; docs_from and
    tokens_from: documents and tokens of that length or more; truncated_tokens: what is left
    of all tokens if every text is cut to that length; quantile: the share of documents of
    that length or less. Null and empty texts have length 0. Rows that repeat count each
    time; columns other than text are not read. An empty table gives an empty result.
    """
    counts = written(histogram(docs.select("text"), vocabulary), "lengths").withColumn(
        "range", F.floor(F.col("length") / RANGE)
    )
    tokens = F.col("length") * F.col("docs")
    beyond = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    none = F.lit(0).cast("long")
    # A row for each range of lengths in use: the longest text over RANGE at most.
    ranges = (
        counts.groupBy("range")
        .agg(F.sum("docs").alias("range_docs"), F.sum(tokens).alias("range_tokens"))
        .select(
            "range",
            F.coalesce(F.sum("range_docs").over(beyond), none).alias("docs_beyond"),
            F.coalesce(F.sum("range_tokens").over(beyond), none).alias("tokens_beyond"),
            F.sum("range_docs").over(everything).alias("all_docs"),
            F.sum("range_tokens").over(everything).alias("all_tokens"),
        )
    )
    onward = Window.partitionBy("range").orderBy(F.col("length").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    summed = counts.join(ranges, "range").withColumns({
        "docs_from": F.sum("docs").over(onward) + F.col("docs_beyond"),
        "tokens_from": F.sum(tokens).over(onward) + F.col("tokens_beyond"),
    })
    up_to = F.col("all_docs") - F.col("docs_from") + F.col("docs")
    return summed.select(
        "length",
        "docs",
        up_to.alias("docs_up_to"),
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias(
            "truncated_tokens"
        ),
        (up_to / F.col("all_docs")).alias("quantile"),
        "all_docs",
        "all_tokens",
    )


def at_limits(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, docs_over, lost_tokens, kept_tokens for any limits, from ``length_table``."""
    per_limit = [
        F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            F.sum(F.when(F.col("length") > limit, F.col("docs")).otherwise(0)).alias("docs_over"),
            F.sum(
                F.when(F.col("length") > limit, (F.col("length") - limit) * F.col("docs")).otherwise(0)
            ).alias("lost_tokens"),
            F.sum(F.least(F.col("length"), F.lit(int(limit))) * F.col("docs")).alias("kept_tokens"),
        )
        for limit in limits
    ]
    return table.agg(F.array(*per_limit).alias("rows")).select(F.inline("rows"))


def length_quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share and length: the smallest length that this share of documents does not exceed."""
    rows = [
        F.struct(
            F.lit(float(share)).alias("share"),
            F.min(F.when(F.col("quantile") >= float(share), F.col("length"))).alias("length"),
        )
        for share in shares
    ]
    return table.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
