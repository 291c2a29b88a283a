"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import written


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node with an edge.

    ``edges`` has long columns a and b. Each round ties every node's larger neighbours, then
    its smaller ones, to the smallest; the number of rounds follows the logarithm of the
    longest path. Edges are tables in the shared folder between rounds, and none is ever
    collected. Loops and repeated edges do no harm.
    """
    pairs = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = written(pairs.distinct(), "edges")
    before = None
    while (mark := _checksum(now)) != before and mark[0]:
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(
            "a", F.least("a", "low").alias("low")
        )
        large = both.join(least, "a").filter("b > a").select(
            F.col("b").alias("a"), F.col("low").alias("b")
        ).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(roots, "a")
        small = joined.select("a", F.col("low").alias("b")).unionByName(
            joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        now = written(small.filter("a <> b").distinct(), "edges")
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tied.unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
