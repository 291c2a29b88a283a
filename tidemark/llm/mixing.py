"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree.

1. Targets: sources share a word budget by weight; none takes more than ``most`` times its
   size, and what is cut off goes to the others by weight (water level over sorted ratios).
2. Blocks: a document is one block, or several if longer than ``block_words``. Each source's
   blocks get a seeded random order. A source goes through that order as often as its target
   says; the block in which the target ends is taken in part, so the words come out exact.
3. Tree: the blocks that each source has to give are split over the output shards. A node
   deals its quotas to two halves by a multivariate-hypergeometric draw, as if the blocks of
   all sources were shuffled and cut in the middle, down to single shards.
4. Each shard takes the next blocks of every source's order, disjoint from all other shards,
   and puts them into an order of its own.

Orders are ranks within (source, leading bits of a hash): a source with a third of all rows
is ranked by many tasks. Only the sources' table, one row per source, is sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import identity, layout, ship, slices, texts, written
from tidemark.llm.words import SPACE, spans

# What one task ranks, about.
RANK_ROWS = 50_000
_LARGEST_DRAW = 10**9 - 1


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, two keys of id and text, and the number of words of every row."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "text", *identity("doc_id", "text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = [len(t.split()) for t in texts(batch.column("text")).to_pylist()]
            columns = {c: batch.column(c) for c in ("doc_id", "source", "key_a", "key_b")}
            yield pa.RecordBatch.from_pydict({**columns, "size": pa.array(n, pa.int64())})

    return named.mapInArrow(
        count, "doc_id long, source string, key_a long, key_b long, size long"
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """A row per source: number in code-point order (null last), size, weight, target words."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")
    )
    named = totals.withColumn("number", F.row_number().over(in_order) - 1).withColumns({
        "weight": weight,
        "cap": F.col("source_size") * F.lit(float(most)),
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "all_weights": F.sum(weight).over(everything),
    })
    before = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = named.withColumn("level", left / left_weight)
    under = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("cap", "number"))
    ratio = F.when(under.isNotNull(), F.col("cap") / F.col("weight"))
    final = F.min_by("level", ratio).over(everything)
    return level.select(
        "source",
        F.col("number").cast("int").alias("number"),
        "source_size",
        F.when(under.isNull(), F.col("cap")).otherwise(final * F.col("weight")).alias("target"),
    )


def _draw(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each colour are among ``take`` of all balls drawn without return."""
    rest, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    for i, count in enumerate(map(int, counts)):
        if rest <= _LARGEST_DRAW:
            out[i] = rng.hypergeometric(count, rest - count, take) if take else 0
        else:  # beyond the sampler's range the normal limit is exact to rounding
            p = count / rest
            sd = math.sqrt(max(0.0, take * p * (1 - p) * (rest - take) / max(1, rest - 1)))
            drawn = round(rng.normal(take * p, sd))
            out[i] = min(max(drawn, take - (rest - count), 0), count, take)
        rest -= count
        take -= int(out[i])
    return out


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """number, shard, first, end: the ranks of every source's draws that each shard gets.

    ``quotas`` has number and draws, one row per source. Shards differ by one draw at most
    per level of the tree; every level is one grouped step over the sources' rows.
    """
    nodes = quotas.select(
        "number", "draws", F.lit(0).alias("low"), F.lit(int(shards)).alias("high")
    )

    def split(key: tuple, node: pd.DataFrame) -> pd.DataFrame:
        low, high = int(key[0]), int(key[1])
        if high - low == 1:
            return node
        middle = (low + high) // 2
        node = node.sort_values("number")
        counts = node["draws"].to_numpy(np.int64)
        take = int(counts.sum()) * (middle - low) // (high - low)
        left = _draw(np.random.default_rng([seed, low, high]), counts, take)
        return pd.concat([
            node.assign(draws=left, high=middle), node.assign(draws=counts - left, low=middle)
        ])

    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        nodes = nodes.groupBy("low", "high").applyInPandas(
            split, "number int, draws long, low int, high int"
        )
    so_far = Window.partitionBy("number").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("draws").over(so_far)
    return nodes.select(
        "number", F.col("low").alias("shard"), (end - F.col("draws")).alias("first"), end.alias("end")
    )


def mixed_blocks(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 64,
    block_words: int = 8192,
    seed: int = 17,
) -> DataFrame:
    """A row per block of every document, with its draws.

    Columns: doc_id, source, key_a, key_b and copy (together one per row of ``docs``), size,
    source_size, target, block, first_word, words, and draws: an array of (pass, shard,
    place, words), empty for a block that the mix leaves out. Rows that repeat in id, text and
    source are numbered by ``copy``. Null and empty texts have one block of no words and no draws; a
    null source is a source of its own, the last. Words are runs without ASCII white space.
    Reruns give the same draws. Columns other than doc_id, text and source are not read.
    """
    ship(docs.sparkSession)
    rows = written(sized(docs.select("doc_id", "text", "source")), "sizes")
    sources = written(targets(rows, weights, share, most), "targets")
    unit = ["doc_id", "source", "key_a", "key_b", "size"]
    units = rows.groupBy(*unit).agg(F.count("*").alias("n")).select(
        *unit, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    )
    same = units["source"].eqNullSafe(sources["source"])
    named = units.join(sources, same).drop(sources["source"])
    last = F.greatest(F.ceil(F.col("size") / block_words) - 1, F.lit(0)).cast("long")
    blocks = named.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")
    ).withColumns({
        "first_word": F.col("block") * block_words,
        "words": F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words),
        "order": F.xxhash64(F.lit(seed), "key_a", "key_b", "copy", "block"),
    })
    blocks = written(blocks, "blocks")

    most_blocks = blocks.groupBy("number").count().agg(F.max("count")).first()[0] or 1
    bits = min(max(math.ceil(math.log2(max(1, most_blocks / RANK_ROWS))), 8), 30)
    blocks = blocks.withColumn("bucket", F.shiftright("order", 64 - bits))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    none = F.lit(0).cast("long")
    filled = (F.col("words") > 0).cast("long")
    buckets = (
        blocks.groupBy("number", "bucket")
        .agg(F.sum("words").alias("bucket_words"), F.sum(filled).alias("bucket_blocks"))
        .select(
            "number",
            "bucket",
            F.coalesce(F.sum("bucket_words").over(earlier), none).alias("words_before"),
            F.coalesce(F.sum("bucket_blocks").over(earlier), none).alias("blocks_before"),
        )
    )
    before_it = (
        Window.partitionBy("number", "bucket")
        .orderBy("order", "key_a", "key_b", "copy", "block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_source = blocks.groupBy("number").agg(F.sum(filled).alias("n_blocks"))
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    left = F.col("rest") - F.col("words_before") - F.col("start")
    ranked = (
        blocks.withColumns({
            "at": F.coalesce(F.sum(filled).over(before_it), none),
            "start": F.coalesce(F.sum("words").over(before_it), none),
        })
        .join(buckets, ["number", "bucket"])
        .join(per_source, "number")
        .withColumns({
            "rank": F.col("blocks_before") + F.col("at"),
            "passes": passes.cast("long"),
        })
        .withColumn("rest", goal - F.col("passes") * F.col("source_size"))
        .withColumn("extra", F.greatest(none, F.least("words", left)))
        .withColumn(
            "drawn",
            F.when(F.col("words") > 0, F.col("passes") + (F.col("extra") > 0).cast("long"))
            .otherwise(none),
        )
    )
    ranked = written(ranked, "ranked")

    quotas = ranked.groupBy("number").agg(F.sum("drawn").alias("draws"))
    ends = split_quotas(quotas, shards, seed).groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("shard_ends")
    )
    place = F.xxhash64(F.lit(seed + 1), "key_a", "key_b", "copy", "block")

    def draw(number):
        rank = number * F.col("n_blocks") + F.col("rank")
        shard = F.element_at(
            F.filter("shard_ends", lambda e: e["end"] > rank), 1
        )["shard"]
        words = F.when(number < F.col("passes"), F.col("words")).otherwise(F.col("extra"))
        return F.struct(
            number.alias("pass"), shard.alias("shard"), F.xxhash64(place, number).alias("place"),
            words.alias("words"),
        )

    draws = F.when(
        F.col("drawn") > 0, F.transform(F.sequence(none, F.col("drawn") - 1), draw)
    ).otherwise(F.array().cast("array<struct<pass:bigint,shard:int,place:bigint,words:bigint>>"))
    return ranked.join(ends, "number").select(
        "doc_id", "source", "key_a", "key_b", "copy", "size", "source_size", "target", "block",
        "first_word", "words", draws.alias("draws"),
    )


def taken_words(blocks: DataFrame) -> DataFrame:
    """A row per document: the words that the mix takes of it, repeats counted, and where."""
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda sum_, d: sum_ + d["words"])
    return (
        blocks.groupBy(
            "doc_id", "source", "key_a", "key_b", "copy", "size", "source_size", "target"
        )
        .agg(
            F.sum(words).alias("taken"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("draws.shard")))).alias("shards"),
        )
        .drop("key_a", "key_b", "copy")
    )


def mixed_documents(docs: DataFrame, blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix as documents: a row per draw, with ``columns``, shard and place.

    A draw of a whole document has its text; of a part, the text from its first to its last
    word. Column n_chars, if among ``columns``, counts the code points of that text. A draw has
    the row of its own source; of rows that repeat in id, text and source, the least by the
    other columns, so reruns agree.
    """
    others = [c for c in columns if c not in ("text", "n_chars")]
    # Rows are grouped and joined on the same plain columns, so a text is shuffled once.
    keys = ["key_a", "key_b", "key_s"]
    source = F.xxhash64(F.col("source").isNull(), F.col("source")).alias("key_s")
    draws = blocks.select(
        "key_a", "key_b", source, "size", "first_word", F.explode("draws").alias("draw")
    ).select(*keys, "size", "first_word", "draw.shard", "draw.place", "draw.words")
    pair = (
        docs.select(*identity("doc_id", "text"), source, "text", F.struct(*others).alias("_others"))
        .groupBy(*keys)
        .agg(F.min("_others").alias("_others"), F.first("text").alias("text"))
    )
    joined = draws.join(pair, keys).select(
        *[F.col("_others")[c].alias(c) for c in others],
        "text", "size", "first_word", "words", "shard", "place",
    )
    fields = {f.name: f.dataType.simpleString() for f in joined.schema}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = texts(batch.column("text"))
            whole = column.to_pylist()
            size, first, words = (
                batch.column(c).to_numpy() for c in ("size", "first_word", "words")
            )
            for i in np.flatnonzero(words < size):
                values, offsets = layout(column.slice(int(i), 1))
                _, begin, end = spans(values, offsets, SPACE)
                whole[i] = whole[i][begin[first[i]] : end[first[i] + words[i] - 1]]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in others},
                "text": pa.array([t.decode() for t in whole], pa.string()),
                "shard": batch.column("shard"),
                "place": batch.column("place"),
            })

    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*others, "text", "shard", "place"])
    out = joined.mapInArrow(cut, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns, "shard", "place")


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder per shard, rows in the shard's order."""
    mixed.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy(
        "shard"
    ).parquet(path)
