"""List ranking: the place of every item in linked lists, by contraction.

``blocks`` of items that are likely to follow each other are contracted inside tasks: runs of
links that stay in a block shrink to one item that carries their length. What is left is
contracted further by random mates: an item that draws tails is taken into the item before it
where that one draws heads, about a quarter of all items a round. Once at most ``SMALL`` items
are left, one more block ranks them, and the rounds are undone in reverse, each with one join.
Items have fixed size, and no task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import ship, written

SMALL = 1 << 16

_RUN = "item binary, head binary, place long, following binary, size long"


def _contracted(group: pa.Table) -> pa.Table:
    """Each item's head within the block, its place behind it, and for heads the run."""
    items = group["item"].to_pylist()
    number = {key: i for i, key in enumerate(items)}
    size = group["size"].to_numpy()
    after = np.array([number.get(f, -1) for f in group["following"].to_pylist()], np.int64)
    n = len(items)
    before = np.full(n, -1, np.int64)
    linked = np.flatnonzero(after >= 0)
    before[after[linked]] = linked
    # Jumping to the head, with the length of all items passed.
    head = np.where(before >= 0, before, np.arange(n))
    place = np.where(before >= 0, size[head], 0)
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        place = place + place[head]
        head = further
    tail = np.flatnonzero(after < 0)
    last = np.full(n, -1, np.int64)
    last[head[tail]] = tail
    ends = last[head]
    return pa.table({
        "item": group["item"],
        "head": group["item"].take(pa.array(head)),
        "place": pa.array(place),
        "following": group["following"].take(pa.array(ends)),
        "size": pa.array(place[ends] + size[ends]),
    })


def _in_blocks(items: DataFrame, block: str) -> DataFrame:
    return items.groupBy(block).applyInArrow(_contracted, _RUN)


def _heads(runs: DataFrame) -> DataFrame:
    return runs.filter("item = head").select("item", "following", "size")


def _mates(items: DataFrame, seed: int) -> DataFrame:
    """One round of random mates, in the form of ``_contracted``."""
    def heads(c: str) -> Column:
        return F.xxhash64(F.lit(seed), F.col(c)) % 2 == 0

    links = items.filter(F.col("following").isNotNull()).filter(
        heads("item") & ~heads("following")
    ).select(F.col("following").alias("taken"), F.col("item").alias("by"), F.col("size").alias("shift"))
    return (
        items.join(links, F.col("item") == F.col("taken"), "left")
        .select(
            "item", F.coalesce("by", "item").alias("head"),
            F.coalesce("shift", F.lit(0)).alias("place"), "following", "size",
        )
    )


def _mated_heads(runs: DataFrame) -> DataFrame:
    """Heads with the item behind, and the size, of what they took in."""
    taken = runs.filter("item <> head").select(
        F.col("head").alias("by"), F.col("following").alias("further"), F.col("size").alias("more")
    )
    return (
        runs.filter("item = head")
        .join(taken, F.col("item") == F.col("by"), "left")
        .select(
            "item",
            F.when(F.col("by").isNotNull(), F.col("further")).otherwise(F.col("following"))
            .alias("following"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
        )
    )


def ranked(items: DataFrame, block: Column, small: int = SMALL) -> DataFrame:
    """item and rank (from 0) of every item of one linked list.

    ``items`` has item and following, binary keys, following null for the last item. ``block``
    says which items to contract together; it should keep neighbours together and groups
    small, and decides nothing else. An empty list gives an empty result.
    """
    ship(items.sparkSession)
    one = F.lit(1).cast("long").alias("size")
    rounds = [written(
        _in_blocks(items.select("item", "following", one, block.alias("_block")), "_block"), "tour"
    )]
    left = written(_heads(rounds[0]), "tour")
    while (n := left.count()) > small:
        runs = written(_mates(left, len(rounds)), "tour")
        rounds.append(runs)
        left = written(_mated_heads(runs), "tour")
    # A single list is left, so its first item is the head of all.
    now = _in_blocks(left.withColumn("_block", F.lit(0)), "_block").select(
        "item", F.col("place").alias("rank")
    )
    for runs in reversed(rounds):
        above = now.select(F.col("item").alias("head"), F.col("rank").alias("of_head"))
        now = runs.join(above, "head").select(
            "item", (F.col("place") + F.col("of_head")).alias("rank")
        )
        now = written(now, "tour") if runs is not rounds[0] else now
    return now
