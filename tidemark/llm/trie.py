"""The trie of conversations that begin with the same turns, by an Euler tour.

A node is a distinct sequence of first turns. Its key combines one keyed hash per turn and
place, so keys come from running exclusive ors, of which no part has to hold a conversation
whole. Each node has an arc into it and one out of it; along the tour a node's arcs enclose those
of its subtree. The tour is ranked as a linked list (``tour.ranked``), and a subtree's leaves and
savings are the difference of two prefix sums.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import ship, written
from tidemark.llm.tour import ranked
from tidemark.operators.history import Timeline, find_cut_points, over_history, with_rank

BASES = 100
MOST_SHARED = 5
# Turns of one conversation whose hashes one task combines.
CHUNK = 4096
# Arcs whose weights one task adds up.
STRETCH = 1 << 16
# A node with more children than this, and than a 4096th of all nodes, is broadcast.
HEAVY = 1 << 16
_IDS = 4096

_TURNS = Timeline(key="conv", time="has_turn", ties=("turn", "role", "digest"))
_SIBLINGS = Timeline(key="parent", time="conv", ties=("node",))


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from its base: crc32 of the id's text modulo 6."""
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, n (from 1), digest, points of every turn; texts are not shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
        .alias("digest"),
        F.length(text).cast("long").alias("points"),
    ).filter("conv IS NOT NULL")
    numbered = with_rank(slim, _TURNS, "n", find_cut_points(slim, _TURNS))
    return numbered.select("conv", "n", "digest", "points")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, place from 1, digest, points), and the
    conversations with their lengths.

    A conversation takes its base's first h turns, and its own after its first h.
    """
    base = F.col("conv") - F.col("conv") % BASES
    heads = (
        turns.filter((F.col("conv") % BASES == 0) & (F.col("n") <= MOST_SHARED))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("n", "digest", "points"))).alias("heads"))
    )
    convs = (
        turns.groupBy("conv").agg(F.max("n").alias("own"))
        .withColumns({"h": shared_turns(F.col("conv")), "base": base})
        .join(heads, "base", "left")
        .withColumn("taken", F.slice(F.coalesce("heads", F.array()), 1, F.col("h").cast("int")))
        .withColumn("shift", F.size("taken") - F.col("h"))
        .withColumn("length", F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("conv", "h", "own", "taken", "shift", F.col("length").cast("long").alias("length"))
    )
    convs = written(convs, "convs")
    first = convs.select("conv", F.inline("taken")).select(
        "conv", F.col("n").alias("place"), "digest", "points"
    )
    own = turns.filter(F.col("n") > shared_turns(F.col("conv")))
    # Places move only where the base is too short; a conversation's rows meet that in chunks.
    chunk = F.floor(F.col("n") / CHUNK).cast("long")
    moved = convs.filter("shift <> 0 AND own > h").select(
        F.col("conv").alias("_conv"), "shift",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / CHUNK).cast("long")))
        .alias("_chunk"),
    )
    own = own.join(moved, (F.col("conv") == F.col("_conv")) & (chunk == F.col("_chunk")), "left")
    own = own.select(
        "conv", (F.col("n") + F.coalesce("shift", F.lit(0))).alias("place"), "digest", "points"
    )
    return first.unionByName(own), convs.select("conv", "length")


def _lanes(name: str) -> list[str]:
    return [f"{name}_1", f"{name}_2"]


def _key(name: str) -> Column:
    """16 bytes from two lanes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.col(c)), 16, "0") for c in _lanes(name)]))


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its node and its node's parent.

    The hashes are keyed anew in every run, so no text can be made to collide; no result
    depends on them.
    """
    seeds = [int.from_bytes(os.urandom(8), "little", signed=True) for _ in range(2)]
    chunk = F.floor(F.col("place") / CHUNK).cast("long").alias("chunk")
    hashed = turns.select(
        "conv", "place", chunk, "digest", "points",
        *[F.xxhash64(F.lit(s), "place", "digest").alias(f"own_{i + 1}") for i, s in enumerate(seeds)],
    )
    hashed = written(hashed, "turns")
    sums = hashed.groupBy("conv", "chunk").agg(
        *[F.bit_xor(f"own_{i}").alias(f"sum_{i}") for i in (1, 2)]
    )
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"),
        *[F.bit_xor(f"sum_{i}").over(earlier).alias(f"before_{i}") for i in (1, 2)],
    ).filter("_chunk > 0")
    along = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = hashed.join(
        carried, (F.col("conv") == F.col("_conv")) & (F.col("chunk") == F.col("_chunk")), "left"
    ).withColumns({
        f"node_{i}": F.bit_xor(f"own_{i}").over(along).bitwiseXOR(
            F.coalesce(f"before_{i}", F.lit(0))
        )
        for i in (1, 2)
    }).withColumns({
        f"parent_{i}": F.col(f"node_{i}").bitwiseXOR(F.col(f"own_{i}")) for i in (1, 2)
    })
    return rows.select(
        "conv", "place", "digest", "points", _key("node").alias("node"), _key("parent").alias("parent")
    )


_ROOT = bytes(16)


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """node, parent, depth, conv (its smallest member), n_convs, points; the root among them.

    Turns and parents of equal nodes are checked to be equal, depth by depth, so by
    induction equal keys are equal sequences.
    """
    alike = (F.min("digest") == F.max("digest")) & (F.min("parent") == F.max("parent"))
    below = rows.groupBy("node", F.col("place").alias("depth")).agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        F.max("points").alias("points"),
        F.max("parent").alias("parent"),
        F.assert_true(alike, F.lit("two prefixes have one hash")).alias("_alike"),
    )
    root = convs.agg(
        F.lit(_ROOT).alias("node"), F.lit(0).cast("long").alias("depth"),
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"),
        F.lit(0).cast("long").alias("points"), F.lit(None).cast("binary").alias("parent"),
    ).filter("n_convs > 0")
    columns = ["node", "parent", "depth", "conv", "n_convs", "points"]
    return below.filter("_alike IS NULL").select(*columns).unionByName(root.select(*columns))


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """node and the SHA-256 of the comma-joined ids of conversations that end there.

    Ids are joined in pieces of up to 4096 before those of one node come together, in order,
    and are hashed as they come.
    """
    last = rows.groupBy("conv").agg(F.max_by("node", "place").alias("node"))
    none = convs.filter("length = 0").select("conv", F.lit(_ROOT).alias("node"))
    at = last.unionByName(none).repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for conv, key in zip(*(c.to_pylist() for c in batch.select(["conv", "node"]).columns)):
                if key != node or len(ids) >= _IDS:
                    close()
                    node = key
                ids.append(conv)
            if out:
                yield _batch(out, ("node", "first", "ids"))
        close()
        if out:
            yield _batch(out, ("node", "first", "ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("node", "ids")]
            for key, ids in zip(*columns):
                if key != node:
                    if digest is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                    digest.update(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield _batch(out, ("node", "ends_sha256"))
        if digest is not None:
            out.append((node, digest.hexdigest()))
            yield _batch(out, ("node", "ends_sha256"))

    pieces = at.mapInArrow(joined, "node binary, first long, ids string")
    return (
        pieces.repartition("node").sortWithinPartitions("node", "first")
        .mapInArrow(hashed, "node binary, ends_sha256 string")
    )


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], list(names))
    rows.clear()
    return made


def _arc(node: str, side: int) -> Column:
    return F.concat(F.col(node), F.lit(bytes([side])))


ENTER, EXIT = 0, 1


def arcs(tree: DataFrame, children: DataFrame) -> DataFrame:
    """The tour as a list: item (an arc), following, and the node's block.

    Siblings stand in the order of their smallest member. An arc is followed by the arc into the
    first child, the next sibling, or the arc out of the parent.
    """
    cuts = find_cut_points(tree.filter("parent IS NOT NULL"), _SIBLINGS)
    # What comes before an arc into a node is found by looking back at its elder sibling.
    elder = over_history(
        tree.filter("parent IS NOT NULL").select("parent", "conv", "node"),
        lambda df, w: df.withColumn("elder", F.lag("node").over(w)),
        _SIBLINGS, 1, ["node"], cuts,
    )
    into = elder.filter("elder IS NOT NULL").select(
        F.col("elder").alias("_elder"), F.col("node").alias("younger")
    )
    linked = (
        tree.select("node", "parent", "conv", "depth")
        .join(into, F.col("node") == F.col("_elder"), "left")
        .join(children, F.col("node") == F.col("_parent"), "left")
    )
    block = F.struct(F.floor(F.col("conv") / BASES), F.floor(F.col("depth") / 512))
    enter = F.when(F.col("first_child").isNotNull(), _arc("first_child", ENTER)).otherwise(
        _arc("node", EXIT)
    )
    leave = F.when(F.col("younger").isNotNull(), _arc("younger", ENTER)).when(
        F.col("parent").isNotNull(), _arc("parent", EXIT)
    )
    pair = F.array(
        F.struct(_arc("node", ENTER).alias("item"), enter.alias("following")),
        F.struct(_arc("node", EXIT).alias("item"), leave.alias("following")),
    )
    return linked.select(F.inline(pair), F.hash(block).alias("near"))


def subtrees(tree: DataFrame, children: DataFrame, count: int) -> DataFrame:
    """node, n_leaves and saved_tokens of its subtree, from prefix sums along the tour."""
    blocks = max(1, -(-2 * count // STRETCH))
    order = ranked(
        arcs(tree, children), F.pmod(F.col("near"), F.lit(4 * blocks)).alias("_block")
    )
    weights = tree.join(children, F.col("node") == F.col("_parent"), "left").select(
        "node",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
    )
    placed = order.select(
        F.expr("substring(item, 1, 16)").alias("node"),
        (F.expr("substring(item, 17, 1)") == F.lit(bytes([ENTER]))).alias("enters"),
        "rank",
        F.floor(F.col("rank") / STRETCH).cast("long").alias("stretch"),
    ).join(weights, "node")
    own = {c: F.when(F.col("enters"), F.col(c)).otherwise(0) for c in ("leaf", "saved")}
    placed = written(placed.withColumns(own), "arcs")
    earlier = Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per 65,536 arcs.
    before = placed.groupBy("stretch").agg(
        F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")
    ).select("stretch", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in own
    ])
    upto = Window.partitionBy("stretch").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"{c}_here": F.sum(c).over(upto) for c in own}).join(
        F.broadcast(before) if blocks < 1 << 20 else before, "stretch"
    )
    upto_arc = {c: F.col(f"{c}_here") + F.col(f"{c}_before") for c in own}
    sign = F.when(F.col("enters"), -1).otherwise(1)
    return summed.groupBy("node").agg(*[
        F.sum(sign * value + F.when(F.col("enters"), F.col(c)).otherwise(0)).alias(name)
        for (c, value), name in zip(upto_arc.items(), ("n_leaves", "saved_tokens"))
    ])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Turns stand
    in the order of turn, nulls first, ties by role, then by SHA-256 of role and text; equal rows
    are turns of their own. A null role or text is empty; rows without a conv_id belong to no
    conversation. Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. An empty table has no nodes.
    """
    ship(conversations.sparkSession)
    rows, convs = rebuilt(written(_turns(conversations), "numbered"))
    rows = written(prefixes(rows), "prefixes")
    tree = written(nodes(rows, convs), "nodes")
    count = tree.count()
    children = written(
        tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_parent")).agg(
            F.count("*").alias("n_children"),
            F.min_by("node", F.struct("conv", "node")).alias("first_child"),
        ),
        "children",
    )
    return _rows(tree, children, subtrees(tree, children, count), ends(rows, convs), count)


def _rows(
    tree: DataFrame, children: DataFrame, sums: DataFrame, ended: DataFrame, count: int
) -> DataFrame:
    # Parents of very many children are few, so these are broadcast; others have a bounded
    # number of rows to meet.
    limit = max(HEAVY, count >> 12)
    named = tree.select(F.col("node").alias("_node"), F.col("conv").alias("parent_conv_id")).join(
        children, F.col("_node") == F.col("_parent")
    )
    heavy = F.broadcast(named.filter(F.col("n_children") > limit).select(
        F.col("_node").alias("_heavy"), F.col("parent_conv_id").alias("_heavy_conv")
    ))
    light = named.filter(F.col("n_children") <= limit).select("_node", "parent_conv_id")
    marked = tree.join(heavy, F.col("parent") == F.col("_heavy"), "left")
    parent = F.when(F.col("_heavy").isNull(), F.col("parent"))
    numbers = children.select(F.col("_parent").alias("node"), "n_children")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        marked.withColumn("_light", parent)
        .join(light, F.col("_light") == F.col("_node"), "left")
        .join(numbers, "node", "left")
        .join(sums, "node")
        .join(ended, "node", "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.coalesce("_heavy_conv", "parent_conv_id").alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )
