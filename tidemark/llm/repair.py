"""Least-cost repair of conversations whose rows were lost, emptied, cut, repeated or mislabelled.

Rows become one letter each, in blocks of ``BLOCK`` rows. A conversation of one block is a
lattice solved by auction (``auction``). Of longer ones every block becomes a table of 16
distances, blocks of blocks likewise until one is left per conversation; prices then descend
the same levels, and every block is traced on its own. So no task holds more than a block of
any conversation while costs are found. Two things need a conversation's rows in order in one
place, because SHA-256 is sequential: its audit string and the hash of its repaired text. That
pass streams: it holds one batch of rows and the conversation's letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm import auction
from tidemark.llm.rows import ship, written
from tidemark.operators.history import Timeline, find_cut_points, with_rank

BLOCK = 64
ROLES = {auction.AFTER_U: "user", auction.AFTER_A: "assistant"}
_WHITE = " \t\n\x0b\x0c\r"
_LINE = Timeline(key="conv", time="has_turn", ties=("turn", "role", "digest"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its
    role user. A null counts as one space, in the hash too.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return (
        conversations.select(
            "conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
            fault.alias("_fault"),
        )
        .filter("_fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_fault") == 1, "")
            .when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_n"),
        )
        .drop("_n")
    )


def _named(rows: DataFrame) -> DataFrame:
    """Rows with one key per conversation, its null id being one too, and their order."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    return plain.withColumns({
        "has_turn": F.col("turn").isNotNull(),
        "digest": F.unhex(F.sha2(F.col("text"), 256)),
    })


def _coded(named: DataFrame) -> DataFrame:
    """Each row's conversation, number and code; the text itself is not shuffled."""
    tail = F.rtrim(F.col("text"), F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    slim = named.select(
        "conv", "has_turn", "turn", "role", "digest",
        (tail == "").alias("blank"),
        (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("short"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("code"),
    )
    numbered = with_rank(slim, _LINE, "n", find_cut_points(slim, _LINE))
    firsts = numbered.groupBy("conv", "role", "digest").agg(F.min("n").alias("n"))
    first = firsts.select("conv", "n", F.lit(True).alias("first"))
    code = (
        F.when(F.col("blank"), "b")
        .when(F.col("first").isNull(), "d")
        .when(F.col("short"), F.upper("code"))
        .otherwise(F.col("code"))
    )
    return numbered.join(first, ["conv", "n"], "left").select("conv", "n", code.alias("code"))


def _gathered(cells: DataFrame, size: int, place: str, value: str, out: str) -> DataFrame:
    """``size`` neighbouring values of a conversation as one array, in order of ``place``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v"))))
    at = F.floor(F.col(place) / size).cast("long")
    return (
        cells.groupBy("conv", at.alias("cell"))
        .agg(pairs.alias("_pairs"))
        .select("conv", "cell", F.transform("_pairs", lambda p: p["v"]).alias(out))
    )


def _fields(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _mapped(df: DataFrame, row, schema: str) -> DataFrame:
    """``row`` takes a row's values and gives rows."""
    fields = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = [made for values in zip(*columns) for made in row(*values)]
            if out:
                made = [pa.array(c, f.type) for c, f in zip(zip(*out), fields)]
                yield pa.RecordBatch.from_arrays(made, schema=fields)

    return df.mapInArrow(run, schema)


_PIECES = "conv string, cell long, codes string, costs array<long>, states array<int>, letters array<string>"


def _pieces(conv: str, cell: int, codes: str, ends: list[int], origins: list[int]) -> list[tuple]:
    found = auction.edits(codes, tuple(ends), tuple(origins))
    costs, states, letters = zip(*[f or (None, None, None) for f in found])
    return [(conv, cell, codes, list(costs), list(states), list(letters))]


def _solved(blocks: DataFrame) -> DataFrame:
    """conv, cell, codes and, by the state a block is entered in, cost to the end, state left
    and letters."""
    ends, size = list(auction.END_COSTS), BLOCK
    whole = (F.col("cell") == 0) & (F.length("codes") < size)
    short = _mapped(
        blocks.filter(whole).select("conv", "codes"),
        lambda conv, codes: _pieces(conv, 0, codes, ends, [auction.START]),
        _PIECES,
    )
    table = "conv string, cell long, costs array<long>"
    levels = [written(
        _mapped(
            blocks.filter(~whole).select("conv", "cell", "codes"),
            lambda conv, cell, codes: [(conv, cell, auction.row_distances(codes), codes)],
            table + ", codes string",
        ),
        "cells",
    )]
    if levels[0].isEmpty():
        return short
    while levels[-1].agg(F.max("cell")).first()[0] > 0:
        groups = _gathered(levels[-1], size, "cell", "costs", "cells")
        levels.append(written(
            _mapped(
                groups, lambda conv, cell, cells: [(conv, cell, auction.cell_distances(cells))], table
            ),
            "cells",
        ))
    start = F.array(F.lit(auction.START))
    prices = levels[-1].select("conv", "cell", F.lit(ends).alias("ends"), start.alias("origins"))
    for level in reversed(levels[:-1]):
        groups = _gathered(level, size, "cell", "costs", "cells").join(prices, ["conv", "cell"])

        def descend(conv, cell, cells, ends, origins):
            below = auction.cell_ends(cells, tuple(ends), origins)
            for i, prices in enumerate(below):
                yield conv, cell * size + i, list(prices), origins
                origins = [s for s in range(auction.STATES) if prices[s] < auction.INF]

        prices = _mapped(
            groups.select("conv", "cell", "cells", "ends", "origins"), descend,
            "conv string, cell long, ends array<long>, origins array<int>",
        )
    long = levels[0].join(prices, ["conv", "cell"]).select(
        "conv", "cell", "codes", "ends", "origins"
    )
    return short.unionByName(_mapped(long, _pieces, _PIECES))


class _Conversation:
    """Edits of one conversation, applied to its rows as they come."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.letters, self.codes = conv_id, [], []
        self.state, self.cost, self.at = auction.START, 0, 0
        self.audit, self.made = "", auction.START
        self.turns = self.illegal = 0
        self.low = self.high = self.last = self.initial = None

    def piece(self, codes: str, costs: list, states: list, letters: list) -> None:
        if not self.codes:
            self.cost = costs[self.state]
        self.codes.append(codes)
        self.letters.append(letters[self.state])
        self.state = states[self.state]

    def begin(self) -> None:
        self.audit = "".join(self.letters) + auction.END_LETTERS[self.state]
        self.letters = []

    def inserts(self) -> Iterator[tuple[str, str, bool]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.made = auction._NEXT[self.made]
            yield ROLES[self.made], "", False

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, bool]]:
        """The repaired rows up to and with this one: role, text, whether a row was kept."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last
            self.high = self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.made = auction.AFTER_S if role[0] == "s" else auction._NEXT[self.made]
            yield role, text, True
        elif letter == "R":
            self.made = auction._NEXT[self.made]
            yield ROLES[self.made], text, True

    def counts(self) -> dict:
        codes = "".join(self.codes)
        return {
            "conv_id": self.conv_id,
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": codes.count("b"),
            "duplicate": codes.count("d"),
            "truncated": sum(c.isupper() for c in codes),
            "illegal": self.illegal,
            "cost": self.cost,
            "audit": self.audit,
        }


def _streamed(rows: DataFrame) -> DataFrame:
    """Pieces and rows of every conversation side by side, the pieces first."""
    named = _named(rows)
    coded = _coded(named).select("conv", (F.col("n") - 1).alias("at"), "code")
    blocks = _gathered(coded, BLOCK, "at", "code", "letters").select(
        "conv", "cell", F.concat_ws("", "letters").alias("codes")
    )
    pieces = _solved(written(blocks, "blocks")).withColumn("kind", F.lit(0))
    both = named.withColumn("kind", F.lit(1)).unionByName(pieces, allowMissingColumns=True)
    order = ["conv", "kind", "cell", *_LINE.order]
    return both.repartition("conv").sortWithinPartitions(*order).select(
        "conv", "conv_id", "kind", "turn", "role", "text", "codes", "costs", "states", "letters"
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Yields (conversation, repaired rows of one stored row, whether that was all)."""
    now, conv = None, None
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            columns = [c.to_pylist() for c in batch.slice(begin, 1024).columns]
            for key, conv_id, kind, turn, role, text, codes, costs, states, letters in zip(*columns):
                if now is None or key != conv:
                    if now is not None:
                        yield now, now.inserts(), True
                    now, conv = _Conversation(None), key
                if kind == 0:
                    now.piece(codes, costs, states, letters)
                    continue
                if now.letters:
                    now.conv_id = conv_id
                    now.begin()
                yield now, now.row(turn, role, text), False
    if now is not None:
        yield now, now.inserts(), True


_REPAIRS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)


def repairs(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows``: its faults, the cheapest edits, and what they give.

    ``rows`` has conv_id, turn, role and text; other columns are not read. A null role or text
    counts as one space. Rows stand in the order of turn, nulls first, ties by role, then by
    SHA-256 of the text; equal rows are all there, all but the first as duplicates. Rows without a
    conv_id are one conversation. Each row's first fault counts: blank, duplicate, truncated.
    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. An empty table gives an empty result.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first, out = hashlib.sha256(), True, []
        for now, made, done in _conversations(batches):
            for role, text, _ in made:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            if done:
                out.append(now.counts() | {"repaired_sha256": digest.hexdigest()})
                digest, first = hashlib.sha256(), True
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)

    fields = _fields(_REPAIRS)
    return _streamed(rows).mapInArrow(run, _REPAIRS)


_TURNS = "conv_id long, place long, role string, text string, kept boolean"


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, and whether a stored row
    was kept there or an empty one inserted. Odd rows are treated as in ``repairs``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, size = 0, [], 0
        for now, made, done in _conversations(batches):
            for role, text, kept in made:
                out.append({
                    "conv_id": now.conv_id, "place": place, "role": role, "text": text, "kept": kept,
                })
                place += 1
                size += len(text)
            if done:
                place = 0
            if size > 1 << 21 or len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, fields)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)

    fields = _fields(_TURNS)
    return _streamed(rows).mapInArrow(run, _TURNS)


def with_all(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with a row for every conv_id of ``conversations``, also one without any rows."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    other = found.withColumnRenamed("conv_id", "_id")
    return (
        ids.join(other, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
        .drop("_id")
        .fillna(zero | {"audit": "", "repaired_sha256": empty})
    )
