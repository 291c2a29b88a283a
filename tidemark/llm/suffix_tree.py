"""Scoring texts with a probabilistic suffix tree over words.

The tree's states are the contexts of one word, two words, and so on to ``depth``, that are
seen ``least_state`` times and whose next words diverge from those of their longest kept
suffix: left out one by one, they must be foretold better by the context than by the suffix.
A state's next words, if seen ``least_pair`` times, are smoothed with those of the suffix
(Witten-Bell), down to the root, which is the smoothed word distribution. A text is scored
word by word from the longest state that fits.

The minima are counts, so the tree grows with the input: words, states and next words are
tables of 64-bit hashes. A word's score is a sum: of each state that fits the logarithm of
what it gives its suffix, and of each next word seen there what it adds. Texts meet these
values by a join of what each text has of them. Broadcast are only values of frequent keys,
at most 1 / ``common_share`` words, and as many of either kind a depth, and bit sets
of 2**``_BITS`` bits at most that leave out most keys that no table has; they change no result.
``grown`` builds a tree in memory, with thresholds that are shares of all tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.rows import layout, passing, remainder, ship, slices, texts, written
from tidemark.llm.words import mix, unmix, words

#: Hash of the end of a text, as a token.
END = mix(np.array([0xE0D], np.uint64))[0]
_ADD = 0.1
_PENDING = 1_000_000
#: Parts that keys are dealt to, as a power of two, and rows that pass at once.
_PARTS = 12
_ROWS = 1024
#: Largest size of a bit set, as a power of two; keys of states differ from those of sequences.
_BITS = 27
_STATE = 0x5851F42D4C957F2D


@dataclass(frozen=True)
class Settings:
    depth: int = 2
    symbol_share: float = 5e-5
    state_share: float = 5e-5
    pair_share: float = 2e-6
    common_share: float = 5e-7
    min_gain: float = 0.002
    least_state: int = 5
    least_pair: int = 2
    least_gain: float = 2.0


@dataclass
class Level:
    """States of one depth: sorted keys, share given to the suffix, and next symbols."""

    keys: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    ratio: np.ndarray


@dataclass
class Tree:
    """``symbols`` are sorted hashes; symbol 0 stands for all other words."""

    symbols: np.ndarray
    base: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.symbols) + 1


def find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in a sorted array, -1 where missing."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    # In order, searches of a large array find the same few pages of it.
    order = np.argsort(wanted)
    ordered = wanted[order]
    place = np.minimum(np.searchsorted(sorted_, ordered), len(sorted_) - 1)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.where(sorted_[place] == ordered, place, -1)
    return at


def tokens(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every token: the words, A-Z lower-cased, then one end per text."""
    text, word = words(column, lower=True)
    ends = np.cumsum(np.bincount(text, minlength=len(column)))
    return (
        np.insert(text, ends, np.arange(len(column))),
        np.insert(word, ends, np.full(len(column), END, np.uint64)),
    )


def context_keys(text: np.ndarray, symbol: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Number of the ``depth`` symbols before each token, -1 where its text has fewer."""
    key = np.full(len(symbol), -1, np.int64)
    if len(symbol) > depth:
        known = text[depth:] == text[:-depth]
        value = np.zeros(len(symbol) - depth, np.int64)
        for d in range(depth):
            value = value * width + symbol[d : len(symbol) - depth + d]
        key[depth:] = np.where(known, value, -1)
    return key


def _merged(
    key: np.ndarray, n: np.ndarray, *others: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, their sums of n, and what stands with them."""
    if not len(key):
        return (key, n, *others)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[first], np.add.reduceat(n[order], first), *(c[order[first]] for c in others))


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _part(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _PARTS)).astype(np.int32)


def _dealt(columns: dict[str, np.ndarray], **constant) -> Iterator[pa.RecordBatch]:
    """Rows of a part number and the bytes of each column's values there.

    Column ``key`` has ascending numbers of 64 bits, whose leading bits are the part. Its
    bytes are sent apart: the leading ones, being in order, hardly take room.
    """
    key = columns["key"]
    part = _part(key)
    columns = {"high": (key >> np.uint64(48)).astype(np.uint16),
               "low": key.view(np.uint8).reshape(-1, 8)[:, :6], **columns}
    del columns["key"]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    for begin in range(0, len(first), _ROWS):
        cuts = np.append(first, len(part))[begin : begin + _ROWS + 1]
        cells = {"part": pa.array(part[cuts[:-1]])}
        for name, column in columns.items():
            width = column.itemsize * (column.size // max(len(column), 1))
            offsets = ((cuts - cuts[0]) * width).astype(np.int32)
            data = pa.py_buffer(np.ascontiguousarray(column[cuts[0] : cuts[-1]]))
            buffers = [None, pa.py_buffer(offsets), data]
            cells[name] = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers)
        for name, value in constant.items():
            cells[name] = pa.array([value] * (len(cuts) - 1), pa.int64())
        yield pa.RecordBatch.from_pydict(cells)


def _runs(batch: pa.RecordBatch, *by: str) -> Iterator[tuple[int, int]]:
    """First row and end of each run of rows that are equal in the columns ``by``."""
    new = np.zeros(batch.num_rows + 1, bool)
    new[[0, -1]] = True
    for name in by:
        column = batch.column(name).fill_null(0).to_numpy()
        new[1:-1] |= column[1:] != column[:-1]
    cuts = np.flatnonzero(new).tolist()
    return zip(cuts, cuts[1:])


def _cells(batch: pa.RecordBatch, *names: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The bytes of columns, and where each row's begin."""
    return {name: layout(batch.column(name).cast(pa.large_binary())) for name in names}


def _cut(cells: tuple[np.ndarray, np.ndarray], begin: int, end: int, kind) -> np.ndarray:
    """The values that rows ``begin`` to ``end`` hold as bytes."""
    data, offsets = cells
    return data[offsets[begin] : offsets[end]].view(kind)


def _key(cells: dict[str, tuple[np.ndarray, np.ndarray]], begin: int, end: int) -> np.ndarray:
    """The keys of rows ``begin`` to ``end``."""
    high = _cut(cells["high"], begin, end, np.uint16)
    key = np.zeros((len(high), 8), np.uint8)
    key[:, :6] = _cut(cells["low"], begin, end, np.uint8).reshape(-1, 6)
    return key.view(np.uint64)[:, 0] | high.astype(np.uint64) << np.uint64(48)


def _summed(docs: DataFrame, rows_of, others: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """key, ``others`` and n: the rows that ``rows_of(batch)`` gives, summed by key.

    ``rows_of`` gives key, n and ``others`` as arrays of 64 bits. Keys with a sum under
    ``least`` are left out. Rows travel as blocks of arrays, dealt by key.
    """
    names = ("key", "n", *others)
    kinds = (np.int64, *(np.uint64 for _ in others))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        pending = 0
        for batch in slices(batches, "text"):
            key, *rest = rows_of(batch)
            parts.append(_merged(mix(key), *rest))
            pending += len(parts[-1][0])
            if pending > _PENDING:
                parts[:] = [_merged(*_joined(parts))]
                pending = len(parts[0][0])
                if pending > _PENDING // 2:
                    yield from _dealt(dict(zip(names, parts.pop(), strict=True)))
                    pending = 0
        if parts:
            yield from _dealt(dict(zip(names, _merged(*_joined(parts)), strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = -1, []

        def out() -> pa.RecordBatch:
            key, *rest = _merged(*_joined(blocks))
            blocks.clear()
            often = rest[0] >= least
            found = unmix(key), *rest
            return pa.RecordBatch.from_arrays(
                [pa.array(c[often].view(np.int64)) for c in found], list(names)
            )

        for batch in batches:
            cells = _cells(batch, "high", "low", *names[1:])
            for begin, end in _runs(batch, "part"):
                part = batch.column("part")[begin].as_py()
                if blocks and part != at:
                    yield out()
                at = part
                blocks.append((_key(cells, begin, end), *(
                    _cut(cells[name], begin, end, kind)
                    for name, kind in zip(names[1:], kinds, strict=True)
                )))
        if blocks:
            yield out()

    sent = docs.select("text").mapInArrow(
        send, "part int, high binary, low binary, " + ", ".join(f"{c} binary" for c in names[1:])
    )
    dealt = sent.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, ", ".join(f"{name} long" for name in names))


def _counts(docs: DataFrame, keys_of) -> DataFrame:
    """key and n: how often ``keys_of(column)`` gives each key, over all rows."""
    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = keys_of(texts(batch.column("text"))).view(np.uint64)
        return keys, np.ones(len(keys), np.int64)

    return _summed(docs, rows_of)


def _gains(
    pairs: DataFrame, parent: DataFrame, least_n: float, pair_n: float, gain: float,
    least_gain: float,
):
    """States that diverge from their suffix, and their frequent next symbols.

    ``pairs``: state, symbol, n; ``parent``: state, symbol, p (the suffix's probability).
    """
    totals = pairs.groupBy("state").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("kinds"),
        F.sum(F.when(F.col("n") >= pair_n, F.col("n")).otherwise(0)).alias("kept"),
    ).filter(F.col("total") >= least_n)
    each = parent.join(totals, "state")
    without = (F.col("n") - 1 + F.col("kinds") * F.col("p")) / (
        F.col("total") - 1 + F.col("kinds")
    )
    better = each.groupBy("state").agg(
        F.sum(F.col("n") * (F.log(without) - F.log("p"))).alias("gain")
    )
    states = totals.join(better, "state").filter(F.col("gain") > F.greatest(F.lit(least_gain), gain * F.col("total")))
    frequent = each.filter(F.col("n") >= pair_n).join(states.select("state"), "state", "left_semi")
    return states, frequent


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table[c].to_numpy() for c in table.column_names}


def grown(training: DataFrame, counts: DataFrame, total: int, kinds: int, s: Settings) -> Tree:
    """The tree of the training texts; ``counts`` are their token counts."""
    frequent = _arrays(counts.filter(F.col("n") >= max(1.0, s.symbol_share * total)))
    hashes = frequent["key"].view(np.uint64)
    order = np.argsort(hashes)
    symbols = hashes[order]
    base = (frequent["n"][order] + _ADD) / (total + _ADD * (kinds + 1))
    tree = Tree(symbols, np.insert(base, 0, max(1 - base.sum(), 1e-12)))
    spark, width = training.sparkSession, tree.width
    root = spark.createDataFrame(
        pa.table({"symbol": pa.array(np.arange(width)), "p0": pa.array(tree.base)})
    )
    end = int(find(symbols, np.array([END]))[0]) + 1
    # A text's end has nothing behind it; END is frequent or part of the other words.
    states = np.array([x for x in range(width) if x != end or not end])
    for depth in range(1, s.depth + 1):
        if width ** (depth + 1) >= 1 << 62:
            raise ValueError("depth or number of symbols too large")
        allowed = np.sort(states)
        known = Tree(tree.symbols, tree.base, list(tree.levels))

        def keys_of(column, depth=depth, allowed=allowed):
            text, word = tokens(column)
            symbol = find(symbols, word) + 1
            context = context_keys(text, symbol, depth, width)
            there = find(allowed, context) >= 0
            return context[there] * width + symbol[there]

        pairs = written(
            _counts(training, keys_of).select(
                F.floor(F.col("key") / width).cast("long").alias("state"),
                (F.col("key") % width).alias("symbol"),
                "n",
            ),
            f"pairs-{depth}",
        )
        parent = _with_parent(pairs, root, known, depth)
        least_n, pair_n = max(2.0, s.state_share * total), max(1.0, s.pair_share * total)
        kept, nexts = _gains(pairs, parent, least_n, pair_n, s.min_gain, s.least_gain)
        level = _level(_arrays(kept), _arrays(nexts.select("state", "symbol", "n", "p", "p0")),
                       width)
        tree.levels.append(level)
        following = pairs.filter((F.col("n") >= least_n) & (F.col("symbol") != end)).select(
            (F.col("state") * width + F.col("symbol")).alias("state")
        )
        states = _arrays(following)["state"]
    return tree


def _with_parent(pairs: DataFrame, root: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """``pairs`` with p0, the root's probability of the symbol, and p, the longest suffix's."""
    if depth == 1:
        return pairs.join(F.broadcast(root), "symbol").withColumn("p", F.col("p0"))
    width = tree.width

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = batch.column("state").to_numpy()
            symbol = batch.column("symbol").to_numpy()
            contexts = [state % width**d for d in range(1, depth)]
            p0 = batch.column("p0").to_numpy()
            p = p0 * _ratios(tree, contexts, symbol)
            yield batch.append_column("p", pa.array(p))

    return pairs.join(F.broadcast(root), "symbol").mapInArrow(
        ratio, "symbol long, state long, n long, p0 double, p double"
    )


def _level(states: dict, nexts: dict, width: int) -> Level:
    order = np.argsort(states["state"])
    keys = states["state"][order].astype(np.int64)
    total, kinds, kept = (states[c][order].astype(np.float64) for c in ("total", "kinds", "kept"))
    backoff = (total - kept + kinds) / (total + kinds)
    at = find(keys, nexts["state"].astype(np.int64))
    p = nexts["n"] / (total + kinds)[at] + backoff[at] * nexts["p"]
    pairs = nexts["state"].astype(np.int64) * width + nexts["symbol"].astype(np.int64)
    order = np.argsort(pairs)
    return Level(keys, backoff, pairs[order], (p / nexts["p0"])[order])


def _ratios(tree: Tree, contexts: list[np.ndarray], symbol: np.ndarray) -> np.ndarray:
    """Probability of each symbol after its longest state, over the root's.

    ``contexts[d]`` are the keys of the d + 1 symbols before, -1 where there are fewer.
    """
    ratio = np.ones(len(symbol))
    for level, context in zip(tree.levels, contexts, strict=False):
        state = find(level.keys, context)
        there = np.flatnonzero(state >= 0)
        pair = find(level.pairs, context[there] * tree.width + symbol[there])
        ratio[there] *= level.backoff[state[there]]
        hit = pair >= 0
        ratio[there[hit]] = level.ratio[pair[hit]]
    return ratio


def sequences(text: np.ndarray, word: np.ndarray, depth: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, ... ``depth`` + 1 words up to each token, 0 where its text has fewer."""
    found = [word]
    for d in range(1, depth + 1):
        longer = np.zeros(len(word), np.uint64)
        if len(word) > d:
            known = text[d:] == text[:-d]
            shorter = found[-1][d - 1 : -1]
            longer[d:] = np.where(known, mix(shorter * np.uint64(0x9E3779B97F4A7C15) + word[d:]), 0)
        found.append(longer)
    return found


def _before(found: list[np.ndarray], depth: int) -> np.ndarray:
    """Hash of the ``depth`` words before each token; means nothing where its text has fewer."""
    state = np.zeros(len(found[0]), np.uint64)
    state[1:] = found[depth - 1][:-1]
    return state


def _bit_set(keys: DataFrame) -> np.ndarray:
    """A bit for the leading bits of every ``key``, in 64-bit words."""
    place = F.shiftrightunsigned("key", 64 - _BITS)
    return _folded((
        keys.select(F.shiftright(place, 6).alias("at"), (place % 64).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    ).toArrow())


def _folded(table: pa.Table) -> np.ndarray:
    """The bit set of words ``bits`` at ``at``, with some eight bits for each that is set."""
    at = table["at"].to_numpy().astype(np.uint64)
    bits = table["bits"].to_numpy().astype(np.int64).view(np.uint64)
    size = min(max(int(np.bitwise_count(bits).sum()) * 8, 1 << 12).bit_length(), _BITS)
    out = np.zeros(1 << (size - 6), np.uint64)
    for bit in range(64):
        place = (at[bits >> np.uint64(bit) & np.uint64(1) > 0] << np.uint64(6)) + np.uint64(bit)
        place >>= np.uint64(_BITS - size)
        np.bitwise_or.at(out, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    return out


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _candidates(training: DataFrame, depth: int, allowed: list, repeated: list) -> np.ndarray:
    """Bit set of the sequences of ``depth`` + 1 words that may occur twice.

    Tasks send 42 bits of the hash of each sequence, sorted and dealt by the first ten; what
    meets an equal one, or occurs twice in a task, has its bit set.
    """
    low = np.uint64(22)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        pending = 0

        def out() -> pa.RecordBatch:
            short = np.sort(np.concatenate(parts))
            parts.clear()
            ends = np.searchsorted(short, np.arange(1025, dtype=np.uint64) << np.uint64(32))
            cells = [None, pa.py_buffer((ends * 4).astype(np.int32)),
                     pa.py_buffer(short.astype(np.uint32))]
            return pa.RecordBatch.from_pydict({
                "part": pa.array(np.arange(1024, dtype=np.int32)),
                "keys": pa.Array.from_buffers(pa.binary(), 1024, cells),
            })

        for batch in slices(batches, "text"):
            found, used = _followed(batch, depth, allowed, repeated)
            short = found[depth][used] >> low
            if not len(short):
                continue
            # An equal pair is enough to show that it occurs twice.
            short = np.sort(short)
            third = np.zeros(len(short), bool)
            third[2:] = short[2:] == short[:-2]
            parts.append(short[~third])
            pending += len(parts[-1])
            if pending > 2 * _PENDING:
                yield out()
                pending = 0
        if parts:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks.setdefault(part, []).append(np.frombuffer(keys, np.uint32))
        for part, keys in blocks.items():
            key = np.sort(np.concatenate(keys)).astype(np.uint64)
            twice = key[1:][key[1:] == key[:-1]]
            place = np.unique((np.uint64(part << 32) | twice) >> np.uint64(42 - _BITS))
            if len(place):
                at, first = np.unique(place >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array(at.view(np.int64)), "bits": pa.array(bits.view(np.int64)),
                })

    sent = training.select("text").mapInArrow(send, "part int, keys binary")
    return _folded(sent.repartition("part").mapInArrow(meet, "at long, bits long").toArrow())


def _followed(
    batch: pa.RecordBatch, depth: int, allowed: list, repeated: list
) -> tuple[list[np.ndarray], np.ndarray]:
    """The sequences of a batch's tokens, and which tokens have states that are ``allowed``."""
    text, word = tokens(texts(batch.column("text")))
    found = sequences(text, word, depth)
    used = found[depth] != 0
    for d in range(1, depth + 1):
        used &= _in(allowed[d - 1].value, _before(found, d))
    # What occurs twice has a parent that does.
    for d, bits in enumerate(repeated, 1):
        used &= _in(bits.value, found[d])
    return found, used


def _repeated(
    training: DataFrame, depth: int, allowed: list, repeated: list, least: int
) -> DataFrame:
    """key, state, parent, n: sequences of ``depth`` + 1 words that occur ``least`` times.

    ``state`` is the sequence without its last word, ``parent`` without its first.
    """
    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        found, used = _followed(batch, depth, allowed, repeated)
        key = found[depth][used]
        return (
            key, np.ones(len(key), np.int64), _before(found, depth)[used], found[depth - 1][used]
        )

    return _summed(training, rows_of, ("state", "parent"), least)


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """Jobs delete the files of their shuffles once they end, and tasks hold few rows at once."""
    wanted = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(_ROWS),
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def tree_values(
    training: DataFrame, counts: DataFrame, total: int, kinds: int, s: Settings
) -> DataFrame:
    """key, n, value: what a state or a next word adds to the log10 probability of a token.

    The key of a state is the hash of its words with ``_STATE`` in exclusive or, that of a
    next word the hash of the state's words and the word. Both are tables of any size.
    """
    spark = training.sparkSession
    norm = total + _ADD * (kinds + 1)
    shorter = counts.select("key", "n", ((F.col("n") + _ADD) / norm).alias("p"))
    allowed, repeated, out, stack = [], [], [], ExitStack()
    for depth in range(1, s.depth + 1):
        # A sequence occurs as often as a token follows it: its count is the state's total.
        often = shorter.filter(F.col("n") >= s.least_state)
        allowed.append(spark.sparkContext.broadcast(_bit_set(often)))
        if s.least_pair > 1:
            bits = _candidates(training, depth, list(allowed), list(repeated))
            repeated.append(spark.sparkContext.broadcast(bits))
        sequences_ = (
            _repeated(training, depth, list(allowed), list(repeated), min(2, s.least_pair))
            .join(shorter.select(F.col("key").alias("parent"), "p"), "parent").drop("parent")
        )
        with passing(sequences_, f"sequences-{depth}") as found:
            n = F.col("n")
            known = found.groupBy("state").agg(
                F.sum(F.when(n > 1, n).otherwise(0)).alias("repeats"),
                F.sum((n > 1).cast("long")).alias("repeated"),
                F.sum(F.when(n >= s.least_pair, n).otherwise(0)).alias("kept"),
            ).join(often.select(F.col("key").alias("state"), F.col("n").alias("total")), "state")
            # What does not repeat occurs once each.
            once = F.col("total") - F.col("repeats")
            known = known.withColumn("kinds", F.col("repeated") + once)
            each = found.join(known, "state")
            rest = F.col("total") - 1 + F.col("kinds")
            without = (n - 1 + F.col("kinds") * F.col("p")) / rest
            # Left out, a word that occurs once has kinds * p / rest, whatever its p.
            single = F.log(F.col("kinds") / rest)
            states = written(
                each.filter(n > 1)
                .withColumn("more", n * (F.log(without) - F.log("p")))
                .groupBy("state", "total", "kinds", "kept", "repeats")
                .agg(F.sum("more").alias("more"))
                .withColumn("gain", F.col("more") + F.when(once > 0, once * single).otherwise(0.0))
                .filter(F.col("gain") > F.greatest(F.lit(s.least_gain), s.min_gain * F.col("total")))
                .select(
                    "state", "total", (F.col("total") + F.col("kinds")).alias("all"),
                    ((F.col("total") - F.col("kept") + F.col("kinds"))
                     / (F.col("total") + F.col("kinds"))).alias("backoff"),
                ),
                f"states-{depth}",
            )
            suffix = F.coalesce("backoff", F.lit(1.0)) * F.col("p")
            here = F.col("backoff").isNotNull() & (n >= s.least_pair)
            after = suffix + F.when(here, n / F.col("all")).otherwise(0.0)
            nexts = found.join(states, "state", "left").select(
                "key", "n", after.alias("p"), F.when(here, F.log10(after / suffix)).alias("value")
            )
            # Probabilities serve the next depth only, values all texts.
            last = depth == s.depth
            shorter = None if last else stack.enter_context(passing(nexts, f"next-{depth}"))
            valued = (nexts if last else shorter).filter("value IS NOT NULL")
            out.append(written(valued.select("key", "n", "value"), f"values-{depth}"))
        out.append(states.select(
            F.col("state").bitwiseXOR(F.lit(_STATE)).alias("key"), F.col("total").alias("n"),
            F.log10("backoff").alias("value"),
        ))
    stack.close()
    for bits in (*allowed, *repeated):
        bits.destroy()
    values = out[0]
    for more in out[1:]:
        values = values.unionByName(more)
    return values


#: Kinds of rows where texts meet values, in the order in which a part has them.
WORD, GAIN, ASKED, TEXT = range(4)
_TEXT = ("row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
         "gain double")
_BLOCKS = ("part int, kind int, high binary, low binary, value binary, row binary, "
           "stretch binary, times binary, origin long, " + _TEXT)
_TOLD = ("part int, high binary, low binary, known binary, more_base binary, more_gain binary, "
         + _TEXT)
_ADDED = ["doc_id", "held_out", "n_tokens", "n_known", "base", "gain"]


def _filled(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    """The batch with all columns of ``_BLOCKS``, null where it has none."""
    return _with(batch.append_column("kind", pa.array(np.full(batch.num_rows, kind, np.int32))), _BLOCKS)


def _with(batch: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(),
             "boolean": pa.bool_()}
    cells = {}
    for column in schema.split(", "):
        name, kind = column.split()
        there = name in batch.schema.names
        cells[name] = batch.column(name) if there else pa.nulls(batch.num_rows, kinds[kind])
    return pa.RecordBatch.from_pydict(cells)


def scored(
    docs: DataFrame, folds: int = 10, settings: Settings | None = None
) -> DataFrame:
    """A row per row of ``docs``: tokens, base score and the tree's score of the whole text.

    Tokens are words without ASCII white space, A-Z lower-cased, then one end. The model
    learns from rows whose crc32(doc_id as text) modulo ``folds`` is not 0; the others are
    ``held_out``. A null doc_id counts as empty text, so it is held out; a null text is
    empty, so its only token is the end. ``base_score`` sums log10((c + 0.1) / (N + 0.1 *
    (V + 1))) over tokens; ``score`` is the tree's log10 probability. Rows that repeat are
    scored alike and each count in training. Columns other than doc_id and text are not
    read. An empty table gives an empty result.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    ship(spark)
    with _lean(spark):
        return _scored(docs, folds, s)


def _scored(docs: DataFrame, folds: int, s: Settings) -> DataFrame:
    spark = docs.sparkSession
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        (remainder(F.col("doc_id"), folds) == 0).alias("held_out"),
    )
    training = named.filter(~F.col("held_out"))

    def all_tokens(column):
        return tokens(column)[1].view(np.int64)

    counts = written(_counts(training, all_tokens), "token-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    values = tree_values(training, counts, total, kinds, s)
    least = max(1.0, s.common_share * total)
    frequent = _arrays(values.filter(F.col("n") >= least).select("key", "value"))
    rarer = values.filter(F.col("n") < least)
    by_key = np.argsort(frequent["key"].view(np.uint64))
    common = _arrays(counts.filter(F.col("n") >= least))
    order = np.argsort(common["key"].view(np.uint64))
    model = spark.sparkContext.broadcast(
        (common["key"].view(np.uint64)[order], np.log10(common["n"][order] + _ADD),
         frequent["key"].view(np.uint64)[by_key], frequent["value"][by_key], _bit_set(rarer))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is known of each text, and blocks of the keys that have to be looked up."""
        known, value, keys, gains, rarer_bits = model.value
        asked: list[tuple[np.ndarray, ...]] = []
        pending, origin = 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            key, row = _joined(asked)
            asked.clear()
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            # Rows of a key ascend, so what a text has of it stands together.
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            place = (row[first] - origin).astype(np.uint32)
            columns = {"key": key[first], "row": place.astype(np.uint16),
                       "stretch": (place >> np.uint32(16)).astype(np.uint16),
                       "times": np.diff(np.append(first, len(key))).astype(np.uint32)}
            for block in _dealt(columns, origin=origin):
                yield _filled(block, ASKED)

        for batch in slices(batches, "text"):
            rows = batch.num_rows
            row_id = batch.column("row_id").to_numpy()
            text, word = tokens(texts(batch.column("text")))
            found = sequences(text, word, s.depth)
            gain = np.zeros(rows)
            if not asked:
                origin = int(row_id[0])

            def ask(key, text, row_id=row_id):
                asked.append((mix(key), row_id[text]))
                return len(key)

            for depth in range(1, s.depth + 1):
                there = np.flatnonzero(found[depth] != 0)
                for key in (_before(found, depth) ^ np.uint64(_STATE), found[depth]):
                    at = find(keys, key[there])
                    met = at >= 0
                    gain += np.bincount(text[there[met]], gains[at[met]], rows)
                    maybe = ~met & _in(rarer_bits, key[there])
                    pending += ask(key[there[maybe]], text[there[maybe]])
                    # Next words have values only in states that are in the tree.
                    there = there[met | maybe]
            at = find(known, word)
            met = at >= 0
            base = np.bincount(text[met], value[at[met]], rows)
            pending += ask(word[~met], text[~met])
            yield _filled(pa.RecordBatch.from_pydict({
                "part": pa.array(_part(mix(row_id.view(np.uint64)))),
                "row_id": batch.column("row_id"),
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": pa.array(np.bincount(text, minlength=rows)),
                "n_known": pa.array(np.bincount(text[met], minlength=rows)),
                "base": pa.array(base.astype(np.float64)),
                "gain": pa.array(gain.astype(np.float64)),
            }), TEXT)
            if pending > _PENDING:
                yield from out()
                pending = 0
        if asked:
            yield from out()

    def give(kind: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[tuple[np.ndarray, ...]] = []
            pending = 0

            def out() -> Iterator[pa.RecordBatch]:
                key, value = _joined(parts)
                parts.clear()
                order = np.argsort(key)
                for block in _dealt({"key": key[order], "value": value[order]}):
                    yield _filled(block, kind)

            for batch in batches:
                key, value = (batch.column(c).to_numpy() for c in ("key", "value"))
                parts.append((mix(key.view(np.uint64)), value))
                pending += batch.num_rows
                if pending > _PENDING:
                    yield from out()
                    pending = 0
            if parts:
                yield from out()

        return send

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What texts have of the keys that are known; the rows of texts as they are."""
        at, pending = -1, 0
        given: dict[int, list[tuple[np.ndarray, ...]]] = {WORD: [], GAIN: []}
        asked: list[tuple[np.ndarray, ...]] = []
        parts: list[tuple[np.ndarray, ...]] = []

        def answer() -> int:
            """Looks up what was asked in one part."""
            met_in_all = 0
            key, row, times = _joined(asked) if asked else (np.zeros(0, np.uint64),) * 3
            for kind, blocks in given.items():
                if blocks and len(key):
                    keys, value = _joined(blocks)
                    order = np.argsort(keys)
                    place = find(keys[order], key)
                    met = np.flatnonzero(place >= 0)
                    n, x = times[met].astype(np.float64), value[order][place[met]]
                    zero = np.zeros(len(met))
                    parts.append((row[met], n, n * x, zero) if kind == WORD
                                 else (row[met], zero, zero, n * x))
                    met_in_all += len(met)
                blocks.clear()
            asked.clear()
            return met_in_all

        def merged() -> tuple[np.ndarray, ...]:
            row, *sums = _joined(parts)
            row, which = np.unique(row, return_inverse=True)
            return (row, *(np.bincount(which, x, len(row)) for x in sums))

        def out() -> Iterator[pa.RecordBatch]:
            row, known, base, gain = parts.pop()
            key = mix(row.view(np.uint64))
            order = np.argsort(key)
            columns = {"key": key, "known": known.astype(np.uint32), "more_base": base, "more_gain": gain}
            for block in _dealt({name: c[order] for name, c in columns.items()}):
                yield _with(block, _TOLD)

        for batch in batches:
            part, kind, origin = (
                batch.column(c).fill_null(0).to_numpy() for c in ("part", "kind", "origin")
            )
            cells = _cells(batch, "high", "low", "value", "row", "stretch", "times")
            for begin, end in _runs(batch, "part", "kind"):
                if part[begin] != at:
                    pending += answer()
                    at = part[begin]
                if pending > _PENDING:
                    parts[:] = [merged()]
                    pending = len(parts[0][0])
                    if pending > _PENDING // 2:
                        yield from out()
                        pending = 0
                key = _key(cells, begin, end)
                if kind[begin] == ASKED:
                    sizes = np.diff(cells["row"][1][begin : end + 1]) // 2
                    row = _cut(cells["stretch"], begin, end, np.uint16).astype(np.int64) << 16
                    row += _cut(cells["row"], begin, end, np.uint16)
                    asked.append((key, np.repeat(origin[begin:end], sizes) + row,
                                  _cut(cells["times"], begin, end, np.uint32)))
                elif kind[begin] != TEXT:
                    given[kind[begin]].append((key, _cut(cells["value"], begin, end, np.float64)))
            yield _with(batch.filter(pa.array(kind == TEXT)), _TOLD)
        answer()
        if parts:
            parts[:] = [merged()]
            yield from out()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of texts, with what was found for them added."""
        at = -1
        rows: list[pa.RecordBatch] = []
        blocks: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            columns = {c: table[c].to_numpy().copy() for c in ("n_known", "base", "gain")}
            if blocks:
                key, *sums = _joined(blocks)
                key, which = np.unique(key, return_inverse=True)
                place = find(key, mix(table["row_id"].to_numpy().view(np.uint64)))
                met = place >= 0
                for (name, column), x in zip(columns.items(), sums, strict=True):
                    more = np.bincount(which, x, len(key))[place[met]]
                    column[met] += more.astype(column.dtype)
            rows.clear()
            blocks.clear()
            for name, column in columns.items():
                table = table.set_column(table.schema.get_field_index(name), name, pa.array(column))
            yield from table.select(_ADDED).to_batches()

        for batch in batches:
            part = batch.column("part").to_numpy()
            whole = batch.column("row_id").is_valid()
            cells = _cells(batch, "high", "low", "known", "more_base", "more_gain")
            for begin, end in _runs(batch, "part"):
                if rows and part[begin] != at:
                    yield from out()
                at = part[begin]
                rows.append(batch.slice(begin, end - begin).filter(whole.slice(begin, end - begin)))
                key = _key(cells, begin, end)
                if len(key):
                    blocks.append((
                        key, _cut(cells["known"], begin, end, np.uint32),
                        _cut(cells["more_base"], begin, end, np.float64),
                        _cut(cells["more_gain"], begin, end, np.float64),
                    ))
        if rows:
            yield from out()

    told = named.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(score, _BLOCKS)
    rare_words = counts.filter(F.col("n") < least).select(
        "key", F.log10(F.col("n") + _ADD).alias("value")
    )
    for table, kind in ((rare_words, WORD), (rarer.select("key", "value"), GAIN)):
        told = told.unionByName(table.mapInArrow(give(kind), _BLOCKS))
    sums = (
        told.repartition("part").sortWithinPartitions("part", "kind")
        .mapInArrow(look_up, _TOLD)
        .repartition("part").sortWithinPartitions("part")
        .mapInArrow(add_up, ", ".join(c for c in _TEXT.split(", ") if c.split()[0] in _ADDED))
    )
    norm = float(np.log10(total + _ADD * (kinds + 1)))
    base = (
        F.col("base")
        + (F.col("n_tokens") - F.col("n_known")) * float(np.log10(_ADD))
        - F.col("n_tokens") * norm
    )
    return written(
        sums.select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(int(total)).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (base + F.col("gain")).alias("score"),
        ),
        "scored-rows",
    )
