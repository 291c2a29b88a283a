"""Near duplicates by DartMinHash signatures, banded joins and exact checks.

A document is the multiset of its five-word shingles; similarity is the weighted Jaccard
index of two such sets. Every element throws darts, seeded by itself, into a region as wide
as its weight; a dart has a height and a coordinate, and each of ``k`` coordinates keeps the
lowest dart. Only about ``k ln k + 2k`` darts of a document lie low enough to matter, so a
signature costs the size of the document plus that, not their product.

Two documents that agree on all darts of a band are candidates. Every candidate that could
join two classes is checked exactly, without listing all pairs of a group:

1. Equal word sequences shrink to one representative.
2. In each bucket the member with the most bucket mates is the hub; all others are compared
   to it alone. Links tie members into classes.
3. Where members of a bucket other than the hub are still in different classes, blocks of at
   most ``2 * BLOCK`` members are compared inside one task, which returns only the links that
   join classes. A pair is compared in the first band that it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.rows import identity, rows_with_keys, ship, slices, texts, written
from tidemark.llm.words import mix, shingles, words

SHINGLE = 5
BANDS, ROWS = 20, 4
THRESHOLD = 0.8
# Members of a bucket that one task compares with as many others.
BLOCK = 512
# Rows of one comparing task, about.
TASK_ROWS = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted(owner: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, element) in order, and how often each occurs."""
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(owner)))
    return owner[first], element[first], count


def strips(
    owner: np.ndarray, element: np.ndarray, weight: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each element's region cut into strips of width 1: owner, strip and width of the strip."""
    n = np.ceil(weight).astype(np.int64)
    which = np.repeat(np.arange(len(owner)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    strip = mix(element[which] ^ mix(nth.astype(np.uint64) * _GOLD + np.uint64(1)))
    return owner[which], strip, np.minimum(1.0, weight[which] - nth)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(
    owner: np.ndarray, strip: np.ndarray, width: np.ndarray, n: int, k: int
) -> np.ndarray:
    """The lowest dart of every coordinate, for owners 0..n-1; zeros for an empty owner.

    Darts fall on a strip at unit rate per width and height: heights grow by exponential
    steps, and a dart beyond the strip's width misses. Each round throws the next dart of
    every strip that is still below the owner's limit. Owners with a coordinate left empty
    are done again with twice the limit.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, width, n)
    limit = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    while len(owner):
        seed, who, wide, height = strip, owner, width, np.zeros(len(owner))
        slots, heights, darts = [], [], []
        while len(seed):
            seed = mix(seed + _GOLD)
            height = height - np.log(_unit(seed))
            below = height <= limit[who]
            seed, who, wide, height = seed[below], who[below], wide[below], height[below]
            place = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            hit = _unit(mix(place)) <= wide
            slots.append(who[hit] * k + (place[hit] % np.uint64(k)).astype(np.int64))
            heights.append(height[hit])
            darts.append(seed[hit])
        slot, height, dart = map(np.concatenate, (slots, heights, darts))
        order = np.lexsort((height, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = dart[first]
        filled = np.bincount(slot[first] // k, minlength=n)
        again = (filled < k)[owner]
        owner, strip, width = owner[again], strip[again], width[again]
        limit = limit * 2
    return out


def document_strips(column: pa.LargeBinaryArray, n: int) -> tuple[np.ndarray, ...]:
    """Owner, strip, width of all shingles, and each text's digest of its words."""
    text, word = words(column)
    owner, strip, width = strips(*weighted(*shingles(text, word, n)))
    size = np.bincount(text, minlength=len(column))
    ends = np.cumsum(size)
    digest = [
        hashlib.blake2b(word[e - s : e].tobytes(), digest_size=16).digest()
        for s, e in zip(size.tolist(), ends.tolist(), strict=True)
    ]
    return owner, strip, width, np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0).astype(np.int32)), values)


def signed(docs: DataFrame, n: int, k: int) -> DataFrame:
    """row_id, doc_id, keys, digest of the words and ``k`` darts (32 bits) of every row."""
    named = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *identity("doc_id", "text"),
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = batch.num_rows
            owner, strip, width, digest = document_strips(texts(batch.column("text")), n)
            darts = (signatures(owner, strip, width, rows, k) >> np.uint64(32)).astype(np.uint32)
            some = np.bincount(owner, minlength=rows) > 0
            ends = np.cumsum(np.where(some, k, 0))
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("row_id", "doc_id", "key_a", "key_b")},
                "digest_a": pa.array(digest[:, 0]),
                "digest_b": pa.array(digest[:, 1]),
                "darts": _lists(pa.array(darts[some].reshape(-1).view(np.int32)), ends),
            })

    return named.mapInArrow(
        sign,
        "row_id long, doc_id long, key_a long, key_b long, digest_a long, digest_b long, "
        "darts array<int>",
    )


def strip_sets(docs: DataFrame, n: int) -> DataFrame:
    """key_a, key_b and the set of 32-bit strips of every row.

    The shared part of two such sets, over their union, is the weighted Jaccard index: a
    shingle that occurs twice has two strips.
    """
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, strip, _, _ = document_strips(texts(batch.column("text")), n)
            owner, strip, _ = weighted(owner, strip >> np.uint64(32))
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))
            values = pa.array(strip.astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_pydict({
                "key_a": batch.column("key_a"), "key_b": batch.column("key_b"),
                "strips": _lists(values, ends),
            })

    return docs.select("key_a", "key_b", "text").mapInArrow(
        collect, "key_a long, key_b long, strips array<int>"
    )


def _band_keys(bands: int, rows: int) -> Column:
    return F.array(*[
        F.xxhash64(F.lit(band), F.slice("darts", band * rows + 1, rows)) for band in range(bands)
    ])


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose strip sets are similar enough."""
    a = sets.select(F.col("row_id").alias("a"), F.col("strips").alias("strips_a"))
    b = sets.select(F.col("row_id").alias("b"), F.col("strips").alias("strips_b"))
    shared = F.size(F.array_intersect("strips_a", "strips_b"))
    size_a, size_b = F.size("strips_a"), F.size("strips_b")
    close = F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)
    return (
        pairs.join(b, "b")
        .join(a, "a")
        .filter(F.when(close, shared >= threshold * (size_a + size_b - shared)).otherwise(False))
        .select("a", "b")
    )


def _joining_links(
    ids: np.ndarray, blocks: np.ndarray, classes: np.ndarray, darts: np.ndarray,
    sets: list[np.ndarray], band: int, within: bool, rows: int, least: int, threshold: float,
) -> list[tuple[int, int]]:
    """Links between members of one bucket that join different classes."""
    m = len(ids)
    size = np.array([len(s) for s in sets])
    wanted = classes[:, None] != classes[None, :]
    wanted &= np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size)
    wanted &= (blocks[:, None] != blocks[None, :]) | within
    wanted &= np.arange(m)[:, None] < np.arange(m)[None, :]
    agreed = np.zeros((m, m), np.uint8)
    for b in range(darts.shape[1] // rows):
        shared = np.ones((m, m), bool)
        for c in range(b * rows, (b + 1) * rows):
            same = darts[:, c, None] == darts[None, :, c]
            agreed += same
            shared &= same
        if b < band:
            wanted &= ~shared
    wanted &= agreed >= least
    x, y = np.nonzero(wanted)
    root = {c: c for c in classes.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for i in np.argsort(-agreed[x, y].astype(np.int16), kind="stable").tolist():
        p, q = int(x[i]), int(y[i])
        s, t = find(int(classes[p])), find(int(classes[q]))
        if s == t:
            continue
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        if both >= threshold * (size[p] + size[q] - both):
            root[s] = t
            links.append((int(ids[p]), int(ids[q])))
    return links


def _remaining(
    members: DataFrame, hubs: DataFrame, classes: DataFrame, light: DataFrame, sets: DataFrame,
    bands: int, rows: int, threshold: float,
) -> DataFrame:
    """Links within buckets whose members, but for the hub, are in several classes."""
    spark = members.sparkSession
    others = (
        members.join(hubs, "key")
        .filter("row_id <> hub")
        .join(classes, "row_id", "left")
        .select("key", "band", "row_id", F.coalesce("root", "row_id").alias("class"))
    )
    split = others.groupBy("key", "band").agg(
        F.count("*").alias("m"), F.min("class").alias("low"), F.max("class").alias("high")
    ).filter("low <> high")
    kept = written(
        others.join(split.select("key", "m"), "key").withColumns({
            "blocks": F.ceil(F.col("m") / BLOCK).cast("int"),
        }).withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks").cast("int")),
        "open-members",
    )
    total = kept.agg(F.sum("blocks")).first()[0] or 0
    tasks = max(1, -(-int(total) // TASK_ROWS))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = kept.withColumn("other", other).select(
        "key", "band", "row_id", "class", "block",
        F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
    ).withColumn("task", F.pmod(F.xxhash64("key", "first", "second"), F.lit(tasks)))
    full = spread.join(light.select("row_id", "darts"), "row_id").join(
        sets.select("row_id", "strips"), "row_id"
    )
    # 44 of 80 darts agree by chance in 1 of 10**8 pairs of similarity 0.8 or more at most.
    k = bands * rows
    least = int(k * threshold - 5.5 * (k * threshold * (1 - threshold)) ** 0.5)

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by(
            [(c, "ascending") for c in ("key", "first", "second", "row_id")]
        ).combine_chunks()
        columns = {
            c: group[c].to_numpy()
            for c in ("key", "first", "second", "block", "row_id", "class", "band")
        }
        new = np.ones(len(group), bool)
        for c in ("key", "first", "second"):
            new[1:] &= columns[c][1:] == columns[c][:-1]
        starts = np.flatnonzero(~new | (np.arange(len(group)) == 0))
        ends = np.append(starts[1:], len(group))
        darts = group["darts"].combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        strips_ = group["strips"].combine_chunks()
        cells, offsets = strips_.values.to_numpy(), strips_.offsets.to_numpy()
        links = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            sets_ = [cells[offsets[i] : offsets[i + 1]] for i in range(s, e)]
            links += _joining_links(
                columns["row_id"][s:e], columns["block"][s:e], columns["class"][s:e],
                darts[s:e], sets_, int(columns["band"][s]),
                columns["first"][s] == columns["second"][s], rows, least, threshold,
            )
        a = pa.array([p for p, _ in links], pa.int64())
        return pa.table({"a": a, "b": pa.array([q for _, q in links], pa.int64())})

    if not total:
        return spark.createDataFrame([], "a long, b long")
    return full.groupBy("task").applyInArrow(compare, "a long, b long")


def near_groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """A row per row of ``docs``: its class of near duplicates and whether it stays.

    Classes are the connected components of similarity ``threshold`` or more between
    multisets of ``shingle`` words (runs without ASCII white space). A text of fewer words is
    one shingle of all its words. Null, empty and blank texts have none and are one class;
    equal word sequences always share a class. A pair at the threshold is missed with a
    chance of ``(1 - threshold ** rows) ** bands``: 3 in 100,000 as set.

    The smallest doc_id of a class names it and stays (null ids last); of rows that repeat,
    one. Columns: row_id, doc_id, key_a, key_b, class_id, class_size, kept. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select("doc_id", "text")
    table = written(signed(plain, shingle, bands * rows), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    reps = written(
        table.groupBy("digest_a", "digest_b").agg(
            F.min("row_id").alias("rep"), F.min(order).alias("best"), F.count("*").alias("copies")
        ),
        "representatives",
    )
    light = written(
        table.select("row_id", "key_a", "key_b", "darts").join(
            reps.select(F.col("rep").alias("row_id")), "row_id", "left_semi"
        ).filter(F.size("darts") > 0),
        "representative-signatures",
    )
    exploded = light.select("row_id", F.posexplode(_band_keys(bands, rows)).alias("band", "key"))
    buckets = exploded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = written(exploded.join(buckets, "key"), "members")
    centrality = members.groupBy("row_id").agg(F.sum("m").alias("mates"))
    hubs = written(
        members.join(centrality, "row_id").groupBy("key").agg(
            F.max_by("row_id", F.struct("mates", -F.col("row_id"))).alias("hub")
        ),
        "hubs",
    )
    named = light.select("row_id", "key_a", "key_b").join(
        members.select("row_id").distinct(), "row_id"
    )
    wanted = plain.select("text", *identity("doc_id", "text")).join(
        named.select("key_a", "key_b"), ["key_a", "key_b"], "left_semi"
    ).dropDuplicates(["key_a", "key_b"])
    sets = written(
        strip_sets(wanted, shingle).join(named, ["key_a", "key_b"]).select("row_id", "strips"),
        "strips",
    )
    stars = members.join(hubs, "key").filter("row_id <> hub").select(
        F.greatest("hub", "row_id").alias("a"), F.least("hub", "row_id").alias("b")
    ).distinct()
    links = written(linked(stars, sets, threshold), "links")
    classes = written(
        components(links).select(F.col("node").alias("row_id"), "root"), "classes"
    )
    rest = written(
        _remaining(members, hubs, classes, light, sets, bands, rows, threshold), "more-links"
    )
    final = components(links.unionByName(rest)).select(F.col("node").alias("rep"), "root")
    named_reps = reps.join(final, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    whole = named_reps.groupBy("root").agg(
        F.min("best").alias("class_best"), F.sum("copies").alias("class_size")
    )
    by_digest = named_reps.join(whole, "root").select(
        "digest_a", "digest_b", "class_best", "class_size"
    )
    return table.select("row_id", "doc_id", "key_a", "key_b", "digest_a", "digest_b").join(
        by_digest, ["digest_a", "digest_b"]
    ).select(
        "row_id", "doc_id", "key_a", "key_b",
        F.col("class_best.doc_id").alias("class_id"),
        "class_size",
        (F.col("row_id") == F.col("class_best.row_id")).alias("kept"),
    )


def without_near_copies(docs: DataFrame, columns: list[str], **settings) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, with ``columns``."""
    kept = near_groups(docs, **settings).filter("kept")
    return rows_with_keys(docs, kept, columns)
