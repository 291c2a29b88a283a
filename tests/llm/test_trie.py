import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import tour, trie
from tidemark.llm.trie import prefix_trie
from tidemark.operators import history

NAMES = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)
SCHEMA = "conv_id long, turn long, role string, text string, node int, conv string, parent int, n long"


def brute(rows):
    turns = {}
    for r in rows:
        if r["conv_id"] is not None:
            turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    for conv, found in turns.items():
        found.sort(key=lambda t: (
            t[0] is not None, t[0] or 0, t[1],
            hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        turns[conv] = [t[1:] for t in found]
    members = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for depth in range(len(path) + 1):
            members.setdefault(path[:depth], []).append((conv, len(path)))
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    sums, out = {}, []
    for path in sorted(members, key=len, reverse=True):
        below = [sums[p] for p in children.get(path, [])]
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        sums[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    for path, found in members.items():
        stop = sorted(c for c, size in found if size == len(path))
        out.append((
            min(found)[0], len(path), min(members[path[:-1]])[0] if path else None, len(found),
            len(children.get(path, [])), *sums[path],
            hashlib.sha256(",".join(map(str, stop)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r[n] for n in NAMES) for r in df.collect()], key=repr)


def conversations(spark, seed, convs, long=0):
    rng, rows = random.Random(seed), []
    texts = ["a", "b", "", None, "Größe 🙂", "x" * 70_000]
    for conv in convs:
        for turn in range(rng.randrange(1, 8)):
            turn = rng.choice([turn, turn, turn, None, 2])
            rows.append((conv, turn, rng.choice(["user", "assistant", None, ""]),
                         rng.choice(texts[:rng.choice([2, 2, 6])]), 1, "c", 2, 3))
    for conv in (200, 201, 202) if long else ():
        rows += [(conv, t, "user", f"t{t}", 1, "c", 2, 3) for t in range(long + conv - 200)]
    rows += [rows[0]] * 3 + [(None, 1, "user", "no id", 1, "c", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_nodes_equal_those_of_brute_force(spark):
    df = conversations(spark, 1, [*range(90), *range(150, 260), -1, -100, -150, 10**15])
    assert got(prefix_trie(df)) == brute(df.collect())


def test_small_blocks_chunks_and_cut_points_change_nothing(spark, monkeypatch):
    df = conversations(spark, 2, [*range(40), *range(300, 330)], long=150)
    for name, value in {"CHUNK": 7, "STRETCH": 16, "HEAVY": 3, "_IDS": 2}.items():
        monkeypatch.setattr(trie, name, value)
    monkeypatch.setattr(
        trie, "find_cut_points", lambda df, line: history.find_cut_points(df, line, 20)
    )
    monkeypatch.setattr(trie, "ranked", lambda items, block: tour.ranked(items, block, small=40))
    assert got(prefix_trie(df)) == brute(df.collect())


def test_a_table_without_conversations_has_no_nodes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(none).count() == 0
    no_ids = spark.createDataFrame([(None, 1, "user", "x", 1, "c", 2, 3)], SCHEMA)
    assert prefix_trie(no_ids).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    # 150 takes five turns of 100, which is absent, and has none beyond its own fifth.
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    df = spark.createDataFrame([(conv, 0, "user", "x", 1, "c", 2, 3)], SCHEMA)
    digest = hashlib.sha256(str(conv).encode()).hexdigest()
    assert got(prefix_trie(df)) == [(conv, 0, None, 1, 0, 1, 0, digest)]


@pytest.mark.parametrize("small", [5, 100_000])
def test_list_ranks_whatever_the_blocks(spark, small):
    order = list(range(500))
    random.Random(5).shuffle(order)
    rows = [(order[i], order[i + 1] if i + 1 < len(order) else None) for i in range(len(order))]
    items = spark.createDataFrame(rows, "a int, b int").select(
        F.col("a").cast("string").cast("binary").alias("item"),
        F.col("b").cast("string").cast("binary").alias("following"),
    )
    found = tour.ranked(items, F.hash("item") % 9, small=small).collect()
    assert {int(r["item"].decode()): r["rank"] for r in found} == {a: i for i, a in enumerate(order)}
