from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd, prose
from tidemark.llm.mixing import (
    _draw, mixed_blocks, mixed_documents, taken_words, targets, write_shards,
)

WEIGHTS = (5, 2, 1)


def brute_targets(sizes, share=1.5, most=2.0):
    """Sources in code-point order, null last; what is over a cap is shared out again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
        free -= set(over)
        left -= sum(target[s] for s in over)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 5000, "c": 70, None: 300, "é": 1, "z": 0},
    {"x": 7}, {"a": 0, None: 0}, {"b": 1, "a": 1_000_000, "c": 3, "d": 9, "e": 900},
])
def test_targets_are_shared_by_weight_under_their_caps(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in targets(df, WEIGHTS, 1.5, 2.0).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want)
    for s in want:
        assert got[s] == pytest.approx(want[s])


def corpus(spark):
    rows = [odd(i, prose(i, 5 + i * 7 % 90), "en", "src%d" % min(i % 11, 6)) for i in range(400)]
    rows += [odd(500, prose(9, 3_000), "en", None), odd(500, prose(9, 3_000), "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
        "n_chars long, key_a long, row_id string, size int, part string, score double, label int"
    ).repartition(4)


def test_every_source_gives_its_target_words(spark):
    docs = corpus(spark)
    kept = {}
    for words in (100, 8192):
        rows = taken_words(mixed_blocks(docs, block_words=words, shards=7)).collect()
        assert len(rows) == docs.count()
        sizes, taken, target = Counter(), Counter(), {}
        source = {r["doc_id"]: r["source"] for r in docs.collect()}
        for r in rows:
            s = source[r["doc_id"]]
            sizes[s] += r["size"]
            taken[s] += r["taken"]
            target[s] = r["target"]
            assert 0 <= r["taken"] <= 2 * r["size"]
            assert r["source_size"] >= r["size"]
        want = brute_targets(sizes)
        for s in sizes:
            assert target[s] == pytest.approx(want[s])
            assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
        kept[words] = sorted(map(tuple, rows), key=repr)
        again = taken_words(mixed_blocks(docs.repartition(2), block_words=words, shards=7))
        assert sorted(map(tuple, again.collect()), key=repr) == kept[words]


def test_shards_are_even_and_draw_every_block_as_often_as_due(spark):
    blocks = mixed_blocks(corpus(spark), block_words=64, shards=8).collect()
    per_shard, places = Counter(), defaultdict(set)
    for b in blocks:
        for d in b["draws"]:
            per_shard[d["shard"]] += 1
            places[d["shard"]].add(d["place"])
            assert 0 < d["words"] <= b["words"]
        assert [d["pass"] for d in b["draws"]] == list(range(len(b["draws"])))
    assert set(per_shard) == set(range(8))
    assert max(per_shard.values()) - min(per_shard.values()) <= 3
    partial = [b for b in blocks if any(d["words"] < b["words"] for d in b["draws"])]
    assert len(partial) <= len({b["source_size"] for b in blocks})


def test_a_draw_is_multivariate_hypergeometric():
    rng = np.random.default_rng(3)
    counts = np.array([10, 0, 30, 60])
    draws = np.array([_draw(rng, counts, 25) for _ in range(4000)])
    assert (draws.sum(axis=1) == 25).all() and (draws <= counts).all()
    assert draws.mean(axis=0) == pytest.approx(counts / 4, abs=0.2)
    variance = 25 * 0.3 * 0.7 * 75 / 99
    assert draws[:, 2].var() == pytest.approx(variance, rel=0.1)
    huge = np.array([10**10, 3 * 10**10, 0])
    drawn = _draw(rng, huge, 10**10)
    assert drawn.sum() == 10**10 and drawn[0] == pytest.approx(2.5e9, rel=1e-3)


def test_the_mix_as_documents(spark, tmp_path):
    docs = corpus(spark)
    blocks = mixed_blocks(docs, block_words=50, shards=3)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = mixed_documents(docs, blocks, names)
    rows = mixed.collect()
    full = {}
    for r in docs.collect():
        full[r["doc_id"]] = r["text"]
    words = Counter()
    for r in rows:
        assert r["text"] in full[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    taken = Counter()
    for r in taken_words(blocks).collect():
        taken[r["doc_id"]] += r["taken"]
    assert words == +taken
    write_shards(mixed, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == len(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = taken_words(mixed_blocks(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    sizes = sorted(len((r["text"] or "").encode().split()) for r in odd_docs.collect())
    assert sorted(r["size"] for r in rows) == sizes
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert taken_words(mixed_blocks(no_docs)).count() == 0
    mixed = mixed_documents(odd_docs, mixed_blocks(odd_docs), ["doc_id", "text"])
    assert mixed.agg(F.max(F.length("text"))).first()[0] > 0


def test_one_document_in_four_sources_is_four_documents(spark):
    from tidemark.llm.mixing import mixed_blocks, mixed_documents, taken_words

    rows = [(7, "one two three", "en", s) for s in ("s0", "s1", "s2", None)]
    rows += [(8, "four five", "en", "s0"), (7, "one two three", "de", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    blocks = mixed_blocks(docs)
    taken = taken_words(blocks).collect()
    assert len(taken) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in taken)
    drawn = {(r["doc_id"], r["source"]): 0 for r in taken}
    for r in taken:
        drawn[r["doc_id"], r["source"]] += r["taken"]
    mixed = mixed_documents(docs, blocks, ["doc_id", "text", "lang", "source"]).collect()
    words = {}
    for r in mixed:
        words[r["doc_id"], r["source"]] = words.get((r["doc_id"], r["source"]), 0) + len(
            r["text"].split())
        assert r["source"] != "s1" or r["lang"] == "de"  # the least of equal rows
    assert words == {k: n for k, n in drawn.items() if n}
