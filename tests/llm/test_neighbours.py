import numpy as np
import pytest

from tidemark.llm import neighbours
from tidemark.llm.neighbours import Index, best_of, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, row_id int, block string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "b", 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=5, every=50):
    good = []
    for at, (i, v) in enumerate(rows):
        if not v or any(x is None for x in v):
            continue
        a = np.float32(v).astype(np.float64)
        if np.isfinite(a).all() and a.any():
            good.append((at, i, a))
    out = {}
    for at, i, a in good:
        if i is None or i % every:
            continue
        scores = [
            (-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), j is None, j or 0)
            for other, j, b in good if other != at and len(b) == len(a)
        ]
        out.setdefault(i, []).append(sorted(scores)[:k])
    return out


def check(spark, rows, **settings):
    got = {}
    result = nearest(frame(spark, rows), **settings).collect()
    for r in sorted(result, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    want = brute(rows)
    for query, lists in want.items():
        for expected in lists:
            found = got.get(query, [])
            assert len(found) == len(expected) * len(lists)
            ids = [r["vec_id"] for r in found]
            total += len(expected)
            hit += sum((None if none else j) in ids for _, none, j in expected)
            if len(lists) == 1:
                assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
                order = [(-round(r["score"], 12), r["vec_id"] is None, r["vec_id"] or 0) for r in found]
                assert order == sorted(order)
    assert set(got) <= set(want)
    return hit / max(1, total)


def clusters(n, dimension, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dimension))
    loose = rng.normal(size=(n, dimension))
    tight = centres[np.arange(n) % 8] + 0.1 * loose
    return [(i, (tight if i % 3 else loose)[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("dimension", [3, 16, 64])
def test_recall_against_brute_force(spark, dimension):
    assert check(spark, clusters(3000, dimension, dimension)) >= 0.9


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert check(spark, rows) >= 0.9


def test_many_equal_vectors_are_ranked_by_id_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    rows = clusters(1200, 8, 1)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    rows = [(i, [2 * x for x in v] if i % 9 == 0 else v) for i, v in rows]
    assert check(spark, rows) >= 0.9
    got = nearest(frame(spark, rows)).filter("query_id = 300").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 3, 6, 9, 12]


def test_odd_rows(spark):
    vector = [1.0, 2.0, -1.0]
    rows = [
        (0, vector), (0, vector), (50, None), (50, []), (100, [0.0, 0.0, 0.0]),
        (150, [1.0, None, 2.0]), (200, [1.0, float("nan"), 2.0]), (250, [float("inf"), 1.0, 0.0]),
        (None, [1.0, 2.0, -1.0]), (300, [1.0, 2.0]), (350, [1e-30, 2e-30, -1e-30]), (7, [3e18, 1e18, 0.0]),
    ]
    good = [r for r in rows if r[0] != 300]
    got = nearest(frame(spark, rows)).collect()
    assert {r["query_id"] for r in got} == {0, 350}
    want = brute(good)
    assert len(got) == sum(len(x) for lists in want.values() for x in lists)
    top = [r for r in got if r["query_id"] == 350 and r["rank"] <= 3]
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in top) == [(False, 0), (False, 0), (True, None)]
    assert all(r["score"] == pytest.approx(1.0) for r in top)


def test_few_rows_and_none(spark):
    assert nearest(frame(spark, [])).count() == 0
    assert nearest(frame(spark, [(50, [1.0, 0.0])])).count() == 0
    got = nearest(frame(spark, [(50, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])])).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]


def test_chances_are_those_of_drawn_neighbours():
    index = Index(24, tables=1)
    rng = np.random.default_rng(2)
    query = rng.normal(size=24)
    query /= np.linalg.norm(query)
    chance = index.chances(index.projected(query[None])[0], 0.6)
    assert chance.sum() == pytest.approx(1, abs=1e-5)
    wide = Index(2000, tables=1)
    query = rng.normal(size=2000)
    query /= np.linalg.norm(query)
    other = rng.normal(size=(3000, 2000))
    other -= (other @ query)[:, None] * query
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.6 * query + 0.8 * other
    visit = wide.visits(wide.projected(query[None])[0], 0.6)
    hit = visit[0, wide.bucket_of(near)[:, 0]].mean()
    assert hit == pytest.approx(wide.target, abs=0.02)


def test_best_of_takes_the_leftmost_of_equal_scores():
    scores = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [-np.inf, 0.0, 0.0, -np.inf, -np.inf]])
    assert best_of(scores, 2).tolist() == [
        [False, True, True, False, False], [False, True, True, False, False]]


def test_vectors_of_every_length_are_searched_among_themselves(spark):
    rows = clusters(400, 12, 3) + [(1_000 + i, v) for i, v in clusters(120, 5, 4)]
    rows += [(100_000, [1.0, 2.0, 3.0]), (7, [1.0, 0.0])]
    assert check(spark, rows) >= 0.9
