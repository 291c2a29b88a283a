import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import odd, prose
from tidemark.llm import minhash
from tidemark.llm.components import components
from tidemark.llm.minhash import document_strips, near_groups, signatures, strips, without_near_copies
from tidemark.llm.rows import texts

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key_a long, "
          "row_id string, size int, part string, score double, label int")


def bag(text, n=5):
    words = (text or "").encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows, threshold=0.8):
    """Class of every row by comparing all pairs."""
    bags = [bag(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            blank = not bags[i] and not bags[j]
            if blank or (bags[i] and bags[j] and similarity(bags[i], bags[j]) >= threshold):
                root[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i]["doc_id"])
    return sorted(sorted(map(repr, c)) for c in classes.values())


def found(rows):
    """Classes told apart by id and by who stays in them."""
    classes, kept = {}, Counter()
    for r in rows:
        classes.setdefault((r["class_id"], r["class_size"]), []).append(repr(r["doc_id"]))
        kept[(r["class_id"], r["class_size"])] += r["kept"]
    return sorted(sorted(c) for c in classes.values()), kept


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"e{rng.random()}" for w in text.split())


def test_darts_agree_as_often_as_the_weighted_index():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 9, 60).astype(float) / 2
    b = a.copy()
    b[:25] = rng.integers(1, 9, 25) / 2
    b[50:] = 0
    element = np.arange(60, dtype=np.uint64) * np.uint64(7919) + np.uint64(11)
    k = 4000
    owner, strip, width = strips(
        np.r_[np.zeros(60, int), np.ones(50, int)], np.r_[element, element[:50]], np.r_[a, b[:50]]
    )
    darts = signatures(owner, strip, width, 2, k)
    index = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (darts != 0).all()
    assert (darts[0] == darts[1]).mean() == pytest.approx(index, abs=0.03)


def test_a_signature_does_not_depend_on_its_neighbours():
    one, other = prose(1, 80), prose(2, 4)
    def sign(values):
        owner, strip, width, _ = document_strips(texts(pa.array(values, pa.string())), 5)
        return signatures(owner, strip, width, len(values), 80)
    both = sign([one, "", other])
    assert (both[0] == sign([one])[0]).all() and (both[2] == sign([other])[0]).all()
    assert not both[1].any()


@pytest.fixture(scope="module")
def families(spark):
    """Groups of copies edited to all degrees, round the threshold too, some of them large."""
    rows, n = [], 0
    for family, (size, length) in enumerate([(40, 120), (25, 60), (90, 200), (3, 30), (2, 500)]):
        base = prose(100 + family, length, 5000)
        for i in range(size):
            n += 1
            rows.append(odd(n, base if i == 0 else edited(base, (i % 10) / 120, n)))
    rows += [odd(1000 + i, prose(1000 + i, 100, 5000)) for i in range(60)]
    passage = prose(77, 60, 5000)
    rows += [odd(2000 + i, f"{passage} {prose(2000 + i, 40, 5000)}") for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("block", [512, 4])
def test_classes_equal_those_of_all_pairs(families, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_groups(families).collect()
    classes, kept = found(rows)
    assert classes == brute(families.collect())
    assert set(kept.values()) == {1}
    assert all(r["class_id"] == r["doc_id"] for r in rows if r["kept"])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(near_groups(docs).collect())[0] == brute(docs.collect())


def test_odd_rows(odd_docs, no_docs):
    rows = near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = [r for r in rows if r["doc_id"] in (4, 5, 6)]
    assert {r["class_id"] for r in blank} == {4} and blank[0]["class_size"] == 5
    base = [r for r in rows if r["doc_id"] in (1, 2, 3, 12)]
    assert {r["class_id"] for r in base} == {1} and {r["class_size"] for r in base} == {6 + 1 - 1}
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = without_near_copies(odd_docs, names)
    assert kept.columns == names
    assert kept.count() == sum(r["kept"] for r in rows)
    assert near_groups(no_docs).count() == 0
    assert without_near_copies(no_docs, names).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    edges += [(201, 200), (200, 202), (202, 201), (201, 200)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == (
        {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)}
        | {200: 200, 201: 200, 202: 200}
    )
    assert len(got) == 40 + 50 + 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
