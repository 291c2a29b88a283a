import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import odd, prose
from tidemark.llm.cotraining import good_documents, quality_scores
from tidemark.llm.features import (
    BITS, Machine, Sparse, scaled, sigmoid, telling_terms, trained, with_features,
)
from tidemark.llm.toxicity import least_errors, toxicity_scores

FOLDER = "/root/testdata/sf0.1"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key_a long, "
          "row_id string, size int, part string, score double, label int")
LABELS = "doc_id long, quality int, toxic int, text string, fold int"


def sparse(rows):
    owner = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    return Sparse(len(rows), owner.astype(np.int64), np.concatenate(rows).astype(np.int64))


def test_a_machine_scores_pairs_as_its_formula():
    rng = np.random.default_rng(1)
    machine = Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [np.array([0, 3, 8]), np.array([], int), np.array([5])]
    got = machine.logits(sparse(rows))
    for r, score in zip(rows, got, strict=True):
        want = 0.3 + machine.weight[r].sum() + sum(
            machine.factor[i] @ machine.factor[j] for i in r for j in r if i < j
        )
        assert score == pytest.approx(want)


def test_factors_learn_a_pair_that_weights_cannot():
    """Bad only if insult (0) and group (1) meet, or if both are missing: not additive."""
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (2000, 2))
    noise = rng.integers(2, 12, (2000, 3))
    rows = [np.unique(np.r_[np.flatnonzero(b), n]) for b, n in zip(bits, noise, strict=True)]
    label = (bits[:, 0] == bits[:, 1]).astype(np.int64)
    data = sparse(rows)
    accuracy = {}
    for factors in (0, 4):
        machine = trained(data, label, 12, factors, 3, steps=600, decay=0.0)
        accuracy[factors] = ((machine.logits(data) > 0) == label).mean()
    assert accuracy[4] > 0.95 > 0.7 > accuracy[0]


def test_telling_terms_are_found(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 500).tolist()
    rows = [
        (i, y, 1 + i % 4, np.unique(np.r_[rng.integers(0, 90, 5), [95] if y else [96]]).tolist())
        for i, y in enumerate(label)
    ]
    sample = spark.createDataFrame(rows, "doc_id long, label int, fold int, terms array<int>")
    place = telling_terms(sample, 100, 5, 4.0)
    assert len(place) == 1 << BITS and np.flatnonzero(place >= 0).tolist() == [95, 96]
    got = {r["doc_id"]: r["features"] for r in with_features(sample, place).collect()}
    assert got == {i: [0] if y else [1] for i, y, _, _ in rows}


def test_calibration_recovers_the_slope():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 20_000)
    label = (rng.random(20_000) < sigmoid(2 * z - 1)).astype(int)
    assert scaled(z[:, None], label) == pytest.approx([2, -1], abs=0.1)


def test_the_threshold_with_the_fewest_errors():
    assert 2 < least_errors(np.array([0.0, 1, 2, 5, 6, 7]), np.array([0, 0, 0, 1, 1, 1])) < 5
    assert least_errors(np.array([1.0, 1, 1]), np.array([0, 1, 1])) < 1


def measured(df, labels, name):
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    rows = [r for r in df.collect() if r["held_out"] and r["doc_id"] in truth]
    y = np.array([truth[r["doc_id"]] for r in rows])
    hit = np.array([r["predicted"] for r in rows]) == y
    for r in df.limit(200).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    return hit[y == 1].mean(), hit[y == 0].mean()


def test_held_out_accuracy_of_toxicity(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = toxicity_scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).cache()
    assert all(0 <= r["score"] <= 1 for r in scores.collect())
    caught, left_alone = measured(scores, labels, "toxic")
    # A few labelled documents hold no term that marks others.
    assert caught > 0.9 and left_alone > 0.99


def test_held_out_accuracy_of_quality(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality_scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).cache()
    kept, rejected = measured(scores, labels, "quality")
    assert kept > 0.99 and rejected > 0.93


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = "pmod(crc32(cast(doc_id AS string)), 5)"
    flipped = labels.selectExpr(
        "doc_id", f"IF({fold} = 0, 1 - toxic, toxic) AS toxic",
        f"IF({fold} = 0, 1 - quality, quality) AS quality",
    )
    for score in (toxicity_scores, quality_scores):
        one = {r["doc_id"]: r["score"] for r in score(docs, labels).collect()}
        two = {r["doc_id"]: r["score"] for r in score(docs, flipped).collect()}
        assert one == two


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        text = prose(i, 40) + (" you absolute muppet" if bad else "")
        rows.append(odd(i, text, "en", "s", len(text)))
        labels.append((i, 1 - bad, bad, "x", 3))
    labels += [(3, 0, 1, "x", 3), (None, 1, 1, "x", 3), (9999, 1, 0, "x", 3), (5, None, None, "x", 3)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_odd_rows(spark, odd_docs, no_docs, labelled):
    docs, labels = labelled
    both = docs.unionByName(odd_docs)
    rows = toxicity_scores(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = toxicity_scores(odd_docs, labels).filter("doc_id IN (4, 5, 6) OR doc_id IS NULL")
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert blank.count() == 6 and blank.filter("doc_id > 3").select("score").distinct().count() <= 1
    rows = quality_scores(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r["score"] <= 1 for r in rows)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert good_documents(both, labels, names).columns == names
    for score in (toxicity_scores, quality_scores):
        assert score(no_docs, labels).count() == 0
        unlabelled = score(odd_docs, labels.limit(0)).collect()
        assert {r["score"] for r in unlabelled} == {0.5}
        same = score(docs, labels.filter("quality = 1")).collect()
        assert len({r["score"] for r in same}) == 1
    assert good_documents(odd_docs, labels.limit(0), names).count() == odd_docs.count()


def test_scores_do_not_depend_on_the_partitioning(labelled):
    docs, labels = labelled
    for score in (toxicity_scores, quality_scores):
        one = {r["doc_id"]: r["score"] for r in score(docs.repartition(1), labels).collect()}
        two = {r["doc_id"]: r["score"] for r in score(docs.repartition(7), labels).collect()}
        assert one == two


def test_scores_learn_pairs_whose_words_tell_nothing_alone(spark):
    """Toxic if both or neither of two words occur: no word has odds of its own."""
    rng, rows, labels = random.Random(4), [], []
    for i in range(4_000):
        one, other = rng.random() < 0.5, rng.random() < 0.5
        filler = [f"w{rng.randrange(300)}" for _ in range(12)]
        extra = ["insulting"] * one + ["outgroup"] * other
        text = filler + extra
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(one == other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    found = toxicity_scores(docs, table).filter("held_out").collect()
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in found) / len(found)
    assert len(found) > 600 and right >= 0.95
