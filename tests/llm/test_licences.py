import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import licences
from tidemark.llm.licences import (
    ANCHORS, NOTICES, PHRASES, SLACK, Index, Template, Vocabulary, document_frequencies,
    licence_labels, licence_matches, words_of,
)
from tests.llm.conftest import odd, ODD_SCHEMA

NAMES = (
    "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
)


def places(words, phrase):
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def brute(rows, templates=PHRASES + NOTICES):
    texts = [words_of(r["text"] or "") for r in rows]
    vocabulary = sorted({w for t in templates for s in (t.text, *t.must) for w in words_of(s)})
    sets = [set(t) for t in texts]
    idf = {
        w: math.log((len(rows) + 1) / (sum(w in s for s in sets) + 1)) + 1.0 for w in vocabulary
    }
    out = []
    for row, words in zip(rows, texts):
        base, labels, score = [], set(), 0.0
        for t in templates:
            own = words_of(t.text)
            if not t.must:
                found = places(words, own)
                if found:
                    labels.add(t.label)
                    score = 1.0
                if t in PHRASES:
                    base += [(p, t.label) for p in found]
                continue
            rare = sorted(set(own), key=lambda w: (-idf[w], w))[:ANCHORS]
            spots = [p for p, w in enumerate(own) if w in rare]
            need = max(2, math.ceil(licences.AGREE * len(spots)))
            begins = {i - p for i, w in enumerate(words) for p in spots if own[p] == w}
            for begin in begins:
                stands = [0 <= begin + p < len(words) and words[begin + p] == w
                          for p, w in enumerate(own)]
                if sum(stands[p] for p in spots) < need:
                    continue
                if not all(
                    any(begin - SLACK <= p <= begin + len(own) - len(words_of(m)) + SLACK
                        for p in places(words, words_of(m)))
                    for m in t.must
                ):
                    continue
                labels.add(t.label)
                weight = [idf[w] for w in own]
                share = sum(w for w, s in zip(weight, stands) if s) / sum(weight)
                score = max(score, 1.0 if all(stands) else share)
        spots = [p for p, _ in base]
        out.append((
            row["doc_id"], len(words), len(base), min(spots, default=None), max(spots, default=None),
            ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), round(score, 9),
        ))
    return sorted(out, key=repr)


def got(df):
    rows = [tuple(round(r[n], 9) if n == "score" else r[n] for n in NAMES) for r in df.collect()]
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "is", "in", "a", "software", "word", "Größe", "by", "cc",
              "all", "rights", "public", "general", "license", "licensed", "under", "x" * 1_500]
    rows = []
    for i in range(250):
        words = [rng.choice(common) for _ in range(rng.randrange(0, 60))]
        for t in rng.sample(PHRASES + NOTICES, rng.choice([0, 0, 1, 1, 2, 4])):
            notice = words_of(t.text)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(notice))
                notice[at : at + rng.choice([0, 1, 2])] = rng.choice([[], ["new"], ["new", "words"]])
                notice = notice or ["none"]
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        text = rng.choice([" ", ", ", "\n", "-", "\x7f"]).join(words)
        rows.append(odd(rng.choice([i, i, 3, None]), rng.choice([text, text.upper(), text.title()])))
    rows += [odd(900, None), odd(901, ""), odd(902, " .,"), odd(903, "All rights reserved " * 30_000)]
    return spark.createDataFrame(rows, ODD_SCHEMA).repartition(6)


def test_labels_equal_those_of_brute_force(files):
    rows = files.collect()
    found = got(licence_labels(files))
    assert found == brute(rows)
    assert {"cc-by", "apache", "gpl"} <= {x for r in found for x in r[6].split(",")}


def test_words_are_those_of_the_pattern():
    text = "Ab1 cD-é_ß`{x}\x7fy z 🙂.\tÄÉ[Q]"
    assert words_of(text) == re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_an_empty_table(no_docs):
    assert licence_labels(no_docs).count() == 0


def test_matches_name_templates_places_and_shares(spark):
    text = "Intro. Licensed under the Apache License, Version 2.0! Released under MIT. CC-BY"
    df = spark.createDataFrame([odd(1, text), odd(2, "nothing here")], ODD_SCHEMA)
    rows = {r["doc_id"]: r["matches"] for r in licence_matches(df).collect()}
    assert [(m["label"], m["first_word"], m["exact"], m["share"]) for m in rows[1]] == [
        ("apache", 1, False, 1.0), ("cc-by", 12, True, 1.0)]
    assert rows[2] == []


def test_words_that_only_share_a_hash_are_no_match(monkeypatch):
    monkeypatch.setattr(licences, "hashes", lambda v, b, e, lower=False: np.zeros(len(b), np.uint64))
    known = Vocabulary([Template("x", "alpha")])
    column = pa.array([b"alpha omega ALPHA alphas"], pa.large_binary())
    assert known.find(column)[1].tolist() == [0, -1, 0, -1]


def test_document_frequencies_count_documents(files):
    rows, frequency = document_frequencies(files, PHRASES)
    known = Vocabulary(PHRASES)
    sets = [set(words_of(r["text"] or "")) for r in files.select("text").collect()]
    assert rows == len(sets)
    assert frequency.tolist() == [sum(w in s for s in sets) for w in known.words]


def test_rare_words_are_the_anchors():
    known = Vocabulary(PHRASES + NOTICES)
    frequency = np.full(len(known.words), 10)
    frequency[known.number["the"]] = 9_000
    index = Index(PHRASES + NOTICES, 10_000, frequency)
    the = known.number["the"]
    anchored = index.first[the + 1] - index.first[the]
    assert anchored < sum("the" in words_of(t.text) for t in NOTICES)
