"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (words, their stems, and whether they occur often), hashed into
a fixed number of buckets. Of these the machine uses the ones that tell labelled texts apart
best, alone or in pairs; each has a weight and a short vector, and two terms that occur together
add the product of their vectors. So an insult may weigh more next to a mention of a group, which
additive weights cannot express, also where neither tells anything by itself. The model is fitted on a
bounded sample of labelled rows; rows of remainder 1 choose when training ends, scale its log
odds, and place the score of one half where it errs least. Its size is fixed by parameters, so all texts are scored where they lie, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.features import (
    BITS, FOLDS, Machine, Sparse, class_counts, from_lists, labelled_rows, paired_terms, scaled,
    sigmoid, telling_terms, terms, trained, with_features,
)
from tidemark.llm.rows import remainder, ship, slices, texts, written



@dataclass(frozen=True)
class Training:
    """At most ``sample`` labelled rows are learned from, ``features`` buckets used.

    A bucket is used if ``least_docs`` of them have it and its log odds lie ``least_z``
    standard errors from zero. Of the ``candidates`` most frequent other ones, ``paired`` at most
    are used as well: those of pairs whose interaction lies ``least_pair_z`` from zero.
    """

    sample: int = 20_000
    features: int = 2048
    least_docs: int = 5
    least_z: float = 3.0
    candidates: int = 1_500
    paired: int = 256
    least_pair_z: float = 6.0
    factors: int = 6
    steps: int = 3000
    seed: int = 11


def term_sets(docs: DataFrame, carried: str) -> DataFrame:
    """The columns of ``carried`` (as a schema) and the hashed terms of every text."""
    names = [part.split()[0] for part in carried.split(", ")]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, bucket = terms(texts(batch.column("text")))
            ends = np.cumsum(np.bincount(text, minlength=batch.num_rows))
            cuts = pa.array(np.insert(ends, 0, 0).astype(np.int32))
            found = pa.ListArray.from_arrays(cuts, pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(
                {**{c: batch.column(c) for c in names}, "terms": found}
            )

    return docs.select(*names, "text").mapInArrow(collect, f"{carried}, terms array<int>")


@dataclass
class Model:
    """Feature number of every bucket (-1: not used), the machine, and its calibration."""

    place: np.ndarray
    machine: Machine
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, rows: int, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        feature = self.place[bucket].astype(np.int64)
        used = feature >= 0
        logits = self.machine.logits(Sparse(rows, owner[used], feature[used]))
        return sigmoid(self.slope * logits + self.shift)


def least_errors(logits: np.ndarray, label: np.ndarray) -> float:
    """The threshold with the fewest errors; between equal ones, in the middle of the widest gap."""
    order = np.argsort(logits, kind="stable")
    value, y = logits[order], label[order]
    edges = np.concatenate([[value[0] - 1], value, [value[-1] + 1]])
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate(
        [np.cumsum((y == 0)[::-1])[::-1], [0]]
    )
    gaps = np.diff(edges)
    best = np.lexsort((-gaps, np.where(gaps > 0, errors, len(label) + 1)))[0]
    return float(edges[best] + edges[best + 1]) / 2


def fitted(docs: DataFrame, labels: DataFrame, label: str, settings: Training) -> Model:
    sample = labelled_rows(
        docs, labels, label, settings.sample, settings.seed, ["doc_id", "text"]
    )
    sets = term_sets(sample, "doc_id long, label int, fold int")
    once = written(
        sets.groupBy("doc_id").agg(
            F.min(F.struct("label", "fold", F.array_sort("terms").alias("terms"))).alias("row")
        ).select("doc_id", "row.*"),
        "labelled-terms",
    )
    spare, classes = class_counts(once)
    if not min(classes):
        bias = float(np.log((classes[1] + 1) / (classes[0] + 1)))
        return Model(
            np.full(1 << BITS, -1, np.int16), Machine(bias, np.zeros(1), np.zeros((1, 0)))
        )
    place = telling_terms(once, settings.features, settings.least_docs, settings.least_z)
    place = paired_terms(
        once, place, settings.candidates, settings.paired, settings.least_docs,
        settings.least_pair_z,
    )
    table = with_features(once, place).orderBy("doc_id").toArrow()
    y = table["label"].to_numpy().astype(np.int64)
    data, size = from_lists(table["features"]), max(1, int(place.max()) + 1)
    check = (table["fold"].to_numpy() == 1) & spare
    learn, held = np.flatnonzero(~check), np.flatnonzero(check)
    machine = trained(
        data.take(learn), y[learn], size, settings.factors, settings.seed,
        (data.take(held), y[held]) if spare else None, settings.steps,
    )
    if not spare:
        return Model(place, machine)
    logits = machine.logits(data.take(held))
    slope = max(float(scaled(logits[:, None], y[held])[0]), 1e-3)
    return Model(place, machine, slope, -slope * least_errors(logits, y[held]))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Training | None = None
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) for every row of ``docs``.

    Scores depend on the text alone. Labels are learned from rows whose crc32(doc_id as text)
    modulo 5 is not 0; the others are ``held_out``, rows with a null id among them. Null and
    empty texts have no terms and score the machine's constant. Without labels every score
    is 0.5; with labels of one class, the constant. Rows that repeat score alike. Columns
    other than doc_id and text are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(fitted(named, labels, label, settings or Training()))
    held = named.withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, bucket = terms(texts(batch.column("text")))
            scores = model.value.scores(batch.num_rows, owner, bucket)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": pa.array(scores),
                "predicted": pa.array((scores >= 0.5).astype(np.int32)),
            })

    return held.mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )
