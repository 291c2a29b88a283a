"""Quality by co-training: one classifier reads the words, one the metadata.

The text view is the set of a document's hashed terms. The metadata view is what can be said
without reading: language, source, size, and layout figures (shares of letters, capitals,
digits, signs; lengths of words and lines; repeated words and lines), cut at sample quantiles.
In every round each classifier labels the unlabelled documents that it is surest of, and the
other one learns from them. How sure a classifier is, and when its training ends, is measured
on labelled rows of a fold of their own; there both are calibrated in the end, and the weights
fitted that join their log odds. Samples are bounded by parameters;
the model has a fixed size, so all documents are scored where they lie, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.features import (
    BITS, FOLDS, Machine, Sparse, class_counts, from_lists, labelled_rows, scaled, sigmoid,
    telling_terms, terms, trained, with_features,
)
from tidemark.llm.rows import layout, remainder, ship, slices, texts, written
from tidemark.llm.words import PUNCTUATION, SPACE, hashes, spans

BINS = 10
FIGURES = 14
_NAMES = 64
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@dataclass(frozen=True)
class Training:
    """At most ``labelled`` and ``unlabelled`` rows are learned from.

    ``sure`` is the least confidence of a pseudo-label and ``growth`` the most that a round
    adds, as a share of the labelled rows.
    """

    labelled: int = 12_000
    unlabelled: int = 6_000
    features: int = 2048
    least_docs: int = 5
    rounds: int = 3
    growth: float = 0.1
    sure: float = 0.95
    least_z: float = 3.0
    steps: int = 1500
    seed: int = 13


def _per_text(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(owner: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per owner, and the count of its commonest."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(owner)))
    most = np.zeros(rows)
    np.maximum.at(most, owner[first], times)
    return np.bincount(owner[first], minlength=rows).astype(np.float64), most


def figures(column: pa.LargeBinaryArray) -> np.ndarray:
    """Size and layout figures, one row per text; shares of an empty text are 0."""
    values, offsets = layout(column)
    rows = len(column)
    size = np.diff(offsets).astype(np.float64)
    letter = ~PUNCTUATION[values] & ~((values >= 48) & (values < 58))
    upper = (values >= 65) & (values < 91)
    digit = (values >= 48) & (values < 58)
    space = SPACE[values]
    sign = PUNCTUATION[values] & ~space
    text, begin, end = spans(values, offsets, SPACE)
    words_ = np.bincount(text, minlength=rows).astype(np.float64)
    kinds, most = _distinct(text, hashes(values, begin, end), rows)
    newline = np.zeros(256, bool)
    newline[10] = True
    line, first, last = spans(values, offsets, newline)
    lines = np.bincount(line, minlength=rows).astype(np.float64)
    line_kinds, line_most = _distinct(line, hashes(values, first, last), rows)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(rows), where=whole > 0)

    letters = _per_text(letter, offsets)
    return np.column_stack([
        np.log1p(size), share(letters, size), share(_per_text(upper, offsets), letters),
        share(_per_text(digit, offsets), size), share(_per_text(sign, offsets), size),
        share(_per_text(space, offsets), size), share(size, words_), share(kinds, words_),
        share(most, words_), np.log1p(lines), share(words_, lines), share(line_kinds, lines),
        share(line_most, lines),
    ])


def _names(batch: pa.RecordBatch) -> np.ndarray:
    """Language and source of every row as hashed numbers, null as one of its own."""
    out = []
    for shift, name in enumerate(("lang", "source")):
        coded = batch.column(name).dictionary_encode()
        numbers = np.array(
            [zlib.crc32(v.encode()) % (_NAMES - 1) + 1 for v in coded.dictionary.to_pylist()],
            np.int64,
        )
        index = coded.indices.fill_null(-1).to_numpy()
        place = np.append(numbers, 0)[index]
        out.append(shift * _NAMES + place)
    return np.column_stack(out)


def _measured(batch: pa.RecordBatch) -> np.ndarray:
    stated = batch.column("n_chars").fill_null(-1).to_numpy().astype(np.float64)
    return np.column_stack([figures(texts(batch.column("text"))), np.log1p(np.maximum(stated, -0.5))])


@dataclass
class Model:
    """Both views' features and classifiers, and the weights that join them."""

    place: np.ndarray
    words: Machine
    cuts: np.ndarray
    meta: Machine
    joint: np.ndarray

    def meta_features(self, measured: np.ndarray, names: np.ndarray) -> Sparse:
        return meta_features(self.cuts, measured, names)

    def scores(self, rows: int, owner, bucket, measured, names) -> tuple[np.ndarray, ...]:
        feature = self.place[bucket].astype(np.int64)
        used = feature >= 0
        by_words = self.words.logits(Sparse(rows, owner[used], feature[used]))
        by_meta = self.meta.logits(self.meta_features(measured, names))
        both = np.column_stack([by_words, by_meta, np.ones(rows)]) @ self.joint
        return sigmoid(both), sigmoid(by_words), sigmoid(by_meta)


def meta_features(cuts: np.ndarray, measured: np.ndarray, names: np.ndarray) -> Sparse:
    rows, kinds = measured.shape
    bins = (measured[:, :, None] > cuts[None]).sum(-1) + np.arange(kinds) * BINS
    feature = np.concatenate([bins, names + kinds * BINS], axis=1)
    return Sparse(rows, np.repeat(np.arange(rows), feature.shape[1]), feature.reshape(-1))


def _sample(rows: DataFrame) -> DataFrame:
    """label, fold, terms, measured and names of bounded rows, one per doc_id, written."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, bucket = terms(texts(batch.column("text")))
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))
            cuts = pa.array(np.insert(ends, 0, 0).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("doc_id", "label", "fold")},
                "terms": pa.ListArray.from_arrays(cuts, pa.array(bucket.astype(np.int32))),
                "measured": pa.array(list(_measured(batch))),
                "names": pa.array(list(_names(batch))),
            })

    found = rows.select(*COLUMNS, "label", "fold").mapInArrow(
        collect,
        "doc_id long, label int, fold int, terms array<int>, measured array<double>, "
        "names array<long>",
    )
    row = F.struct("label", "fold", F.array_sort("terms").alias("terms"), "measured", "names")
    once = found.groupBy("doc_id").agg(F.min(row).alias("row"))
    return written(once.select("doc_id", "row.*"), "sampled-terms")


def _stacked(table: pa.Table, name: str) -> np.ndarray:
    column = table[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _learned(labelled_rows_: DataFrame, pool_rows: DataFrame, s: Training) -> Model:
    spare, classes = class_counts(labelled_rows_)
    if not min(classes):
        size = FIGURES * BINS + 2 * _NAMES
        return Model(
            np.full(1 << BITS, -1, np.int16), Machine(0.0, np.zeros(1), np.zeros((1, 0))),
            np.zeros((FIGURES, BINS - 1)), Machine(0.0, np.zeros(size), np.zeros((size, 0))),
            np.array([0.0, 0.0, np.log((classes[1] + 1) / (classes[0] + 1))]),
        )
    place = telling_terms(labelled_rows_, s.features, s.least_docs, s.least_z)
    labelled, pool = (
        with_features(rows, place).orderBy("doc_id").toArrow()
        for rows in (labelled_rows_, pool_rows)
    )
    y = labelled["label"].to_numpy().astype(np.int64)
    check = (labelled["fold"].to_numpy() == 1) & spare
    learn, held = np.flatnonzero(~check), np.flatnonzero(check)
    measured = _stacked(labelled, "measured")
    cuts = np.quantile(measured[learn], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    size = measured.shape[1] * BINS + 2 * _NAMES
    views = [from_lists(labelled["features"]), meta_features(cuts, measured, _stacked(labelled, "names"))]
    pools = [from_lists(pool["features"])]
    if pool.num_rows:
        pools.append(meta_features(cuts, _stacked(pool, "measured"), _stacked(pool, "names")))
    else:
        pools.append(Sparse(0, np.zeros(0, np.int64), np.zeros(0, np.int64)))
    sizes = [max(1, int(place.max()) + 1), size]

    def fit(view: int, extra: dict[int, int]) -> Machine:
        which = np.array(sorted(extra), np.int64)
        data = views[view].take(learn)
        label = y[learn]
        if len(which):
            data = data.plus(pools[view].take(which))
            label = np.append(label, [extra[i] for i in which.tolist()])
        stop = (views[view].take(held), y[held]) if len(held) else None
        return trained(data, label, sizes[view], 0, s.seed + view, stop, s.steps)

    on = held if len(held) else learn

    def calibrated(view: int) -> np.ndarray:
        """Slope and shift that make the view's log odds right on rows it has not learned."""
        return scaled(machines[view].logits(views[view].take(on))[:, None], y[on])

    given: list[dict[int, int]] = [{}, {}]
    machines = [fit(0, given[0]), fit(1, given[1])]
    share = y[learn].mean()
    for _ in range(s.rounds if pool.num_rows else 0):
        for view in (0, 1):
            slope, shift = calibrated(view)
            p = sigmoid(slope * machines[view].logits(pools[view]) + shift)
            other = given[1 - view]
            for label, sure, part in ((1, p, share), (0, 1 - p, 1 - share)):
                most = int(s.growth * len(learn) * part) + 1
                best = [i for i in np.argsort(-sure, kind="stable").tolist() if i not in other]
                other.update({i: label for i in best[:most] if sure[i] >= s.sure})
        machines = [fit(0, given[0]), fit(1, given[1])]
    for view in (0, 1):
        slope, shift = calibrated(view)
        m = machines[view]
        machines[view] = Machine(slope * m.bias + shift, slope * m.weight, m.factor)
    logits = np.column_stack([m.logits(v.take(on)) for m, v in zip(machines, views, strict=True)])
    return Model(place, machines[0], cuts, machines[1], scaled(logits, y[on]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Training | None = None,
    carried: list[str] | None = None,
) -> DataFrame:
    """Score (0 to 1, high is good), both views' own scores, and predicted for every row.

    Columns: doc_id, held_out, score, text_score, meta_score, predicted (1 if score >= 0.5),
    or those of ``carried`` in place of doc_id. Labels are learned from rows whose
    crc32(doc_id as text) modulo 5 is not 0; of these, remainder 1 serves to end training and to calibrate.
    Nulls in text count as empty, in lang or source as a value of their own, in n_chars as
    unknown. Without labels every score is 0.5; with labels of one class, a constant. Rows
    that repeat score alike; an empty table gives an empty result. Of ``docs`` only doc_id,
    text, lang, source, n_chars and ``carried`` are read.
    """
    s = settings or Training()
    spark = docs.sparkSession
    ship(spark)
    fold = remainder(F.col("doc_id"), FOLDS)
    typed = {"doc_id": "long", "text": "string", "lang": "string", "source": "string",
             "n_chars": "long"}
    named = docs.select(*[F.col(c).cast(t).alias(c) for c, t in typed.items()])
    labelled = _sample(labelled_rows(named, labels, label, s.labelled, s.seed, COLUMNS))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = (
        named.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
        .join(known, "doc_id", "left_anti")
        .orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.unlabelled)
    )
    # ``unlabelled`` ids of 8 bytes.
    pool = _sample(
        named.join(F.broadcast(ids), "doc_id")
        .withColumns({"label": F.lit(0), "fold": fold.cast("int")})
    )
    model = spark.sparkContext.broadcast(_learned(labelled, pool, s))
    out = carried or ["doc_id"]
    read = list(dict.fromkeys([*COLUMNS, *out]))
    all_rows = docs.select(
        *[F.col(c).cast(typed[c]).alias(c) if c in typed else F.col(c) for c in read],
        (fold == 0).alias("__held"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in all_rows.schema}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, bucket = terms(texts(batch.column("text")))
            both, by_words, by_meta = model.value.scores(
                batch.num_rows, owner, bucket, _measured(batch), _names(batch)
            )
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in out},
                "held_out": batch.column("__held"),
                "score": pa.array(both),
                "text_score": pa.array(by_words),
                "meta_score": pa.array(by_meta),
                "predicted": pa.array((both >= 0.5).astype(np.int32)),
            })

    carried_schema = ", ".join(f"`{c}` {kinds[c]}" for c in out)
    return all_rows.mapInArrow(
        score,
        f"{carried_schema}, held_out boolean, score double, text_score double, "
        "meta_score double, predicted int",
    )


def good_documents(docs: DataFrame, labels: DataFrame, columns: list[str], **settings) -> DataFrame:
    """The rows of ``docs`` that are not rejected (score >= 0.5), with ``columns``."""
    return (
        quality_scores(docs, labels, carried=columns, **settings)
        .filter("score >= 0.5")
        .select(*columns)
    )
