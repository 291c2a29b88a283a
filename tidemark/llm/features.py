"""Sparse binary features of texts, bounded labelled samples, and a small trainer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import layout, remainder
from tidemark.llm.words import PUNCTUATION, hashes, mix, spans

FOLDS = 5


#: Hashed terms have so many bits; a term's stems are its first bytes, if it is longer.
BITS = 22
STEMS = (4, 6, 8)
#: A term that occurs so often in a text adds one more term each.
LEVELS = (2, 4, 8)


def terms(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed term, each pair once.

    Terms are runs of letters and digits, lower-cased, and the stems of longer ones, so that
    a stem counts whatever its ending; and the same again for each of ``LEVELS`` that their
    count in the text reaches.
    """
    values, offsets = layout(column)
    text, begin, end = spans(values, offsets, PUNCTUATION)
    owners, found = [text], [hashes(values, begin, end, lower=True)]
    for size in STEMS:
        longer = end - begin > size
        stem = hashes(values, begin[longer], begin[longer] + size, lower=True)
        owners.append(text[longer])
        found.append(mix(stem + np.uint64(size)))
    drop = np.uint64(64 - BITS)
    bucket = (np.concatenate(found) >> drop).astype(np.int64)
    pair, count = np.unique((np.concatenate(owners) << BITS) | bucket, return_counts=True)
    owner, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
    owners, found = [owner], [bucket]
    for level in LEVELS:
        often = count >= level
        again = mix(bucket[often].astype(np.uint64) + (np.uint64(level) << np.uint64(BITS)))
        owners.append(owner[often])
        found.append((again >> drop).astype(np.int64))
    pair = np.unique((np.concatenate(owners) << BITS) | np.concatenate(found))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, seed: int, columns: list[str]
) -> DataFrame:
    """``columns``, label (0 or 1) and fold of at most ``limit`` labelled documents.

    Only rows whose crc32(doc_id as text) modulo FOLDS is not 0 are taken; which ones, if
    there are more, a seeded hash of the id decides. A label is 1 if any row of its id says
    so; null labels and null ids are left out.
    """
    fold = remainder(F.col("doc_id"), FOLDS)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold != 0))
        .groupBy("doc_id")
        .agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(limit)
    )
    # ``limit`` rows of 12 bytes.
    return docs.select(*columns).join(F.broadcast(chosen), "doc_id").withColumn("fold", fold.cast("int"))


@dataclass
class Sparse:
    """Rows of feature numbers: row of every entry (in order) and its feature."""

    rows: int
    owner: np.ndarray
    feature: np.ndarray

    def take(self, which: np.ndarray) -> Sparse:
        place = np.full(self.rows, -1)
        place[which] = np.arange(len(which))
        kept = place[self.owner] >= 0
        owner, feature = place[self.owner[kept]], self.feature[kept]
        order = np.argsort(owner, kind="stable")
        return Sparse(len(which), owner[order], feature[order])

    def plus(self, other: Sparse) -> Sparse:
        return Sparse(
            self.rows + other.rows,
            np.concatenate([self.owner, other.owner + self.rows]),
            np.concatenate([self.feature, other.feature]),
        )


def from_lists(column: pa.ChunkedArray) -> Sparse:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return Sparse(len(lists), np.repeat(np.arange(len(lists)), sizes), values)


def class_counts(sample: DataFrame) -> tuple[bool, list[int]]:
    """Whether the sample can spare its rows of fold 1, and the classes of what is learned."""
    rows = sample.groupBy((F.col("fold") == 1).alias("held"), "label").count().collect()
    counts = {True: [0, 0], False: [0, 0]}
    for row in rows:
        counts[row["held"]][row["label"]] += row["count"]
    if sum(counts[True]) and min(counts[False]):
        return True, counts[False]
    return False, [a + b for a, b in zip(counts[True], counts[False], strict=True)]


def telling_terms(
    sample: DataFrame, most: int, least_docs: int, least_z: float
) -> np.ndarray:
    """Feature number of every bucket, -1 for those not used.

    Of the buckets of ``terms`` that ``least_docs`` learned rows have, those whose log odds
    between the classes lie ``least_z`` standard errors from zero, ``most`` at most.
    """
    spare, (zeros, ones) = class_counts(sample)
    learned = sample.filter("fold <> 1") if spare else sample
    counts = learned.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("label").alias("ones"), F.count("*").alias("docs")
    ).filter(F.col("docs") >= least_docs)
    a, b = F.col("ones") + 0.5, F.col("docs") - F.col("ones") + 0.5
    odds = F.log(a / (F.lit(ones + 1.5) - a)) - F.log(b / (F.lit(zeros + 1.5) - b))
    z = F.round(F.abs(odds) / F.sqrt(1 / a + 1 / b), 9)
    best = (
        counts.select("term", z.alias("z")).filter(F.col("z") >= least_z)
        .orderBy(F.desc("z"), "term").limit(most).toArrow()
    )
    place = np.full(1 << BITS, -1, np.int16)
    used = np.sort(best["term"].to_numpy())
    place[used] = np.arange(len(used))
    return place


def paired_terms(
    sample: DataFrame, place: np.ndarray, candidates: int, most: int, least_docs: int,
    least_z: float,
) -> np.ndarray:
    """``place`` with the buckets that tell classes apart only together with another.

    Candidates are the ``candidates`` most frequent buckets not used yet. For every pair of
    them the learned rows make a table of neither, one, other and both; the pair counts if its
    interaction (the log odds of both and neither less those of one and other) lies ``least_z``
    standard errors from zero. At most ``most`` buckets are added, of the strongest pairs. The
    sample is bounded, and so is what is counted: a matrix of candidates by candidates.
    """
    spare, (zeros, ones) = class_counts(sample)
    learned = sample.filter("fold <> 1") if spare else sample
    exploded = learned.select("label", F.explode("terms").alias("term"))
    frequent = (
        exploded.groupBy("term").agg(F.count("*").alias("docs"))
        .filter(F.col("docs") >= least_docs)
        .orderBy(F.desc("docs"), "term").limit(candidates + int((place >= 0).sum())).toArrow()
    )
    term = frequent["term"].to_numpy()
    term = np.sort(term[place[term] < 0][:candidates])
    if len(term) < 2:
        return place
    number = np.full(1 << BITS, -1, np.int16)
    number[term] = np.arange(len(term))
    rows = with_features(learned, number).select("label", "features").toArrow()
    label = rows["label"].to_numpy().astype(np.int64)
    data = from_lists(rows["features"])
    both = np.zeros((2, len(term), len(term)), np.float32)
    for begin in range(0, data.rows, 2_048):
        stretch = data.take(np.arange(begin, min(begin + 2_048, data.rows)))
        held = np.zeros((stretch.rows, len(term)), np.float32)
        held[stretch.owner, stretch.feature] = 1
        for c in (0, 1):
            part = held[label[begin : begin + 2_048] == c]
            both[c] += part.T @ part
    odds, error = 0.0, 0.0
    for sign, cell in ((1, "both"), (1, "neither"), (-1, "one"), (-1, "other")):
        counts = []
        for c, total in ((0, zeros), (1, ones)):
            n = np.diag(both[c])
            one, other = n[:, None] - both[c], n[None, :] - both[c]
            counts.append({
                "both": both[c], "one": one, "other": other,
                "neither": total - both[c] - one - other,
            }[cell] + 0.5)
        odds = odds + sign * (np.log(counts[1]) - np.log(counts[0]))
        error = error + 1 / counts[0] + 1 / counts[1]
    z = np.triu(np.round(np.abs(odds) / np.sqrt(error), 6), 1)
    left, right = np.nonzero(z >= least_z)
    order = np.lexsort((right, left, -z[left, right]))
    chosen: dict[int, None] = {}
    for i in order:
        chosen |= dict.fromkeys((int(left[i]), int(right[i])))
        if len(chosen) >= most:
            break
    used = np.sort(np.concatenate([np.flatnonzero(place >= 0), term[list(chosen)]]).astype(int))
    out = np.full(1 << BITS, -1, np.int16)
    out[used] = np.arange(len(used))
    return out


def with_features(sample: DataFrame, place: np.ndarray) -> DataFrame:
    """``terms`` replaced by the feature numbers of those in use, as ``features``."""
    others = [f for f in sample.schema.fields if f.name != "terms"]
    kept = sample.sparkSession.sparkContext.broadcast(place)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = from_lists(batch.column("terms"))
            feature = kept.value[data.feature]
            used = feature >= 0
            ends = np.cumsum(np.bincount(data.owner[used], minlength=data.rows))
            cuts = pa.array(np.insert(ends, 0, 0).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                **{f.name: batch.column(f.name) for f in others},
                "features": pa.ListArray.from_arrays(
                    cuts, pa.array(feature[used].astype(np.int32))
                ),
            })

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return sample.mapInArrow(number, f"{schema}, features array<int>")


@dataclass
class Machine:
    """A factorization machine over binary features; without factors, logistic regression."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, data: Sparse) -> np.ndarray:
        out = self.bias + np.bincount(data.owner, self.weight[data.feature], data.rows)
        for f in range(self.factor.shape[1]):
            v = self.factor[data.feature, f]
            sums = np.bincount(data.owner, v, data.rows)
            out += (sums**2 - np.bincount(data.owner, v * v, data.rows)) / 2
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def log_loss(logit: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(label == 1, -logit, logit))))


def trained(
    data: Sparse, label: np.ndarray, size: int, factors: int, seed: int,
    check: tuple[Sparse, np.ndarray] | None = None, steps: int = 3000, rate: float = 0.1,
    decay: float = 1e-3, batch: int = 256, every: int = 100,
) -> Machine:
    """AdaGrad on log loss over small batches; with ``check``, the step that does best on it."""
    rng = np.random.default_rng(seed)
    share = (label.sum() + 1.0) / (len(label) + 2.0)
    machine = Machine(
        float(np.log(share / (1 - share))),
        np.zeros(size),
        rng.normal(0, 0.05, (size, factors)),
    )
    squares = [1e-6, np.full(size, 1e-6), np.full((size, factors), 1e-6)]
    begins = np.searchsorted(data.owner, np.arange(data.rows + 1))
    best, best_loss = None, np.inf
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(batch, data.rows):
            order = rng.permutation(data.rows)
        which, order = order[:batch], order[batch:]
        sizes = begins[which + 1] - begins[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = Sparse(len(which), owner, data.feature[begins[which][owner] + nth])
        error = (sigmoid(machine.logits(part)) - label[which]) / len(which)
        used = np.bincount(part.feature, minlength=size) > 0
        grad = np.bincount(part.feature, error[owner], size) + decay * machine.weight * used
        grads = np.empty_like(machine.factor)
        for f in range(factors):
            v = machine.factor[part.feature, f]
            sums = np.bincount(owner, v, part.rows)
            slope = error[owner] * (sums[owner] - v)
            grads[:, f] = np.bincount(part.feature, slope, size)
        grads += decay * machine.factor * used[:, None]
        gradient = (float(error.sum()), grad, grads)
        for i, g in enumerate(gradient):
            squares[i] = squares[i] + np.square(g)
        moves = [rate * g / np.sqrt(s) for g, s in zip(gradient, squares, strict=True)]
        machine.bias -= float(moves[0])
        machine.weight -= moves[1]
        machine.factor -= moves[2]
        if check is not None and step % every == 0:
            loss = log_loss(machine.logits(check[0]), check[1])
            if loss < best_loss:
                best_loss = loss
                best = Machine(machine.bias, machine.weight.copy(), machine.factor.copy())
    return best or machine


def scaled(logits: np.ndarray, label: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the columns of ``logits`` and a constant: calibrated log odds (Newton)."""
    x = np.column_stack([logits, np.ones(len(logits))])
    weight = np.append(np.full(logits.shape[1], 1.0 / logits.shape[1]), 0.0)
    start = weight.copy()
    for _ in range(rounds):
        p = sigmoid(x @ weight)
        slope = x.T @ (p - label) + (weight - start)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(weight))
        step = np.linalg.solve(bend, slope)
        weight = weight - step
        if np.abs(step).max() < 1e-9:
            break
    return weight
