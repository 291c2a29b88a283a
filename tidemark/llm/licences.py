"""Licence notices in texts, by a positional index of rare words.

The index holds templates: short phrases, which must stand word for word, and notices, which may
be edited but must keep their mandatory phrases. Of each template the words that are rarest in
the corpus (highest IDF) are its anchors, with their positions as postings. Every anchor that a
text holds is looked up; postings that agree on where the template would begin are intersected;
enough agreement makes a candidate, whose mandatory phrases are then verified word by word. All
occurrences are looked up, in whole texts; nothing is capped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import layout, ship, slices, texts
from tidemark.llm.words import LOWER, PUNCTUATION, hashes, spans

# Anchors of a template, and the share of them that has to agree in an edited notice.
ANCHORS = 6
AGREE = 0.5
# Words by which an edited notice's mandatory phrase may be off its place.
SLACK = 12


@dataclass(frozen=True)
class Template:
    """A licence by its words. Without ``must`` all of them have to stand, else these phrases."""

    label: str
    text: str
    must: tuple[str, ...] = ()


# Base phrases and their labels.
PHRASES = (
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
)

# Names and opening words of well-known public licences.
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("source and binary forms",),
    ),
    Template(
        "gpl-notice",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license",),
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        ("gnu general public license", "free software"),
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license as published by the free "
        "software foundation",
        ("lesser general public license",),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("with or without fee",),
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template(
        "cc-by-legal",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",),
    ),
    Template("cc0", "creative commons zero universal public domain dedication", ("public domain",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software",),
    ),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """Words as the operator takes them: runs of digits, letters and all beyond ASCII."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return _WORD.findall(lower)


class Vocabulary:
    """The templates' words, found in texts byte for byte."""

    def __init__(self, templates: Sequence[Template]) -> None:
        phrases = [t.text for t in templates] + [p for t in templates for p in t.must]
        self.words = sorted({w for text in phrases for w in words_of(text)})
        self.number = {w: i for i, w in enumerate(self.words)}
        raw = [w.encode() for w in self.words]
        self.size = np.array([len(w) for w in raw])
        self.longest = int(self.size.max())
        self.bytes = np.zeros((len(raw), self.longest), np.uint8)
        for i, w in enumerate(raw):
            self.bytes[i, : len(w)] = np.frombuffer(w, np.uint8)
        joined = np.frombuffer(b" ".join(raw), np.uint8)
        begin = np.cumsum(self.size + 1) - self.size - 1
        found = hashes(joined, begin, begin + self.size)
        self.order = np.argsort(found)
        self.hash = found[self.order]

    def find(self, column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Text number of every word, and its number in the vocabulary or -1."""
        values, offsets = layout(column)
        text, begin, end = spans(values, offsets, PUNCTUATION)
        word = np.full(len(text), -1, np.int64)
        near = np.flatnonzero(end - begin <= self.longest)
        value = hashes(values, begin[near], end[near], lower=True)
        place = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
        same = self.hash[place] == value
        near, guess = near[same], self.order[place[same]]
        # Equal hashes are not taken for equal words.
        size = end[near] - begin[near]
        same = size == self.size[guess]
        columns = np.arange(self.longest)
        at = np.minimum(begin[near, None] + columns, max(0, len(values) - 1))
        wrong = (LOWER[values[at]] != self.bytes[guess]) & (columns < size[:, None])
        same &= ~wrong.any(axis=1)
        word[near[same]] = guess[same]
        return text, word


def document_frequencies(docs: DataFrame, templates: Sequence[Template]) -> tuple[int, np.ndarray]:
    """Documents in all, and with each word of the templates."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(templates)
        total, rows = np.zeros(len(known.words), np.int64), 0
        for batch in slices(batches, "text"):
            rows += batch.num_rows
            text, word = known.find(texts(batch.column("text")))
            hit = word >= 0
            pairs = np.unique(text[hit] * len(known.words) + word[hit])
            total += np.bincount(pairs % len(known.words), minlength=len(known.words))
        numbers = [*range(len(total)), -1]
        yield pa.RecordBatch.from_pydict({"word": numbers, "docs": [*total.tolist(), rows]})

    found = docs.select("text").mapInArrow(count, "word long, docs long")
    # One row per word of the templates.
    sums = dict(found.groupBy("word").agg(F.sum("docs")).collect())
    known = Vocabulary(templates)
    return sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(len(known.words))], np.int64)


class Index:
    """Postings of every template's anchors, and what verifies a candidate."""

    def __init__(self, templates: Sequence[Template], rows: int, frequency: np.ndarray) -> None:
        self.templates = list(templates)
        self.known = Vocabulary(templates)
        self.idf = np.log((rows + 1) / (frequency + 1)) + 1.0
        # Mandatory phrases are templates as well, without a label of their own.
        seen = {t.text for t in templates if not t.must}
        for phrase in dict.fromkeys(p for t in templates for p in t.must):
            if phrase not in seen:
                self.templates.append(Template("", phrase))
        self.words = [
            np.array([self.known.number[w] for w in words_of(t.text)]) for t in self.templates
        ]
        self.gap = max(map(len, self.words)) + SLACK + 1
        self.phrase = {t.text: i for i, t in enumerate(self.templates) if not t.must}
        self.need = []
        postings: dict[int, list[tuple[int, int]]] = {}
        for number, (template, words) in enumerate(zip(self.templates, self.words)):
            rare = sorted(set(words.tolist()), key=lambda w: (-self.idf[w], w))[:ANCHORS]
            places = [(w, p) for p, w in enumerate(words.tolist()) if w in rare]
            share = AGREE if template.must else 1.0
            self.need.append(max(2, math.ceil(share * len(places))) if len(places) > 1 else 1)
            for w, p in places:
                postings.setdefault(w, []).append((number, p))
        self.need = np.array(self.need)
        self.first = np.zeros(len(self.known.words) + 1, np.int64)
        flat = []
        for w in range(len(self.known.words)):
            flat += postings.get(w, [])
            self.first[w + 1] = len(flat)
        self.template, self.place = np.array(flat, np.int64).reshape(-1, 2).T

    def candidates(self, text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Template and begin, in words counted with gaps between texts, of agreeing postings."""
        at = np.flatnonzero(word >= 0)
        count = (self.first[1:] - self.first[:-1])[word[at]]
        at, first, count = at[count > 0], self.first[word[at]][count > 0], count[count > 0]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        posting = np.repeat(first, count) + step
        begin = np.repeat(at + text[at] * self.gap, count) - self.place[posting] + self.gap
        key, votes = np.unique(
            begin * len(self.templates) + self.template[posting], return_counts=True
        )
        template = key % len(self.templates)
        enough = votes >= self.need[template]
        return template[enough], key[enough] // len(self.templates) - self.gap

    def matches(self, text: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Text, template, first word, and share of the template's weight that stands in place,
        of every verified candidate, by text and place."""
        template, begin = self.candidates(text, word)
        # Words by their places with gaps; -1 where there is none.
        size = np.bincount(text, minlength=n)
        start = np.cumsum(size) - size
        origin = start + np.arange(n) * self.gap
        owner = np.searchsorted(origin, begin + self.gap - SLACK - 1, "right") - 1
        share, found = np.zeros(len(template)), {}
        exact = np.array([not t.must for t in self.templates])
        for number in np.unique(template):
            rows = np.flatnonzero(template == number)
            words = self.words[number]
            own = begin[rows] - origin[owner[rows]]
            inside = own[:, None] + np.arange(len(words))
            real = (inside >= 0) & (inside < size[owner[rows]][:, None])
            at = np.where(real, start[owner[rows]][:, None] + inside, 0)
            match = real & (word[at] == words)
            weight = self.idf[words]
            share[rows] = np.where(match.all(axis=1), 1.0, match @ weight / weight.sum())
            if exact[number]:
                found[number] = begin[rows][match.all(axis=1)]
        good = np.zeros(len(template), bool)
        for number in np.unique(template):
            rows = np.flatnonzero(template == number)
            if exact[number]:
                good[rows] = share[rows] == 1.0
                continue
            held = np.ones(len(rows), bool)
            for phrase in self.templates[number].must:
                places = found.get(self.phrase[phrase], np.zeros(0, np.int64))
                low = np.searchsorted(places, begin[rows] - SLACK)
                last = begin[rows] + len(self.words[number]) - len(words_of(phrase)) + SLACK
                near = low < np.searchsorted(places, last, "right")
                # The gap between texts is wider than the slack, so a place found is the text's own.
                held &= near
            good[rows] = held
        labelled = np.array([bool(t.label) for t in self.templates])
        good &= labelled[template] if len(template) else good
        template, begin, owner, share = template[good], begin[good], owner[good], share[good]
        first = begin - origin[owner]
        order = np.lexsort((template, first, owner))
        return owner[order], template[order], first[order], share[order]


_SCHEMA = (
    "doc_id long, n_words long, matches array<struct<label: string, phrase: string, "
    "first_word: long, exact: boolean, share: double>>"
)
_FOUND = pa.list_(pa.struct([
    ("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()),
    ("exact", pa.bool_()), ("share", pa.float64()),
]))


def licence_matches(
    docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES
) -> DataFrame:
    """doc_id, n_words and matches, a row per row of ``docs``; other columns are not read.

    A match names its template, the word (from 0) at which that begins, whether all its words
    have to stand there, and the share of the template's weight (IDF) that stands in place, 1.0
    if all does. An edited notice may begin before the text and may match at more than one place.
    Matches stand in the order of their first word. Null texts are empty and have no match, also
    in an empty table; repeated rows are judged one by one. Letters A-Z count as lower case.
    """
    ship(docs.sparkSession)
    rows, frequency = document_frequencies(docs, templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, rows, frequency)
        labels = pa.array([t.label for t in index.templates])
        phrases = pa.array([t.text for t in index.templates])
        exact = np.array([not t.must for t in index.templates])
        for batch in slices(batches, "text"):
            n = batch.num_rows
            text, word = index.known.find(texts(batch.column("text")))
            owner, template, first, share = index.matches(text, word, n)
            made = pa.StructArray.from_arrays(
                [
                    labels.take(pa.array(template)), phrases.take(pa.array(template)),
                    pa.array(first), pa.array(exact[template]), pa.array(share),
                ],
                fields=list(_FOUND.value_type),
            )
            ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), made),
                ],
                ["doc_id", "n_words", "matches"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, _SCHEMA
    )


def licence_labels(docs: DataFrame) -> DataFrame:
    """Counts, places and labels of the base phrases, and labels and score of all templates.

    n_base counts the places where a base phrase stands, first_word and last_word are the
    smallest and largest of them, null without any. Labels are distinct, sorted and joined by
    commas, empty without any. ``score`` is the greatest share of a template that stands in place.
    """
    base = [t.text for t in PHRASES]
    places = F.filter("matches", lambda m: m["phrase"].isin(base))

    def joined(matches: Column) -> Column:
        labels = F.array_distinct(F.transform(matches, lambda m: m["label"]))
        return F.array_join(F.array_sort(labels), ",")

    firsts = F.transform(places, lambda m: m["first_word"])
    score = F.array_max(F.transform("matches", lambda m: m["share"]))
    return licence_matches(docs).select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        joined(places).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )
