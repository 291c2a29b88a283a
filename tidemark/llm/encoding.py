"""Token ids of whole texts, by the vocabulary file of a public tokenizer.

For tokenizers whose pieces never span ASCII white space, a text's ids are its words' ids one
after another. Words repeat, so every worker keeps the ids of words it has met in sorted
arrays, and only new ones go through the tokenizer's steps. ``by_words`` says whether a file
is of that kind; others are encoded text by text. Words are told apart by a 64-bit hash: with
``KEPT_WORDS`` words, two share one with a chance below one in a million.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm.rows import layout
from tidemark.llm.words import SPACE, hashes, spans

# Words that a worker keeps, about 40 bytes each. The memory starts anew when it is full.
KEPT_WORDS = 1_000_000

# Lower-case words that such a tokenizer splits into their letters and what follows them.
_LETTERS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PATTERN = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of many texts at once, in little-endian arrays of ``dtype``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.by_words = _splits_at_white_space(parts)
        self.special = [token["content"].encode() for token in parts["added_tokens"]]
        self._letter_of = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)
        self.pieces: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and how many each text has."""
        values, offsets = layout(column)
        raw = values.tobytes()
        if not self.by_words or any(token in raw for token in self.special):
            found = [self.ids(t.decode()) for t in column.to_pylist()]
            counts = np.array([len(i) for i in found], np.int64)
            return np.array([i for ids in found for i in ids], self.dtype), counts
        text, begin, end = spans(values, offsets, SPACE)
        word = hashes(values, begin, end, lower=True)
        distinct, where, which = np.unique(word, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS:
            self.forget()
        self._learn(raw, distinct, begin[where], end[where])
        at = np.searchsorted(self.known, distinct)[which]
        count = self.count[at]
        total = int(count.sum())
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        ids = self.flat[np.repeat(self.first[at], count) + step]
        return ids, np.bincount(text, count, len(column)).astype(np.int64)

    def _learn(self, raw: bytes, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        at = np.searchsorted(self.known, word)
        new = np.ones(len(word), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != word[inside]
        if not new.any():
            return
        found = [
            self.word_ids(raw[a:b].lower())
            for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)
        ]
        count = np.array([len(i) for i in found], np.int64)
        flat = np.array([i for ids in found for i in ids], self.dtype)
        first = len(self.flat) + np.cumsum(count) - count
        self.known = np.insert(self.known, at[new], word[new])
        self.first = np.insert(self.first, at[new], first)
        self.count = np.insert(self.count, at[new], count)
        self.flat = np.concatenate([self.flat, flat])
        if len(self.pieces) > KEPT_WORDS // 8:
            self.pieces.clear()

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of one word, by the tokenizer's own steps for its pieces."""
        text = word.decode()
        simple = _LETTERS.fullmatch(text if word.isascii() else text.lower())
        if simple:
            letters, rest = simple.groups()
            if not word.isascii():
                letters = letters.encode().decode("latin-1").translate(self._letter_of)
            ids = [t.id for t in self.model.tokenize(letters)]
            if rest:
                if rest not in self.pieces:
                    self.pieces[rest] = [t.id for t in self.model.tokenize(rest)]
                ids += self.pieces[rest]
            return ids
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [t.id for piece, _ in pieces for t in self.model.tokenize(piece)]


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers show a byte as, for the bytes that have none."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + n for n, b in enumerate(rest)}


def _steps(part: dict | None) -> list[dict]:
    if not part:
        return []
    inner = part.get("normalizers") or part.get("pretokenizers")
    return [s for p in inner for s in _steps(p)] if inner else [part]


def _splits_at_white_space(parts: dict) -> bool:
    """True if the file lower-cases, and its splitting pattern drops white space."""
    steps = _steps(parts.get("pre_tokenizer"))
    normalizers = {s["type"] for s in _steps(parts.get("normalizer"))}
    return (
        [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["behavior"] == "Removed"
        and steps[0]["invert"]
        and steps[0]["pattern"].get("Regex", "").endswith(_PATTERN)
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and normalizers == {"NFC", "Replace", "Lowercase"}
        and parts.get("post_processor") is None
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file; it outlives tasks."""
    return Encoder(path)


def public_vocabulary(name: str) -> str:
    """Path of a vocabulary file that is installed with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
