"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Words of up to ``LONG`` bytes are hashed by a polynomial over a table of letters. Longer ones can
be made to collide in that, whatever its base (Thue-Morse words of 1,024 letters and more), so
they are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tidemark.llm.rows import layout

LONG = 200
_CHUNK = 1 << 20
_PRIME = 0x9E3779B97F4A7C55
_GOLD = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Words of letters, digits and non-ASCII characters alone, for features.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _first, _last in ("az", "AZ", "09"):
    PUNCTUATION[ord(_first) : ord(_last) + 1] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixing bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The numbers whose ``mix`` is ``x``."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        x = x ^ (x >> np.uint64(shift)) ^ (x >> np.uint64(2 * shift))
        x = x * np.uint64(pow(factor, -1, 1 << 64))
    return x


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < size:
        for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def spans(
    values: np.ndarray, offsets: np.ndarray, separator: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and end of every maximal run without separators."""
    if not len(values):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[values]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, begin, "right") - 1, begin, end


def hashes(
    values: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A hash of each span; equal bytes give equal hashes."""
    letters = _LETTERS[LOWER] if lower else _LETTERS
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        base = int(begin[i])
        j = max(i + 1, int(np.searchsorted(begin, base + _CHUNK)))
        size = int(end[j - 1]) - base
        up, down = _power_tables(max(size, _CHUNK) + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(letters[values[base : base + size]] * up[:size], out=total[1:])
        out[i:j] = (total[end[i:j] - base] - total[begin[i:j] - base]) * down[begin[i:j] - base]
        i = j
    out = mix(out + (end - begin).astype(np.uint64) * _GOLD)
    for i in np.flatnonzero(end - begin > LONG):
        word = values[begin[i] : end[i]]
        word = (LOWER[word] if lower else word).tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def words(
    column: pa.LargeBinaryArray, separator: np.ndarray = SPACE, lower: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word, in order."""
    values, offsets = layout(column)
    text, begin, end = spans(values, offsets, separator)
    return text, hashes(values, begin, end, lower)


def shingles(text: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``n`` words; shorter texts give one run of all."""
    if not len(word):
        return text, word
    size = np.bincount(text)
    first = np.cumsum(size) - size
    short = np.flatnonzero((size > 0) & (size < n))
    places = np.arange(1, n + 1, dtype=np.uint64) * _GOLD
    run = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        run = mix(run + word[k : k + len(run)] + places[k])
    whole = text[: len(run)] == text[n - 1 :] if len(run) else np.zeros(0, bool)
    extra = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        more = size[short] > k
        extra[more] = mix(extra[more] + word[first[short[more]] + k] + places[k])
    owner = np.concatenate([text[: len(run)][whole], short])
    value = np.concatenate([run[whole], extra])
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]
