"""Vectorised text primitives shared by the operators: code points, words and their hashes.

Everything here works on slices of Arrow string columns with numpy, so that the Python side of a
``mapInArrow`` costs a few nanoseconds a character and never loops over characters or words.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White space as the regular expression class ``\s`` has it.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PRIME, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SLICE = 1 << 20  # bytes of text that are worked on at once, unless one text is longer


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter (L*), number (N*), white space or other."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    table[[i for i, k in enumerate(kinds) if k == "L"]] = LETTER
    table[[i for i, k in enumerate(kinds) if k == "N"]] = NUMBER
    table[_SPACES] = SPACE
    return table


@lru_cache(1)
def word_chars() -> np.ndarray:
    """True for code points of words: letters, numbers and combining marks."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    table = (char_classes() == LETTER) | (char_classes() == NUMBER)
    table[marks] = True
    return table


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case of each code point, itself where that isn't one code point."""
    low = [chr(c).lower() if not 0xD800 <= c < 0xE000 else chr(c) for c in range(sys.maxunicode + 1)]
    return np.array([ord(s) if len(s) == 1 else i for i, s in enumerate(low)], np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _PRIME) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE:
            _powers[int(base)] = have
    return have[:n]


_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


class Hasher:
    """Hashes of any ranges of one array, each in constant time (polynomial prefix sums, mixed)."""

    def __init__(self, units: np.ndarray):
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[units & 0xFF] * powers(len(units)) if units.dtype == np.uint8 else (units.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)) * powers(len(units)), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= powers(len(self.sums), _INVERSE)[start]
        h += (end - start).astype(np.uint64)
        return mix(h)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts make up at most so many bytes, or are one row."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)]))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


class Texts:
    """Code points of some texts one after another, with a line feed after each; null counts as ''."""

    def __init__(self, texts: list[str | None]):
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        whole = "".join(f"{t or ''}\n" for t in texts)
        self.cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(lengths + 1) - 1  # position of the line feed behind each text
        self.starts = self.ends - lengths
        self.n = len(texts)

    @staticmethod
    def of(column: pa.Array, at: int, to: int) -> Texts:
        return Texts(column.slice(at, to - at).to_pylist())

    def words(self) -> Words:
        return Words(self)


class Words:
    """Words (runs of letters, numbers and marks, lower case) of Texts: bounds, text and hash of each."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.low = lower_table()[texts.cps]
        inside = np.zeros(len(self.low) + 1, bool)
        inside[:-1] = word_chars()[self.low]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, texts.starts)  # first word of each text
        self.count = np.searchsorted(self.start, texts.ends) - self.first
        self.hasher = Hasher(self.low)
        self.hash = self.hasher.ranges(self.start, self.end)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.count)

    def left(self) -> np.ndarray:
        """For each word, the number of words of its text from it on."""
        return np.repeat(self.first + self.count, self.count) - np.arange(len(self.hash))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 reach beyond the end and are zero."""
    out = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= n:
        acc = np.zeros(len(hashes) - n + 1, np.uint64)
        for j in range(n):
            acc *= _GRAM
            acc += hashes[j : len(hashes) - n + 1 + j]
        out[: len(acc)] = mix(acc)
    return out


def one_array(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of hashes."""
    with np.errstate(over="ignore"):
        return mix(np.array([(hashes * powers(len(hashes))).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0] if len(hashes) else np.uint64(0)
