"""Pre-tokens of byte-level BPE found with numpy, and a piece cache over a public tiktoken vocabulary."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from arcwright.llm._text import LETTER, OTHER, SPACE, Hasher, Texts, char_classes

#: Folder of the public vocabularies and the file used; both are parameters of the operators.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The split that :func:`boundaries` reproduces; tests hold it against the regular expression.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SEP = 4
LOOKAHEAD = 3  # a pre-token is settled by at most so many characters from its end on


def boundaries(texts: Texts) -> np.ndarray:
    """Starts of the pre-tokens of all texts, and the ends of the texts; ascending.

    The pre-token from b[i] on ends at b[i + 1]; a text's end is not the start of one.
    """
    cps = texts.cps
    kinds = char_classes()[cps]
    kinds[texts.ends] = _SEP
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    start[texts.ends] = True
    # white space: the last character of a run goes to what follows, or stands alone if it isn't a blank
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != _SEP))
    start[last] = True
    joined = last[cps[last] == 0x20]
    start[joined + 1] = False
    # contractions: an apostrophe that starts a pre-token, alone in its run, before s t re ve m ll d
    quote = np.flatnonzero((cps[:-1] == 0x27) & start[:-1] & (kinds[1:] == LETTER))
    if len(quote):
        one, two = cps[quote + 1], cps[np.minimum(quote + 2, n - 1)]
        is1 = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        is2 = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((is1, 2), (is2, 3)):
            at = quote[which]
            start[at + 1] = False
            rest = at + size
            start[rest[kinds[rest] == LETTER]] = True
    return np.flatnonzero(start)


@lru_cache(4)
def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and ids of a tiktoken rank file."""
    with open(os.path.join(folder, name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Pieces:
    """Cache from pre-token hash to token ids; forgets all when it holds too many.

    Two different pre-tokens of equal 64-bit hash would be confused; among the at most ``most``
    pre-tokens held at once that has a chance below 1e-8.
    """

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY, most: int = 400_000):
        import tiktoken

        ranks = read_ranks(folder, name)
        self.coder = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.most = most
        by_id = sorted((i, b) for b, i in ranks.items())
        size = by_id[-1][0] + 1
        self.byte_len = np.zeros(size, np.int32)
        for i, b in by_id:
            self.byte_len[i] = len(b)
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_len)])[:-1]
        self.bytes = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.lens = np.zeros(1 << 16, np.int32)
        self.offs = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def lookup(self, texts: Texts, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Slot of each pre-token, after encoding those that are new."""
        if hashes is None:
            hashes = Hasher(texts.cps).ranges(start, end)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if len(self.slot) + len(keys) > self.most:
            self.clear()
        get = self.slot.get
        slots = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            f = first[new]
            raw = texts.cps.tobytes()
            parts = [raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(start[f].tolist(), end[f].tolist())]
            ids = [self.coder.encode_ordinary(p) for p in parts]
            base = len(self.slot)
            total = sum(map(len, ids))
            while base + len(new) > len(self.lens):
                self.lens, self.offs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.offs))
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            lens = np.fromiter(map(len, ids), np.int32, len(ids))
            self.lens[base : base + len(new)] = lens
            self.offs[base : base + len(new)] = self.used + np.cumsum(lens) - lens
            self.flat[self.used : self.used + total] = np.fromiter((t for x in ids for t in x), np.int32, total)
            self.used += total
            slots[new] = np.arange(base, base + len(new))
            for k, s in zip(uniq[new].tolist(), range(base, base + len(new))):
                self.slot[k] = s
        return slots[inverse]

    def counts(self, texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        slots = self.lookup(texts, start, end)
        return self.lens[slots].astype(np.int64)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all slots one after another, and how many each has."""
        lens = self.lens[slots].astype(np.int64)
        total = int(lens.sum())
        at = np.repeat(self.offs[slots] - (np.cumsum(lens) - lens), lens) + np.arange(total)
        return self.flat[at], lens

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Raw bytes of the tokens, concatenated."""
        lens = self.byte_len[ids].astype(np.int64)
        at = np.repeat(self.byte_at[ids] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        return self.bytes[at]


_pieces: dict[tuple[str, str], Pieces] = {}


def pieces(folder: str, name: str) -> Pieces:
    """The cache of this process."""
    if (folder, name) not in _pieces:
        _pieces[folder, name] = Pieces(folder, name)
    return _pieces[folder, name]


def split(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each pre-token, and the index of the first one of each text (n + 1 numbers)."""
    b = boundaries(texts)
    real = np.ones(len(b), bool)
    real[np.searchsorted(b, texts.ends)] = False
    index = np.flatnonzero(real)
    start = b[index]
    end = b[index + 1]
    return start, end, np.concatenate([np.searchsorted(start, texts.starts), [len(start)]])


def list_array(values: np.ndarray, offsets: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of values, null where asked."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind), mask=pa.array(null) if null.any() else None)
