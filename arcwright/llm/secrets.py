"""Secret scan: random strings show by how few characters a public vocabulary's tokens cover in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm import _pretok as P
from arcwright.llm._text import Texts, slices

LEAST, RATIO = 16, 2.2  # characters of a candidate; characters a token under which it is a secret
LETTERS = 1.8  # the same for candidates of letters alone, as words of other languages reach the other
LEAST_NAMED = 8  # characters of what a key name and ``=`` or ``:`` introduce
_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
_NAME = r"(?:token|secret|passw\w{0,8}|api[ _-]?key|key|auth\w{0,12}|credentials?|bearer|pwd)[\"']?\s{0,3}"
_KEYED = re.compile(_NAME + r"(?:[:=]|=>|\s)\s{0,3}[\"'`]?$", re.I)
_VALUE = re.compile(_NAME + r"(?:[:=]|=>)\s{0,3}[\"'`]?([^\s\"'`<>]+)", re.I)
_CONTEXT = 40  # characters before a candidate in which its key name is looked for
_SIGNS = "-=_/+.,;:()[]{}"
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)


@lru_cache(1)
def _mask() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[list(_CHARS)] = True
    return table


def known_identifier(text: str) -> bool:
    """Digests by their length in hex digits, UUIDs, and numbers with or without signs between."""
    return bool(_DIGEST.fullmatch(text) or _UUID.fullmatch(text)) or not any(c.isalpha() for c in text)


def findings(texts: list[str | None], coder, least: int, ratio: float, known: frozenset[str]) -> list[tuple[int, int, int, float, bool]]:
    """(text, start, length, characters a token, keyed) of each secret."""

    def tested(d: int, at: int, found: str, signs: str, short: int, keyed: bool) -> bool:
        core = found.strip(signs)
        if len(core) < short or core in known or not any(c.isalpha() for c in core) or (not keyed and known_identifier(core)):
            return False
        per = len(core) / len(coder.encode_ordinary(core))
        if per >= (LETTERS * ratio / RATIO if core.isalpha() else ratio):
            return False
        out.append((d, at + len(found) - len(found.lstrip(signs)), len(core), per, keyed))
        return True

    out: list[tuple[int, int, int, float, bool]] = []
    named: dict[int, list[tuple[int, int]]] = {}
    for d, text in enumerate(texts):
        for m in _VALUE.finditer(text or ""):
            if tested(d, m.start(1), m.group(1), _SIGNS, min(LEAST_NAMED, least), True):
                named.setdefault(d, []).append(m.span(1))
    t = Texts(texts)
    inside = np.zeros(len(t.cps) + 1, np.int8)
    inside[:-1] = _mask()[t.cps]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    start, end = start[long], end[long]
    for a, b, d in zip(start.tolist(), end.tolist(), (np.searchsorted(t.starts, start, "right") - 1).tolist()):
        a, b = a - int(t.starts[d]), b - int(t.starts[d])
        if not any(x < b and a < y for x, y in named.get(d, ())):
            tested(d, a, texts[d][a:b], "-=_/+", least, bool(_KEYED.search(texts[d][max(0, a - _CONTEXT) : a])))
    return out


def scan(docs: DataFrame, folder: str = P.TOKENIZERS, name: str = P.VOCABULARY, least: int = LEAST, ratio: float = RATIO, known: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, start, length, chars_per_token, keyed) of each secret in the documents; start counts from 0.

    Candidates are the longest runs of base64 and URL-safe characters of at least ``least``
    characters, and, from ``LEAST_NAMED`` characters on and up to white space or a quote, whatever a
    key name (token, secret, password ...) and ``=`` or ``:`` introduce; signs at their ends don't
    count. Left out are those in ``known``, those without a letter, and, unless a key name stands
    right before, digests and UUIDs. The rest is a secret if the vocabulary needs more than a token
    for each ``ratio`` characters (of letters alone: ``LETTERS``): text and names take fewer tokens,
    random strings more.

    Null and empty texts have none. Repeated rows and strings each count. Null doc_ids stay null;
    others must be numbers. Other columns are not carried. No rows: none. The secret itself is not
    written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("scan", pat_str=P.PATTERN, mergeable_ranks=P.read_ranks(folder, name), special_tokens={})
        for batch in batches:
            for at, to in slices(batch["text"]):
                rows = findings(batch["text"].slice(at, to - at).to_pylist(), coder, least, ratio, known)
                if rows:
                    doc, *rest = zip(*rows)
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                    ids = batch["doc_id"].slice(at, to - at).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rest, kinds))], names=["doc_id", "start", "length", "chars_per_token", "keyed"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, start bigint, length bigint, chars_per_token double, keyed boolean")
