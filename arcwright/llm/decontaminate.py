"""Removal of benchmark passages: normalised n-grams of the benchmark looked up in every token window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwright.llm._text import Texts, Words, grams, slices

N, SHORTEST, DROP_SHARE = 8, 4, 0.5
#: The n-grams are broadcast while the benchmark has at most so many characters; beyond, windows are joined with them.
BROADCAST_CHARS = 8_000_000
_PASS = "doc_id bigint, windows bigint, words bigint, share double, action string, items string"


class Grams:
    """n-grams of benchmark items: hashes by length, where each stands, and the words to verify hits with."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int, shortest: int):
        self.ids = [i for i, _ in items]
        words = Words(Texts([t for _, t in items]))
        self.low, self.start, self.end, self.doc = words.low, words.start, words.end, words.doc
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, sorted hashes, first word of each
        size = np.minimum(words.count, n)
        for length in sorted(set(size[size >= shortest].tolist())):
            at = np.flatnonzero((size[self.doc] == length) & (words.left() >= length))
            h = grams(words.hash, length)[at]
            order = np.argsort(h, kind="stable")
            self.tables.append((length, h[order], at[order]))

    def text(self, at: int, length: int) -> list[str]:
        return _words(self.low, self.start, self.end, at, length)

    def hits(self, words: Words) -> list[tuple[int, int, np.ndarray]]:
        """(first word, length, items) of each window of the words that is an n-gram of the benchmark."""
        found = []
        left = words.left()
        for length, table, at in self.tables:
            h = grams(words.hash, length)
            mask = np.zeros(1 << 20, bool)  # most windows end here: the sorted table is only searched for the rest
            mask[table & np.uint64((1 << 20) - 1)] = True
            maybe = np.flatnonzero(mask[h & np.uint64((1 << 20) - 1)] & (left >= length))
            lo, hi = np.searchsorted(table, h[maybe], "left"), np.searchsorted(table, h[maybe], "right")
            for w, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                here = _words(words.low, words.start, words.end, w, length)
                items = np.unique(self.doc[[x for x in at[a:b].tolist() if self.text(x, length) == here]])
                if len(items):
                    found.append((w, length, items))
        return found


def _words(low: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, length: int) -> list[str]:
    return [low[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start[at : at + length].tolist(), end[at : at + length].tolist())]


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, the punctuation right behind each and one white space."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        while b < len(text) and not text[b].isspace() and not text[b].isalnum():
            b += 1
        at = b + (b < len(text) and text[b].isspace())
    return "".join([*out, text[at:]])


def _scan_texts(texts: list[str | None], index: Grams, share: float) -> dict[int, tuple]:
    """For each text with hits: windows, words, share of words covered, action, items and the text without them."""
    t = Texts(texts)
    words = t.words()
    by: dict[int, list] = {}
    hits = index.hits(words)
    if hits:
        doc = np.searchsorted(words.first, [w for w, _, _ in hits], "right") - 1
        for d, hit in zip(doc.tolist(), hits):
            by.setdefault(d, []).append(hit)
    out = {}
    for d, found in by.items():
        base, count, at = int(words.first[d]), int(words.count[d]), int(t.starts[d])
        covered = np.zeros(count + 1, np.int64)
        for w, length, _ in found:
            covered[w - base] += 1
            covered[w - base + length] -= 1
        covered = np.cumsum(covered)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        spans = [(int(words.start[base + a]) - at, int(words.end[base + b - 1]) - at) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        part = covered.sum() / count
        items = sorted({str(index.ids[i]) for _, _, x in found for i in x.tolist()}, key=lambda s: (len(s), s))
        out[d] = (len(found), count, float(part), "drop" if part >= share else "cut", ",".join(items), _cut(texts[d], spans))
    return out


def _report(index, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["text"]):
                found = _scan_texts(batch["text"].slice(at, to - at).to_pylist(), index.value, share)
                if found:
                    ids = batch["doc_id"].slice(at, to - at).take(pa.array(list(found)))
                    columns = list(zip(*found.values()))[:5]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "windows", "words", "share", "action", "items"])

    return run


def _clean(index, share: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            for at, to in slices(texts):
                part = batch.slice(at, to - at)
                own = part.column(text_at).to_pylist()
                found = _scan_texts(own, index.value, share)
                if found:
                    keep = np.ones(len(part), bool)
                    for d, x in found.items():
                        own[d] = x[5]
                        keep[d] = x[3] == "cut"
                    columns = list(part.columns)
                    columns[text_at] = pa.array(own, texts.type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))
                yield part

    return run


def _window_hashes(n: int, shortest: int, key: str):
    """Rows (key, w) of all window hashes, of each length that windows can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["text"]):
                words = Texts.of(batch["text"], at, to).words()
                left = words.left()
                ids = batch[key].slice(at, to - at)
                for length in range(shortest, n + 1):
                    w = np.flatnonzero(left >= length)
                    h = grams(words.hash, length)[w].view(np.int64)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(words.doc[w])), pa.array(h)], names=[key, "w"])

    return run


class _Items:
    """Stands in for a broadcast where each task has its own items."""

    def __init__(self, value: Grams):
        self.value = value


def _per_row(n: int, shortest: int, share: float, text_at: int, only_report: bool):
    """The scan where each row brings the benchmark items that it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                items = [(x["item_id"], x["text"]) for x in row.column(len(row.schema) - 1)[0].as_py() or []]
                bare = pa.RecordBatch.from_arrays(row.columns[:-1], names=row.schema.names[:-1])
                index = _Items(Grams(items, n, shortest))
                yield from (_report(index, share)(iter([bare])) if only_report else _clean(index, share, text_at)(iter([bare])))

    return run


def _run(docs: DataFrame, benchmark: DataFrame, n: int, shortest: int, share: float, broadcast_chars: int, only_report: bool) -> DataFrame:
    shortest = min(shortest, n)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text") if only_report else docs
    names, schema = docs.columns, T.StructType(docs.schema.fields)
    if chars <= broadcast_chars:
        rows = sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = docs.sparkSession.sparkContext.broadcast(Grams(rows, n, shortest))
        return docs.mapInArrow(_report(index, share), _PASS) if only_report else docs.mapInArrow(_clean(index, share, names.index("text")), schema)
    size = items.select("item_id", "text")
    mine = size.mapInArrow(_window_hashes(n, shortest, "item_id"), "item_id bigint, w bigint").distinct()
    key = F.xxhash64("doc_id", "text")
    theirs = docs.select(key.alias("k"), "text").mapInArrow(_window_hashes(n, shortest, "k"), "k bigint, w bigint")
    pairs = theirs.join(mine, "w").select("k", "item_id").distinct().join(size, "item_id")
    found = pairs.groupBy("k").agg(F.collect_list(F.struct("item_id", "text")).alias("__items"))
    joined = docs.join(found, key == found["k"], "left").select(*(docs[c] for c in names), "__items")
    return joined.mapInArrow(_per_row(n, shortest, share, names.index("text"), only_report), _PASS if only_report else schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, shortest: int = SHORTEST, drop_share: float = DROP_SHARE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Documents that hold windows of ``n`` words of the benchmark: (doc_id, windows, words, share, action, items).

    Words are runs of letters, numbers and marks, in lower case. An item of fewer than ``n`` words is
    one window as a whole, if it has at least ``shortest``. Windows are looked up by 64-bit hash and
    verified word by word. share is the share of the document's words that hits cover; action is
    ``drop`` from ``drop_share`` on, else ``cut``; items are the numbers of the items, joined by commas.

    The benchmark is broadcast up to ``broadcast_chars`` characters; above, windows are joined with it.
    Null or empty texts and items have no windows. Repeated documents give a row each, repeated items
    count once. Null doc_ids stay null. Other columns are not carried. No rows on either side: none.
    """
    return _run(docs, benchmark, n, shortest, drop_share, broadcast_chars, True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, shortest: int = SHORTEST, drop_share: float = DROP_SHARE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The documents without what :func:`contaminated` finds: spans cut out, documents to drop gone.

    All columns stay, n_chars too, which still counts the text as it came. Other cases as there.
    """
    return _run(docs, benchmark, n, shortest, drop_share, broadcast_chars, False)
