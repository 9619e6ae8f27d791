"""Removal of repeated runs of lines: overlapping windows of three lines, hashed and counted globally."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwright.llm._graph import keep
from arcwright.llm._text import SPACE, Hasher, Texts, char_classes, grams, slices

WINDOW = 3
#: A window in so many documents is joined by broadcast: there are at most as many such as windows in the corpus divided by this.
HOT = 1_000_000


class Lines:
    """Lines of some texts that aren't blank: where each starts and ends, and the hashes of the windows that begin there."""

    def __init__(self, texts: Texts, size: int):
        cps = texts.cps
        begins = np.zeros(len(cps), bool)
        begins[1:] = cps[:-1] == 0x0A
        begins[texts.starts] = True
        edge = np.flatnonzero(begins)
        solid = np.append(np.flatnonzero(char_classes()[cps] != SPACE), len(cps))
        first = solid[np.searchsorted(solid, edge)]
        some = first < np.append(edge[1:], len(cps))
        edge, first = edge[some], first[some]
        last = np.append(-1, solid)[np.searchsorted(solid, np.append(edge[1:], len(cps)))] + 1  # blank lines have none
        self.first = np.searchsorted(edge, texts.starts)
        self.count = np.searchsorted(edge, texts.ends) - self.first
        some = self.count > 0
        heads, tails = self.first[some], (self.first + self.count - 1)[some]
        self.start, self.end = edge.copy(), np.append(edge[1:], 0)
        self.start[heads] = texts.starts[some]  # blank lines belong to the one before them, at the beginning to the first
        self.end[tails] = texts.ends[some]
        self.window = grams(Hasher(cps).ranges(first, last), size).view(np.int64)
        self.whole = np.repeat(self.first + self.count, self.count) - np.arange(len(edge)) >= size  # a window begins here


def _runs(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _windows(size: int):
    """(d, ws, own) of each text: its windows, and those that it has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["text"]):
                lines = Lines(Texts.of(batch["text"], at, to), size)
                doc = np.repeat(np.arange(to - at), lines.count)[lines.whole]
                window = lines.window[lines.whole]
                order = np.lexsort((window, doc))
                doc, window = doc[order], window[order]
                same = (doc[1:] == doc[:-1]) & (window[1:] == window[:-1])
                first = np.concatenate([[True], ~same])[: len(doc)]
                again = np.zeros(int(first.sum()), bool)
                again[(np.cumsum(first) - 1)[1:][same]] = True
                doc, window = doc[first], window[first]
                count = lambda of: np.bincount(of, minlength=to - at)
                yield pa.RecordBatch.from_arrays([batch["d"].slice(at, to - at), _runs(count(doc), window), _runs(count(doc[again]), window[again])], names=["d", "ws", "own"])

    return run


def _rebuild(size: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-2]
            texts = batch.column(text_at)
            later, own = batch.column(len(names)), batch.column(len(names) + 1)
            hit = np.flatnonzero(later.is_valid().to_numpy(zero_copy_only=False))
            new, gone = texts.to_pylist(), np.zeros(len(batch), np.int64)
            some = texts.take(pa.array(hit))
            for at, to in slices(some):
                whole = Texts.of(some, at, to)
                lines = Lines(whole, size)
                for k in range(to - at):
                    i, a, b = hit[at + k], lines.first[k], lines.first[k] + lines.count[k]
                    begin = np.flatnonzero(lines.whole[a:b])
                    window = lines.window[a:b][begin]
                    again = np.ones(len(window), bool)
                    again[np.unique(window, return_index=True)[1]] = False
                    drop = np.isin(window, later[i].values.to_numpy()) | np.isin(window, own[i].values.to_numpy()) & again
                    covered = np.zeros(b - a + 1, np.int64)
                    np.add.at(covered, begin[drop], 1)
                    np.add.at(covered, begin[drop] + size, -1)
                    covered = np.cumsum(covered)[:-1] > 0
                    gone[i] = covered.sum()
                    if gone[i]:
                        text, origin = new[i], whole.starts[k]
                        new[i] = "".join(text[x:y] for x, y in zip((lines.start[a:b][~covered] - origin).tolist(), (lines.end[a:b][~covered] - origin).tolist()))
            columns = list(batch.columns[: len(names)])
            columns[text_at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone)], names=[*names, "removed_lines"])

    return run


def dedup_lines(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Documents without the lines of window runs that occurred before, and the column removed_lines.

    A line ends with a line feed; white space around it doesn't count, and blank lines are no lines:
    they go or stay with the line before them, at the beginning with the first. Each ``window``
    consecutive lines are hashed (64 bits). Of windows that occur more than once, the one in the
    lowest doc_id stays, and there the first one; all others are removed: every line that one of
    them covers goes, overlapping ones merged (and where it overlaps the first, lines of that too).

    Plan: one scan hashes the texts; the hashes, one row a document, are kept. An aggregate with
    map-side combining finds the lowest doc_id of each window; the windows of several documents are
    joined back, those of ``hot`` documents and more by broadcast, so that no task holds one window's
    documents. A last join by doc_id moves the texts.

    Null text stays null, '' and texts of fewer lines than a window stay as they are. Rows of equal
    doc_id count as one document: what they share stays. Null doc_ids count as one document behind
    all others; doc_ids must be numbers. A text whose lines all go becomes ''. Other columns stay;
    removed_lines of the input is replaced. No rows: none.
    """
    docs = docs.drop("removed_lines")
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    rows = keep(docs.select(order.alias("d"), "text").mapInArrow(_windows(window), "d bigint, ws array<bigint>, own array<bigint>").where("size(ws) > 0"))
    found = rows.select("d", F.explode("ws").alias("w"))
    first = found.groupBy("w").agg(F.min("d").alias("lowest"), F.max("d").alias("highest"), F.count("*").alias("n")).where("lowest < highest")
    first = keep(first.select("w", "lowest", "n"))
    often = F.broadcast(first.where(F.col("n") >= hot).select("w", "lowest"))
    later = found.join(often, "w").unionByName(found.join(often, "w", "left_anti").join(first.where(F.col("n") < hot).select("w", "lowest"), "w")).where("d > lowest")
    own = rows.where("size(own) > 0").select("d", F.explode("own").alias("o"))
    gone = later.select("d", "w", F.lit(None).cast("bigint").alias("o")).unionByName(own.select("d", F.lit(None).cast("bigint").alias("w"), "o"))
    gone = gone.groupBy("d").agg(F.collect_list("w").alias("__later"), F.collect_list("o").alias("__own"))
    names = docs.columns
    joined = docs.join(gone, order == gone["d"], "left").select(*(docs[c] for c in names), "__later", "__own")
    schema = T.StructType([*docs.schema.fields, T.StructField("removed_lines", T.LongType())])
    return joined.mapInArrow(_rebuild(window, names.index("text")), schema)
