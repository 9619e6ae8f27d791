"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenated bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm import _pretok as P
from arcwright.llm._text import Texts, slices

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Bytes of short texts and chunks, or characters of a long text, that are worked on at once; working on them takes some 25 times as much.
PART = 1 << 18


def _encode(texts: list[str | None], cache: P.Pieces, bounds: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, tokens of each, and whether the decoded bytes are the text's.

    bounds: for each text the starts of its pre-tokens, if they are known already.
    """
    t = Texts(texts)
    if bounds is None:
        start, end, first = P.split(t)
    else:
        start = np.concatenate([b + s for b, s in zip(bounds, t.starts)] or [np.zeros(0, np.int64)]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bounds])]).astype(np.int64)
        end = np.concatenate([start[1:], [0]]) if len(start) else start
        some = first[1:] > first[:-1]
        end[first[1:][some] - 1] = t.ends[some]
    slots = cache.lookup(t, start, end)
    ids, lens = cache.ids(slots)
    until = np.concatenate([[0], np.cumsum(lens)])[first]
    count = np.diff(until)
    back = cache.decode(ids).tobytes()
    to = np.concatenate([[0], np.cumsum(cache.byte_len[ids], dtype=np.int64)])[until]
    same = np.fromiter((back[to[i] : to[i + 1]] == (x or "").encode("utf-8", "surrogatepass") for i, x in enumerate(texts)), bool, len(texts))
    return ids, count, same


def _batches(batches: Iterator[pa.RecordBatch], folder: str, name: str) -> Iterator[pa.RecordBatch]:
    cache = P.pieces(folder, name)
    for batch in batches:
        for at, to in slices(batch["text"], PART):
            texts = batch["text"].slice(at, to - at).to_pylist()
            ids, count, same = _encode(texts, cache)
            yield _rows(batch["doc_id"].slice(at, to - at), texts, ids, count, same)


def _rows(doc_ids: pa.Array, texts: list, ids: np.ndarray, count: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    null = np.fromiter((x is None for x in texts), bool, len(texts))
    offsets = np.concatenate([[0], np.cumsum(count)])
    return pa.RecordBatch.from_arrays(
        [doc_ids, P.list_array(ids, offsets, null, pa.int32()), pa.array(count.astype(np.int64), mask=null), pa.array(same, mask=null)],
        names=["doc_id", "token_ids", "n_tokens", "round_trip"],
    )


SCHEMA = "doc_id bigint, token_ids array<int>, n_tokens bigint, round_trip boolean"


def pretokenise_chunk(text: str) -> np.ndarray:
    """Starts of the pre-tokens of one chunk, as if the text began and ended with it."""
    return P.split(Texts([text]))[0]


def stitch(text: str, chunks: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Starts of the pre-tokens of a text, from those of overlapping chunks (start, end, starts within).

    A chunk takes over from its predecessor at the first start that both have, out of reach of the
    predecessor's cut. Where their overlap has none, the text from the predecessor's last settled
    start on is pre-tokenised again up to a start of the next chunk that it agrees with.
    """
    at, end, local = chunks[0]
    out = [local + at]
    sure = end  # the current starts hold up to here
    for begin, stop, local in chunks[1:]:
        here = out[-1]
        nxt = local + begin
        if stop <= sure:
            continue
        limit = sure - P.LOOKAHEAD
        common = np.intersect1d(here[(here >= begin) & (here < limit)], nxt)
        if not len(common):  # no agreement: go on from the last settled start, over more and more of the next chunk
            settled = here[here < limit]
            base = int(settled[-1] if len(settled) else here[0])
            size = max(2 * (sure - base), 4 * P.LOOKAHEAD)
            while True:
                cut = min(base + size, stop)
                again = pretokenise_chunk(text[base:cut]) + base
                ok = again if cut == stop else again[again < cut - P.LOOKAHEAD]
                common = np.intersect1d(ok[ok > base], nxt)
                if len(common) or cut == stop:
                    break
                size *= 2
            point = int(common[0]) if len(common) else stop
            out[-1] = np.concatenate([here[here < base], again[again < point]])
        else:
            point = int(common[0])
            out[-1] = here[here < point]
        if len(rest := nxt[nxt >= point]):
            out.append(rest)
        sure = stop
    return np.concatenate(out)


def _chunk_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(batch["chunk"], PART):
            part = batch.slice(at, to - at)
            starts = [pretokenise_chunk(x) for x in part["chunk"].to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(starts), pa.int32()))], names=[*batch.schema.names, "starts"])


def _encode_long(text: str, cache: P.Pieces, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _encode of one text whose pre-tokens are known, a part that ends with one of them after the other."""
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(text), PART)))
    cuts = np.append(cuts[cuts < len(starts)], len(starts))
    bounds = np.append(starts, len(text))
    parts = [_encode([text[bounds[i] : bounds[j]]], cache, [starts[i:j] - bounds[i]]) for i, j in zip(cuts, cuts[1:])]
    ids, count, same = zip(*parts)
    return np.concatenate(ids), np.sum(count, axis=0), np.all(same, axis=0)


def _stitched(folder: str, name: str, overlap: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        parts = table["chunk"].to_pylist()
        at = table["at"].to_pylist()
        text = "".join(p[: len(p) - overlap] if i < len(parts) - 1 else p for i, p in enumerate(parts))
        starts = stitch(text, [(a, a + len(p), s.values.to_numpy().astype(np.int64)) for a, p, s in zip(at, parts, table["starts"])])
        ids, count, same = _encode_long(text, P.pieces(folder, name), starts)
        return pa.Table.from_batches([_rows(pa.array(table["doc_id"].to_pylist()[:1], pa.int64()), [text], ids, count, same)])

    return run


def encode(docs: DataFrame, folder: str = P.TOKENIZERS, name: str = P.VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of every document (doc_id, token_ids, n_tokens, round_trip).

    Texts of at most ``chunk`` characters are one chunk. Longer ones become chunks that overlap by
    ``overlap`` characters, pre-tokenised in parallel, stitched where their boundaries meet again and
    then encoded; only their text is shuffled. round_trip tells whether :func:`decode` gives the text
    back. ``folder`` must hold the rank file ``name`` on every machine.

    Null text: null ids, count and round_trip. Empty text: no ids, 0, true. Null or repeated doc_id:
    one row for each input row. Other columns are not carried, whatever their names. No rows: none.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = F.length("text")
    short = docs.where(size.isNull() | (size <= chunk)).mapInArrow(lambda b: _batches(b, folder, name), SCHEMA)
    step = chunk - overlap
    long = docs.where(size > chunk).withColumn("row", F.expr("uuid()"))
    long = long.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1 - overlap) / step).cast("int"))).alias("no"))
    long = long.select("row", "doc_id", "no", (F.col("no").cast("bigint") * step).alias("at"), F.expr(f"substring(text, no * {step} + 1, {chunk})").alias("chunk"))
    bounds = long.mapInArrow(_chunk_bounds, "row string, doc_id bigint, no int, at bigint, chunk string, starts array<int>")
    return short.unionByName(bounds.groupBy("row").applyInArrow(_stitched(folder, name, overlap), SCHEMA))


def decode(encoded: DataFrame, folder: str = P.TOKENIZERS, name: str = P.VOCABULARY) -> DataFrame:
    """Texts of rows of token ids (doc_id, text): the tokens' bytes one after another, read as UTF-8.

    Null ids give null, no ids ''. Bytes that aren't UTF-8, as after cutting a list, become U+FFFD.
    An id that the vocabulary lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = P.pieces(folder, name)
        for batch in batches:
            texts = [None if x is None else cache.decode(np.asarray(x, np.int64)).tobytes().decode("utf-8", "replace") for x in batch["token_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id bigint, text string")
