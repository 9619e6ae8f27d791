"""Edit-aware token counts: a segment tree over the pre-tokens of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm import _pretok as P
from arcwright.llm._text import Texts, slices

LEAF = 64  # pre-tokens of a leaf when a tree is built
EDITS = "array<struct<pos:bigint,n_del:bigint,ins:string>>"


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes()


class TokenTree:
    """A text whose token count follows edits: leaves hold runs of pre-tokens, inner nodes sums over their leaves.

    Node 1 is the root, node i has the children 2i and 2i + 1; each holds (characters, tokens). An
    edit re-encodes the pre-tokens it touches, ``LOOKAHEAD`` characters of context before it, and
    what follows up to the first boundary that the old and the new split share; then it updates the
    sums on the way from the touched leaves to the root.
    """

    def __init__(self, text: str, cache: P.Pieces, starts: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.cache, self.reencoded = cache, 0
        if starts is None:
            starts, counts = self._split(text)
        self._build(text, starts, counts)

    def _split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        t = Texts([text])
        start, end, _ = P.split(t)
        return start, self.cache.counts(t, start, end)

    def _build(self, text: str, starts: np.ndarray, counts: np.ndarray) -> None:
        at = np.arange(0, len(starts), LEAF)
        cuts = [*starts[at].tolist(), len(text)]
        self.leaves = [(text[a:b], starts[i : i + LEAF] - a, counts[i : i + LEAF]) for i, a, b in zip(at.tolist(), cuts, cuts[1:])] or [("", np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        sums = np.zeros((2, 2 * self.size), np.int64)
        sums[0, self.size : self.size + len(self.leaves)] = np.diff(cuts) if len(at) else 0
        sums[1, self.size : self.size + len(self.leaves)] = np.add.reduceat(counts, at) if len(at) else 0
        half = self.size
        while half > 1:
            sums[:, half // 2 : half] = sums[:, half : 2 * half : 2] + sums[:, half + 1 : 2 * half : 2]
            half //= 2
        self.chars, self.tokens = sums[0].tolist(), sums[1].tolist()

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)

    def state(self) -> tuple[str, bytes, bytes]:
        """Text, and lengths and token counts of its pre-tokens: with them the tree is built without splitting or encoding anything."""
        starts = np.concatenate([x[1] + at for x, at in zip(self.leaves, np.cumsum([0, *(len(x[0]) for x in self.leaves)]))])
        counts = np.concatenate([x[2] for x in self.leaves])
        text = self.text
        return text, _packed(np.diff(np.append(starts, len(text)))), _packed(counts)

    @classmethod
    def load(cls, text: str, lengths: bytes, counts: bytes, cache: P.Pieces) -> TokenTree:
        lengths = np.frombuffer(lengths, np.int32).astype(np.int64)
        return cls(text, cache, np.cumsum(lengths) - lengths, np.frombuffer(counts, np.int32).astype(np.int64))

    def _leaf(self, pos: int) -> tuple[int, int]:
        """The leaf that holds a position, the last one with characters for the end; and where it begins."""
        node, base = 1, 0
        while node < self.size:
            node *= 2
            if pos - base >= self.chars[node] and self.chars[node + 1]:
                base += self.chars[node]
                node += 1
        return node - self.size, base

    def _set(self, i: int, text: str, starts: np.ndarray, counts: np.ndarray) -> None:
        self.leaves[i] = (text, starts, counts)
        node = i + self.size
        self.chars[node], self.tokens[node] = len(text), int(counts.sum())
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, pos: int, n_del: int, ins: str) -> None:
        """Replaces n_del characters from pos on; both are cut to the text."""
        total = self.chars[1]
        pos = min(max(pos, 0), total)
        n_del = min(max(n_del, 0), total - pos)
        back = max(pos - P.LOOKAHEAD - 1, 0)
        (first, base), (last, _) = self._leaf(back), self._leaf(min(pos + n_del + P.LOOKAHEAD, total))
        while True:
            parts = self.leaves[first : last + 1]
            old = "".join(p[0] for p in parts)
            shift = np.cumsum([0, *(len(p[0]) for p in parts)])
            starts = np.concatenate([p[1] + s for p, s in zip(parts, shift)])
            counts = np.concatenate([p[2] for p in parts])
            at = pos - base
            new = old[:at] + ins + old[at + n_del :]
            left = int(np.searchsorted(starts, back - base, "right")) - 1
            from_ = int(starts[left]) if left >= 0 else 0
            left = max(left, 0)
            moved = starts + (len(ins) - n_del)
            tail = int(np.searchsorted(starts, at + n_del))
            closed = base + len(old) == total  # nothing but empty leaves behind
            # only a short way behind the edit first; then up to the end of the leaves at hand
            for cut in (at + len(ins) + 48, len(new)):
                cut = min(cut, len(new))
                t = Texts([new[from_:cut]])
                s, e, _ = P.split(t)
                s, e = s + from_, e + from_
                end = cut == len(new) and closed
                sure = s if end else s[s < cut - P.LOOKAHEAD]
                common = np.intersect1d(sure[sure >= at + len(ins)], moved[tail:])
                if len(common) or end:
                    break
            if len(common) or end:
                break
            last += 1  # no boundary agrees yet
            while not self.chars[self.size + last]:
                last += 1
        meet = int(common[0]) if len(common) else len(new)
        keep = s < meet
        s, e = s[keep], e[keep]
        n = self.cache.counts(t, s - from_, e - from_) if len(s) else np.zeros(0, np.int64)
        self.reencoded += len(s)
        rest = np.searchsorted(moved[tail:], meet) + tail
        starts = np.concatenate([starts[:left], s, moved[rest:]])
        counts = np.concatenate([counts[:left], n, counts[rest:]])
        if len(starts) > 16 * LEAF * (last - first + 1):  # a large insertion: the tree is built again around it
            before, behind = self.leaves[:first], self.leaves[last + 1 :]
            parts = [*before, (new, starts, counts), *behind]
            shift = np.cumsum([0, *(len(p[0]) for p in parts)])
            self._build("".join(p[0] for p in parts), np.concatenate([p[1] + x for p, x in zip(parts, shift)]), np.concatenate([p[2] for p in parts]))
            return
        share = -(-len(starts) // (last - first + 1))
        for k, i in enumerate(range(first, last + 1)):
            mine = slice(k * share, (k + 1) * share)
            a = int(starts[mine][0]) if len(starts[mine]) else len(new)
            b = int(starts[(k + 1) * share]) if (k + 1) * share < len(starts) else len(new)
            a = 0 if k == 0 else a
            self._set(i, new[a:b], starts[mine] - a, counts[mine])


def _counted(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = P.pieces(folder, name)
        for batch in batches:
            for at, to in slices(batch["text"]):
                texts = batch["text"].slice(at, to - at).to_pylist()
                edits = batch["edits"].slice(at, to - at).to_pylist()
                t = Texts(texts)
                start, end, first = P.split(t)
                counts = cache.counts(t, start, end)
                sums = np.concatenate([[0], np.cumsum(counts)])[first]
                before = np.diff(sums)
                after, done, again = before.copy(), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for i, (text, changes) in enumerate(zip(texts, edits)):
                    if text is not None and changes:
                        tree = TokenTree(text, cache, start[first[i] : first[i + 1]] - t.starts[i], counts[first[i] : first[i + 1]])
                        for c in changes:
                            if c is not None and c["pos"] is not None:
                                tree.edit(c["pos"], c["n_del"] or 0, c["ins"] or "")
                                done[i] += 1
                        after[i], again[i] = tree.count, tree.reencoded
                null = np.fromiter((x is None for x in texts), bool, len(texts))
                columns = (np.diff(first).astype(np.int64), before, done, again, after)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, to - at), *(pa.array(c, mask=null) for c in columns)], names=["doc_id", "n_pieces", "tokens_before", "n_edits", "reencoded", "tokens_after"])

    return run


def count_tokens(docs: DataFrame, folder: str = P.TOKENIZERS, name: str = P.VOCABULARY) -> DataFrame:
    """(doc_id, n_pieces, tokens_before, n_edits, reencoded, tokens_after) of documents with a column edits.

    ``edits`` is an array of (pos, n_del, ins), applied one after the other: n_del characters from
    pos on are replaced by ins; each position refers to the text as the edits before left it and is
    cut to its length. reencoded counts the pre-tokens that edits had encoded again. See
    :func:`with_edits` for edits in a table of their own.

    Null text: all counts null. Empty text: 0, and edits apply. Null edits, or such of null pos, are
    passed over; null n_del is 0, null ins ''. Repeated rows give a row each. Columns besides
    doc_id, text and edits are not carried. No rows: none.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits"))
    return docs.mapInArrow(_counted(folder, name), "doc_id bigint, n_pieces bigint, tokens_before bigint, n_edits bigint, reencoded bigint, tokens_after bigint")


TREES = "doc_id bigint, text string, lengths binary, counts binary, n_tokens bigint, reencoded bigint"


def _built(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = P.pieces(folder, name)
        for batch in batches:
            for at, to in slices(batch["text"]):
                t = Texts.of(batch["text"], at, to)
                start, end, first = P.split(t)
                counts = cache.counts(t, start, end)
                total = np.diff(np.concatenate([[0], np.cumsum(counts)])[first])
                null = batch["text"].slice(at, to - at).is_null().to_numpy(zero_copy_only=False)
                raw = [[None if null[i] else x[first[i] : first[i + 1]].astype(np.int32).tobytes() for i in range(to - at)] for x in (end - start, counts)]
                columns = [batch["doc_id"].slice(at, to - at), batch["text"].slice(at, to - at), *(pa.array(c, pa.binary()) for c in raw), pa.array(total, mask=null), pa.array(np.zeros(to - at, np.int64), mask=null)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "lengths", "counts", "n_tokens", "reencoded"])

    return run


def build_trees(docs: DataFrame, folder: str = P.TOKENIZERS, name: str = P.VOCABULARY) -> DataFrame:
    """Trees (doc_id, text, lengths, counts, n_tokens, reencoded) of documents, to be stored and then kept up by :func:`update_trees`.

    lengths and counts hold the characters and tokens of each pre-token, as 32-bit numbers; inner
    nodes are sums of them, and are made again in passing when a tree is edited. Null text: all null
    but doc_id. Repeated rows give a row each.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_built(folder, name), TREES)


def _updated(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = P.pieces(folder, name)
        for batch in batches:
            out = {c: batch[c].to_pylist() for c in ("text", "lengths", "counts", "n_tokens")}
            again: list[int | None] = [None if t is None else 0 for t in out["text"]]
            edits = batch["edits"]
            for i in np.flatnonzero((edits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0) & batch["text"].is_valid().to_numpy(zero_copy_only=False)).tolist():
                tree = TokenTree.load(out["text"][i], out["lengths"][i], out["counts"][i], cache)
                for c in edits[i].as_py():
                    if c is not None and c["pos"] is not None:
                        tree.edit(c["pos"], c["n_del"] or 0, c["ins"] or "")
                out["text"][i], out["lengths"][i], out["counts"][i] = tree.state()
                out["n_tokens"][i], again[i] = tree.count, tree.reencoded
            columns = [pa.array(out[c], k) for c, k in (("text", pa.string()), ("lengths", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(again, pa.int64())], names=["doc_id", "text", "lengths", "counts", "n_tokens", "reencoded"])

    return run


def update_trees(trees: DataFrame, edits: DataFrame, folder: str = P.TOKENIZERS, name: str = P.VOCABULARY) -> DataFrame:
    """Stored trees after edits (doc_id, seq, pos, n_del, ins): only edited ones are touched, and of them only what edits reach is encoded again.

    reencoded counts the pre-tokens that these edits had encoded again, 0 for other trees. See
    :func:`count_tokens` for what edits mean and :func:`with_edits` for their order.
    """
    rows = with_edits(trees.select("doc_id", "text", "lengths", "counts", "n_tokens"), edits)
    return rows.mapInArrow(_updated(folder, name), TREES)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """The documents with the column edits from rows (doc_id, seq, pos, n_del, ins), in the order of seq.

    Ties of seq go by pos, n_del and ins. Documents without edits have null; edits of unknown or null
    doc_id are dropped.
    """
    row = F.struct("seq", "pos", "n_del", "ins")
    lists = edits.groupBy(F.col("doc_id").alias("__of")).agg(F.sort_array(F.collect_list(row)).alias("__all"))
    joined = docs.drop("edits").join(lists, docs["doc_id"] == lists["__of"], "left")
    return joined.withColumn("edits", F.transform("__all", lambda e: F.struct(e["pos"].alias("pos"), e["n_del"].alias("n_del"), e["ins"].alias("ins")))).drop("__of", "__all")


def sample_edits(docs: DataFrame, number: int = 3) -> DataFrame:
    """The documents with so many edits each, at places and of kinds that hashes of doc_id give."""
    texts = F.array(*(F.lit(x) for x in ("", " edited", "'s", "\n\n", "12", "é, ")))
    h = lambda j, k: F.pmod(F.xxhash64("doc_id", j, F.lit(k)), F.lit(1 << 40))
    one = lambda j: F.struct((h(j, 1) % (F.length("text") + 1)).alias("pos"), (h(j, 2) % 12).alias("n_del"), F.element_at(texts, (h(j, 3) % 6 + 1).cast("int")).alias("ins"))
    return docs.withColumn("edits", F.transform(F.sequence(F.lit(1), F.lit(number)), one))
