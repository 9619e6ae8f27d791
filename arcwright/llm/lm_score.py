"""Language-model scores: masked pseudo-likelihood of a bidirectional window network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm._graph import keep
from arcwright.llm._text import Texts, Words, mix, slices

#: What the network predicts: the most frequent words of the whole corpus, and buckets of all others by how they begin. A bucket's
#: words share its probability as they occur in the corpus.
KNOWN, BUCKETS, BEGIN = 3840, 256, 2
WINDOW, DIM, HIDDEN = 2, 8, 16
#: Share of the words of every document that a round of training masks, and the rounds; together they mask every word once.
MASKED, ROUNDS = 0.5, 2
#: The most frequent words of the buckets, so many at most, have their shares broadcast; the others are joined.
SHARED = 400_000
#: Words of a shard. One shard is trained on by one task, and shards follow the corpus alone, not how rows are split.
SHARD = 4_000_000
STEP = 8192  # words that a step of training takes
#: A word's id is predicted as so many digits to this base, each with weights of its own for the digits before it.
_SIDE, _DIGITS = 16, "HML"
_BOUND = 4  # of the weights of digits, so that no exponent overflows
_SIZE = KNOWN + BUCKETS


def _buckets(words: Words) -> np.ndarray:
    return (words.hasher.ranges(words.start, np.minimum(words.start + BEGIN, words.end)) % np.uint64(BUCKETS)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for at, to in slices(batch["text"]):
            words = Texts.of(batch["text"], at, to).words()
            h, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            parts.append((h, _buckets(words)[first], n))
        if parts:
            h, b, n = (np.concatenate(x) for x in zip(*parts))
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(inverse, n, len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b[first]), pa.array(total)], names=["h", "b", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, b, n) of every word of the corpus: its hash, bucket and count over all documents."""
    return docs.select("text").mapInArrow(_count, "h bigint, b int, n bigint").groupBy("h").agg(F.min("b").alias("b"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, known: int = KNOWN, shared: int = SHARED) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], DataFrame]:
    """Hashes of the most frequent words, ties going to the lower hash; of the others the logarithm of a word's share of its bucket: (hashes, shares) of frequent ones, and (h, share) of the rest.

    Frequent are those of so many occurrences that at most ``shared`` words have as many.
    """
    top = [(r["h"], r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(known).collect()]
    h, n = top[-1] if top else (0, 0)
    rest = counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("h") > h)))
    sums = {r["b"]: r["all"] for r in rest.groupBy("b").agg(F.sum("n").alias("all")).collect()}  # at most BUCKETS rows
    table = np.array([sums.get(b, 1) for b in range(BUCKETS)], np.float64)
    levels = sorted(((r["n"], r["count"]) for r in rest.groupBy("n").count().collect()), reverse=True)  # different counts are few
    least, many = (levels[0][0] + 1 if levels else 1), 0
    for level, words in levels:
        many += words
        if many > shared:
            break
        least = level
    often = rest.where(F.col("n") >= least).select("h", "b", "n").toArrow()
    keys = often["h"].to_numpy()
    order = np.argsort(keys.view(np.uint64))
    share = np.log(often["n"].to_numpy() / table[often["b"].to_numpy()])[order]
    seldom = rest.where(F.col("n") < least).select("h", F.log(F.col("n") / F.element_at(F.array(*(F.lit(float(x)) for x in table)), F.col("b") + 1)).alias("share"))
    return np.array([x for x, _ in top], np.int64).view(np.uint64), (keys[order].view(np.uint64), share), seldom


class Ids:
    """Ids of words by a vocabulary; unknown words fall into buckets."""

    def __init__(self, known: np.ndarray):
        order = np.argsort(known)
        self.keys, self.ids = known[order], order.astype(np.int32)

    def __call__(self, words: Words) -> np.ndarray:
        ids = KNOWN + _buckets(words)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words.hash), len(self.keys) - 1)
            hit = self.keys[at] == words.hash
            ids[hit] = self.ids[at[hit]]
        return ids


def start(seed: int = 11) -> dict[str, np.ndarray]:
    """First weights: of words, of the hidden values, and of each digit (the last row is added to the others' sums)."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    m = {"E": (rng.standard_normal((_SIZE + 1, DIM)) * 0.3).astype(np.float32), "A": draw(2 * WINDOW * DIM, HIDDEN), "a": np.zeros(HIDDEN, np.float32)}
    for d, k in enumerate(_DIGITS):
        m[k] = draw(_SIDE**d, HIDDEN + 1, _SIDE) * np.float32(0.3 if d else 1)
        m[k][:, HIDDEN] = 0
    return m


def contexts(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ids of the WINDOW words before and behind each word of texts of so many words, and _SIZE beyond a text's ends."""
    n = len(ids)
    first = np.repeat(np.cumsum(count) - count, count)
    local = np.arange(n) - first
    left = np.repeat(count, count) - local
    out = np.full((n, 2 * WINDOW), _SIZE, np.int32)
    for j in range(1, WINDOW + 1):
        out[j:, WINDOW - j] = np.where(local[j:] >= j, ids[:-j], _SIZE) if n > j else _SIZE
        out[:-j, WINDOW + j - 1] = np.where(left[:-j] > j, ids[j:], _SIZE) if n > j else _SIZE
    return out


def _forward(m: dict[str, np.ndarray], context: np.ndarray, ids: np.ndarray):
    """Of words sorted by id: embeddings, hidden values and a one, the values of each digit's choices, places of those taken, and runs of words that share weights."""
    e = m["E"].take(context.ravel(), axis=0).reshape(len(ids), -1)
    z = np.ones((len(ids), HIDDEN + 1), e.dtype)
    hidden = e @ m["A"]
    hidden += m["a"]
    np.divide(hidden, np.abs(hidden) + 1, out=z[:, :HIDDEN])
    x = np.empty((len(_DIGITS), len(ids), _SIDE), e.dtype)
    chosen = np.empty((len(_DIGITS), len(ids)), np.int64)
    runs = []
    for d, k in enumerate(_DIGITS):
        before, digit = np.divmod(ids // _SIDE ** (len(_DIGITS) - 1 - d), _SIDE)
        np.add(np.arange(d * len(ids), (d + 1) * len(ids)) * _SIDE, digit, out=chosen[d])
        cut = np.searchsorted(before, np.arange(_SIDE**d + 1)).tolist()
        for g, (at, to) in enumerate(zip(cut, cut[1:])):
            if to > at:
                np.matmul(z[at:to], m[k][g], out=x[d, at:to])
                runs.append((d, k, g, at, to))
    return e, z, x, chosen, runs


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones((_SIDE, 1), x.dtype)


def log_probabilities(m: dict[str, np.ndarray], context: np.ndarray, ids: np.ndarray, step: int = 2 * STEP) -> np.ndarray:
    """Of each word, given the words on both sides."""
    out = np.empty(len(ids), np.float32)
    for i in range(0, len(ids), step):
        order = np.argsort(ids[i : i + step].astype(np.uint16), kind="stable") + i  # a radix sort
        _, _, x, chosen, _ = _forward(m, context[order], ids[order])
        taken = x.ravel()[chosen]
        out[order] = (taken - np.log(_sums(np.exp(x, out=x)))[:, :, 0]).sum(0)
    return out


def gradients(m: dict[str, np.ndarray], context: np.ndarray, ids: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of the mean negative log-probability of words sorted by id: of all weights but E, and (rows, values) of E."""
    e, z, x, chosen, runs = _forward(m, context, ids)
    np.exp(x, out=x)
    x /= _sums(x) * x.dtype.type(len(ids))
    x.reshape(-1)[chosen] -= x.dtype.type(1 / len(ids))
    grad = {k: np.zeros_like(m[k]) for k in _DIGITS}
    turned = {k: np.ascontiguousarray(m[k][:, :HIDDEN].transpose(0, 2, 1)) for k in _DIGITS}
    back = np.empty((len(_DIGITS), len(ids), HIDDEN), z.dtype)
    for d, k, g, at, to in runs:
        np.matmul(z[at:to].T, x[d, at:to], out=grad[k][g])
        np.matmul(x[d, at:to], turned[k][g], out=back[d, at:to])
    back = back.sum(0)
    back *= (1 - np.abs(z[:, :HIDDEN])) ** 2
    grad["A"], grad["a"] = e.T @ back, back.sum(0)
    flat = context.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    keys = flat[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return grad, (keys[first], np.add.reduceat((back @ m["A"].T).reshape(-1, DIM).take(order, axis=0), first, axis=0))


def _step(m, state, context, ids, rate=0.1):
    """Adagrad; what doesn't occur stays."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    grad, (rows, values) = gradients(m, context[order], ids[order])
    for k, g in grad.items():
        state[k] += g * g
        m[k] -= rate * g / np.sqrt(state[k])
        if k in _DIGITS:
            np.clip(m[k], -_BOUND, _BOUND, out=m[k])
    state["E"][rows] += values * values
    m["E"][rows] -= rate * values / np.sqrt(state["E"][rows])


def _pack(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def _unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    shapes = start()
    for k in sorted(shapes):
        size = shapes[k].size
        out[k] = flat[at : at + size].reshape(shapes[k].shape).astype(np.float32)
        at += size
    return out


def _chosen(ids: np.ndarray, count: np.ndarray, masked: float, turn: int) -> np.ndarray:
    """Positions that a round masks, by the words' ids and places alone; rounds take disjoint ones until all were masked."""
    if masked >= 1:
        return np.arange(len(ids))
    local = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
    chance = (mix((ids.astype(np.uint64) << np.uint64(32)) + local.astype(np.uint64)) >> np.uint64(40)).astype(np.int64)
    one = 1 << 24
    at, to = round(turn * masked * one), round((turn + 1) * masked * one)
    return np.flatnonzero((chance - at) % one < to - at)


def _encoded(known, often):
    """Rows (rid, doc_id, n_words, ids, inside, hs, ns) of documents: the ids of their words, the sum of the shares of frequent ones in buckets, and the hashes and counts of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(known.value)
        keys, shares = often.value
        for batch in batches:
            for at, to in slices(batch["text"]):
                words = Texts.of(batch["text"], at, to).words()
                ids = ids_of(words)
                other = np.flatnonzero(ids >= KNOWN)
                doc, h = np.repeat(np.arange(to - at), words.count)[other], words.hash[other]
                inside = np.zeros(to - at)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[place] == h
                    inside += np.bincount(doc[hit], shares[place[hit]], to - at)
                    doc, h = doc[~hit], h[~hit]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(h))).astype(np.int32)
                offsets = pa.array(np.searchsorted(doc[first], np.arange(to - at + 1)).astype(np.int32))
                ends = np.concatenate([[0], np.cumsum(words.count)]).astype(np.int32) * 2
                raw = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(np.int16).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch["rid"].slice(at, to - at), batch["doc_id"].slice(at, to - at), pa.array(words.count.astype(np.int64)), raw, pa.array(inside)]
                    + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[first].view(np.int64), n)],
                    names=["rid", "doc_id", "n_words", "ids", "inside", "hs", "ns"],
                )

    return run


def encode(docs: DataFrame, known, often, words: int, shard: int = SHARD) -> DataFrame:
    """Rows of the documents' word ids, in shards that hashes of doc_id and words give; rows of null doc_id by hash of their place."""
    rows = docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_encoded(known, often), "rid bigint, doc_id bigint, n_words bigint, ids binary, inside double, hs array<bigint>, ns array<int>")
    place = F.xxhash64(F.coalesce("doc_id", "rid"), "ids")
    return rows.withColumn("place", place).repartition(max(1, -(-words // shard)), "place").sortWithinPartitions("place", "rid").drop("place")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column one after another, and how many each has."""
    count = np.array([len(x) // 2 for x in column.to_pylist()], np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).astype(np.int32), count


def _local(model, masked: float, turn: int, size: int = STEP):
    """Trains on one shard from the common weights on; one row: positions seen and weights times positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = {k: v.copy() for k, v in model.value.items()}
        state = {k: np.full(v.shape, 1e-8, np.float32) for k, v in m.items()}
        seen, rest = 0, []
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids, count = _ids(batch["ids"].slice(at, 256))
                context = contexts(ids, count)
                chosen = _chosen(ids, count, masked, turn)
                seen += len(chosen)
                rest.append((context[chosen], ids[chosen]))
                if sum(len(x) for _, x in rest) >= size:
                    context, ids = (np.concatenate(x) for x in zip(*rest))
                    whole = len(ids) // size * size
                    for i in range(0, whole, size):
                        _step(m, state, context[i : i + size], ids[i : i + size])
                    rest = [(context[whole:], ids[whole:])]
        context, ids = (np.concatenate(x) for x in zip(*rest)) if rest else ([], [])
        if len(ids):
            _step(m, state, context, ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(_pack(m).astype(np.float64) * seen).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for k, w in zip(batch["n"].to_pylist(), batch["w"].to_pylist()):
            n, w = n + k, np.frombuffer(w, np.float32).astype(np.float64)
            total = w if total is None else total + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])


def train(rows: DataFrame, masked: float = MASKED, rounds: int = ROUNDS, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights after some rounds over all documents' ids.

    In each round every shard trains on ``masked`` of the words of each of its documents, from
    common weights on; the results, one set of weights a shard, are averaged in a tree of sums, so
    that what is gathered follows the corpus while no task holds more than two sets.
    """
    context = rows.sparkSession.sparkContext
    m = start(seed)
    for turn in range(rounds):
        parts = keep(rows.select("ids").mapInArrow(_local(context.broadcast(m), masked, turn), "n bigint, w binary"))
        many = parts.count()
        while many > 1:
            many = -(-many // 16)
            parts = parts.repartition(many).mapInArrow(_add, "n bigint, w binary")
        row = parts.first()
        if row is None:
            return m
        m = _unpack(np.frombuffer(row["w"], np.float32).astype(np.float64) / row["n"])
    return m


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = []
            for at in range(0, len(batch), 256):
                ids, count = _ids(batch["ids"].slice(at, 256))
                sums = np.concatenate([[0], np.cumsum(log_probabilities(model.value, contexts(ids, count), ids).astype(np.float64))])
                ends = np.cumsum(count)
                total.append(sums[ends] - sums[ends - count])
            total = np.concatenate(total or [np.zeros(0)]) + batch["inside"].to_numpy()
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], batch["n_words"], pa.array(total)], names=["rid", "doc_id", "n_words", "most"])

    return run


def score(docs: DataFrame, masked: float = MASKED, rounds: int = ROUNDS, seed: int = 11, shard: int = SHARD, shared: int = SHARED) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every document.

    log_likelihood is the sum over all words of the logarithm of their probability given the
    ``WINDOW`` words on either side, by a network that predicts the three digits of a word's id to base
    16, each with weights of its own for the digits before it. Ids are the ``KNOWN`` most frequent words and buckets of the others
    by their first ``BEGIN`` characters; the probability of a word in a bucket is the bucket's times
    the word's share of its occurrences, so that every word of the corpus has a probability of its
    own. Counts and training cover all documents.

    Null and empty texts have 0 words, 0 and null. Every row is scored by itself, repeated ones and
    null doc_ids too. Words of equal counts at the end of the vocabulary: the lower hash is in it.
    doc_ids must be numbers. Other columns are not carried. No rows: none.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = keep(word_counts(docs))
    top, often, shares = vocabulary(counts, shared=shared)
    context = docs.sparkSession.sparkContext
    rows = keep(encode(docs, context.broadcast(top), context.broadcast(often), counts.agg(F.sum("n")).first()[0] or 0, shard))
    model = context.broadcast(train(rows, masked, rounds, seed))
    words = rows.select("rid", F.explode(F.arrays_zip("hs", "ns")).alias("x")).select("rid", F.col("x.hs").alias("h"), F.col("x.ns").alias("n"))
    inside = words.join(shares, "h").groupBy("rid").agg(F.sum(F.col("n") * F.col("share")).alias("seldom"))
    scored = rows.select("rid", "doc_id", "n_words", "ids", "inside").mapInArrow(_scored(model), "rid bigint, doc_id bigint, n_words bigint, most double")
    scored = scored.join(inside, "rid", "left").withColumn("log_likelihood", F.col("most") + F.coalesce("seldom", F.lit(0.0)))
    return scored.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
