"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwright.llm._text import LETTER, NUMBER, OTHER, SPACE, Hasher, Texts, char_classes, slices

#: Labelled rows that training takes at most: of toxic, of low-quality and of clean documents.
SAMPLE = (2000, 2000, 5000)
PASSAGE = 32  # words of a passage
RARE, LEFT_OUT = 5, 0.15  # documents that a word must be in to count; share of words left out in training
THRESHOLD = 0.4  # of either probability; from it on a document is rejected
_BUCKETS, _DIM, _ATT, _FEATURES, _PREFIXES = 1 << 16, 24, 12, 9, (3, 4)


class Passages:
    """Passages of some texts: hashed words and word beginnings, where passages start, and their measures."""

    def __init__(self, texts: Texts):
        words = texts.words()
        n = len(words.hash)
        self.word = (words.hash % np.uint64(_BUCKETS)).astype(np.int32)
        stems = [words.hasher.ranges(words.start, np.minimum(words.start + k, words.end)) for k in _PREFIXES]
        stems = [(((h ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32) for k, h in zip(_PREFIXES, stems)]
        self.word = np.stack([self.word, *stems], 1)  # a row for each word: itself and its beginnings
        local = np.arange(n) - np.repeat(words.first, words.count)
        self.at = np.flatnonzero(local % PASSAGE == 0)  # first word of each passage
        self.count = -(-words.count // PASSAGE)  # passages of each text
        size = np.diff(np.concatenate([self.at, [n]]))
        begin = words.start[self.at]
        ends = np.concatenate([begin[1:], [len(texts.cps)]])
        last = np.cumsum(self.count)[self.count > 0] - 1
        ends[last] = texts.ends[self.count > 0]
        kinds = char_classes()[texts.cps]
        sums = np.zeros(len(kinds) + 1, np.int64)
        measures = []
        for mask in (kinds == OTHER, kinds == NUMBER, kinds == SPACE, texts.cps == 0x0A, (kinds == LETTER) & (texts.cps != words.low)):
            np.cumsum(mask, out=sums[1:])
            measures.append((sums[ends] - sums[begin]) / np.maximum(ends - begin, 1))
        measures.append((words.end[np.minimum(self.at + size - 1, n - 1)] - begin) / np.maximum(size, 1) / 10 if n else np.zeros(0))
        for lag in (1, 2):
            same = np.zeros(n + 1, np.int64)
            if n > lag:
                same[lag + 1 :] = np.cumsum((words.hash[lag:] == words.hash[:-lag]) & (local[lag:] >= lag))
            measures.append((same[self.at + size] - same[self.at]) / np.maximum(size, 1))
        measures.append(size / PASSAGE)
        self.measures = np.stack(measures, 1).astype(np.float32) if n else np.zeros((0, _FEATURES), np.float32)


def _start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "E": draw(_BUCKETS, _DIM, scale=0.02), "F": draw(_FEATURES, _DIM, scale=0.5), "b": np.zeros(_DIM, np.float32),
        "V": draw(_DIM, _ATT, scale=0.3), "U": draw(_DIM, _ATT, scale=0.3), "w": draw(_ATT, scale=0.5),
        "O": draw(_DIM, 2, scale=0.3), "c": np.zeros(2, np.float32),
    }


_SCALE = np.float32(0.35)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at, axis=0) if len(at) else np.zeros((0, *x.shape[1:]), x.dtype)


def _forward(m: dict[str, np.ndarray], word: np.ndarray, at: np.ndarray, measures: np.ndarray, doc_at: np.ndarray) -> dict[str, np.ndarray]:
    """doc_at: first passage of each document; each has one at least."""
    hidden = np.tanh(sum(_sums(m["E"][x], at) for x in word.T) * _SCALE + measures @ m["F"] + m["b"])
    t, g = np.tanh(hidden @ m["V"]), 1 / (1 + np.exp(-(hidden @ m["U"])))
    a = (t * g) @ m["w"]
    doc = np.repeat(np.arange(len(doc_at)), np.diff(np.concatenate([doc_at, [len(at)]])))
    e = np.exp(a - np.maximum.reduceat(a, doc_at)[doc])
    weight = e / np.add.reduceat(e, doc_at)[doc]
    z = _sums(hidden * weight[:, None], doc_at)
    p = 1 / (1 + np.exp(-(z @ m["O"] + m["c"])))
    return {"hidden": hidden, "t": t, "g": g, "doc": doc, "weight": weight, "z": z, "p": p}


def _step(m, state, batch, y, weights, rate):
    word, at, measures, doc_at = batch
    f = _forward(m, *batch)
    d = (f["p"] - y) * weights / len(y)  # of the logits
    grad = {"O": f["z"].T @ d, "c": d.sum(0)}
    dz = (d @ m["O"].T)[f["doc"]]
    dh = dz * f["weight"][:, None]
    s = (dz * f["hidden"]).sum(1)
    da = f["weight"] * (s - np.add.reduceat(f["weight"] * s, doc_at)[f["doc"]])
    tg = f["t"] * f["g"]
    grad["w"] = tg.T @ da
    dtg = da[:, None] * m["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * tg * (1 - f["g"])
    grad["V"], grad["U"] = f["hidden"].T @ dt, f["hidden"].T @ dg
    dh += dt @ m["V"].T + dg @ m["U"].T
    dx = dh * (1 - f["hidden"] ** 2)
    grad["F"], grad["b"] = measures.T @ dx, dx.sum(0)
    for k, v in grad.items():  # Adam
        s1, s2 = state[k]
        s1 += (v - s1) * 0.1
        s2 += (v * v - s2) * 0.01
        m[k] -= rate * (s1 / (np.sqrt(s2) + 1e-6)).astype(np.float32)
    passage = np.repeat(np.arange(len(at)), np.diff(np.concatenate([at, [len(word)]])))
    rows = word.T.ravel()
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    g = np.add.reduceat(dx[np.tile(passage, word.shape[1])[order]] * _SCALE, first, axis=0)
    rows, g = rows[first], g * (rows[first] > 0)[:, None]
    state["E"][rows] += g * g  # Adagrad on the rows that occur
    m["E"][rows] -= 0.1 * g / (np.sqrt(state["E"][rows]) + 1e-6)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, size: int = 64, seed: int = 7) -> dict[str, np.ndarray]:
    """Model from documents (word, at, measures) and their labels (low quality, toxic; 0 or 1)."""
    m = _start(seed)
    seen = np.zeros(_BUCKETS, np.int32)  # documents that have each bucket
    for r in rows:
        seen[np.unique(r[0])] += 1
    known = seen >= RARE
    known[0] = False  # the empty bucket
    m["E"] *= known[:, None]
    state = {k: (np.zeros(v.shape, np.float32), np.zeros(v.shape, np.float32)) for k, v in m.items() if k != "E"} | {"E": np.full(m["E"].shape, 1e-4, np.float32)}
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), size):
            part = [rows[j] for j in order[i : i + size]]
            words = np.cumsum([0, *(len(r[0]) for r in part)])
            at = np.concatenate([r[1] + w for r, w in zip(part, words)])
            doc_at = np.cumsum([0, *(len(r[1]) for r in part)])[:-1]
            word = np.concatenate([r[0] for r in part]).astype(np.int32)
            word[~known[word] | (rng.random(word.shape) < LEFT_OUT)] = 0  # rare or left out by chance: the empty bucket
            batch = (word, at, np.concatenate([r[2] for r in part]), doc_at)
            _step(m, state, batch, labels[order[i : i + size]], np.float32(1), 0.01 * 0.6**epoch)
    m["E"][0] = 0
    return m


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(batch["text"]):
            p = Passages(Texts.of(batch["text"], at, to))
            cut = np.cumsum(np.concatenate([[0], p.count]))
            word_cut = np.concatenate([p.at, [len(p.word)]])[cut]
            columns = [[], [], []]
            for i in range(to - at):
                a, b, x, y = word_cut[i], word_cut[i + 1], cut[i], cut[i + 1]
                for column, v in zip(columns, (p.word[a:b].astype(np.uint16), (p.at[x:y] - a).astype(np.int32), p.measures[x:y])):
                    column.append(v.tobytes())
            rest = [batch[c].slice(at, to - at) for c in ("low", "toxic", "rank")]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, pa.binary()) for c in columns)], names=["low", "toxic", "rank", "word", "at", "measures"])


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int, int] = SAMPLE, epochs: int = 6, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Model from labelled documents, None without any that has words.

    Of each kind (toxic, low quality, clean) at most ``sample`` rows are taken, those of lowest hash
    of doc_id; only they come to the driver, as hashed words. Several labels of one document: the
    worst counts. A null label counts as quality 1, toxic 0. Repeated documents count once each.
    """
    y = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    y = y.agg((F.coalesce(F.min("quality"), F.lit(1)) < 1).cast("int").alias("low"), (F.coalesce(F.max("toxic"), F.lit(0)) > 0).cast("int").alias("toxic"))
    y = y.withColumn("rank", F.xxhash64("doc_id"))
    kinds = (F.col("toxic") == 1, (F.col("toxic") == 0) & (F.col("low") == 1), (F.col("toxic") == 0) & (F.col("low") == 0))
    chosen = None
    for kind, n in zip(kinds, sample):
        part = y.where(kind).orderBy("rank", "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    joined = texts.join(F.broadcast(chosen), "doc_id").select("text", "low", "toxic", "rank")  # at most sum(sample) rows
    rows = joined.mapInArrow(_features, "low int, toxic int, rank bigint, word binary, at binary, measures binary").collect()
    rows = sorted((r for r in rows if r["word"]), key=lambda r: (r["rank"], bytes(r["word"])))
    if not rows:
        return None
    labels = np.array([(r["low"], r["toxic"]) for r in rows], np.float32)
    parts = []
    for r in rows:  # views, not copies: with all samples the driver holds them once
        parts.append((np.frombuffer(r["word"], np.uint16).reshape(-1, 1 + len(_PREFIXES)), np.frombuffer(r["at"], np.int32), np.frombuffer(r["measures"], np.float32).reshape(-1, _FEATURES)))
    return train(parts, labels, epochs, seed=seed)


def predict(m: dict[str, np.ndarray] | None, texts: Texts) -> np.ndarray:
    """Probabilities of low quality and of toxicity, to 5 decimals, as a text's neighbours in a batch may change the next; 1 and 0 without words."""
    out = np.zeros((texts.n, 2))
    out[:, 0] = 1
    if m is None:
        return np.zeros((texts.n, 2))
    p = Passages(texts)
    some = np.flatnonzero(p.count)
    if len(some):
        doc_at = (np.cumsum(p.count) - p.count)[some]
        out[some] = np.round(_forward(m, p.word, p.at, p.measures, doc_at)["p"], 5)
    return out


def _apply(model, threshold: float | None, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(text_at)):
                part = batch.slice(at, to - at)
                p = predict(model.value, Texts.of(batch.column(text_at), at, to))
                if threshold is not None:
                    yield part.filter(pa.array(p.max(1) < threshold))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*part.schema.names, "low_quality", "toxicity"])

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """The documents with low_quality and toxicity, the probabilities that their passages give.

    A text without words, null included, has 1 and 0. Without a model (no labels) both are 0. Columns
    of these names are replaced, all others stay; every row is scored by itself. No rows: none.
    """
    docs = docs.drop("low_quality", "toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("low_quality", T.DoubleType()), T.StructField("toxicity", T.DoubleType())])
    return docs.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model), None, docs.columns.index("text")), schema)


def keep(docs: DataFrame, model: dict[str, np.ndarray] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, of which both probabilities are under the threshold; see :func:`score`."""
    return docs.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model), threshold, docs.columns.index("text")), T.StructType(docs.schema.fields))
