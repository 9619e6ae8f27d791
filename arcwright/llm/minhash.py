"""Near duplicates by bands of minimal hashes, estimates from all of them and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.llm._graph import components, keep
from arcwright.llm._text import Texts, grams, mix, slices

SHINGLE, THRESHOLD = 3, 0.5
#: Minimal hashes to a band, and the chance that two sets of just the threshold agree in no band; of a Jaccard similarity by 0.1
#: higher than 0.5 it is below one in a hundred million.
ROWS, MISS = 3, 2.5e-5
#: Standard deviations by which the share of equal minimal hashes may stay below what the threshold lets expect (a chance of 3 in 100 000).
SLACK = 4.0
#: Members of a list that one task pairs with all others of it.
HOT = 2000
#: Ids whose texts are verified are broadcast up to so many rows, to shuffle no other text; beyond, joined.
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 63-bit hashes of the word shingles of each text; a shorter text is one shingle, none without words."""
    t = Texts(texts)
    words = t.words()
    h = grams(words.hash, size) >> np.uint64(1)
    for first, count in zip(words.first.tolist(), words.count.tolist()):
        if count >= size:
            yield np.unique(h[first : first + count - size + 1])
        else:
            yield grams(words.hash[first : first + count], count)[:1] >> np.uint64(1)


@lru_cache
def _bands(threshold: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of bands, and for each hash function what is added by exclusive or and the odd factor; functions beyond the bands fill up the marks."""
    bands = max(80, math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))) if threshold < 1 else 80
    n = -(-bands * ROWS // 64) * 64
    rng = np.random.default_rng(9)
    return bands, rng.integers(0, 1 << 32, (n, 1), np.uint32), rng.integers(0, 1 << 32, (n, 1), np.uint32) | np.uint32(1)


def _least(s: np.ndarray, threshold: float) -> np.ndarray:
    """Minimum of each hash function over a set; two sets agree in one with a chance of their Jaccard similarity."""
    _, other, factor = _bands(threshold)
    x = (s >> np.uint64(20)).astype(np.uint32)
    return np.min([((x[at : at + 512] ^ other) * factor).min(axis=1) for at in range(0, len(x), 512)], axis=0)


def band_keys(least: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of minima -> 32 bits of each band. Bands that fall together by chance only let a pair through to the marks."""
    bands = _bands(threshold)[0]
    key = np.zeros((len(least), bands), np.uint64)
    for i in range(ROWS):
        key = mix(key + least[:, i : bands * ROWS : ROWS])
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def marks(least: np.ndarray) -> np.ndarray:
    """Rows of minima -> four bits of each; a number holds one of the four for 64 minima, and four numbers in turn hold them all."""
    four = (least * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8).reshape(len(least), -1, 1, 64)
    planes = (four >> np.arange(4, dtype=np.uint8)[:, None]) & np.uint8(1)
    return np.packbits(planes, axis=-1).view(np.int64).reshape(len(least), -1)


def least_equal(threshold: float) -> int:
    """Minima whose marks must be equal: fewer are left to chance at the threshold (see SLACK). Unequal minima have equal marks once in 16."""
    n, share = len(_bands(threshold)[1]), threshold + (1 - threshold) / 16
    return math.floor(n * share - SLACK * math.sqrt(n * share * (1 - share)))


def _alike(x: str, y: str, threshold: float) -> Column:
    """That enough marks of two columns are equal. It is kept short: the JVM doesn't compile long methods."""
    n, unequal = len(_bands(threshold)[1]), F.lit(0)
    for i in range(0, n // 16, 4):
        a, b, c, d = (F.get(x, F.lit(j)).bitwiseXOR(F.get(y, F.lit(j))) for j in range(i, i + 4))
        unequal = unequal + F.bit_count(a.bitwiseOR(b).bitwiseOR(c).bitwiseOR(d))
    return unequal <= n - least_equal(threshold)


def _sketches(size: int, threshold: float, sums_only: bool):
    """id, s1, s2 of each text with words: sums that stand for its set. Without ``sums_only`` also the set's size, the keys of its bands and its marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for at, to in slices(batch["text"]):
                keys, sums, least = [], [], []
                for key, s in zip(ids[at:to].tolist(), shingle_sets(batch["text"].slice(at, to - at).to_pylist(), size)):
                    if len(s):
                        keys.append(key)
                        sums.append((mix(s).sum(), mix(~s).sum() + np.uint64(len(s)), np.uint64(len(s))))
                        if not sums_only:
                            least.append(_least(s, threshold))
                if keys:
                    sums = np.array(sums, np.uint64).view(np.int64)
                    found = {"id": pa.array(keys, pa.int64()), "s1": pa.array(sums[:, 0]), "s2": pa.array(sums[:, 1])}
                    if not sums_only:
                        found["size"] = pa.array(sums[:, 2])
                        for name, x in (("bands", band_keys(np.array(least), threshold)), ("marks", marks(np.array(least)))):
                            found[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_pydict(found)

    return run


def _jaccard(size: int, threshold: float):
    """Rows sorted by leader, the leader's own first: (a, b) of each member at least that similar to its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            for at, to in slices(batch["text"]):
                part = batch.slice(at, to - at)
                a, b = [], []
                for g, key, s in zip(part["g"].to_pylist(), part["id"].to_pylist(), shingle_sets(part["text"].to_pylist(), size)):
                    if g == key:
                        leader, own = g, s
                    elif g == leader:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if both >= threshold * (len(own) + len(s) - both):
                            a.append(g)
                            b.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(likely: DataFrame, texts: DataFrame, size: int, threshold: float, broadcast_ids: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold."""
    roles = likely.select(F.col("b").alias("id"), F.col("a").alias("g")).unionByName(likely.select(F.col("a").alias("id"), F.col("a").alias("g")).distinct())
    wanted = roles.select("id").distinct()
    texts = texts.join(F.broadcast(wanted) if likely.count() <= broadcast_ids // 2 else wanted, "id", "left_semi")
    rows = roles.join(texts, "id").repartition("g").sortWithinPartitions("g", (F.col("id") != F.col("g")), "id")
    return rows.select("g", "id", "text").mapInArrow(_jaccard(size, threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, broadcast_ids: int = BROADCAST_IDS, hot: int = HOT) -> DataFrame:
    """(doc_id, kept_id) of every document that is a near duplicate; kept_id is the lowest doc_id of its group.

    Groups are the connected components of pairs whose sets of ``size``-word shingles (lower case,
    punctuation left out) have a Jaccard similarity of at least ``threshold``.

    1. Each document gets the minima of 256 hash functions over its shingles, 240 of them in 80 bands of
       three (more below a threshold of 0.5). Equal whole sets (128-bit sums) are one node from here on, so
       thousands of exact copies cost as much as one.
    2. Lists of the nodes that agree in a band. Shingles that unrelated texts have in common hardly
       matter here: of similarity j they agree in a band with a chance of j³, so lists stay short as
       the corpus grows, but for those of similar texts.
    3. Every node is paired with the lowest node of each of its lists, estimated from four bits of each
       minimum and verified on the exact sets. Then all pairs of a list that lie in different
       components so far: pairs within a component can't change the result. So a group of m edited
       copies costs in proportion to m, and no list is cut off; pairs of a list are compared as they are
       joined, so that only likely ones are written. A list of more than ``hot`` nodes is split over
       tasks. Pairs are only lost by chance: 1 in 10 000 at the threshold (MISS, SLACK), far fewer above.

    A text without words, null included, has no duplicates; one of fewer than ``size`` words is one
    shingle. Null doc_ids are not compared. Rows of equal doc_id are one document, of which any row
    that matches counts. Ties go to the lowest doc_id. Other columns don't matter. No rows: none.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    rows = texts.mapInArrow(_sketches(size, threshold, False), "id bigint, s1 bigint, s2 bigint, size bigint, bands array<int>, marks array<bigint>")
    nodes = rows.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "bands", "marks")))
    nodes = keep(nodes)
    # reading the texts again for these two sums costs less than keeping all minima twice
    sums = texts.mapInArrow(_sketches(size, threshold, True), "id bigint, s1 bigint, s2 bigint")
    copies = nodes.where("n > 1").select("s1", "s2", "rep").join(sums, ["s1", "s2"]).where("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    values = nodes.select("rep", F.posexplode("bands")).select((F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("col")).alias("v"), "rep").repartition("v")
    common = values.groupBy("v").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("v", "head")
    # shuffled once more, as few large files: to write each, an executor may start processes (chmod), which count with all of its memory until they run
    lists = keep(values.join(common.hint("shuffle_hash"), "v").select("v", "rep", "head").repartition("rep"))

    fits = F.least("x_size", "y_size") >= threshold * F.greatest("x_size", "y_size")  # a set can't be that similar to one that much larger
    alike = fits & _alike("x", "y", threshold)
    stars = lists.where("rep > head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    left, right = (nodes.select(F.col("rep").alias(r), F.col("size").alias(c + "_size"), F.col("marks").alias(c)) for r, c in (("a", "x"), ("b", "y")))
    stars = keep(stars.join(left, "a").join(right, "b").where(alike).select("a", "b"))
    roots = components(_verified(stars, texts, size, threshold, broadcast_ids))

    labelled = lists.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("v", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = labelled.groupBy("v").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count("*") / hot).alias("parts")).where("r0 < r1").select("v", "parts")
    mixed = keep(labelled.join(mixed, "v").join(nodes.select("rep", "size", "marks"), "rep"))
    x, y = (mixed.select("v", part, F.col("rep").alias(r), F.col("root").alias(r + "_root"), F.col("size").alias(c + "_size"), F.col("marks").alias(c))
            for r, c, part in (("p", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ("q", "y", F.pmod(F.hash("rep"), F.col("parts")).alias("part"))))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, so that few bytes but many pairs aren't brought together
    x, y = (side.repartition(tasks, "v", "part") for side in (x, y))
    across = x.join(y, ["v", "part"]).where(F.col("p_root") < F.col("q_root")).where(alike).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    across = keep(across.join(stars, ["a", "b"], "left_anti"))
    found = copies.unionByName(roots.select(F.col("root").alias("a"), F.col("id").alias("b")))  # components so far stand for the stars' pairs
    if across.limit(1).count():
        found = found.unionByName(_verified(across, texts, size, threshold, broadcast_ids))
    groups = components(found)
    return groups.select(F.col("id").alias("doc_id"), F.col("root").alias("kept_id"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, broadcast_ids: int = BROADCAST_IDS, hot: int = HOT) -> DataFrame:
    """The documents, with all their columns, without those that :func:`near_duplicates` lists."""
    gone = keep(near_duplicates(docs, threshold, size, broadcast_ids, hot).select(F.col("doc_id").alias("__gone")))
    few = gone.count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("bigint") == gone["__gone"], "left_anti")
