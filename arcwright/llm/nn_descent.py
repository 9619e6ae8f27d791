"""Embedding near duplicates by NN-descent: neighbour lists refined by joins with the neighbours' lists."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcwright.llm._graph import components, hot_join, keep

THRESHOLD, START, RECALL = 0.9, 10, 0.95
TABLES, BLOCK = 8, 256  # hash tables that give the first lists; vectors compared with each other there
PIVOTS, SAMPLE, ROUNDS = 12, 16, 12  # neighbours joined in a round, and taken of each; at most so many rounds
WIDE = 48  # both of the last for lists that grow
#: Vectors that the audit asks first (fourfold more each time), and vectors with a partner that it must meet, unless all are asked.
AUDIT, MET = 200, 200
#: Vectors that are compared with all others at once, in bytes.
ASKED_BYTES = 8 << 20
#: Vectors are broadcast up to so many bytes; beyond, they are joined to the candidate pairs.
BROADCAST_BYTES = 32 << 20
#: Classes and groups of equal vectors of so many are joined by broadcast; there are at most as many such as vectors divided by this.
HOT = 100_000
#: Share of representatives that a round of collapsing must remove for another to follow.
SHRINK = 0.02


def _unit(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    v = batch[column]
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1), np.float32)


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors (id, v) that have a direction, with length 1."""
    for batch in batches:
        v = batch["v"]
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x = v.flatten().to_numpy(zero_copy_only=False)  # null elements become NaN
        some = np.flatnonzero(size)
        row = np.repeat(some, size[some])
        first = (np.cumsum(size) - size)[some]
        most = np.zeros(len(v))
        if len(some):
            most[some] = np.maximum.reduceat(np.abs(x), first)
        ok = np.isfinite(most) & (most > 0)
        mine = ok[row]
        x, row = x[mine] / most[row[mine]], row[mine]
        length = np.sqrt(np.bincount(row, x * x, len(v)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[ok])]).astype(np.int32)), pa.array((x / length[row]).astype(np.float32)))
        yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(ok)), lists], names=["id", "v"])


def _reach(s: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """The largest cosine that members of two classes may have, from their representatives' and the sum of the classes' radii."""
    some = slack > 0
    if some.any():
        s[some] = np.cos(np.maximum(np.arccos(np.clip(s[some], -1, 1)) - slack[some], 0))
    return s


def _codes(first: int, tables: int, bits: int, radius: bool):
    """Rows (t, code, id, v): in each table, from the first on, the signs of the vector's products with some random directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch)
            if radius:
                x = x[:, :-1]
            for t in range(first, first + tables):
                planes = np.random.default_rng(1000 + t).standard_normal((x.shape[1], bits)).astype(np.float32)
                code = ((x @ planes > 0).astype(np.int64) << np.arange(bits)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), batch["id"], batch["v"]], names=["t", "code", "id", "v"])

    return run


def _tabled(nodes: DataFrame, first: int, tables: int, bits: int, radius: bool) -> DataFrame:
    """(id, v) of the nodes in the order of some tables; ranges, not hashes, are shuffled, so that a hot code is split."""
    codes = nodes.select("id", "v").mapInArrow(_codes(first, tables, bits, radius), "t int, code bigint, id bigint, v array<float>")
    return codes.repartitionByRange("t", "code", "id").sortWithinPartitions("t", "code", "id").select("id", "v")


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best partners of each i, those of equal s by lower j, each once."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    once = np.ones(len(i), bool)
    once[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])  # the same pair has the same s, but for rounding
    i, j, s = i[once], j[once], s[once]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], s[rank < k]


def _blocks(k: int):
    """The k best partners of each node among those next to it in a table's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch["id"].to_numpy(), _unit(batch)
            parts = []
            for at in range(0, len(ids), BLOCK // 2):  # overlapping, so that runs of equal codes meet
                own, y, r = ids[at : at + BLOCK], x[at : at + BLOCK, :-1], x[at : at + BLOCK, -1]
                if len(own) < 2:
                    continue
                s = _reach(y @ y.T, r[:, None] + r[None, :])
                s[own[:, None] == own[None, :]] = -2  # itself, also from another table
                n = min(k, len(own) - 1)
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                i, j, s = np.repeat(own, n), own[best].ravel(), np.take_along_axis(s, best, 1).ravel().astype(np.float32)
                real = s > -2
                parts.append((i[real], j[real], s[real]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(*map(np.concatenate, zip(*parts)), k)], names=["i", "j", "s"])

    return run


def _leads(tight: float):
    """The lowest id among those that are next to a vector in a table's order and so close to it, if lower than its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch["id"].to_numpy(), _unit(batch)
            for at in range(0, len(ids), BLOCK // 2):
                own, y = ids[at : at + BLOCK], x[at : at + BLOCK]
                low = np.where(y @ y.T >= tight, own[None, :], np.iinfo(np.int64).max).min(1)
                led = low < own
                yield pa.RecordBatch.from_arrays([pa.array(own[led]), pa.array(low[led])], names=["i", "j"])

    return run


def _close(tight: float):
    """Rows (id, rep, s) of those (id, rep, v, u) whose vectors are so close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.einsum("ij,ij->i", _unit(batch, "v"), _unit(batch, "u")).astype(np.float32)
            near = s >= tight
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(near)) for c in ("id", "rep")] + [pa.array(s[near])], names=["id", "rep", "s"])

    return run


def classes(vectors: DataFrame, n: int, bits: int, threshold: float = THRESHOLD, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """(id, rep, s) of the vectors that a representative of lower id stands for, and their cosine.

    That is at least the cosine of half the threshold's angle, so any two vectors of a class are
    linked. Groups of any size shrink to few representatives: in blocks of a table each vector
    points to the lowest id close to it, pointers are followed to their ends, and who isn't close to
    that end stays its own representative; this is repeated with those left while enough go.
    """
    tight = float(np.cos(np.arccos(threshold) / 2))
    members, reps, left, turn = None, vectors.select("id", "v"), n, 0
    tables = min(TABLES, _tables(bits, tight, recall))
    while left > 1:
        leads = _tabled(reps, 500 + turn * tables, tables, bits, False).mapInArrow(_leads(tight), "i bigint, j bigint").groupBy("i").agg(F.min("j").alias("j"))
        roots = components(leads.select(F.col("i").alias("a"), F.col("j").alias("b")))
        moved = roots.select("id", F.col("root").alias("rep"))
        if members is not None:
            to = roots.select(F.col("id").alias("rep"), "root").join(members.groupBy("rep").agg(F.count("*").alias("n")), "rep")
            moved = moved.unionByName(hot_join(members.select("id", "rep"), to, ["rep"], "n", hot).select("id", F.col("root").alias("rep")))
        moved = keep(moved)
        ends = keep(moved.groupBy("rep").agg(F.count("*").alias("n")).join(vectors.select(F.col("id").alias("rep"), F.col("v").alias("u")), "rep"))
        near = hot_join(moved.join(vectors.select("id", "v"), "id"), ends, ["rep"], "n", hot)
        near = near.select("id", "rep", "v", "u").mapInArrow(_close(tight), "id bigint, rep bigint, s float")
        near = keep(near)
        if members is not None:  # others stay, also those whose representative isn't close to its end
            near = keep(near.unionByName(members.join(near.select("id"), "id", "left_anti").join(near.select(F.col("id").alias("rep")), "rep", "left_anti").select("id", "rep", "s")))
        members = near
        now, turn = n - members.count(), turn + 1
        if now > (1 - SHRINK) * left:
            break
        left = now
        reps = vectors.select("id", "v").join(members.select("id"), "id", "left_anti")
    return members if members is not None else vectors.select("id", F.col("id").alias("rep"), F.lit(1.0).cast("float").alias("s")).limit(0)


def _products(shared):
    """Reaches of candidate lists with broadcast nodes: (i, js) to (i, j, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            js = batch["js"]
            i = np.repeat(batch["i"].to_numpy(), np.diff(js.offsets.to_numpy()))
            j = js.flatten().to_numpy()
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                yield _pairs(a, b, x[np.searchsorted(ids, a)], x[np.searchsorted(ids, b)])

    return run


def _pairs(a, b, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    s = _reach(np.einsum("ij,ij->i", x[:, :-1], y[:, :-1]), x[:, -1] + y[:, -1])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], names=["i", "j", "s"])


def _similar(candidates: DataFrame, nodes: DataFrame, shared) -> DataFrame:
    """(i, j, s) of candidates (i, js)."""
    if shared is not None:
        return candidates.mapInArrow(_products(shared), "i bigint, j bigint, s float")
    pairs = candidates.select("i", F.explode("js").alias("j"))
    x, y = (nodes.select(F.col("id").alias(n), F.col("v").alias("v" + n)) for n in "ij")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _pairs(b["i"], b["j"], _unit(b, "vi"), _unit(b, "vj"))

    return pairs.join(x, "i").join(y, "j").select("i", "j", "vi", "vj").mapInArrow(run, "i bigint, j bigint, s float")


def _choose(array: str, number, salt: int):
    """So many members of an array, chosen by hash."""
    order = F.transform(array, lambda j: F.struct(F.xxhash64(j, F.col("i"), F.lit(salt)).alias("h"), j.alias("j")))
    return F.transform(F.slice(F.array_sort(order), 1, number), lambda x: x["j"])


def _table(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Columns of a table whose size was checked; the last holds vectors."""
    got = rows.select(*columns).toArrow().combine_chunks()
    v = got[columns[-1]].combine_chunks()
    x = (v.flatten() if len(v) else pa.array([], pa.float32())).to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1), np.float32)
    return [*(got[c].to_numpy() for c in columns[:-1]), x]


def neighbour_graph(nodes: DataFrame, truth: DataFrame, n: int, width: int, threshold: float = THRESHOLD, start: int = START, recall: float = RECALL, rounds: int = ROUNDS, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, float]:
    """Neighbour lists (i, k, js, ss) of representatives (id, v), v a vector of length 1 and its class's radius, and the recall measured.

    Nodes are compared by the largest cosine that members of their classes may have. The first
    lists come from random-hyperplane tables, so many that a pair at the threshold shares a code
    with a probability of ``recall``: nodes next to each other in a table's order are compared.
    Then each round joins every node with lists of some of its neighbours, near and reverse ones,
    and keeps the best; of a node that very many list, as many are chosen by hash before lists are
    gathered. A list whose members all reach the threshold is saturated and grows fourfold. After
    each round the lists are held against the truth (i, ci, cj, n) of sampled vectors; rounds end
    when none is saturated and they hold ``recall`` of its links, by link and as the mean of its
    vectors. If they end without that, as many tables again are added, and rounds follow; when
    tables would cost more than comparing all vectors, lists are returned as they are.
    """
    spark = nodes.sparkSession
    shared = None
    if n * width * 4 <= broadcast_bytes:
        ids, x = _table(nodes, ["id", "v"])
        order = np.argsort(ids)
        shared = spark.sparkContext.broadcast((ids[order], x[order]))
    bits = _bits(n)
    best = F.reverse(F.array_sort(F.collect_list(F.struct("s", (-F.col("j")).alias("m")))))

    def listed(pairs: DataFrame, sizes: DataFrame | None) -> DataFrame:
        unique = pairs.groupBy("i", "j").agg(F.max("s").alias("s"))
        lists = unique.groupBy("i").agg(best.alias("all"))
        lists = lists.join(sizes, "i", "left").withColumn("k", F.coalesce("k", F.lit(start))) if sizes is not None else lists.withColumn("k", F.lit(start))
        lists = lists.withColumn("all", F.slice("all", 1, F.col("k")))
        full = (F.size("all") >= F.col("k")) & (F.element_at("all", -1)["s"] >= threshold)
        return keep(lists.select("i", F.when(full, F.col("k") * 4).otherwise(F.col("k")).alias("k"), full.alias("full"), F.transform("all", lambda x: -x["m"]).alias("js"), F.col("all.s").alias("ss")))

    def pairs_of(lists: DataFrame) -> DataFrame:
        return lists.select("i", F.explode(F.arrays_zip("js", "ss")).alias("x")).select("i", F.col("x.js").alias("j"), F.col("x.ss").alias("s"))

    def hashed(now: DataFrame | None, first: int, count: int) -> DataFrame:
        for at in range(first, first + count, TABLES):  # a few at a time, as each shuffles all vectors
            found = _tabled(nodes, at, min(TABLES, first + count - at), bits, True).mapInArrow(_blocks(start), "i bigint, j bigint, s float")
            now = listed(found, None) if now is None else listed(pairs_of(now).unionByName(found), now.select("i", "k"))
        return now

    tables = max(TABLES, _tables(bits, threshold, recall))
    now, measured, step = hashed(None, 0, tables), 0.0, 0
    while True:
        last = None
        for turn in range(rounds):
            wide = F.when(F.col("k") > start, F.lit(WIDE))
            near = now.select("i", F.explode(_choose("js", F.coalesce(wide, F.lit(PIVOTS)), 2 * step)).alias("j"))
            chance = F.row_number().over(W.partitionBy("j", "salt").orderBy(F.xxhash64("i", "j", F.lit(step))))
            back = near.withColumn("salt", F.pmod(F.xxhash64("i", F.lit(step)), F.lit(8))).withColumn("rank", chance).where(F.col("rank") <= WIDE // 8)
            links = near.unionByName(back.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
            lists = now.select(F.col("i").alias("j"), _choose("js", F.coalesce(wide, F.lit(SAMPLE)), 7 * step + 3).alias("next"))
            reach = links.join(lists, "j").groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("js"), F.collect_list("j").alias("direct"))
            known = now.select("i", F.col("js").alias("mine"))
            fresh = reach.join(known, "i").select("i", F.array_except(F.array_remove(F.array_union("js", "direct"), F.col("i")), "mine").alias("js"))
            pairs = _similar(fresh, nodes, shared)
            floor = now.select("i", F.when(F.size("js") >= F.col("k"), F.element_at("ss", -1)).otherwise(F.lit(-2.0)).alias("least"))
            pairs = pairs.join(floor, "i").where("s > least").drop("least")
            now = listed(pairs_of(now).unionByName(pairs), now.select("i", "k"))
            step += 1
            grown, size, mark = now.agg(F.sum(F.col("full").cast("int")), F.sum(F.size("js")), F.sum(F.aggregate("ss", F.lit(0.0), lambda a, x: a + x))).first()
            measured = _recall(now, truth, threshold)
            if not grown and measured >= recall and turn or last == (size, mark):
                break
            last = (size, mark)
        if measured >= recall or 4 * tables * BLOCK >= n:  # twice the tables, in each of which a node is compared with about two blocks
            break
        now, tables = hashed(now, tables, tables), 2 * tables
    logging.getLogger(__name__).info("recall %.4f with %d tables and %d rounds", measured, tables, step)
    return now.select("i", "k", "js", "ss"), measured


def _bits(n: int) -> int:
    return max(1, int(np.log2(n / 16))) if n > 32 else 1


def _tables(bits: int, threshold: float, recall: float) -> int:
    """Tables of which one at least has, with a probability of ``recall``, one code for both vectors of a pair at the threshold."""
    same = (1 - np.arccos(min(max(threshold, -1.0), 1.0)) / np.pi) ** bits
    if same >= 1 or recall <= 0:
        return 1
    return int(min(np.ceil(np.log(max(1 - recall, 1e-9)) / np.log1p(-max(same, 1e-9))), 1 << 10))


def _linked(lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of the lists' nodes whose classes may have linked members."""
    edges = lists.select("i", F.explode(F.arrays_zip("js", "ss")).alias("x")).where(F.col("x.ss") >= threshold)
    return edges.select(F.least("i", "x.js").alias("a"), F.greatest("i", "x.js").alias("b")).distinct()


def _recall(lists: DataFrame, truth: DataFrame, threshold: float) -> float:
    """Share of the true links that lie in one class or between classes that the lists hold, or the mean of the vectors' shares if that is less."""
    held = _linked(lists, threshold).withColumn("held", F.lit(1))
    own = truth.select("i", F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b"), "n").join(held, ["a", "b"], "left")
    own = own.groupBy("i").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("held").isNotNull() | (F.col("a") == F.col("b")), F.col("n")).otherwise(0)).alias("held"))
    pairs, vectors = own.agg(F.sum("held") / F.sum("all"), F.avg(F.col("held") / F.col("all"))).first()
    return 1.0 if pairs is None else min(pairs, vectors)


def _buckets(n: int) -> int:
    return -(-n // AUDIT)


def _audit(vectors: DataFrame, n: int, width: int, threshold: float) -> tuple[DataFrame, bool]:
    """Links (i, ci, cj, n) of a sample of the vectors in which ``MET`` have one, and whether the sample is all of them."""
    parts, met, at, to = [], 0, 0, 1
    while True:
        parts.append(keep(_partners(vectors, n, width, threshold, at, to)))
        met += parts[-1].select("i").distinct().count()
        if met >= MET or to == _buckets(n):
            return reduce(DataFrame.unionByName, parts), to == _buckets(n)
        at, to = to, min(4 * to, _buckets(n))


def _partners(vectors: DataFrame, n: int, width: int, threshold: float, at: int, to: int) -> DataFrame:
    """Links (i, ci, cj, n), by class, of the vectors in some buckets of about ``AUDIT``, compared with all others a part at a time."""
    step = max(1, ASKED_BYTES // (4 * width * AUDIT))
    bucket = F.pmod(F.xxhash64("id"), F.lit(_buckets(n)))
    parts = []
    for low in range(at, to, step):
        parts.append(_brute(vectors, _table(vectors.where((bucket >= low) & (bucket < min(low + step, to))), ["id", "rep", "v"]), threshold))
    return reduce(DataFrame.unionByName, parts)


def _brute(vectors: DataFrame, asked: list[np.ndarray], threshold: float) -> DataFrame:
    """Links (i, ci, cj, n) of the vectors asked for, by comparing with every vector; n counts equal ones of each."""
    context = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, reps, q = context.value
        for batch in batches:
            own, rep, w, x = batch["id"].to_numpy(), batch["rep"].to_numpy(), batch["w"].to_numpy(), _unit(batch)
            for at in range(0, len(ids) if len(own) else 0, 1024):
                s = q[at : at + 1024] @ x.T
                a, b = np.nonzero((s >= threshold) & (ids[at : at + 1024, None] != own[None, :]))
                key, inverse = np.unique(np.stack([a, rep[b]], 1), axis=0, return_inverse=True)
                total = np.bincount(inverse.ravel(), w[b], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + key[:, 0]]), pa.array(reps[at + key[:, 0]]), pa.array(key[:, 1].astype(np.int64)), pa.array(total)], names=["i", "ci", "cj", "n"])

    return vectors.select("id", "rep", "w", "v").mapInArrow(run, "i bigint, ci bigint, cj bigint, n bigint")


def _crossed(threshold: float):
    """Links (i, ci, cj, n) of members of one class with those of another, from pairs of blocks of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sides = [[batch[c + side] for c in ("ids", "ws", "vs")] for side in "ab"]
            offsets = [[np.concatenate([[0], np.cumsum(np.diff(c.offsets.to_numpy()))]) for c in side] for side in sides]
            flat = [[c.flatten().to_numpy(zero_copy_only=False) for c in side] for side in sides]
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            for k in range(len(batch)):
                (i, wi, x), (j, wj, y) = ([f[o[k] : o[k + 1]] for f, o in zip(fs, os)] for fs, os in zip(flat, offsets))
                hit = x.reshape(len(i), -1) @ y.reshape(len(j), -1).T >= threshold
                for ids, c, d, n in ((i, a[k], b[k], hit @ wj), (j, b[k], a[k], wi @ hit)):
                    some = np.flatnonzero(n)
                    out.append((ids[some], np.full(len(some), c), np.full(len(some), d), n[some]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["i", "ci", "cj", "n"])

    return run


def _between(vectors: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Links (i, ci, cj, n) between the members of pairs (a, b) of classes, in blocks of both, so that no pair of vectors is a row."""
    some = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sizes = vectors.groupBy("rep").agg(F.count("*").alias("m"))
    mine = hot_join(vectors.select("id", "rep", "w", "v"), some.join(sizes, "rep"), ["rep"], "m", HOT)
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK).cast("bigint"))
    blocks = mine.groupBy("rep", block.alias("block")).agg(F.collect_list(F.struct("id", "w", "v")).alias("x"))
    blocks = keep(blocks.select("rep", F.col("x.id").alias("ids"), F.col("x.w").alias("ws"), F.flatten("x.v").alias("vs")))
    a, b = (blocks.select(F.col("rep").alias(c), *(F.col(x).alias(x + c) for x in ("ids", "ws", "vs"))) for c in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(_crossed(threshold), "i bigint, ci bigint, cj bigint, n bigint")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, start: int = START, recall: float = RECALL, rounds: int = ROUNDS, broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """(vec_id, class_id, links) of every vec_id: the number of others whose cosine is at least ``threshold``, and the lowest vec_id that links lead to.

    Equal vectors are one from here on, with a weight. Vectors within half the threshold's angle of
    a representative are its class (see :func:`classes`): all of them are linked, which needs no
    comparing. Between classes, NN-descent over the representatives finds those that may have
    linked members (see :func:`neighbour_graph`), and blocks of their members are compared. So a
    group of m copies costs in proportion to m, and links are counted, not listed.

    The search is audited: a sample of vectors, which grows until ``MET`` of them have partners, is
    compared with all others. If that takes all vectors, or if the search can't reach ``recall`` of
    their links, all vectors are compared in blocks and the result is exact.

    Null or empty vectors, such with a null, NaN or infinite element or of length 0, and those whose
    dimension isn't the most common one (ties: the larger) have no links and are their own class.
    Null vec_ids are not listed. Rows of equal vec_id: the one of the greatest vector counts. vec_ids
    must be numbers. Which of a list's last places goes to one of equals depends on ids alone: the
    lower comes first. Other columns don't matter. No rows: none.
    """
    every = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null")
    ok = every.mapInArrow(_normal, "id bigint, v array<float>")
    ok = keep(ok.groupBy("id").agg(F.max("v").alias("v")))
    dim = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    ids = every.select(F.col("id").alias("vec_id")).distinct()
    if not dim:
        return ids.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    width = dim[0][0]
    ok = ok.where(F.size("v") == width).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    same = keep(ok.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v")))
    n = same.count()
    members = classes(same, n, _bits(n), threshold, recall, hot)
    vectors = keep(same.select("id", "w", "v").join(members.select("id", "rep"), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), "w", "v"))
    links, exact = _audit(vectors, n, width, threshold)
    if not exact:
        radius = members.groupBy(F.col("rep").alias("id")).agg(F.acos(F.least(F.min("s"), F.lit(1.0))).alias("r"))
        nodes = vectors.where("id = rep").select("id", "v").join(radius, "id", "left")
        nodes = keep(nodes.select("id", F.concat("v", F.array(F.coalesce("r", F.lit(0.0)).cast("float"))).alias("v")))
        graph, measured = neighbour_graph(nodes, links, nodes.count(), width + 1, threshold, start, recall, rounds, broadcast_bytes)
        if measured >= recall:
            within = vectors.groupBy(F.col("rep").alias("ci")).agg(F.sum("w").alias("all"))
            whole = hot_join(vectors.select("id", F.col("rep").alias("ci"), "w"), within.join(vectors.groupBy(F.col("rep").alias("ci")).agg(F.count("*").alias("m")), "ci"), ["ci"], "m", hot)
            inner = whole.select(F.col("id").alias("i"), "ci", F.col("ci").alias("cj"), (F.col("all") - F.col("w")).alias("n"))
            links = _between(vectors, keep(_linked(graph, threshold)), threshold).unionByName(inner)
        else:
            links = _partners(vectors, n, width, threshold, 0, _buckets(n))
    links = keep(links)
    roots = components(links.where("ci <> cj").select(F.col("ci").alias("a"), F.col("cj").alias("b")))
    whole = vectors.select(F.col("rep").alias("id"), F.col("id").alias("low")).groupBy("id").agg(F.min("low").alias("low")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lows = whole.join(whole.groupBy("root").agg(F.min("low").alias("class_id")), "root").select(F.col("id").alias("rep"), "class_id")
    lows = lows.join(vectors.groupBy("rep").agg(F.count("*").alias("m")), "rep")
    found = hot_join(vectors.select("id", "rep", "w"), lows, ["rep"], "m", hot)
    found = found.join(links.groupBy(F.col("i").alias("id")).agg(F.sum("n").alias("n")), "id", "left")
    found = same.select("id", "h1", "h2").join(found.select("id", "w", "class_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links")), "id").drop("id")
    found = hot_join(ok.select(F.col("id").alias("vec_id"), "h1", "h2"), keep(found), ["h1", "h2"], "w", hot).select("vec_id", "class_id", "links")
    return ids.join(found, "vec_id", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
