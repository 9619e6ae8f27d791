import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from arcwright.llm import _pretok as P
from arcwright.llm import _text as T
from arcwright.llm import bpe, decontaminate, line_dedup, secrets, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=P.read_ranks(), special_tokens={})
MIXED = st.text(st.sampled_from(list("ab Zé1٣'\n\t 　!?-_sdtrevml.中文🙂")), max_size=60)


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, max_size=4))
def test_boundaries_are_those_of_the_pattern(texts):
    t = T.Texts(texts)
    start, end, first = P.split(t)
    for i, x in enumerate(texts):
        found = [(a - t.starts[i], b - t.starts[i]) for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
        assert found == [m.span() for m in regex.finditer(P.PATTERN, x)]


@settings(max_examples=200, deadline=None)
@given(st.one_of(MIXED, st.text(st.sampled_from("a'"), max_size=200)), st.integers(9, 40), st.integers(4, 8))
def test_stitching_gives_the_whole_split(text, chunk, overlap):
    step = chunk - overlap
    chunks = [(k * step, min(k * step + chunk, len(text)), bpe.pretokenise_chunk(text[k * step : k * step + chunk])) for k in range(max(1, -(-(len(text) - overlap) // step)))]
    assert list(bpe.stitch(text, chunks)) == [m.start() for m in regex.finditer(P.PATTERN, text)]


def test_words():
    w = T.Texts(["Ab c1, É d", None, "", "x y"]).words()
    assert ["".join(map(chr, w.low[a:b])) for a, b in zip(w.start, w.end)] == ["ab", "c1", "é", "d", "x", "y"] and list(w.count) == [4, 0, 0, 2]
    assert T.Texts(["É d"]).words().hash[0] == w.hash[2]


def test_encoding(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["the ", "a", "\n\n", "'re", "  ", "Ünï "]) for _ in range(3000))
    texts = ["Hello world's end", "", None, long, "a" * 5000, "x", "x"]
    frame = docs(spark, texts).unionByName(spark.createDataFrame([(None, "y z", "en", "s", 3)], DOCS)).withColumnRenamed("lang", "token_ids")
    rows = bpe.encode(frame, chunk=700, overlap=50).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r["token_ids"], r["n_tokens"], r["round_trip"]) == ((None,) * 3 if t is None else (ENC.encode_ordinary(t), len(ENC.encode_ordinary(t)), True))
    assert by[None]["token_ids"] == ENC.encode_ordinary("y z")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(frame, chunk=700, overlap=50)).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert bpe.encode(docs(spark, [])).collect() == [] and bpe.decode(bpe.encode(docs(spark, []))).collect() == []


def _peak(run):
    """MB that a call takes at most, and what it returns."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_encoding_takes_memory_for_a_part_not_for_the_batch_or_text():
    rng = np.random.default_rng(5)
    words = ["the", "cat's", " sat", "1234", "über", "\n\n", "x" * 9, "..."]
    text = " ".join([*(words[i] for i in rng.integers(0, 8, 200_000)), "y" * 300_000, *(words[i] for i in rng.integers(0, 8, 200_000))])
    known = list(bpe._encode([text], P.pieces(P.TOKENIZERS, P.VOCABULARY))[0])  # fills the caches
    size, overlap = 1 << 16, 1 << 10
    at = list(range(0, len(text) - overlap, size - overlap))
    chunks = [text[a : a + size] for a in at]
    batch = pa.RecordBatch.from_pydict({"doc_id": at, "text": chunks})
    rows, peak = _peak(lambda: [r.num_rows for r in bpe._batches(iter([batch]), P.TOKENIZERS, P.VOCABULARY)])
    assert sum(rows) == len(at) and peak < 16
    named = pa.RecordBatch.from_pydict({"no": range(len(at)), "chunk": chunks})
    parts, peak = _peak(lambda: list(bpe._chunk_bounds(iter([named]))))
    assert len(parts) > 1 and peak < 16
    assert [(n, s) for p in parts for n, s in zip(p["no"].to_pylist(), p["starts"].to_pylist())] == [(i, bpe.pretokenise_chunk(c).tolist()) for i, c in enumerate(chunks)]
    starts = pa.concat_arrays([p["starts"] for p in parts])
    table = pa.table({"doc_id": [7] * len(at), "no": range(len(at)), "at": at, "chunk": chunks, "starts": starts})
    row, peak = _peak(lambda: bpe._stitched(P.TOKENIZERS, P.VOCABULARY, overlap)(table))
    assert row.to_pylist() == [{"doc_id": 7, "token_ids": known, "n_tokens": len(known), "round_trip": True}] and peak < 60


def _brute_lines(texts, window=3):
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append((None, 0))
            continue
        pieces = []  # (key, text), blank lines with the line before them
        for line in re.findall(r"[^\n]*\n|[^\n]+", t):
            if line.strip() or not pieces:
                pieces.append([line.strip(), line])
            elif pieces:
                pieces[-1][1] += line
            if len(pieces) > 1 and not pieces[0][0]:
                pieces[:2] = [[pieces[1][0], pieces[0][1] + pieces[1][1]]]
        pieces = [p for p in pieces if p[0]]
        gone = set()
        for i in range(len(pieces) - window + 1):
            w = tuple(k for k, _ in pieces[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out.append((t if not gone else "".join(x for k, (_, x) in enumerate(pieces) if k not in gone), len(gone)))
    return out


@pytest.mark.parametrize("hot", [10**6, 3])
def test_line_dedup(spark, hot):
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(rng.randint(1, 6))) for _ in range(12)] + ["}", "\u3000é. x, y; z", "- a"]
    texts = [None, "", "one\ntwo\nthree", "\n\n", "x " * 30000, "a line\n" * 7000, " \n\t\n}\n}\n}\n}"]
    texts += ["".join(rng.choice(["", "", "\n", " \n\n"]) + rng.choice(pool) + rng.choice(["\n", "\n", " \n", "\n\n", "\r\n", ". "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [texts[10], texts[11] + "\nnew end", "\n \n" + texts[12]]
    frame = docs(spark, texts).withColumnRenamed("source", "removed_lines").withColumnRenamed("lang", "w")
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame, hot=hot).collect()}
    assert [(rows[i]["text"], rows[i]["removed_lines"]) for i in range(len(texts))] == _brute_lines(texts)
    assert rows[len(texts) - 3]["text"] == "" and rows[5]["removed_lines"] == 6999 and rows[6]["removed_lines"] == 3
    body = "first line here\nsecond\n3\n"
    ties = spark.createDataFrame([(1, body), (1, body), (None, body), (2, body), (3, body + "tail")], "doc_id bigint, text string")
    found = sorted((r["doc_id"] or 9, r["text"]) for r in line_dedup.dedup_lines(ties, hot=hot).collect())
    assert found == [(1, body), (1, body), (2, ""), (3, "tail"), (9, "")]
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []
    sentences = "One sentence. Another one, with a clause; a third. A fourth: the end."
    assert [r["removed_lines"] for r in line_dedup.dedup_lines(docs(spark, [sentences, sentences])).collect()] == [0, 0]  # one line


def _item(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, limit):
    a, b, c = _item(20, 1), _item(5, 2), _item(30, 3)
    bench = spark.createDataFrame([(1, a), (2, b), (2, b), (3, c), (4, None), (5, ""), (6, "one two"), (None, _item(9, 8))], "item_id bigint, text string")
    clean = _item(200, 4)
    shouted = a.upper().replace(" ", " -- ")
    texts = [clean, f"{clean}\n{a}. {clean}", f"{_item(3, 5)} {shouted}", b, None, "", f"{clean} one two {clean}", " ".join(a.split()[:7]) + " " + clean, f"{clean} {b}! {' '.join(c.split()[4:15])}, {clean}", clean, _item(50000, 9)]
    frame = docs(spark, texts).withColumnRenamed("lang", "items")
    report = {r["doc_id"]: r for r in decontaminate.contaminated(frame, bench, broadcast_chars=limit).collect()}
    assert sorted(report) == [1, 2, 3, 8]
    assert report[1]["items"] == "1" and report[1]["windows"] == 13 and report[1]["action"] == "cut" and report[2]["action"] == "drop" and report[3]["share"] == 1.0 and report[8]["items"] == "2,3"
    kept = {r["doc_id"]: r for r in decontaminate.decontaminate(frame, bench, broadcast_chars=limit).collect()}
    assert sorted(kept) == [0, 1, 4, 5, 6, 7, 8, 9, 10] and kept[1]["text"] == f"{clean}\n{clean}" and kept[4]["text"] is None and kept[8]["text"] == f"{clean} {clean}" and kept[9]["text"] == clean
    assert decontaminate.contaminated(docs(spark, []), bench, broadcast_chars=limit).collect() == [] and decontaminate.contaminated(frame, bench.limit(0)).collect() == []


def test_token_trees():
    cache = P.pieces(P.TOKENIZERS, P.VOCABULARY)
    rng = random.Random(3)
    letters = list("abc  Zé1'\n\t!-sdtrevm")
    for k in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 50, 900, 4000]))) if k % 7 else "a" * 800
        tree = token_counts.TokenTree(text, cache)
        for _ in range(8):
            pos, n, ins = rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 10, 300, 5000]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 60, 2500])))
            tree.edit(pos, n, ins)
            pos = min(pos, len(text))
            text = text[:pos] + ins + text[pos + n :]
            assert tree.text == text and tree.count == len(ENC.encode_ordinary(text))
    big = token_counts.TokenTree("some words here " * 5000, cache)
    big.edit(40000, 3, "new")
    assert big.reencoded < 20


def test_token_counts(spark):
    texts = ["Hello there, it's 12 o'clock", "", None, "word " * 20000, "tie", "tie"]
    frame = docs(spark, texts)
    edits = spark.createDataFrame([(0, 1, 5, 6, " you"), (0, 0, 0, 0, "X"), (1, 0, 9, 9, "abc"), (2, 0, 0, 1, "z"), (3, 0, 50000, 5, None), (4, 0, None, 1, "q"), (None, 0, 0, 0, "lost"), (77, 0, 0, 0, "lost")], "doc_id bigint, seq int, pos bigint, n_del bigint, ins string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(token_counts.with_edits(frame.withColumnRenamed("lang", "edits"), edits)).collect()}
    n = lambda t: len(ENC.encode_ordinary(t))
    assert got[0]["tokens_before"] == n(texts[0]) and got[0]["tokens_after"] == n("XHell you, it's 12 o'clock"[:5] + " you" + ("X" + texts[0])[11:]) and got[0]["n_edits"] == 2
    assert got[1]["tokens_after"] == n("abc") and got[2]["tokens_after"] is None and got[3]["tokens_after"] == n(texts[3][:50000] + texts[3][50005:]) and got[3]["reencoded"] < 20
    assert got[4]["tokens_after"] == got[5]["tokens_before"] == n("tie") and got[4]["n_edits"] == 0
    sampled = token_counts.sample_edits(frame)
    kept = {r["doc_id"]: (r["text"], r["edits"]) for r in sampled.collect()}
    for r in token_counts.count_tokens(sampled).collect():
        text, changes = kept[r["doc_id"]]
        if text is not None:
            for e in changes:
                text = text[: min(e["pos"], len(text))] + e["ins"] + text[min(e["pos"], len(text)) + e["n_del"] :]
            assert r["tokens_after"] == n(text)
    assert token_counts.count_tokens(token_counts.sample_edits(docs(spark, []))).collect() == []


def test_stored_trees(spark, tmp_path):
    """Two batches of edits on stored trees: counts are those of the whole texts, and untouched documents aren't encoded again."""
    texts = ["Hello there, it's 12 o'clock", "", None, "word " * 20000, "tie", "tie", "some other words " * 300]
    n = lambda t: len(ENC.encode_ordinary(t))
    frame = docs(spark, texts).unionByName(docs(spark, ["no id"]).withColumn("doc_id", token_counts.F.lit(None).cast("bigint"))).withColumnRenamed("lang", "counts")
    token_counts.build_trees(frame).write.parquet(f"{tmp_path}/0")
    first = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    assert [first[i]["n_tokens"] for i in range(7)] == [None if t is None else n(t) for t in texts] and first[None]["n_tokens"] == n("no id") and not any(r["reencoded"] for r in first.values())
    schema = "doc_id int, seq int, pos bigint, n_del bigint, ins string"
    batches = [[(0, 1, 5, 6, " you"), (0, 0, 0, 0, "X"), (3, 0, 50000, 5, None), (None, 0, 0, 1, "z")], [(3, 0, 10, 1, "12 new words's"), (1, 0, 3, 3, "filled"), (2, 0, 0, 0, "q"), (99, 0, 0, 0, "q")]]
    now = dict(enumerate(texts))
    for k, edits in enumerate(batches):
        token_counts.update_trees(spark.read.parquet(f"{tmp_path}/{k}"), spark.createDataFrame(edits, schema)).write.parquet(f"{tmp_path}/{k + 1}")
        got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/{k + 1}").collect()}
        for d, _, pos, cut, ins in sorted((e for e in edits if e[0] is not None), key=lambda e: e[:2]):
            if now.get(d) is not None:
                pos = min(pos, len(now[d]))
                now[d] = now[d][:pos] + (ins or "") + now[d][pos + cut :]
        assert len(got) == 8 and all((got[i]["text"], got[i]["n_tokens"]) == (t, None if t is None else n(t)) for i, t in now.items())
        touched = {e[0] for e in edits} - {None, 2, 99}
        assert all(0 < got[i]["reencoded"] < 25 if i in touched else not got[i]["reencoded"] for i in got)
    assert token_counts.update_trees(token_counts.build_trees(docs(spark, [])), spark.createDataFrame([], schema)).collect() == []


def test_secrets(spark):
    key, sha, uuid = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY9", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "123e4567-e89b-12d3-a456-426614174000"
    texts = [f"my {key} here", f"commit {sha} and {uuid} 1234567890123456", f'token = "{sha}"', "averyveryverylongidentifiername_with_words2 and more", None, "", f"{key} {key}", "é" * 70000 + " " + key, f"api_key: {key[:20]}"]
    found = sorted((r["doc_id"], r["start"], r["length"], r["keyed"]) for r in secrets.scan(docs(spark, texts)).collect())
    assert found == [(0, 3, len(key), False), (2, 9, 40, True), (6, 0, len(key), False), (6, len(key) + 1, len(key), False), (7, 70001, len(key), False), (8, 9, 20, True)]
    assert secrets.scan(docs(spark, texts), known=frozenset([key])).count() == 2 and secrets.scan(docs(spark, [])).count() == 0
    rng = random.Random(5)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32)) for _ in range(200)]
    caught = {r["doc_id"] for r in secrets.scan(docs(spark, [f"say {m} now" for m in made])).collect()}
    assert len(caught) > 190


def test_secrets_of_all_kinds(spark):
    rng = random.Random(6)
    made = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [[f"say {made(letters, 32)} now" for _ in range(100)], [f"password = {made(letters, 24)}" for _ in range(100)], [f'"passwd": "{made(letters + digits + "!$%.&*", 20)}"' for _ in range(100)], [f"api_key={made(letters + digits, 12)};" for _ in range(100)]]
    for texts in kinds:
        assert len({r["doc_id"] for r in secrets.scan(docs(spark, texts)).collect()}) >= 90
    clean = ["the key: information, and a token = international", "password: see documentation", "https://www.example.com/path/to/something/else", "Donaudampfschifffahrtsgesellschaft", "some_function_name_in_code", "key: 1234567890123456"]
    assert secrets.scan(docs(spark, clean)).collect() == []


def test_secrets_against_plain_loops(spark):
    rng = random.Random(7)
    pool = ["token", "key", "password", " = ", ": ", "=", '"', "\n", " ", ",", "words and such", "é"]
    some = lambda: "".join(rng.choice("abcdefABCDEF0123456789+/_-.!$") for _ in range(rng.randint(1, 40)))
    texts = ["".join(rng.choice(pool) if rng.random() < 0.7 else some() for _ in range(rng.randint(0, 60))) for _ in range(150)]
    want = []
    for d, text in enumerate(texts):
        taken = []
        name = r"(?:token|secret|passw\w{0,8}|api[ _-]?key|key|auth\w{0,12}|credentials?|bearer|pwd)[\"']?\s{0,3}"
        found = [(m.start(1), m.group(1), "-=_/+.,;:()[]{}", 8, True) for m in re.finditer(name + r"(?:[:=]|=>)\s{0,3}[\"'`]?([^\s\"'`<>]+)", text, re.I)]
        found += [(m.start(), m.group(), "-=_/+", 16, bool(re.search(name + r"(?:[:=]|=>|\s)\s{0,3}[\"'`]?$", text[max(0, m.start() - 40) : m.start()], re.I))) for m in re.finditer(r"[A-Za-z0-9+/=_-]{16,}", text)]
        for at, run, signs, least, keyed in found:
            core = run.strip(signs)
            hexes = len(core) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-f]*|[0-9A-F]*", core)
            if least == 16 and any(a < at + len(run) and at < b for a, b in taken) or len(core) < least or not re.search("[^\\W\\d_]", core) or (hexes and not keyed):
                continue
            per = len(core) / len(ENC.encode_ordinary(core))
            if per < (1.8 if core.isalpha() else 2.2):
                want.append((d, at + run.index(core), len(core), per, keyed))
                if least == 8:
                    taken.append((at, at + len(run)))
    got = [tuple(r) for r in secrets.scan(docs(spark, texts)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_grams_are_range_hashes():
    h = T.Texts(["a b c d a b c"]).words().hash
    g = T.grams(h, 3)
    assert g[0] == g[4] and len(np.unique(g[:5])) == 4 and not g[5:].any()
