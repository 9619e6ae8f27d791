"""HTML extraction: templates of a site from equivalence classes of tokens, then the text of their slots."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm._graph import keep, written
from arcwright.llm._text import mix

SUPPORT = 0.5  # share of a site's pages that a class must occur in, two pages at least
#: Templates are broadcast up to so many tokens of all sites together; beyond, joined by site.
BROADCAST_TOKENS = 2_000_000
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"\s*(?:[|:·•»©]|\s[-–—]\s)\s*")
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def tokens(page: str) -> list[tuple[int, str | None]]:
    """Tokens of a page in order: (role, text).

    A tag's role is its name, class and id, and the path of open elements around it; its text is
    None. Text between tags is cut at signs such as ``|`` or ``:``; a part's role is the part and its
    path. Comments, scripts and styles are left out, elements left open are closed as HTML does.
    """
    out: list[tuple[int, str | None]] = []
    stack: list[tuple[str, int]] = []
    path, at = 0, 0
    digest = xxhash.xxh64_intdigest

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            for part in _PARTS.split(_html.unescape(piece)):
                part = " ".join(part.split())
                if part:
                    out.append((digest(part, path & 0xFFFFFFFF) >> 1, part))

    for m in _TAG.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    path = stack[i][1]
                    del stack[i:]
                    out.append((digest("/" + name, path & 0xFFFFFFFF) >> 1, None))
                    break
            continue
        if name in _CLOSED_BY:
            for i in range(len(stack) - 1, max(len(stack) - 4, -1), -1):
                if stack[i][0] in _CLOSED_BY[name]:
                    path = stack[i][1]
                    del stack[i:]
                    break
        named = name + "".join("." + next(g for g in x if g or g == "") if any(x) else "." for x in _NAMED.findall(m.group(4))) if m.group(4) else name
        role = digest(named, path & 0xFFFFFFFF)
        out.append((role >> 1, None))
        if name not in _VOID:
            stack.append((name, path))
            path = role
    if at < len(page):
        text(page[at:])
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, site, page, roles, parts): a hash of the page, and its tokens in order; null roles for null html."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            pages, roles, parts = [], [], []
            for page_id, html in zip(part["page_id"].to_pylist(), part["html"].to_pylist()):
                found = tokens(html or "")
                pages.append(xxhash.xxh64_intdigest(f"{page_id} {html}") >> 1)
                roles.append(None if html is None else [r for r, _ in found])
                parts.append([t for _, t in found])
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["site"], pa.array(pages, pa.int64()), pa.array(roles, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.string()))], names=["page_id", "site", "page", "roles", "parts"]
            )


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (site, token, s1, s2, n): the page's part of each token's occurrence vector; token -1 counts pages."""
    for batch in batches:
        size = batch["roles"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row = np.concatenate([np.repeat(np.arange(len(batch)), size), np.arange(len(batch))])
        role = np.concatenate([batch["roles"].flatten().to_numpy(zero_copy_only=False), np.full(len(batch), -1)]).astype(np.int64)
        order = np.lexsort((role, row))
        row, role = row[order], role[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (role[1:] != role[:-1])])) if len(row) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(row))).astype(np.uint64)
        row, role = row[first], role[first]
        with np.errstate(over="ignore"):
            s = mix(batch["page"].to_numpy()[row].astype(np.uint64) + n * np.uint64(0x9E3779B97F4A7C15))
        columns = (role, (s >> np.uint64(32)).astype(np.int64), (s & np.uint64(0xFFFFFFFF)).astype(np.int64), n.astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch["site"].take(pa.array(row)), *(pa.array(c) for c in columns)], names=["site", "token", "s1", "s2", "n"])


class _Templates:
    """Reads the template column of rows, once for each site in a batch: the class of each token, and where each class is nested."""

    def __init__(self):
        self.site, self.of, self.nest, self.sizes = object(), {}, {}, {}

    def __call__(self, site, cell) -> dict[int, int]:
        if site != self.site:
            row = cell.as_py()
            self.site, self.of, self.nest = site, dict(zip(row["tokens"], row["classes"])) if row else {}, {}
            if row and row.get("nest"):
                self.nest = {x["class"]: (x["parent"], x["slot"]) for x in row["nest"]}
            self.sizes = {}
            for c in self.of.values():
                self.sizes[c] = self.sizes.get(c, 0) + 1
        return self.of


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (site, class, parent, low, high, n): what so many pages say of a class's place.

    For parent -1, low and high are hashes of the order of its tokens in one round, -1 if rounds
    differ; else the lowest and highest slot of that class in which its tokens lie, counted within a
    round of the parent, 0 outside of any. Only classes before it can be parents.
    """
    read = _Templates()
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        templates = batch["template"]
        for i, (site, roles) in enumerate(zip(batch["site"].to_pylist(), batch["roles"].to_pylist())):
            classes = read(site, templates[i])
            if not classes or not roles:
                continue
            order: dict[int, list[int]] = {}
            places: dict[tuple[int, int], tuple[int, int]] = {}
            for role in roles:
                c = classes.get(role)
                if c is None:
                    continue
                if c not in order:
                    order[c] = []
                    for x in order:
                        if x > c:  # began before this one
                            places[x, c] = (0, 0)
                for d, seq in order.items():
                    if d < c:
                        slot = len(seq) % read.sizes[d] if d else len(seq)
                        low, high = places.get((c, d), (slot, slot))
                        places[c, d] = (min(low, slot), max(high, slot))
                order[c].append(role)
            for c, seq in order.items():
                size = read.sizes[c]
                one = seq[:size]
                whole = len(set(one)) == size and len(seq) % size == 0 and seq == one * (len(seq) // size)
                sign = xxhash.xxh64_intdigest(np.array(one, np.int64).tobytes()) >> 1 if whole else -1
                places[c, -1] = (sign, sign)
                if c and 0 not in order:
                    places[c, 0] = (0, 0)
            for (c, d), (low, high) in places.items():
                have = found.setdefault((site, c, d), [low, high, 0])
                have[:] = min(have[0], low), max(have[1], high), have[2] + 1
        columns = list(zip(*((*k, *v) for k, v in found.items()))) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["site", "class", "parent", "low", "high", "n"])


def nested(places: dict[tuple[int, int], tuple[int, int, int]], sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Parent and slot of each valid class, from (class, parent): (low, high, n) as :func:`_orders` has them.

    A class is valid if its tokens keep their order in all rounds and on all its pages it lies in one
    slot of a valid class: of the last one before it in whose rounds it lies wholly, or else of the
    main class.
    """
    valid: dict[int, tuple[int, int]] = {}
    for c in sorted(sizes):
        low, high, pages = places.get((c, -1), (-1, -1, 0))
        if low != high or low < 0:
            continue
        fixed = [d for d in sorted(valid, reverse=True) if (c, d) in places and places[c, d][0] == places[c, d][1] and places[c, d][2] == pages and (places[c, d][0] > 0 or d == 0)]
        if not c or fixed:
            valid[c] = (fixed[0], places[c, fixed[0]][0]) if c else (-1, 0)
    return valid


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of sites from their classes and what pages say of them; a site's classes are few."""
    for batch in batches:
        sites, out = [], []
        for site, classes, seen in zip(*(batch[c].to_pylist() for c in ("site", "classes", "seen"))):
            own = {c["class"]: c["tokens"] for c in classes}
            valid = nested({(s["class"], s["parent"]): (s["low"], s["high"], s["n"]) for s in seen}, {c: len(t) for c, t in own.items()})
            if valid:
                sites.append(site)
                out.append({"tokens": [t for c in valid for t in own[c]], "classes": [c for c in valid for _ in own[c]], "nest": [{"class": c, "parent": p, "slot": k} for c, (p, k) in valid.items()]})
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(out, _TEMPLATE)], names=["site", "template"])


_TEMPLATE = pa.struct([("tokens", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64())), ("nest", pa.list_(pa.struct([("class", pa.int64()), ("parent", pa.int64()), ("slot", pa.int64())])))])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = _Templates()
    for batch in batches:
        texts, found, known = [], [], []
        templates = batch["template"]
        for i, (site, roles, parts) in enumerate(zip(*(batch[c].to_pylist() for c in ("site", "roles", "parts")))):
            classes, nest, sizes = read(site, templates[i]), read.nest, read.sizes
            slots: dict[str, list[str]] = {}
            at: dict[int, int] = {}  # tokens of each class so far
            here, n = 0, 0  # the class whose token came last and isn't yet at the end of its round
            for role, part in zip(roles or (), parts or ()):
                c = classes.get(role)
                if c is not None:
                    n += 1
                    at[c] = at.get(c, 0) + 1
                    here = c
                    while here > 0 and at[here] % sizes[here] == 0:
                        here = nest[here][0]
                elif part is not None:
                    path, d = [], here
                    while d > 0:
                        path.append(str(at.get(d, 0) % sizes[d]))
                        d = nest[d][0]
                    slots.setdefault(".".join([str(at.get(0, 0)), *reversed(path)]), []).append(part)
            found.append(None if roles is None else [{"slot": k, "text": "\n".join(v)} for k, v in slots.items()])
            texts.append(None if roles is None else "\n".join("\n".join(v) for v in slots.values()))
            known.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["site"], pa.array(known, pa.int64()), pa.array(found, pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())]))), pa.array(texts, pa.string())],
            names=["page_id", "site", "template_tokens", "slots", "text"],
        )


def templates(pages: DataFrame, support: float = SUPPORT, broadcast_tokens: int = BROADCAST_TOKENS) -> tuple[DataFrame, bool]:
    """(site, template) of the sites that have one, from tokens of pages, and whether that table may be broadcast.

    template holds tokens, the number of the class of each, and where each class is nested; class 0 is
    the site's main class.
    """
    vectors = pages.select("site", "page", "roles").mapInArrow(_vectors, "site string, token bigint, s1 bigint, s2 bigint, n bigint")
    sums = keep(vectors.groupBy("site", "token").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.count("*").alias("pages"), F.sum("n").alias("n")).where("pages > 1"))
    size = sums.where("token = -1").select("site", F.col("pages").alias("all"))
    often = sums.where("token >= 0").join(size, "site").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("all") * support)))
    groups = often.groupBy("site", "s1", "s2", "pages", "n").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    # the main class: of the tokens that occur once in each of their pages, those in most pages, then the largest class
    main = F.struct((F.col("n") == F.col("pages")).cast("int").alias("once"), "pages", F.size("tokens").alias("size"), F.element_at("tokens", 1).alias("t"))
    listed = groups.groupBy("site").agg(F.reverse(F.sort_array(F.collect_list(F.struct(main.alias("rank"), F.col("tokens").alias("tokens"))))).alias("all"))
    classes = keep(listed.select("site", F.transform("all", lambda c, i: F.struct(i.cast("bigint").alias("class"), c["tokens"].alias("tokens"))).alias("classes")))
    few = (classes.agg(F.coalesce(F.sum(F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["tokens"]))), F.lit(0))).first()[0]) <= broadcast_tokens
    flat = F.struct(F.flatten("classes.tokens").alias("tokens"), F.flatten(F.transform("classes", lambda c: F.array_repeat(c["class"], F.size(c["tokens"])))).alias("classes"))
    seen = _with(pages, classes.select("site", flat.alias("template")), few, "site", "roles").mapInArrow(_orders, "site string, class bigint, parent bigint, low bigint, high bigint, n bigint")
    seen = seen.groupBy("site", "class", "parent").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    seen = seen.groupBy("site").agg(F.collect_list(F.struct("class", "parent", "low", "high", "n")).alias("seen"))
    schema = "site string, template struct<tokens:array<bigint>,classes:array<bigint>,nest:array<struct<class:bigint,parent:bigint,slot:bigint>>>"
    return keep(classes.join(seen, "site").select("site", "classes", "seen").mapInArrow(_nest, schema)), few


def _with(pages: DataFrame, table: DataFrame, few: bool, *columns: str) -> DataFrame:
    return pages.select(*columns).join(F.broadcast(table) if few else table, "site", "left").select(*columns, "template")


def extract(pages: DataFrame, support: float = SUPPORT, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(page_id, site, template_tokens, slots, text) of every page.

    Pages of one host are a site. Its tokens (tags by path, parts of text by path; see
    :func:`tokens`) that occur equally often on every page form a class, if on at least ``support``
    of the pages. The main class is made of tokens that occur once on each of its pages (of several
    such the one in most pages, then the largest, then that of the lowest token); it splits a page
    into slots. Other classes are nested into slots of it and of each other (see :func:`nested`);
    those that fit nowhere are no part of the template. What is left of a page, its parts of text
    outside the template, is listed by slot, and joined in text. A slot is named by the number of
    tokens of the main class before it and, within rounds of nested classes, of theirs: "3.1".

    Pages are parsed once; their tokens are written to the shared folder as Parquet. Occurrence
    vectors are compared by 64-bit sums over pages, so sites of any size are worked on without
    bringing their pages together; pages are never shuffled while templates are small enough to
    broadcast, which is checked.

    Null html: null slots and text. Empty html: no slots, ''. A site of one page has no template. A
    url that is null or has no host belongs to the site ''. Repeated pages count like others. A null
    page_id stays null; others must be numbers. Columns besides page_id, url and html are not
    carried. No rows: none.
    """
    site = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), site.alias("site"), "html")
    pages = written(pages.mapInArrow(_tokens, "page_id bigint, site string, page bigint, roles array<bigint>, parts array<string>"), "pages")
    table, few = templates(pages, support, broadcast_tokens)
    return _with(pages, table, few, "page_id", "site", "roles", "parts").mapInArrow(_extract, "page_id bigint, site string, template_tokens bigint, slots array<struct<slot:string,text:string>>, text string")
