"""Column functions over symbol ids, names and paths, and the patterns behind them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcwright.model import EDGE_TYPES, NODE_KINDS, GraphError


def wildcard(pattern: str, question: bool = False) -> str:
    """Anchored regular expression, whatever the case, of a pattern with ``*`` (and ``?`` if asked)."""
    special = {"*": ".*", "?": "."} if question else {"*": ".*"}
    return "(?iud)^" + "".join(special.get(c) or re.sub(r"([^\w\s])", r"\\\1", c, flags=re.A) for c in pattern) + "$"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches_wildcard(column: Column | str, pattern: str, question: bool = False) -> Column:
    return _column(column).rlike(wildcard(pattern, question))


def same(column: str, text: str) -> Column:
    """Equal, whatever the case."""
    return F.lower(column) == text.lower()


def ends(column: str, text: str) -> Column:
    return F.endswith(F.lower(column), F.lit(text.lower()))


def starts(column: str, text: str) -> Column:
    """Begins with, whatever the case; false for null."""
    return F.coalesce(F.startswith(F.lower(column), F.lit(text.lower())), F.lit(False))


def contains(column: str, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def first_segment(column: str) -> Column:
    """What stands before the first dot; the whole id if there is none or it comes first."""
    c = F.col(column)
    return F.when(F.instr(c, ".") > 1, F.substring_index(c, ".", 1)).otherwise(c)


def parent_segment(column: str) -> Column:
    """What stands before the last dot, even one within a parameter list; the whole id if there is none or it comes first."""
    before = F.regexp_extract(column, r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(before != "", before).otherwise(F.col(column))


def last_segment(column: Column | str) -> Column:
    return F.substring_index(column, ".", -1)


def file_name(column: Column | str) -> Column:
    """A group's key as a file name: characters that file systems forbid become ``_``."""
    return F.regexp_replace(column, r'[\x00-\x1f<>:"/\\|?*]', "_")


def kind_priority(column: str = "kind") -> Column:
    """Order of kinds in rankings: what can be called, members, types, namespaces."""
    c = F.col(column)
    return F.when(c.isin("method", "constructor"), 0).when(c.isin("property", "field", "event"), 1).when(c == "type", 2).when(c == "namespace", 3).otherwise(4)


def edge_ordinal(column: str = "type") -> Column:
    """Place of an edge type in the enumeration."""
    return F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(EDGE_TYPES) for x in (t, i))), F.col(column))


def edge_pascal(column: str = "type") -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.substring(column, 2, 100))


def short_commit(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", "unknown").otherwise(F.substring(column, 1, 7))


def same_commit(a: str, b: str) -> bool:
    """Either hash begins with the other, whatever the case."""
    a, b = a.lower(), b.lower()
    return a.startswith(b) or b.startswith(a)


def slug(column: Column | str) -> Column:
    """Package name: lower case, other characters than letters, digits and ``._-`` become ``-``."""
    return F.regexp_replace(F.lower(column), r"[^\w.-]|[^\x00-\x7f]", "-")


def ref_name(ref: str) -> str:
    """A git reference as part of a folder's name."""
    return ref.replace("/", "-").replace("\\", "-")


def slashes(column: Column | str) -> Column:
    return F.translate(column, "\\", "/")


def stem(column: Column | str) -> Column:
    """File name of a path without its folder and last extension."""
    return F.regexp_replace(F.regexp_extract(column, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def folder(column: Column | str) -> Column:
    """Folder of a path, '' without one."""
    return F.regexp_extract(column, r"^(.*)/[^/]*$", 1)


def extension(column: Column | str) -> Column:
    return F.lower(F.regexp_extract(column, r"(\.[^./\\]*)$", 1))


def relative(path: str, root: str) -> Column:
    """Path below a root; unchanged if either is empty or it lies elsewhere."""
    p, r = slashes(F.col(path)), F.regexp_replace(slashes(F.col(root)), "/+$", "")
    below = F.startswith(F.lower(p), F.concat(F.lower(r), F.lit("/")))
    return F.when((p != "") & (r != "") & below, F.substr(p, F.length(r) + 2)).otherwise(F.col(path))


def parts(column: Column | str, separator: str = ",") -> Column:
    """Parts of a list in a text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(column, re.escape(separator)), lambda x: F.trim(x)), lambda x: x != "")


def number_or_zero(column: Column | str) -> Column:
    return F.coalesce(_column(column).try_cast("double"), F.lit(0.0))


def bare_type(column: Column | str) -> Column:
    """Type text without the marks of nullable values and arrays."""
    text = F.regexp_replace(column, r"^(?:System\.)?Nullable<(.*)>$", "$1")
    return F.regexp_replace(text, r"(?:\?|\[[,\s]*\])+$", "")


def lifetime(column: str) -> Column:
    """Life span that a registration method's name tells."""
    c = F.col(column)
    return F.when(c.contains("Scoped"), "Scoped").when(c.contains("Transient"), "Transient").when(c.contains("Singleton"), "Singleton").otherwise("Unknown")


def accessibility(column: str) -> Column:
    """Stored name of declared modifiers, private without any."""
    c = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(" "))
    has = lambda w: c.contains(f" {w} ")
    return (
        F.when(has("public"), "public").when(has("protected") & has("internal"), "protectedInternal").when(has("private") & has("protected"), "privateProtected")
        .when(has("internal"), "internal").when(has("protected"), "protected").otherwise("private")
    )


def doc_summary(column: str) -> Column:
    """Text of the first summary element of an XML comment, without tags and with entities read; null if blank."""
    inner = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"(?s)<summary>(.*?)</summary>", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), r"\s+", " "))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.when(text != "", text)


def escape_html(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(a, b)
    return text


def parse_kind_prefix(pattern: str) -> tuple[str | None, str]:
    """(node kind, rest) of a pattern such as ``type:Order*``; no kind if none is named."""
    kind, _, rest = pattern.partition(":")
    return (kind.lower(), rest) if rest and "\n" not in rest and kind.lower() in NODE_KINDS else (None, pattern)


EDGE_ALIASES: dict[str, str | None] = {
    "calls-to": "calls", "calls-from": "calls", "depends-on": "dependsOn", "resolves-to": "resolvesTo", "covered-by": "coveredBy", "all": None,
    **{t: t for t in ("calls", "contains", "covers", "implements", "inherits", "overrides", "references")},
}


def parse_edge_type(text: str | None) -> str | None:
    """Edge type of an alias, a member's name or its number, whatever the case; None for all."""
    if text is None or not text.strip():
        return None
    key = text.lower()
    if key in EDGE_ALIASES:
        return EDGE_ALIASES[key]
    named = {t.lower(): t for t in EDGE_TYPES}
    if key.strip() in named:
        return named[key.strip()]
    if re.fullmatch(r"\s*[+-]?\d+\s*", text):  # a number outside the enumeration is a type that no edge has
        return EDGE_TYPES[int(text)] if 0 <= int(text) < len(EDGE_TYPES) else f"#{int(text)}"
    raise GraphError(f"There is no edge type '{text}'; there are {', '.join(EDGE_ALIASES)}")
