"""Facts from C# source text: declarations, references and registrations, without a compiler.

A lexer blanks out comments and strings, a scan over braces and declarations follows. Sources are
read twice: the first time for declared types and for the names that texts ask for, which
:mod:`arcwright.operators.binding` resolves by containing types, namespaces and usings; the second
time with what each file's names stand for, so that ids hold full names. What a reference is called
on is told from locals, parameters, fields and properties of its file; results of calls are not typed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arcwright.operators import binding
from arcwright.operators.durable import keep

DECLS = (
    "assembly string, file string, start bigint, end bigint, start_line int, end_line int, kind string, type_kind string, symbol_id string, name string, containing_type string, containing_ns string, modifiers string, "
    "signature string, return_type string, param_types array<string>, required int, bases array<string>, ifaces array<string>, overridden string, attributes array<string>, type_params array<string>, doc_xml string"
)
REFS = "assembly string, file string, pos bigint, kind string, name string, args int, receivers array<string>, type_args array<string>, typeof_args array<string>"
NAMES = "what string, assembly string, file string, scope string, name string, arity int, candidates array<string>, id string, type_kind string"

#: What a name in a scope (containing type and namespace) stands for: its full name without type arguments, and its kind; None if unknown.
Find = Callable[[str, str, int], tuple[str, str | None] | None]

_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|@?\$?@?"(?:[^"\\\n]|\\.|"")*"|\'(?:[^\'\\\n]|\\.)\'', re.S)
_MODS = r"((?:(?:public|private|protected|internal|static|abstract|sealed|virtual|override|async|readonly|const|partial|extern|unsafe|new|required|volatile|ref)\s+)*)"
_TYPE = r"[A-Za-z_][\w.]*(?:<[^;{}()=]*?>)?(?:\?|\[[,\s]*\])*"
_DECL = re.compile(
    rf"(?P<ns>\bnamespace\s+(?P<nsname>[\w.]+)\s*(?P<nsend>[;{{]))"
    rf"|{_MODS.replace('((', '(?P<tmods>(', 1)}\b(?P<tkind>class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(?P<tname>\w+)(?P<targs><[^>{{]*>)?\s*(?P<tparams>\([^)]*\))?\s*(?::\s*(?P<tbases>[^{{;]*?))?(?:\s*where[^{{;]*)?\s*(?P<tend>[{{;])"
    rf"|{_MODS.replace('((', '(?P<emods>(', 1)}\bevent\s+(?P<etype>{_TYPE})\s+(?P<ename>\w+)\s*(?P<eend>[{{;])"
    rf"|{_MODS.replace('((', '(?P<mmods>(', 1)}(?:(?P<mtype>{_TYPE})\s+)?(?P<mname>\w+)\s*(?P<mgen><[\w\s,]+>)?\s*\((?P<mparams>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::\s*(?:base|this)\s*\([^{{;]*\)\s*)?(?:where[^{{;]*)?(?P<mend>\{{|=>|;)"
    rf"|{_MODS.replace('((', '(?P<pmods>(', 1)}(?P<ptype>{_TYPE})\s+(?P<pname>\w+)\s*(?P<pend>\{{|=>|=(?!=)|;|,)",
)
_LOCAL = re.compile(rf"\b(?P<type>{_TYPE})\s+(?P<name>[A-Za-z_]\w*)\s*(?:(?=[;,)])|\bin\b|=(?!=)\s*(?:new\s+(?P<made>[A-Za-z_][\w.]*(?:<[^;{{}}()=]*?>)?))?)")
_USING = re.compile(r"^[ \t]*(?P<global>global\s+)?using\s+(?P<static>static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<name>[\w.]+)\s*;", re.M)
_VALUES = {"bool", "byte", "sbyte", "char", "decimal", "double", "float", "int", "uint", "nint", "nuint", "long", "ulong", "short", "ushort"}
_BUILT_IN = _VALUES | {"string", "object", "void", "dynamic", "var"}
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<dot>\.)?\b(?P<name>[A-Za-z_]\w*)(?P<args><[\w\s,.<>?\[\]]*>)?\s*(?P<open>\()|\.(?P<access>[A-Z]\w*)\b(?!\s*[(<])")
_WORDS = {"if", "while", "for", "foreach", "switch", "catch", "using", "lock", "return", "nameof", "typeof", "sizeof", "default", "new", "await", "throw", "when", "base", "this", "fixed", "checked", "unchecked", "else", "in", "is", "as", "out", "get", "set", "init", "where", "yield", "var", "case", "goto"}


def _end(code: str, at: int, signs: str = "{}") -> int:
    """Position of the brace that closes the one at a position."""
    depth = 0
    for m in re.compile("[" + re.escape(signs) + "]").finditer(code, at):
        depth += 1 if m[0] == signs[0] else -1
        if not depth:
            return m.start()
    return len(code) - 1


def _split(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([") - (c in ">)]")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def _params(text: str) -> list[tuple[str, str, bool]]:
    """(type, name, whether it may be left out) of parameters."""
    found = []
    for p in _split(text):
        head, _, default = p.partition("=")
        bare = re.sub(r"^(?:\[[^\]]*\]\s*)*(?:(?:this|ref|out|in|params|scoped)\s+)*", "", head).strip()
        found.append((bare.rpartition(" ")[0].strip() or bare, bare.rpartition(" ")[2], bool(default) or bool(re.match(r"params\s", head.strip()))))
    return found


def qualify(text: str, find: Callable[[str, int], tuple[str, str | None] | None]) -> tuple[str, str | None]:
    """A type's text with full names, and the kind of the outermost type. Marks of nullable references go, those of values stay."""
    m = re.match(r"(?:global::)?([A-Za-z_][\w.]*)\s*", text.strip())
    if not m:
        return " ".join(text.split()), None
    text, name, args = text.strip(), m[1], []
    at = m.end()
    if text[at : at + 1] == "<":
        stop = _end(text, at, "<>")
        args = [qualify(x, find)[0] for x in _split(text[at + 1 : stop])]
        at = stop + 1
    known = None if name in _BUILT_IN else find(name, len(args))
    full, kind = known or (name, None)
    rest = re.sub(r"\s", "", text[at:])
    if rest.startswith("?") and name not in _VALUES and kind not in ("struct", "enum", "record struct"):
        rest = rest[1:]
    return full + (f"<{', '.join(args)}>" if args else "") + rest.replace("]?", "]"), kind


class Recorder:
    """Finds nothing, and notes what was asked for."""

    def __init__(self):
        self.asked: set[tuple[str, str, int]] = set()

    def __call__(self, scope: str, name: str, arity: int) -> None:
        self.asked.add((scope, name, arity))


def usings(text: str) -> tuple[list[str], dict[str, str], list[str]]:
    """Namespaces (and types whose members) a file uses, its aliases, and what it lets the whole project use."""
    plain, aliases, shared = [], {}, []
    for m in _USING.finditer(text):
        if m["alias"]:
            aliases[m["alias"]] = m["name"]
        else:
            (shared if m["global"] else plain).append(m["name"])
    return plain, aliases, shared


def candidates(scope: str, name: str, arity: int, used: list[str], aliases: dict[str, str]) -> list[str]:
    """Full names, with the number of type arguments behind a grave accent, that a name may stand for, by precedence."""
    owner, _, space = scope.partition("|")
    owner, prefixes = re.sub(r"<.*>", "", owner), []
    while owner and owner != space:
        prefixes.append(owner)
        owner = owner.rpartition(".")[0]
    parts = space.split(".") if space else []
    prefixes += [".".join(parts[:i]) for i in range(len(parts), 0, -1)]
    head, _, tail = name.partition(".")
    found = [f"{p}.{name}" for p in prefixes] + [name]
    if head in aliases:
        found.append(aliases[head] + (f".{tail}" if tail else ""))
    return [f"{x}`{arity}" for x in dict.fromkeys(found + [f"{u}.{name}" for u in used])]


def declarations(assembly: str, file: str, text: str, find: Find = lambda *_: None) -> list[dict]:
    """Declared symbols of a file; members lie within their type, methods keep their whole text."""
    code = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out: list[dict] = []

    def finder(owner: dict | None, space: str | None, own: tuple[str, ...] = ()):
        scope, free = f"{owner['symbol_id'] if owner else ''}|{space or ''}", {*own, *(owner["type_params"] if owner else ())}
        return lambda name, arity: (name, "parameter") if name in free else find(scope, name, arity)

    def walk(a: int, b: int, space: str | None, owner: dict | None) -> None:
        at = a
        while m := _DECL.search(code, at, b):
            g = m.groupdict()
            begin = m.start()
            if g["ns"]:
                name = f"{space}.{g['nsname']}" if space else g["nsname"]
                stop = _end(code, m.end() - 1) if g["nsend"] == "{" else b
                add("namespace", name, begin, stop, name=name.rpartition(".")[2], symbol=name, space=None)
                walk(m.end(), stop, name, owner)
                at = stop + 1
                continue
            which = next(k for k in "temp" if g[k + "name"])
            name, kind, mods = g[which + "name"], {"t": "type", "e": "event", "m": "method", "p": "property"}[which], g[which + "mods"] or ""
            bad = name in _WORDS or (which == "m" and g["mtype"] in _WORDS) or (which == "p" and g["ptype"] in _WORDS)
            if bad or (owner is None and which != "t") or (which == "m" and g["mtype"] is None and name != owner["name"]) or (owner is not None and owner["type_kind"] == "enum"):
                at = m.end() if not bad else m.start() + max(1, len(re.match(r"\s*\w*", code[m.start() : m.end()])[0]))
                continue
            end = g[which + "end"]
            if end == "{":
                stop = _end(code, m.end() - 1)
            else:
                semi = code.find(";", m.end() - 1, b)
                stop = semi if semi >= 0 else b
            base = owner["symbol_id"] if owner else space
            prefix = f"{base}." if base else ""
            if which == "t":
                own = tuple(re.sub(r"^(?:in|out)\s+", "", x) for x in _split((g["targs"] or "")[1:-1]))
                face = g["tkind"] == "interface"
                bases = [] if g["tkind"] == "enum" else [qualify(re.sub(r"\(.*", "", x), finder(owner, space, own)) for x in _split(g["tbases"] or "")]
                looks = [face or kind == "interface" or (kind is None and bool(re.match(r"I[A-Z]", re.sub(r"<.*", "", x).rpartition(".")[2]))) for x, kind in bases]
                symbol = prefix + name + (f"<{', '.join(own)}>" if own else "")
                d = add("type", symbol, begin, stop, name=name, symbol=symbol, space=space, owner=owner, mods=mods, type_kind=" ".join(g["tkind"].split()), signature=f"{mods}{g['tkind']} {name}".strip(),
                        bases=[x for (x, _), i in zip(bases, looks) if not i], ifaces=[x for (x, _), i in zip(bases, looks) if i], own=own)
                if end == "{":
                    walk(m.end(), stop, space, d)
            elif which == "m":
                given = _params(g["mparams"])
                own = tuple(_split((g["mgen"] or "")[1:-1]))
                types = [qualify(x, finder(owner, space, own))[0] for x, *_ in given]
                ctor = g["mtype"] is None
                symbol = f"{prefix}{name}{'<' + ', '.join(own) + '>' if own else ''}({', '.join(types)})"
                d = add("constructor" if ctor else "method", symbol, begin, stop, name=name, symbol=symbol, space=space, owner=owner, mods=mods, returns=None if ctor else qualify(g["mtype"], finder(owner, space, own))[0], types=types,
                        signature=f"{mods}{(g['mtype'] + ' ') if g['mtype'] else ''}{name}({g['mparams'].strip()})".strip(), overridden=(f"{name}({', '.join(types)})" if " override " in f" {mods} " else None), own=own)
                d["required"] = sum(not spare for *_, spare in given)
                d["_locals"] = {n: t for t, (_, n, _) in zip(types, given)}
            elif which == "e":
                if end == "{":
                    add("event", prefix + name, begin, stop, name=name, symbol=prefix + name, space=space, owner=owner, mods=mods, returns=qualify(g["etype"], finder(owner, space))[0], signature=f"{mods}event {g['etype']} {name}")
            else:
                field = end in ("=", ";", ",")
                names = [name, *(re.match(r"\w+", x)[0] for x in _split(code[m.end() : stop]) if re.match(r"\w+\s*(?:=|$)", x))] if end == "," else [name]
                for n in names:
                    add("field" if field else "property", prefix + n, begin, stop, name=n, symbol=prefix + n, space=space, owner=owner, mods=mods, returns=qualify(g["ptype"], finder(owner, space))[0], signature=f"{mods}{g['ptype']} {n}".strip())
            at = stop + 1

    def add(kind, symbol_id, start, stop, name, symbol, space, owner=None, mods="", type_kind=None, signature="", returns=None, types=(), bases=(), ifaces=(), overridden=None, own=()) -> dict:
        attributes: list[str] = []
        left = code[:start].rstrip()
        while left.endswith("]"):
            depth, i = 0, len(left)
            while i and (depth or i == len(left)):
                i -= 1
                depth += (left[i] == "]") - (left[i] == "[")
            attributes = re.findall(r"(?:\[|,)\s*(?:\w+:\s*)?([\w.]+)", re.sub(r"\([^\]]*?\)", "", left[i:])) + attributes
            left = left[:i].rstrip()
        lines = text[len(left) : start].split("\n")
        doc = [x.strip()[3:].removeprefix(" ") for x in (lines[1:] if left else lines) if x.lstrip().startswith("///")]
        d = {"assembly": assembly, "file": file, "start": start, "end": stop, "start_line": code.count("\n", 0, start + len(code[start:]) - len(code[start:].lstrip())) + 1, "end_line": code.count("\n", 0, stop) + 1, "kind": kind, "type_kind": type_kind, "symbol_id": symbol, "name": name,
             "containing_type": owner["symbol_id"] if owner else None, "containing_ns": space, "modifiers": " ".join(mods.split()), "signature": " ".join(signature.split()), "return_type": returns, "param_types": list(types), "required": len(types), "bases": list(bases), "ifaces": list(ifaces),
             "overridden": overridden, "attributes": attributes, "type_params": [*own, *(owner["type_params"] if owner else ())], "doc_xml": "\n".join(doc) + "\n" if doc else None}
        out.append(d)
        return d

    walk(0, len(code), None, None)
    return out


def references(assembly: str, file: str, text: str, find: Find = lambda *_: None) -> list[dict]:
    """Invocations, object creations and accesses to members, by name and place, and the types that what they are called on may have."""
    code = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    decls = declarations(assembly, file, text, find)
    types = [d for d in decls if d["kind"] == "type"]
    members = [d for d in decls if d["kind"] in ("method", "constructor", "property", "event")]
    values = {(d["containing_type"], d["name"]): d["return_type"] for d in decls if d["kind"] in ("property", "field", "event")}
    known = {d["symbol_id"]: d for d in types}
    bare = lambda t: re.sub(r"<.*>|[\[\]?].*$", "", t)
    out = []

    def inner(rows: list[dict], at: int) -> dict | None:
        return max((d for d in rows if d["start"] <= at <= d["end"]), key=lambda d: d["start"], default=None)

    def outer(d: dict | None) -> list[dict]:
        found = []
        while d:
            found.append(d)
            d = known.get(d["containing_type"])
        return found

    def local_types(member: dict, look) -> dict[str, str]:
        if "_all" not in member:
            member["_all"] = dict(member.get("_locals", {}))
            for m in _LOCAL.finditer(code, member["start"], member["end"]):
                written = (m["made"] if m["type"] == "var" else m["type"]) or ""
                if written and m["type"] not in _WORDS - {"var"}:
                    member["_all"].setdefault(m["name"], qualify(written, look)[0])
        return member["_all"]

    for m in _CALL.finditer(code):
        name = m["name"] or m["access"]
        if name in _WORDS:
            continue
        kind = "memberAccess" if m["access"] else "creation" if m["new"] else "invocation"
        type_, member = inner(types, m.start()), inner(members, m.start())
        scope = f"{type_['symbol_id'] if type_ else ''}|{(type_ or {}).get('containing_ns') or ''}"
        free = {*(type_["type_params"] if type_ else ()), *(member["type_params"] if member else ())}
        look = lambda n, k, scope=scope, free=free: (n, "parameter") if n in free else find(scope, n, k)
        chain, receivers = "", []
        if m["dot"] or m["access"]:
            i = m.start()
            while i and (code[i - 1].isalnum() or code[i - 1] in "_."):
                i -= 1
            chain = code[i : m.start()].removeprefix("this.") if code[i : i + 1] not in (".", "") else ""
            if m["new"] or (kind == "invocation" and re.search(r"\bnew\s+$", code[:i][-8:])):
                kind = "creation"
        if kind == "creation":
            receivers = [bare(qualify(f"{chain}.{name}" if chain else name + (m["args"] or ""), look)[0])]
        elif not (m["dot"] or m["access"]) or chain == "this":
            receivers = [bare(d["symbol_id"]) for d in outer(type_)]
        elif chain == "base":
            receivers = [bare(x) for d in outer(type_)[:1] for x in d["bases"]]
        elif chain:
            typed = (local_types(member, look) if member else {}).get(chain) or next((values[d["symbol_id"], chain] for d in outer(type_) if values.get((d["symbol_id"], chain))), None)
            found = None if typed or "." in chain and chain.split(".")[0] in (local_types(member, look) if member else {}) else look(chain, 0)
            receivers = [bare(typed)] if typed else [found[0]] if found else []
        inside = code[m.end() : _end(code, m.end() - 1, "()")] if m["open"] else ""
        typeofs = [qualify(x, look)[0] for x in re.findall(r"typeof\s*\(\s*([\w.<>, ]+?)\s*\)", inside)]
        out.append({"assembly": assembly, "file": file, "pos": m.start(), "kind": kind, "name": name, "args": len(_split(inside)), "receivers": receivers, "type_args": [qualify(x, look)[0] for x in _split((m["args"] or "")[1:-1])], "typeof_args": typeofs})
    return out


def asked(assembly: str, file: str, text: str) -> list[dict]:
    """Rows of NAMES: the types that a file declares, the names that it asks for, and what it lets its project use."""
    note = Recorder()
    references(assembly, file, text, note)
    used, aliases, shared = usings(text)
    row = {"assembly": assembly, "file": file}
    rows = [row | {"what": "type", "id": d["symbol_id"], "type_kind": d["type_kind"]} for d in declarations(assembly, file, text) if d["kind"] == "type"]
    rows += [row | {"what": "name", "scope": s, "name": n, "arity": k, "candidates": candidates(s, n, k, used, aliases)} for s, n, k in sorted(note.asked)]
    return rows + [row | {"what": "using", "name": n} for n in shared]


def _rows(find, columns: str):
    schema = to_arrow_schema(T.StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["content"]:
                    table = {(x["scope"], x["name"], x["arity"]): (x["full"], x["type_kind"]) for x in r.get("known") or ()}
                    more = () if find is asked else (lambda *key, table=table: table.get(key),)
                    rows += find(r["assembly"], r["file"], r["content"], *more)
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in rows], schema=schema)

    return run


def facts(sources: DataFrame, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """decls and refs of source texts (assembly, file, content); types (assembly, id, type_kind) are declared elsewhere, as in projects that aren't read again."""
    texts = sources.select("assembly", "file", "content")
    names = keep(texts.mapInArrow(_rows(asked, NAMES), NAMES))
    known = binding.resolve(names, types)
    texts = texts.join(known, ["assembly", "file"], "left").select("assembly", "file", "content", "known")
    return keep(texts.mapInArrow(_rows(declarations, DECLS), DECLS)), keep(texts.mapInArrow(_rows(references, REFS), REFS))


def bind(decls: DataFrame, refs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """References with target_id, target_kind and target_assembly; see :func:`arcwright.operators.binding.targets`."""
    return keep(binding.targets(decls, refs, others))


def registrations(refs: DataFrame) -> DataFrame:
    """Invocations as :func:`arcwright.operators.extract.di_edges` takes them."""
    return refs.where("kind = 'invocation'").select(F.col("name").alias("method"), "type_args", "typeof_args", "file")
