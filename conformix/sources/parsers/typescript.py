"""TypeScript, by a scanner of functions, class bodies and object literals.

Objects as parameters are resolved against the file's literal types and a map of
the tree's interfaces and object aliases, which type_map() collects by file.
"""

from __future__ import annotations

import re

from . import param, row
from .text import Source, clean_comment

_FUNCTION = re.compile(r"\bfunction\s*\*?\s*([\w$]+)\s*(?=[<(])")
_CLASS = re.compile(r"\b(class|interface)\s+([\w$]+)")
_NAMED = re.compile(r"\b(?:interface\s+([\w$]+)|type\s+([\w$]+)\s*(?:<[^=]*>)?\s*=)")
_WORDS = {"public", "private", "protected", "static", "async", "readonly", "abstract", "override", "declare", "get", "set", "export", "default"}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "super"}
_SUFFIXES = ("Request", "Response", "Options", "Config", "Context")

TypeMap = dict[str, dict[str, tuple[str, bool]]]


def _members_of_type(src: Source, a: int, b: int) -> dict[str, tuple[str, bool]]:
    """Properties of an object type between its braces."""
    found: dict[str, tuple[str, bool]] = {}
    for x, y in [p for q in src.parts(a, b, ";") for r in src.parts(*q, ",") for p in src.parts(*r, "\n")]:
        m = re.compile(r"(?:readonly\s+)?['\"]?([\w$]+)['\"]?\s*(\?)?\s*:\s*(.+)", re.S).fullmatch(src.text[x:y])
        if m:
            found[m[1]] = (m[3].strip(), bool(m[2]))
    return found


def mentioned(content: str) -> set[str]:
    """Identifiers that may name a type."""
    return set(re.findall(r"[A-Za-z_$][\w$]*", Source(content, "\"'`").mask))


def type_map(content: str) -> list[tuple[str, bool, int, str, str, bool]]:
    """(name, whether an alias, position, property, type, optional) of a file's interfaces
    and object aliases; an empty property stands for a name without any."""
    src = Source(content, "\"'`")
    found = []
    for m in _NAMED.finditer(src.mask):
        name, at = m[1] or m[2], m.end()
        brace = src.mask.find("{", at) if m[1] else at + len(src.mask[at:]) - len(src.mask[at:].lstrip())
        ok = 0 <= brace < len(src.mask) and src.mask[brace] == "{"
        props = _members_of_type(src, brace + 1, src.close(brace)) if ok else {}
        head = (name, m[2] is not None, m.start())
        found += [(*head, p, t, o) for p, (t, o) in props.items()] or [(*head, "", "", False)]
    return found


def name_from_type(kind: str) -> str:
    """Parameter name for a destructured object of a named type."""
    base = re.sub(r"<.*", "", kind, flags=re.S).strip()
    for suffix in _SUFFIXES:
        if base.endswith(suffix):
            return suffix.lower()
    return base[:1].lower() + base[1:] if base else "obj"


def _docs(comment: str) -> tuple[str, dict[str, str]]:
    """Description before the first tag, and descriptions by parameter."""
    text = clean_comment(comment) if comment else ""
    lines = text.split("\n")
    cut = next((i for i, line in enumerate(lines) if line.startswith("@")), len(lines))
    docs = {}
    for line in lines:
        m = re.match(r"@param\s+(?:\{[^}]*\}\s*)?(\S+)\s*(.*)", line)
        if m:
            name = m[1]
            if name[0] + name[-1] == "[]":
                name = name[1:-1].partition("=")[0]
            docs[name] = re.sub(r"^-\s*", "", m[2]).strip() if m[2].startswith("- ") else m[2].strip()
    return "\n".join(lines[:cut]).strip(), docs


def _params(src: Source, a: int, b: int, types: TypeMap, docs: dict[str, str]) -> list[dict]:
    found = []
    for x, y in src.parts(a, b):
        while src.mask[x:y].startswith("@"):
            m = re.compile(r"@[\w$.]+\s*").match(src.mask, x)
            x = m.end()
            if x < y and src.mask[x] == "(":
                x = src.close(x) + 1
        lead = re.compile(r"\s*(?:(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?\s*").match(src.mask, x, y)
        x = lead.end()
        if x >= y:
            continue
        stop = src.close(x) + 1 if src.mask[x] in "{[" else re.compile(r"[\w$]*").match(src.mask, x).end()
        pattern = src.text[x:stop]
        rest = re.compile(r"\s*(\?)?\s*(:)?\s*").match(src.mask, stop)
        optional = bool(rest[1])
        kind = ""
        if rest[2]:
            end = src.find_outside(rest.end(), y, "=")
            kind = src.text[rest.end() : y if end < 0 else end].strip()
        props = types.get(kind, {})
        literal = kind.startswith("{")
        if literal:
            brace = rest.end()
            props = _members_of_type(src, brace + 1, src.close(brace))
        known = literal or kind in types
        if pattern.startswith("{"):
            if kind and not known:
                found.append(param(name_from_type(kind), [kind], optional))
                continue
            own = []
            for p, q in src.parts(x + 1, stop - 1):
                piece = src.text[p:q]
                if piece.startswith("..."):
                    continue
                eq = src.find_outside(p, q, "=")
                left = src.text[p : q if eq < 0 else eq].strip()
                key, colon, alias = (s.strip() for s in left.partition(":"))
                t, o = props.get(key, ("unknown", False))
                if colon:
                    own.append(param(src.text[p:q].partition(":")[2].strip(), [t], o or optional))
                else:
                    own.append(param(key, [t], True if eq >= 0 else o or optional))
            found += own or [param(re.sub(r"\s+", " ", pattern).strip(), ["OBJECT"], optional)]
        elif pattern and pattern != "this":
            if known and props:
                found += [param(p, [t], o or optional, docs.get(f"{pattern}.{p}")) for p, (t, o) in props.items()]
            else:
                found.append(param(pattern, [kind] if kind else [], optional))
    for p in found:
        p["doc"] = p["doc"] or docs.get(p["name"]) or None
    return found


def _decorators(src: Source, a: int, b: int) -> tuple[list[str], int]:
    marks = []
    while True:
        m = re.compile(r"\s*@([\w$.]+)\s*").match(src.mask, a, b)
        if not m:
            return marks, a
        marks.append(m[1])
        a = m.end()
        if a < b and src.mask[a] == "(":
            a = src.close(a) + 1


def _signature(src: Source, at: int, types: TypeMap, docs: dict[str, str]) -> tuple[list[dict], list[str], int] | None:
    """Parameters, return type and position of the body's brace, from the `<` or `(` after a name."""
    if at < len(src.mask) and src.mask[at] == "<":
        at = src.close(at) + 1
    if at >= len(src.mask) or src.mask[at] != "(":
        return None
    close = src.close(at)
    params = _params(src, at + 1, close, types, docs)
    i = close + 1
    m = re.compile(r"\s*:\s*").match(src.mask, i)
    returns = []
    if m:
        i = m.end()
        begin = i
        while i < len(src.mask):
            c = src.mask[i]
            if c in "{([":
                if c == "{" and src.text[begin:i].strip() and not re.search(r"(?:[|&<,:]|=>|\bis)\s*$", src.mask[begin:i]):
                    break
                i = src.close(i) + 1
                continue
            if c == "<":
                i = src.close(i) + 1
                continue
            if c == ";" or (c == "\n" and src.text[begin:i].strip() and not re.search(r"[|&]\s*$", src.mask[begin:i]) and not re.match(r"\s*[|&{]", src.mask[i:])):
                break
            i += 1
        returns = [src.text[begin:i].strip()]
    m = re.compile(r"\s*\{").match(src.mask, i)
    return params, returns, m.end() - 1 if m else -1


def parse(path: str, content: str, types: TypeMap) -> list[dict]:
    src = Source(content, "\"'`")
    rows = []
    exports = [(m.start(), m.end()) for m in re.finditer(r"\bexport\b", src.mask)]
    for m in _FUNCTION.finditer(src.mask):
        begin = m.start()
        head = re.compile(r"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\bdeclare\s+)?(?:\basync\s+)?$").search(src.mask[:begin])
        lead = src.mask[head.start() : begin]
        before = src.mask[: head.start()].rstrip()
        if before and before[-1] not in ";{}" and not lead.strip():
            if before[-1] in "=(,:?&|" or re.search(r"\b(?:return|new)$", before):
                continue  # a function expression
        description, docs = _docs(src.comment_before(head.start()))
        got = _signature(src, m.end(), types, docs)
        if got is None or got[2] < 0:
            continue
        exported = "export" in lead or _inside_export(src, begin, exports)
        modifiers = [w for w in lead.split() if w in _WORDS] + (["export"] if exported and "export" not in lead else [])
        rows.append(row(path, at=begin, name=m[1], modifiers=modifiers, doc=description, params=got[0], returns=got[1]))
    for begin, end, owner in _bodies(src):
        for a, head, stop in _class_members(src, begin, end):
            marks, at = _decorators(src, a, head)
            words = []
            while True:
                m = re.compile(r"\s*([\w$]+)\b(?=\s+[\w$#\[*]|\s*\*)").match(src.mask, at, head)
                if not m or m[1] not in _WORDS:
                    break
                words.append(m[1])
                at = m.end()
            m = re.compile(r"\s*\*?\s*(#?[\w$]+)\s*\??\s*(?=[<(])").match(src.mask, at)
            if not m or m.end() > stop or m[1] in _NOT_METHODS:
                continue
            description, docs = _docs(src.comment_before(a))
            got = _signature(src, m.end(), types, docs)
            if got is None or got[2] < 0:
                continue
            rows.append(row(path, stage=1, at=a, node="method", name=m[1], owner=owner, modifiers=words, decorators=marks, doc=description, params=got[0], returns=got[1]))
    return rows


def _inside_export(src: Source, at: int, exports: list[tuple[int, int]]) -> bool:
    """Whether the position is within the braces of an exported statement."""
    for _, b in exports:
        brace = src.mask.find("{", b, at)
        if brace >= 0 and ";" not in src.mask[b:brace] and src.close(brace) > at:
            return True
    return False


def _bodies(src: Source) -> list[tuple[int, int, str]]:
    """Class bodies, and object literals, each with the nearest class around it."""
    classes = []
    for m in _CLASS.finditer(src.mask):
        brace = src.mask.find("{", m.end())
        while brace >= 0 and re.search(r"[<,(&|:]\s*$", src.mask[m.end() : brace]):
            brace = src.mask.find("{", src.close(brace) + 1)
        if brace >= 0 and ";" not in src.mask[m.end() : brace]:
            classes.append((brace + 1, src.close(brace), m[2], m[1]))
    bodies = [(a, b, name) for a, b, name, kind in classes if kind == "class"]
    for m in re.finditer(r"(?:[=(,:\[?]|\breturn|=>\s*\()\s*\{", src.mask):
        a = m.end()
        if not re.match(r"\s*(?:\.\.\.|['\"]?[\w$#]+['\"]?\s*[:,(<}]|(?:async|get|set|static)\s+[\w$]+\s*[(<])", src.mask[a:]):
            continue
        around = [c for c in classes if c[0] <= a < c[1]]
        bodies.append((a, src.close(a - 1), max(around)[2] if around else ""))
    return sorted(bodies)


def _class_members(src: Source, a: int, b: int):
    """Members of a body: start, end of the header and end; commas and semicolons divide them too."""
    i = a
    while i < b:
        if src.mask[i].isspace() or src.mask[i] in ";,":
            i += 1
            continue
        j = i
        while j < b and src.mask[j] not in ";,":
            if src.mask[j] in "([{":
                opening = src.mask[j]
                j = src.close(j) + 1
                if opening == "{" and not re.match(r"\s*[\[{;,=.|&)]", src.mask[j:b]):
                    break
                continue
            j += 1
        end = max(j, i + 1)
        head = src.mask.find("{", i, end)
        yield i, head if head >= 0 else end, end
        i = end
