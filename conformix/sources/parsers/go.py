"""Go, by a scanner of top-level functions."""

from __future__ import annotations

import re

from . import param, row
from .text import Source

_FUNC = re.compile(r"^func\b\s*", re.M)
_NAMED = re.compile(r"(\w+)((?:\s*,\s*\w+)*)\s+(\S.*)", re.S)
_GOES_ON = re.compile(r"(?:[,.(\[{+\-*/%&|^<>=:!]|\b(?:return|go|defer))\s*$")


def _declared(src: Source, a: int, b: int) -> list[tuple[list[str], str]]:
    """Names and type of each declaration of a parameter list; no names where only types are given."""
    parts = [src.text[x:y] for x, y in src.parts(a, b)]
    named = [m for p in parts if (m := _NAMED.fullmatch(p)) and m[1] not in ("chan", "func", "map", "struct", "interface")]
    if not named:
        return [([], p) for p in parts]
    found, pending = [], []
    for p in parts:
        m = _NAMED.fullmatch(p)
        if m:
            found.append(([*pending, m[1]], m[3].strip()))
            pending = []
        else:
            pending.append(p)
    return found


def _statements(src: Source, a: int, b: int) -> int:
    """Statements of a block: lines or parts between semicolons that don't continue the one before."""
    count, depth, begin = 0, 0, a
    open_, last = False, ""
    for i in range(a, b + 1):
        c = src.mask[i] if i < b else "\n"
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if (c in "\n;" and depth == 0) or i == b:
            line = src.mask[begin:i].strip()
            if line:
                if not (open_ and _GOES_ON.search(last)):
                    count += 1
                last, open_ = line, c == "\n"
            begin = i + 1
    return count


def parse(path: str, content: str) -> list[dict]:
    src = Source(content, "\"'", raw_quotes="`")
    if not re.search(r"^\s*package\s+\w+", src.mask, re.M) or not src.balanced():
        return []  # a file with errors has no features
    rows = []
    for m in _FUNC.finditer(src.mask):
        at, owner, node = m.end(), "", "function"
        if at < len(src.mask) and src.mask[at] == "(":
            close = src.close(at)
            node = "method"
            declared = _declared(src, at + 1, close)
            owner = declared[0][1].lstrip("*") if declared else ""
            at = close + 1
        name = re.compile(r"\s*(\w+)\s*").match(src.mask, at)
        if not name:
            continue
        at = name.end()
        if at < len(src.mask) and src.mask[at] == "[":
            at = src.close(at) + 1
        if at >= len(src.mask) or src.mask[at] != "(":
            continue
        close = src.close(at)
        params = [param(names[0], [kind]) for names, kind in _declared(src, at + 1, close) if names and not kind.startswith("...")]
        at = close + 1
        # the result: up to the body, or the end of the line
        end, depth = at, 0
        while end < len(src.mask):
            c = src.mask[end]
            if c == "{" and depth == 0 and not re.search(r"\b(?:interface|struct)\s*$", src.mask[at:end]):
                break
            if c == "\n" and depth == 0:
                break
            depth += (c in "([{") - (c in ")]}")
            end += 1
        result = src.text[at:end].strip()
        if result.startswith("("):
            opening = src.mask.index("(", at)
            returns = [kind for names, kind in _declared(src, opening + 1, src.close(opening))]
        else:
            single = re.fullmatch(r"\*.+|[\w.]+|\[\].+|map\[.+", result, re.S)
            returns = [result] if single else []
        statements = _statements(src, end + 1, src.close(end)) if end < len(src.mask) and src.mask[end] == "{" else None
        rows.append(row(path, stage=int(node == "method"), at=m.start(), node=node, name=name[1], owner=owner, params=params, returns=returns, statements=statements))
    return rows
