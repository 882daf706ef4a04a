"""Java, by a scanner of class bodies."""

from __future__ import annotations

import re

from . import param, row
from .text import Source, clean_comment

_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_ANONYMOUS = re.compile(r"\bnew\s+[\w.]+\s*(<[^(){};]*>)?\s*\(")
_WORD = re.compile(r"\w+")


def _annotations(src: Source, a: int, b: int) -> tuple[list[str], list[str], int]:
    """Plain annotations and keywords at the start of a header, and where the rest begins."""
    marks, words = [], []
    keywords = {"public", "protected", "private", "static", "final", "abstract", "default", "synchronized", "native", "strictfp", "transient", "volatile", "sealed"}
    while True:
        while a < b and src.mask[a].isspace():
            a += 1
        if a < b and src.mask[a] == "@" and not src.mask.startswith("@interface", a):
            m = re.compile(r"@\s*[\w.]+").match(src.mask, a)
            end = m.end() if m else a + 1
            k = end
            while k < b and src.mask[k].isspace():
                k += 1
            if k < b and src.mask[k] == "(":
                end = src.close(k) + 1
            else:
                marks.append(src.text[a + 1 : end].strip())
            a = end
            continue
        m = _WORD.match(src.mask, a, b)
        if m and m[0] in keywords:
            words.append(m[0])
            a = m.end()
            continue
        return marks, words, a


def _params(src: Source, a: int, b: int) -> list[dict]:
    found = []
    for x, y in src.parts(a, b):
        if "..." in src.mask[x:y]:
            continue
        _, _, x = _annotations(src, x, y)
        m = re.compile(r"(.*?)\s*\b(\w+)((?:\s*\[\s*\])*)$", re.S).match(src.text[x:y])
        if m and m[2] != "this":
            found.append(param(m[2], [m[1].strip() or "Object"]))
    return found


def _body(src: Source, path: str, package: str, owner: str, kind: str, a: int, b: int, rows: list) -> None:
    if kind == "enum":
        stop = src.find_outside(a, b, ";")
        end = b if stop < 0 else stop
        for x, y in src.parts(a, end):
            brace = src.find_outside(x, y, "{")
            if brace >= 0:  # methods of a constant's body belong to the enum
                _body(src, path, package, owner, "class", brace + 1, src.close(brace), rows)
        a = b if stop < 0 else stop + 1
    for begin, head, end in src.members(a, b):
        marks, words, at = _annotations(src, begin, head)
        has_body = head < b and src.mask[head] == "{"
        m = _TYPE.search(src.mask, at, head)
        opening = src.find_outside(at, head, "(=")
        is_call = opening >= 0 and src.mask[opening] == "("
        if m and (not is_call or m[1] == "record"):
            if has_body:
                inner = owner if m[1] == "record" else m[2]
                _body(src, path, package, inner, m[1], head + 1, end - 1, rows)
            continue
        if is_call:
            before = re.sub(r"^\s*<[^()]*?>\s*(?=\S)", "", src.text[at:opening], flags=re.S) if src.mask[at] == "<" else src.text[at:opening]
            m = re.compile(r"(.*?)\b(\w+)\s*$", re.S).match(before)
            if m:
                kind_of = m[1].strip()
                node = "method" if kind_of else "constructor"
                rows.append(
                    row(
                        path,
                        stage=0 if kind_of else 1,
                        at=begin,
                        node=node,
                        name=m[2],
                        owner=owner,
                        package=package,
                        modifiers=words,
                        decorators=marks,
                        doc=clean_comment(src.comment_before(begin)),
                        params=_params(src, opening + 1, src.close(opening)),
                        returns=[kind_of] if kind_of else [],
                    )
                )
        # local and anonymous classes
        k = opening if opening >= 0 else at
        while k < end:
            local, anonymous = _TYPE.search(src.mask, max(k, head), end), _ANONYMOUS.search(src.mask, k, end)
            nearest = min((x for x in (local, anonymous) if x), key=lambda x: x.start(), default=None)
            if nearest is None:
                break
            brace = src.mask.find("{", nearest.end(), end) if nearest is local else src.close(nearest.end() - 1) + 1
            while 0 <= brace < end and src.mask[brace].isspace():
                brace += 1
            if not 0 <= brace < end or src.mask[brace] != "{":
                k = nearest.end()
                continue
            close = src.close(brace)
            _body(src, path, package, nearest[2] if nearest is local and nearest[1] != "record" else owner, nearest[1] if nearest is local else "class", brace + 1, close, rows)
            k = close + 1


def parse(path: str, content: str) -> list[dict]:
    src = Source(content, "\"'", text_blocks=True)
    m = re.search(r"^\s*package\s+([\w.]+)\s*;", src.mask, re.M)
    rows: list[dict] = []
    _body(src, path, m[1] if m else "", "", "file", m.end() if m else 0, len(content), rows)
    return rows
