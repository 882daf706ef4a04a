"""Python, by the standard library's parser.

What it rejects is blanked, a line or else a block at a time, so that one error
doesn't hide the other definitions of a file.
"""

from __future__ import annotations

import ast

from . import param, row


def _doc(node: ast.AST) -> str:
    first = node.body[0] if node.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return first.value.value.strip()
    return ""


def _params(node, text) -> list[dict]:
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    known = [(x, i >= len(plain) - len(a.defaults)) for i, x in enumerate(plain)]
    known += [(a.vararg, False)] if a.vararg else []
    known += [(x, d is not None) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    known += [(a.kwarg, False)] if a.kwarg else []
    return [param(x.arg, [text(x.annotation)] if x.annotation else [], optional) for x, optional in known if x.arg not in ("self", "cls")]


def _fields(node: ast.ClassDef, text) -> tuple[list[dict], bool]:
    """Public class-level names with their types, up to an initialiser; whether one was met."""
    found = []
    for s in node.body:
        if isinstance(s, ast.FunctionDef) and s.name == "__init__" and not s.decorator_list:
            return found, True
        if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            found.append(param(s.target.id, [text(s.annotation)], s.value is not None))
        elif isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Name):
            found.append(param(s.targets[0].id, [], True))
    return [f for f in found if not f["name"].startswith("_")], False


_ATTEMPTS = 200


def _tree(content: str) -> tuple[ast.AST | None, str]:
    """Syntax tree of the text, and the text with what had to be blanked."""
    lines = content.split("\n")
    for attempt in range(_ATTEMPTS):
        try:
            return ast.parse("\n".join(lines)), "\n".join(lines)
        except SyntaxError as e:
            at = min(max(1, e.lineno or 1), len(lines)) - 1
            while at > 0 and not lines[at].strip():
                at -= 1
        except (ValueError, RecursionError):
            return None, content
        if not lines[at].strip():  # an error before any text: what follows it
            at = next((i for i, line in enumerate(lines) if line.strip()), at)
        end = at + 1
        if attempt >= _ATTEMPTS // 2:  # many errors: the rest of the block at once
            depth = len(lines[at]) - len(lines[at].lstrip())
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
                end += 1
        for i in range(at, end):
            # a definition that can't be read keeps its block valid
            lines[i] = ""
        before = next((lines[i] for i in range(at - 1, -1, -1) if lines[i].strip()), "")
        after = next((lines[i] for i in range(end, len(lines)) if lines[i].strip()), "")
        depth = len(before) - len(before.lstrip())
        if before.rstrip().endswith(":") and len(after) - len(after.lstrip()) <= depth:
            lines[at] = " " * (depth + 1) + "pass"
    return None, content


def parse(path: str, content: str) -> list[dict]:
    tree, content = _tree(content)
    if tree is None:
        return []
    lines = content.split("\n")
    begin = [0]
    for line in lines:
        begin.append(begin[-1] + len(line) + 1)

    def text(node) -> str:
        return ast.get_source_segment(content, node) or ""

    rows = []
    stack = [(tree, "")]
    while stack:
        node, owner = stack.pop()
        inner = node.name if isinstance(node, ast.ClassDef) else owner
        for child in ast.iter_child_nodes(node):
            stack.append((child, inner))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            rows.append(
                row(
                    path,
                    at=begin[node.lineno - 1] + node.col_offset,
                    name=node.name,
                    owner=owner,
                    modifiers=["async"] if isinstance(node, ast.AsyncFunctionDef) else [],
                    decorators=[text(d) for d in node.decorator_list],
                    doc=_doc(node),
                    params=_params(node, text),
                    returns=[text(node.returns)] if node.returns else [],
                )
            )
        elif isinstance(node, ast.ClassDef):
            fields, has_init = _fields(node, text)
            rows.append(row(path, stage=1, at=begin[node.lineno - 1] + node.col_offset, node="class", name=node.name, owner=node.name, doc=_doc(node), params=fields, fields_only=bool(fields) and not has_init))
    return rows
