"""Reading of bracketed languages: masking of strings and comments, brackets, lists."""

from __future__ import annotations

import re
from functools import lru_cache

_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_INSIDE = re.compile(r"[^\n]")


@lru_cache(maxsize=16)
def _starts(quotes: str) -> re.Pattern:
    """Where a comment or a string may begin."""
    return re.compile(f"//|/\\*|[{re.escape(quotes)}]")


class Source:
    """A text, the same with the insides of comments and strings blanked, and its comments."""

    def __init__(self, text: str, quotes: str, raw_quotes: str = "", text_blocks: bool = False):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        out, i, n, done = [], 0, len(text), 0
        starts = _starts(quotes + raw_quotes)

        def blank(a: int, b: int) -> None:
            nonlocal done
            if a < b:
                out.append(text[done:a])
                out.append(_INSIDE.sub(" ", text[a:b]))
                done = b

        while m := starts.search(text, i):
            i = m.start()
            c, two = text[i], text[i : i + 2]
            if two == "//":
                j = text.find("\n", i)
                j = n if j < 0 else j
                blank(i, j)
            elif two == "/*":
                j = text.find("*/", i + 2)
                j = n if j < 0 else j + 2
                self.comments.append((i, j))
                blank(i, j)
            elif text_blocks and text[i : i + 3] == '"""':
                j = text.find('"""', i + 3)
                j = n if j < 0 else j + 3
                blank(i + 1, j - 1)
            elif c in raw_quotes:
                j = text.find(c, i + 1)
                j = n if j < 0 else j + 1
                blank(i + 1, j - 1)
            else:
                j = i + 1
                while j < n and text[j] != c and (text[j] != "\n" or c == "`"):
                    j += 2 if text[j] == "\\" else 1
                j = min(j + 1, n)
                blank(i + 1, j - 1)
            i = j
        self.mask = "".join([*out, text[done:]])

    def close(self, at: int) -> int:
        """Position of the bracket that closes the one at `at`; the end of the text if none does."""
        opening = self.mask[at]
        closing, depth = _PAIRS[opening], 0
        for m in re.finditer(f"[{re.escape(opening + closing)}]", self.mask[at:]):
            if closing == ">" and at + m.start() and self.mask[at + m.start() - 1] in "=-":
                continue
            depth += 1 if m[0] == opening else -1
            if not depth:
                return at + m.start()
        return len(self.mask)

    def balanced(self) -> bool:
        """Whether round, square and curly brackets pair up outside strings and comments."""
        open_: list[str] = []
        for m in re.finditer(r"[()\[\]{}]", self.mask):
            if m[0] in "([{":
                open_.append(_PAIRS[m[0]])
            elif not open_ or open_.pop() != m[0]:
                return False
        return not open_

    def parts(self, a: int, b: int, separator: str = ",") -> list[tuple[int, int]]:
        """Ranges between separators outside brackets, without white space; empty ones are left out."""
        found, depth, begin = [], 0, a
        for i in range(a, b + 1):
            c = self.mask[i] if i < b else separator
            if c in "([{<":
                depth += 1
            elif c in ")]}" or (c == ">" and self.mask[i - 1] not in "=-"):
                depth = max(0, depth - 1)
            elif (c == separator and depth == 0) or i == b:
                x, y = begin, i
                while x < y and self.mask[x].isspace():
                    x += 1
                while y > x and self.mask[y - 1].isspace():
                    y -= 1
                if y > x:
                    found.append((x, y))
                begin = i + 1
        return found

    def find_outside(self, a: int, b: int, chars: str) -> int:
        """First position in [a, b) of one of the characters outside brackets, -1 if none."""
        depth = 0
        for i in range(a, b):
            c = self.mask[i]
            if c in chars and depth == 0 and not (c == "=" and self.mask[i : i + 2] in ("=>", "==")):
                return i
            if c in "([{<":
                depth += 1
            elif c in ")]}" or (c == ">" and self.mask[i - 1] not in "=-"):
                depth = max(0, depth - 1)
        return -1

    def members(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """Members of a body: start, end of the header, and end; a header ends at `{`, `;` or the end."""
        found, i = [], a
        while i < b:
            if self.mask[i].isspace() or self.mask[i] in ";},":
                i += 1
                continue
            j = i
            while j < b and self.mask[j] not in ";{":
                j = self.close(j) + 1 if self.mask[j] in "([" else j + 1
            end = self.close(j) + 1 if j < b and self.mask[j] == "{" else j + 1
            found.append((i, min(j, b), min(end, b)))
            i = end
        return found

    def comment_before(self, at: int) -> str:
        """The doc comment that only white space separates from the position; empty if there is none."""
        for a, b in self.comments:
            if b <= at and self.text[a : a + 3] == "/**" and not self.text[b:at].strip():
                return self.text[a:b]
        return ""


def clean_comment(comment: str) -> str:
    """Text of a doc comment without its stars."""
    body = re.sub(r"\*/\s*$", "", re.sub(r"^/\*\*", "", comment.strip()))
    return "\n".join(re.sub(r"^\*", "", line.strip()).strip() for line in body.split("\n")).strip()
