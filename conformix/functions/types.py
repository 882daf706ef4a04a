"""Normalisation of type texts of four languages to language-neutral type names."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _words(**names: str) -> dict[str, str]:
    """Type name by word, from the words of each name."""
    return {word: name for name, words in names.items() for word in words.split()}


KEYWORDS = _words(
    NULL="none",
    LIST="array asyncgenerator asynciterable asynciterator generator iterable iterator list slice vector",
    SET="set",
    MAP="dict dictionary hash map record",
    NUMBER="double float int int64 integer long",
    STRING="str string",
    BOOLEAN="bool boolean",
)
_GO = _words(STRING="byte rune string", NUMBER="complex128 complex64 float32 float64 int int16 int32 int64 int8 uint uint16 uint32 uint64 uint8 uintptr", BOOLEAN="bool boolean")
_TS = _words(STRING="formattedstring path string", NUMBER="double float int integer number", BOOLEAN="bool boolean", UNKNOWN="unknown", OBJECT="any object")
_TS_NOTHING = {"void", "undefined", "null"}
_TS_LISTS = set("Array AsyncGenerator AsyncIterable AsyncIterator Generator Iterable Iterator ReadonlyArray".split())
_JAVA = _words(STRING="char character charsequence string", NUMBER="bigdecimal biginteger byte double float int integer long number short", BOOLEAN="bool boolean")
_JAVA_WRAPPED = set("CompletableFuture Flux Future Mono Promise Single".split())
_JAVA_GENERIC = _words(LIST="ArrayList Collection Iterable LinkedList List", MAP="ConcurrentHashMap HashMap Map TreeMap", SET="HashSet Set TreeSet")
_GENERIC = re.compile(r"(\w+)<(.+)>", re.S)


def keyword(text: str) -> str:
    return KEYWORDS.get(text.strip().lower(), "OBJECT")


def distinct(items) -> list[str]:
    return list(dict.fromkeys(items))


def split_outside(text: str, separator: str, opening: str, closing: str) -> list[str]:
    """Parts between separators that aren't inside brackets, without white space around them."""
    parts, depth, begin = [], 0, 0
    for at, c in enumerate(text):
        if c in opening:
            depth += 1
        elif c in closing:
            depth -= 1
        elif c == separator and depth == 0:
            parts.append(text[begin:at].strip())
            begin = at + 1
    if begin < len(text):
        parts.append(text[begin:].strip())
    return parts


def _each(parts, rule) -> list[str]:
    return distinct(t for p in parts for t in rule(p))


def python_types(text: str) -> list[str]:
    text = text.strip()
    if not text:
        return ["OBJECT"]
    closed = text.endswith("]")
    if closed and text.startswith("Union["):
        return _each(_arguments(text[6:-1]), python_types)
    if closed and text.startswith("Optional["):
        inner = python_types(text[9:-1])
        return inner if "NULL" in inner else [*inner, "NULL"]
    if closed and text[:6].lower() == "tuple[":
        return _each(_arguments(text[6:-1]), python_types)
    if "|" in text:
        return _each(text.split("|"), python_types)
    if closed and "[" in text:
        return [keyword(text[: text.index("[")])]
    return [keyword(text)]


def _arguments(text: str) -> list[str]:
    return split_outside(text, ",", "[", "]")


def typescript_types(text: str) -> list[str]:
    text = text.strip()
    if not text:
        return ["OBJECT"]
    if text in _TS_NOTHING:
        return ["NULL"]
    if "|" in text:
        parts = split_outside(text, "|", "<", ">")
        if len(parts) > 1:
            return _each(parts, typescript_types)
    m = _GENERIC.fullmatch(text)
    if m:
        base = m[1]
        if base == "Promise":
            return typescript_types(m[2])
        return ["LIST" if base in _TS_LISTS else {"Map": "MAP", "Set": "SET"}.get(base, "OBJECT")]
    low = text.lower()
    if low in _TS:
        return [_TS[low]]
    if text[-2:] == "[]":
        kind = "LIST"
    elif "{" in text or low.startswith(("record", "map")):
        kind = "MAP"
    else:
        kind = "SET" if low.startswith("set") else "OBJECT"
    return [kind]


def go_types(text: str) -> list[str]:
    text = text.strip()
    while True:
        if not text:
            return ["OBJECT"]
        if text.startswith("map["):
            return ["MAP"]
        close, blank = text.find("]"), text.find(" ")
        if text.startswith("[") and close > 0 and (blank < 0 or text.startswith("[]") or close < blank):
            return ["LIST"]
        if not text.startswith("*"):
            return [_GO.get(text.lower(), "OBJECT")]
        text = text[1:].strip()


def java_types(text: str) -> list[str]:
    text = text.strip()
    if not text:
        return ["OBJECT"]
    if text.lower() in {"completable", "void"}:
        return ["NULL"]
    if text[-2:] == "[]":
        return ["LIST"]
    m = _GENERIC.fullmatch(text)
    if m:
        if m[1] in _JAVA_WRAPPED:
            return java_types(m[2])
        if m[1] in ("Optional", "Maybe"):
            inner = java_types(m[2])
            return inner if "NULL" in inner else [*inner, "NULL"]
        return [_JAVA_GENERIC.get(m[1], "OBJECT")]
    return [_JAVA.get(text.lower(), "OBJECT")]


_RULES = {"python": python_types, "py": python_types, "typescript": typescript_types, "ts": typescript_types, "go": go_types, "golang": go_types, "java": java_types}


@lru_cache(maxsize=100_000)
def _normalized(text: str, language: str) -> tuple[str, ...]:
    rule = _RULES.get(language.lower())
    return tuple(rule(text)) if rule else (keyword(text),)


def normalize_type(text: str, language: str) -> list[str]:
    """Type names of a type text; languages that aren't known use the keywords alone."""
    return list(_normalized(text, language))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normalize_types(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else normalize_type(t, l or "") for t, l in zip(text, language)])


def normalized_types(text: Column, language: Column | str) -> Column:
    """The grammars that recurse, as an Arrow function; NULL stays NULL."""
    return _normalize_types(text, F.lit(language) if isinstance(language, str) else language)
