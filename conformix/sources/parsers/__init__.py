"""Parsers: one file's text to raw rows, one for each function, method or class.

They only read syntax. Which rows become features, and how columns are derived,
is decided by expressions in operators/extraction.py.
"""

from __future__ import annotations

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

RAW = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("stage", T.IntegerType()),  # order of node kinds
        T.StructField("at", T.IntegerType()),  # position in the file
        T.StructField("node", T.StringType()),  # function, method, constructor or class
        T.StructField("name", T.StringType()),
        T.StructField("owner", T.StringType()),  # enclosing class, or receiver type
        T.StructField("package", T.StringType()),
        T.StructField("modifiers", _strings),
        T.StructField("decorators", _strings),
        T.StructField("doc", T.StringType()),
        T.StructField("params", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("types", _strings), T.StructField("optional", T.BooleanType()), T.StructField("doc", T.StringType())]))),
        T.StructField("returns", _strings),
        T.StructField("fields_only", T.BooleanType()),  # class with public fields and no initialiser
        T.StructField("statements", T.IntegerType()),  # in the body; NULL without one
    ]
)


def row(path: str, **values) -> dict:
    """A raw row with empty values where none are given."""
    empty = {"path": path, "stage": 0, "at": 0, "node": "function", "name": "", "owner": "", "package": "", "modifiers": [], "decorators": [], "doc": "", "params": [], "returns": [], "fields_only": False, "statements": None}
    return empty | values


def param(name: str, types: list[str], optional: bool = False, doc: str | None = None) -> dict:
    return {"name": name, "types": types, "optional": optional, "doc": doc}
