"""Scalar functions over names, namespaces and codes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    """snake_case: hyphens become underscores, words are split before capitals."""
    c = F.translate(c, "-", "_")
    for before, after in ((".", "[A-Z][a-z]+"), ("[0-9a-z]", "[A-Z]")):
        c = F.regexp_replace(c, f"({before})({after})", "$1_$2")
    return F.lower(c)


def normalize_namespace(path: Column, root: str | Column, prefix: str) -> Column:
    """Module key of a file: the prefix, and behind it the directories under root joined by underscores.

    Files that aren't under root by their string prefix, or lie right in it, have
    the prefix alone. Paths must be absolute and normalised. As the prefix test
    knows no separator, a sibling whose name begins like root gets `..` parts.
    """
    root = F.lit(root.rstrip("/") or "/") if isinstance(root, str) else root
    folder = F.regexp_replace(path, "/[^/]*$", "")
    rest = F.expr("null")
    inside = folder.startswith(F.concat(root, F.lit("/")))
    rest = F.when(folder == root, F.lit("")).when(root == "/", F.substr(folder, F.lit(2)))
    rest = rest.when(inside, F.substr(folder, F.length(root) + 2))
    # beside root: up to the common parent, then down
    rest = rest.otherwise(F.concat(F.lit("../"), F.substr(folder, F.length(F.regexp_replace(root, "[^/]*$", "")) + 1)))
    return F.when(~path.startswith(root) | (rest == ""), F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "_"), F.regexp_replace(rest, "/", "_")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def module_key(namespace: Column, normalized: Column) -> Column:
    """Group of a feature: its normalised namespace, else its namespace, else a fixed name."""
    return F.coalesce(blank_to_null(normalized), blank_to_null(namespace), F.lit("Unknown Module"))


def display_name(original: Column, normalized: Column, member: Column) -> Column:
    """Name as reports show it, with the class in front unless it is empty or `null`."""
    name = F.coalesce(blank_to_null(original), normalized)
    return F.when((F.coalesce(member, F.lit("")) == "") | (F.lower(member) == "null"), name).otherwise(F.concat(member, F.lit("."), name))


def display_type(kind: Column) -> Column:
    return F.when(kind == "CONSTRUCTOR", "constructor").when(kind.isin("FUNCTION", "CLASS_METHOD"), "function").when(kind == "INSTANCE_METHOD", "method").otherwise("unknown")


def type_priority(kind: Column) -> Column:
    """Order of kinds in reports."""
    return F.when(kind == "CONSTRUCTOR", 0).when(kind.isin("FUNCTION", "CLASS_METHOD"), 1).when(kind == "INSTANCE_METHOD", 2).otherwise(3)


def kind_class(kind: Column) -> Column:
    """C, F or M for kinds that can be compared with each other; else the kind itself."""
    return F.when(kind == "CONSTRUCTOR", "C").when(kind.isin("FUNCTION", "CLASS_METHOD"), "F").when(kind == "INSTANCE_METHOD", "M").otherwise(kind)


def language_code(language: Column) -> Column:
    """Short code of a language name; Python keeps its long one."""
    name = F.upper(language)
    return F.when(name.isin("TYPESCRIPT", "TS"), "ts").when(name == "JAVA", "java").when(name.isin("GOLANG", "GO"), "go").otherwise(F.lower(name))


def code(language: str) -> str:
    """language_code of a plain string."""
    name = language.upper()
    return {"TYPESCRIPT": "ts", "TS": "ts", "JAVA": "java", "GOLANG": "go", "GO": "go"}.get(name, name.lower())


def csv_cell(c: Column) -> Column:
    """Quoted only if it has a comma, a quote or a line feed; NULL is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.contains(",") | c.contains('"') | c.contains("\n"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def raw_columns(namespace: Column, normalized_namespace: Column, member: Column, normalized_member: Column, original: Column, normalized: Column) -> tuple[Column, Column, Column]:
    """Namespace, class and name as the CSV report has them."""
    ns = F.coalesce(blank_to_null(namespace), blank_to_null(normalized_namespace), F.lit(""))
    mem = F.coalesce(blank_to_null(member), blank_to_null(normalized_member), F.lit(""))
    return ns, F.when(F.lower(mem) == "null", "").otherwise(mem), F.coalesce(blank_to_null(original), blank_to_null(normalized), F.lit(""))


def module_file(module: Column) -> Column:
    return F.concat(F.replace(module, F.lit("."), F.lit("_")), F.lit(".md"))


def status_icon(score: Column) -> Column:
    return F.when(score == 1.0, "✅").when(score >= F.lit(0.8), "⚠️").otherwise("❌")
