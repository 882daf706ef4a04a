"""From source trees to feature tables: parse, filter, derive.

Files are read and parsed in one pass; only TypeScript's named types meet the files
that mention them in a join. Parsers only give raw rows; which of them are features,
and every derived column, are expressions here. The order of rows takes one shuffle,
by ranges of paths.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.types import normalize_type
from ..schema import FEATURE, Registry
from ..sources import scan as files
from ..sources.parsers import RAW, go, java, python, typescript
from ..sources.scan import Project
from .ordering import boundaries, ordered

_PARSERS = {"python": python.parse, "java": java.parse, "go": go.parse}


#: Raw rows of a batch.
_BATCH_ROWS = 1000
_PROPS = "array<struct<prop:string,type:string,optional:boolean>>"


def type_map(sources: DataFrame) -> DataFrame:
    """(name, props) of the named object types of a tree.

    Of several definitions the last by path counts; within a file aliases come
    after interfaces, then the later one counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch["path"], batch["content"]) for x in typescript.type_map(bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["path", "name", "alias", "at", "prop", "type", "optional"])

    rows = sources.mapInPandas(run, "path string, name string, alias boolean, at int, prop string, type string, optional boolean")
    place = F.struct("path", "alias", "at")
    one = rows.groupBy("name", place.alias("place")).agg(F.filter(F.collect_list(F.struct("prop", "type", "optional")), lambda p: p["prop"] != "").alias("props"))
    return one.groupBy("name").agg(F.max_by("props", "place").alias("props"))


def with_types(sources: DataFrame, types: DataFrame) -> DataFrame:
    """Sources with `types`: name and properties of those named types that the file mentions.

    Types meet files by name, so neither side is held by the driver or a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, w) for p, c in zip(batch["path"], batch["content"]) for w in sorted(typescript.mentioned(bytes(c).decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["path", "name"])

    found = sources.mapInPandas(run, "path string, name string").join(types, "name")
    found = found.groupBy("path").agg(F.collect_list(F.struct("name", "props")).alias("types"))
    return sources.select("path", "content").join(found, "path", "left")


def parse(sources: DataFrame, language: str) -> DataFrame:
    """Raw rows of all files; for TypeScript `types` holds the named types of with_types, if there is such a column."""
    has_types = "types" in sources.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(RAW), []
        for batch in batches:
            lists = batch.column(2).to_pylist() if has_types else [None] * batch.num_rows
            for path, content, types in zip(batch.column(0).to_pylist(), batch.column(1), lists):
                text = content.as_py().decode("utf-8", "replace")
                if language == "typescript":
                    rows += typescript.parse(path, text, {t["name"]: {p["prop"]: (p["type"], p["optional"]) for p in t["props"]} for t in types or []})
                else:
                    rows += _PARSERS[language](path, text)
                if len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return sources.select("path", "content", *(["types"] if has_types else [])).mapInArrow(run, RAW)


def is_feature(language: str, root: str) -> Column:
    """Whether a raw row is part of the public surface."""
    name, owner, node = F.col("name"), F.col("owner"), F.col("node")
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    if language == "python":
        public = ~name.startswith("_") | name.isin("__init__", "__call__")
        hidden_file = file.startswith("_") & (file != "__init__.py")
        free = (owner == "") & (hidden_file | F.array_contains(parts, "cli"))
        return (name != "") & public & ~free & ((node != "class") | F.col("fields_only"))
    if language == "typescript":
        hidden = name.startswith("_") | name.startswith("#") | F.arrays_overlap("modifiers", F.array(*[F.lit(w) for w in ("private", "protected", "get", "set")]))
        return (name != "") & ~hidden & ((node != "function") | F.array_contains("modifiers", "export"))
    if language == "java":
        plain = "builder canEqual clone equals hashCode toBuilder toString".split()
        accessor = (node == "method") & name.rlike(r"^(?:get|set|is)\p{Lu}")
        return (name != "") & ~name.startswith("test") & ~name.isin(*plain) & ~accessor & ~owner.endswith("Builder")
    trivial = F.col("statements").isNotNull() & (F.col("statements") <= 1)
    return (name != "") & ~trivial & ~name.rlike(r"^\p{Ll}") & files.holds_features(F.col("path"), "go")


def kind(language: str) -> Column:
    """Kind of a feature."""
    name, has = F.col("name"), F.col("owner") != ""
    if language == "python":
        class_level = F.arrays_overlap("decorators", F.array(F.lit("classmethod"), F.lit("staticmethod")))
        member = F.when(name == "__init__", "CONSTRUCTOR").when(class_level, "CLASS_METHOD").otherwise("INSTANCE_METHOD")
        return F.when(F.col("node") == "class", "CONSTRUCTOR").when(has, member).otherwise("FUNCTION")
    static = F.array_contains("modifiers", "static")
    if language == "typescript":
        member = F.when(name == "constructor", "CONSTRUCTOR").when(static, "CLASS_METHOD").otherwise("INSTANCE_METHOD")
        return F.when(has, member).otherwise("FUNCTION")
    if language == "java":
        return F.when(F.col("node") == "constructor", "CONSTRUCTOR").when(static, "CLASS_METHOD").otherwise("INSTANCE_METHOD")
    return F.when(F.col("node") == "method", "INSTANCE_METHOD").when(name.startswith("New"), "CONSTRUCTOR").otherwise("FUNCTION")


def _drop_lead(parts: Column, lead: list[str]) -> Column:
    if not lead:
        return parts
    return F.when(F.slice(parts, 1, len(lead)) == F.array(*[F.lit(x) for x in lead]), F.slice(parts, len(lead) + 1, F.size(parts))).otherwise(parts)


def namespace(language: str, root: str, project: Project) -> Column:
    """Namespace of a feature's file in its own language."""
    root = root.rstrip("/")
    inside = F.col("path").startswith(root + "/")
    rel = F.when(inside, F.substr("path", F.lit(len(root) + 2))).otherwise(F.col("path"))
    folder = F.filter(F.split(F.regexp_replace(rel, r"(^|/)[^/]*$", ""), "/"), lambda p: ~p.isin("", ".", ".."))
    file = F.element_at(F.split("path", "/"), -1)
    if language == "python":
        parts = _drop_lead(_drop_lead(folder, ["src"]), [p for p in project.python_package.split("/") if p])
        joined = F.array_join(parts, ".")
        return F.when((joined == "") & (file != "__init__.py"), F.regexp_replace(file, r"\.[^.]*$", "")).otherwise(joined)
    if language == "typescript":
        first = F.element_at(folder, 1)
        core = F.slice(folder, 1, 2) == F.array(F.lit("core"), F.lit("src"))
        rest = F.when(core, F.slice(folder, 3, F.size(folder))).when((F.size(folder) > 0) & F.get(folder, F.lit(0)).isin("src", "lib"), F.slice(folder, 2, F.size(folder))).otherwise(folder)
        return F.array_join(rest, ".")
    if language == "java":
        maven = F.regexp_extract(F.concat(F.lit("/"), F.array_join(folder, "/"), F.lit("/")), r"/src/main/java/(.*)$", 1)
        plain = F.regexp_extract(F.concat(F.lit("/"), F.array_join(folder, "/"), F.lit("/")), r"/src/(.*)$", 1)
        by_path = F.when(~inside, F.array_join(F.slice(folder, F.greatest(F.size(folder) - 2, F.lit(1)), 3), ".")).when(maven != "", F.replace(F.rtrim(maven, F.lit("/")), F.lit("/"), F.lit("."))).when(plain != "", F.replace(F.rtrim(plain, F.lit("/")), F.lit("/"), F.lit("."))).otherwise(F.array_join(folder, "."))
        full = F.coalesce(F.nullif(F.col("package"), F.lit("")), by_path)
        own = project.java_package
        return F.when(full == own, "").when(full.startswith(own + "."), F.substr(full, F.lit(len(own) + 2))).otherwise(full) if own else full
    return F.when(inside, F.array_join(F.filter(folder, lambda p: p != "src"), ".")).otherwise("")


def maturity(language: str) -> Column:
    marks = F.col("decorators")
    has = lambda m: F.array_contains(marks, m)
    if language == "java":
        first = F.get(F.filter(marks, lambda m: m.isin("Experimental", "Beta", "Deprecated")), F.lit(0))
        return F.when(first.isin("Experimental", "Beta"), "EXPERIMENTAL").when(first == "Deprecated", "DEPRECATED")
    if language == "go":
        return F.lit(None).cast("string")
    return F.when(has("deprecated"), "DEPRECATED").when(has("experimental"), "EXPERIMENTAL").when(has("beta"), "BETA")


def is_async(language: str) -> Column:
    """True or NULL: being synchronous isn't stated."""
    word = F.array_contains("modifiers", "async")
    result = F.coalesce(F.get("returns", F.lit(0)), F.lit(""))
    if language == "java":
        word = result.rlike("^(?:CompletableFuture|Future|Mono|Flux)") | F.array_contains("decorators", "Async")
    elif language == "typescript":
        word = word | result.startswith("Promise<") | (result == "Promise")
    elif language == "go":
        word = F.lit(False)
    return F.when(word, F.lit(True))


def docstring_params(doc: str) -> dict[str, str]:
    """Descriptions by parameter from the argument section of a docstring."""
    found: dict[str, str] = {}
    inside, current = False, ""
    for line in doc.split("\n"):
        text = line.strip()
        if text.startswith(("Args:", "Arguments:")):
            inside = True
            continue
        if not inside or not text:
            continue
        if text.endswith(":") and text.startswith(("Returns:", "Raises:", "Yields:")):
            break
        head, colon, rest = text.partition(":")
        name = head.split("(")[0].strip()
        if colon and name and " " not in name:
            current = name
            found[current] = rest.strip()
        elif current:
            found[current] = f"{found[current]} {text}".strip()
    return found


def _types_of(language: str):
    """Normalised types of all parameters and returns of a batch."""
    one = "array<string>"

    @F.pandas_udf(f"struct<params:array<{one}>,docs:array<string>,returns:{one}>")
    def run(params: pd.Series, returns: pd.Series, doc: pd.Series, node: pd.Series) -> pd.DataFrame:
        out = []
        for ps, rs, d, n in zip(params, returns, doc, node):
            own = docstring_params(d) if language == "python" and n != "class" else {}
            kinds, docs = [], []
            for p in ps:
                k = [t for x in p["types"] for t in normalize_type(x, language)]
                kinds.append((sorted(set(k)) if language == "typescript" or (language == "python" and n != "class") else k) or ["OBJECT"])
                docs.append(p["doc"] or own.get(p["name"]) or None)
            out.append((kinds, docs, [t for x in rs for t in normalize_type(x, language)]))
        return pd.DataFrame(out, columns=["params", "docs", "returns"])

    return run


def to_features(raw: DataFrame, language: str, root: str, source_root: str = ".", project: Project = Project(), edges: list[str] | None = None) -> DataFrame:
    """Feature table of raw rows; `ord` follows file path, order of node kinds, and position.

    edges: paths that divide the files in ranges (see ordering.boundaries).
    """
    base = os.path.abspath(os.path.join(root, source_root))
    rows = raw.where(is_feature(language, root))
    if language == "go":
        # results named error and contexts say nothing about parity; receivers are shown capitalised
        rows = rows.withColumn("params", F.filter("params", lambda p: F.get(p["types"], F.lit(0)) != "context.Context")).withColumn("returns", F.filter("returns", lambda r: r != "error"))
        rows = rows.withColumn("owner", F.concat(F.upper(F.substr("owner", F.lit(1), F.lit(1))), F.substr("owner", F.lit(2))))
    rows = rows.withColumn("types", _types_of(language)("params", "returns", "doc", "node"))
    shown = F.col("doc")
    if language == "python":
        shown = F.when(shown.contains("Args:"), names.strip(F.substring_index(shown, "Args:", 1))).when(shown.contains("Arguments:"), names.strip(F.substring_index(shown, "Arguments:", 1))).otherwise(shown)
    params = F.transform(
        F.arrays_zip("params", F.col("types.params").alias("kinds"), F.col("types.docs").alias("docs")),
        lambda z: F.struct(
            z["params"]["name"].alias("original_name"),
            names.normalize_name(z["params"]["name"]).alias("normalized_name"),
            z["params"]["types"].alias("original_types"),
            z["kinds"].alias("normalized_types"),
            z["docs"].alias("description"),
            z["params"]["optional"].alias("is_optional"),
        ),
    )
    free = F.lit("") if language == "go" else F.lit("null")
    out = rows.select(
        F.col("name").alias("original_name"),
        names.normalize_name(F.col("name")).alias("normalized_name"),
        F.nullif(shown, F.lit("")).alias("description"),
        F.when(F.col("owner") == "", free).otherwise(F.col("owner")).alias("member_of"),
        names.normalize_name(F.col("owner")).alias("normalized_member_of"),
        maturity(language).alias("maturity"),
        kind(language).alias("type"),
        F.col("path").alias("file_path"),
        namespace(language, root, project).alias("namespace"),
        names.normalize_namespace(F.col("path"), base, project.prefix).alias("normalized_namespace"),
        params.alias("parameters"),
        F.col("returns").alias("original_return_types"),
        F.col("types.returns").alias("normalized_return_types"),
        is_async(language).alias("async"),
        "stage",
        "at",
    )
    out = ordered(out, "file_path", ["stage", "at"], edges or [])
    return out.select(*[f.name for f in FEATURE.fields])


def extract(spark: SparkSession, source: str | Path, language: str, mode: str = "repo", config: dict | None = None, project: Project = Project()) -> Registry:
    """Registry of a source tree.

    mode: `repo` (the search folder of a repository, recursively, without what
    the configuration excludes), `dir` (the files of one folder) or `file`.
    config: language to source_root and exclude; read from the source if absent.
    """
    language = files.LANGUAGES[language]
    source = Path(source).resolve() if language == "go" else Path(os.path.abspath(source))
    if not source.exists():
        raise FileNotFoundError(source)
    root = files.repo_root(source, language) or source.parent if mode == "file" else source
    config = files.load_config(Path(root)) if config is None else config
    own = config.get(language, {}) or {}
    if mode == "repo":
        sources = files.scan(spark, files.search_dir(source, language), language, True, list(own.get("exclude", []) or []))
    elif mode == "dir":
        sources = files.scan(spark, source, language, False)
    elif mode == "file":
        sources = files.scan(spark, source.parent, language, False).where(F.col("path") == str(source))
        if not sources.head(1):  # a file named explicitly counts even if a scan would skip it
            sources = spark.createDataFrame([(str(source), source.read_bytes())], "path string, content binary")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    listed = sources.select("path")
    edges = boundaries(listed)
    if language == "typescript":
        sources = with_types(sources, type_map(files.scan(spark, root, language)))
    features = to_features(parse(sources, language), language, str(root), own.get("source_root", "."), project, edges)
    return Registry(language.upper(), files.version(spark, Path(root), language, project), features, listed)
