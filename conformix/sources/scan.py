"""Source trees: which files are scanned, where roots lie, and versions."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = dict(python="py", typescript="ts", java="java", go="go")
LANGUAGES = {k: k for k in SUFFIX} | {v: k for k, v in SUFFIX.items()}
_MARKERS = dict(python="src", typescript="package.json tsconfig.json", java="pom.xml build.gradle build.gradle.kts", go="go.mod")
_SEARCH = dict(python="src", typescript="core/src src", java="src/main/java src", go="")
_SKIP_NAMES = dict(python="conftest.py setup.py version.py __init__.py", java="module-info.java package-info.java")
_SKIP_PARTS = dict(typescript="node_modules", java="bin build node_modules out target test")


@dataclass(frozen=True)
class Project:
    """What is particular to the libraries compared.

    prefix: first part of module keys; python_package: leading folders dropped
    from Python namespaces, such as `acme/sdk`; java_package: dropped likewise;
    java_version: name of the constant in Version.java.
    """

    prefix: str = "lib"
    python_package: str = ""
    java_package: str = ""
    java_version: str = "VERSION"


def keeps(path: Column, language: str) -> Column:
    """Whether a path is scanned. Parts of the whole path count, as given."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    ok = name.endswith("." + SUFFIX[language]) & ~F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))
    if language in _SKIP_NAMES:
        ok &= ~name.isin(*_SKIP_NAMES[language].split())
    if language in _SKIP_PARTS:
        ok &= ~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in _SKIP_PARTS[language].split()]))
    return ok & ~name.endswith(".d.ts") if language == "typescript" else ok


def holds_features(path: Column, language: str) -> Column:
    """Whether a scanned file can have features: Go's tests have none."""
    return ~path.endswith("_test.go") if language == "go" else F.lit(True)


def excluded(path: Column, names: list[str]) -> Column:
    """Whether some part of the path is in the list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def scan(spark: SparkSession, folder: str | Path, language: str, recursive: bool = True, exclude: list[str] | None = None) -> DataFrame:
    """(path, content) of the files to parse; paths are plain and absolute.

    Filters act on the path column, before contents are read. A folder that
    doesn't exist gives no rows; files that vanish or can't be read are skipped.
    """
    folder = os.path.abspath(folder)
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "path string, content binary")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{SUFFIX[language]}").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    reader = reader.option("recursiveFileLookup", "true") if recursive else reader
    files = reader.load(folder if recursive else os.path.join(folder, f"*.{SUFFIX[language]}")) if recursive or any(f.endswith("." + SUFFIX[language]) for f in os.listdir(folder)) else None
    if files is None:
        return spark.createDataFrame([], "path string, content binary")
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.withColumn("path", plain).where(keeps(F.col("path"), language) & ~excluded(F.col("path"), exclude or [])).select("path", "content")


def repo_root(path: Path, language: str) -> Path | None:
    """Nearest folder above the path with a marker of the language."""
    for parent in path.parents:
        if any((parent / m).exists() for m in _MARKERS[language].split()):
            return parent
    return None


def search_dir(root: Path, language: str) -> Path:
    """Folder of a repository in which sources are looked for; the root if there is none."""
    return next((root / s for s in _SEARCH[language].split() if (root / s).is_dir()), root)


def load_config(folder: Path) -> dict:
    """config.yaml of a folder: language to source_root and exclude; empty if absent."""
    path = folder / "config.yaml"
    if not path.exists():
        return {}
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


# versions, as expressions over a column that holds a whole file


def python_version(content: Column) -> Column:
    """Value of the line that starts with __version__."""
    line = F.regexp_extract(content, r"(?m)^__version__[^=\n]*=([^\n]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(line, r"""^[\s"']+|[\s"']+$""", ""), F.lit("")), F.lit("0.0.0"))


def typescript_version(content: Column) -> Column:
    return F.coalesce(F.get_json_object(content, "$.version"), F.lit("0.0.0"))


def java_constant(content: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(content, rf'\b{name}\s*={{1}}\s*["]([^"]+)', 1), F.lit(""))


def maven_version(content: Column) -> Column:
    """Version of the project, else that of its parent; nested elements don't count."""
    bare = F.regexp_replace(content, r"(?s)<!--.*?-->|\sxmlns(:\w+)?=\"[^\"]*\"|\sxsi:\w+=\"[^\"]*\"|<\?xml.*?\?>", "")
    own = F.nullif(F.trim(F.xpath_string(bare, F.lit("/project/version"))), F.lit(""))
    return F.coalesce(own, F.nullif(F.trim(F.xpath_string(bare, F.lit("/project/parent/version"))), F.lit("")))


def gradle_version(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"""(?m)^\s*version\s*={1}\s*["']([^"']+)""", 1), F.lit(""))


def go_module(content: Column) -> Column:
    """Module path: the second word of the line that starts with `module`."""
    return F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1)


def version(spark: SparkSession, root: Path, language: str, project: Project = Project()) -> str:
    """Version of the library at root; for Go the module path."""

    def read(path: Path, rule) -> str | None:
        if not path.is_file():
            return None
        text = spark.createDataFrame([(path.read_text(encoding="utf-8", errors="replace"),)], "content string")
        return text.select(rule(F.col("content")).alias("v")).first()["v"]

    if language == "python":
        return read(root / "src" / project.python_package / "version.py", python_version) or "0.0.0"
    if language == "typescript":
        return read(root / "package.json", typescript_version) or "0.0.0"
    if language == "go":
        return read(root / "go.mod", go_module) or ""
    for path in sorted(root.rglob("Version.java"), key=lambda p: (len(p.parts), str(p))):
        got = read(path, lambda c: java_constant(c, project.java_version))
        if got:
            return got
    found = read(root / "pom.xml", maven_version)
    for kind in ("", ".kts"):
        found = found or read(root / f"build.gradle{kind}", gradle_version)
    return found or "0.0.0"
