"""Parity reports: CSV of all pairs, and Markdown for people.

The rows of a report come from DataFrames; text is made on the driver, from one
row for each feature that the report lists. Percentages are formatted by Python,
whose rounding of binary values the JVM's formatter doesn't share.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.similarity import Weights
from ..schema import Registry
from .matching import match_features, remap_target, with_module
from .metrics import global_summary, module_summary

REPORT_TYPES = ("symmetric", "directional", "raw")
_KINDS = ["solid", "potential", "base_only", "target_only"]


@F.pandas_udf(T.StringType())
def _four_digits(score: pd.Series) -> pd.Series:
    return score.map("{:.4f}".format)


@dataclass
class MatchResult:
    """Text of the main report, and of the module reports by file name."""

    master_content: str
    module_files: dict[str, str] = field(default_factory=dict)


def matched_rows(base: DataFrame, target: DataFrame, alpha: float, weights: Weights = Weights()) -> tuple[DataFrame, DataFrame]:
    """Matches, and the same with what reports show of both features."""
    base = with_module(base)
    target = remap_target(base, with_module(target))
    matches = match_features(base, target, alpha, weights)

    def side(df: DataFrame, p: str) -> DataFrame:
        ns, member, name = names.raw_columns(*(F.col(c) for c in ("namespace", "normalized_namespace", "member_of", "normalized_member_of", "original_name", "normalized_name")))
        return df.select(
            F.col("ord").alias(f"{p}_ord"),
            names.display_name(F.col("original_name"), F.col("normalized_name"), F.col("member_of")).alias(f"{p}_display"),
            names.display_type(F.col("type")).alias(f"{p}_type"),
            names.type_priority(F.col("type")).alias(f"{p}_priority"),
            F.col("normalized_name").alias(f"{p}_name"),
            ns.alias(f"{p}_ns"),
            member.alias(f"{p}_member"),
            name.alias(f"{p}_raw"),
        )

    return matches, matches.join(side(base, "base"), "base_ord", "left").join(side(target, "target"), "target_ord", "left")


def raw_lines(rows: DataFrame) -> DataFrame:
    """Lines of the CSV report: module, rank and place give their order, `line` is the text."""
    cell = lambda c: names.csv_cell(F.col(c))
    kind = F.when(F.col("kind") == "target_only", F.col("target_type")).otherwise(F.col("base_type"))
    line = F.concat_ws(",", *[cell(f"{p}_{c}") for p in ("base", "target") for c in ("ns", "member", "raw")], names.csv_cell(kind))
    line = F.concat(line, F.lit(","), _four_digits("score"))
    return rows.select("module", F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("kind")).alias("rank"), "place", line.alias("line"))


def raw_header(base_language: str, target_language: str) -> str:
    return ",".join([f"{names.code(c)}_{x}" for c in (base_language, target_language) for x in ("namespace", "member_of", "name")] + ["type", "score"])


def write_raw(rows: DataFrame, base_language: str, target_language: str, output: Path) -> None:
    """The CSV report as a file, streamed line by line."""
    with open(output, "w", encoding="utf-8") as out:
        out.write(raw_header(base_language, target_language))
        for r in raw_lines(rows).orderBy("module", "rank", "place").toLocalIterator():
            out.write("\n" + r["line"])


def raw_report(rows: DataFrame, base_language: str, target_language: str) -> MatchResult:
    lines = raw_lines(rows).orderBy("module", "rank", "place").toLocalIterator()
    return MatchResult("\n".join([raw_header(base_language, target_language), *(r["line"] for r in lines)]))


def ranked_modules(summary: DataFrame, base_language: str, target_language: str, symmetric: bool) -> DataFrame:
    """Module summaries with what reports show of them: score, icon, file, languages and number of features.

    The symmetric report has the Jaccard index, the directional one F1 and only
    modules of the base. Modules come by falling score, then by name.
    """
    rows = summary if symmetric else summary.where("base > 0")
    score = F.col("jaccard" if symmetric else "f1")
    codes = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) > 0, names.language_code(F.lit(x))) for n, x in (("base", base_language), ("target", target_language))])), ", ")
    size = F.col("base") + F.col("target") - F.col("solid") if symmetric else F.col("base")
    return rows.select("*", score.alias("score"), names.status_icon(score).alias("icon"), names.module_file(F.col("module")).alias("file"), codes.alias("languages"), size.alias("features")).orderBy(F.desc("score"), "module")


def _cells(*values: str) -> str:
    return "| " + " | ".join(values) + " |"


def _head(*titles: str) -> list[str]:
    return [_cells(*titles), "|" + "---|" * len(titles)]


def _table(title: str, head: list[str], rows: Iterable[str]) -> list[str]:
    rows = list(rows)
    return [title, *head, *rows, ""] if rows else []


_BACK = "[⬅️ Back to Master Report](" + "../{master_report})"


def _module_text(m, rows: dict[str, list], symmetric: bool) -> str:
    score = m["score"]
    lines = [f"# Module: `{m['module']}`", _BACK, ""]
    lines.append(f"**Score:** {score:.2%} ({m['icon']})")
    if not symmetric:
        lines += ["", *_head("Metric", "Score"), *(_cells(f"**{n.title()}**", f"{m[n]:.2%}") for n in ("precision", "recall"))]
    lines += ["", f"**Features:** {m['features']}", ""]
    pair = lambda r: _cells(r["base_type"], f"`{r['base_display']}`", f"`{r['target_display']}`", f"{r['score']:.2f}")
    lines += _table(f"### ✅ {'Solid' if symmetric else 'Matched'} Features", _head("Type", "Base Feature", "Target Feature", "Similarity Score"), map(pair, rows["solid"]))
    lines += _table("### ⚠️ Potential Matches", _head("Type", "Base Feature", "Closest Target Candidate", "Similarity"), map(pair, rows["potential"]))
    missing = [f"`{r['base_display']}`" for r in rows["base_only"]]
    if symmetric:
        both = [_cells(x, "Target") for x in missing] + [_cells(f"`{r['target_display']}`", "Base") for r in rows["target_only"]]
        lines += _table("### ❌ Unmatched Features", ["", *_head("Missing Feature", "Missing In")], both)
    else:
        lines += _table("### ❌ Missing in Target", _head("Missing Feature"), map(_cells, missing))
    return "\n".join(lines).strip()


def _row(m, symmetric: bool) -> str:
    link = f"[View Details]({{modules_dir}}/{m['file']})"
    cells = [f"`{m['module']}`", str(m["base"]), f"{m['score']:.2%}", m["icon"], link]
    if symmetric:
        cells.insert(0, m["languages"])
    return _cells(*cells)


_NOTES = {
    "jaccard": "Jaccard compares the matched features with all features of both sides; at 100% each side has what the other has.",
    "precision": "**Precision** is the share of the target's features that match one of the base: it falls with extras.",
    "recall": "**Recall** is the share of the base's features that the target has: it falls with gaps.",
    "f1": "**F1 Score** is the harmonic mean of both.",
}


def markdown_report(base: Registry, target: Registry, matches: DataFrame, rows: DataFrame, symmetric: bool, product: str, now: datetime.datetime | None = None) -> MatchResult:
    summary = module_summary(matches)
    modules = ranked_modules(summary, base.language, target.language, symmetric).collect()
    total = global_summary(summary, base.features.count(), target.features.count()).first()
    shown: dict[str, dict[str, list]] = {m["module"]: {k: [] for k in _KINDS} for m in modules}
    for r in rows.orderBy("module", "place").toLocalIterator():
        if r["module"] in shown:
            shown[r["module"]][r["kind"]].append(r)
    for groups in shown.values():
        for k in ("solid", "potential"):
            groups[k].sort(key=lambda r: (r["base_priority"], r["base_name"]))
    lines = [f"# Feature Matching Report: {'Symmetric' if symmetric else 'Directional'}", "Date: " + (now or datetime.datetime.now()).isoformat(" ", "seconds"), ""]
    sides = (("Base", base), ("Target", target))
    if symmetric:
        lines += [_cells("Registry", "Language", "Version"), _cells(*[":---"] * 3)]
        lines += [_cells(f"**{n}**", r.language, r.version) for n, r in sides]
        lines += ["", f"**Jaccard Index:** {total['jaccard']:.2%}", "", f"> {_NOTES['jaccard']}"]
    else:
        lines += [f"**{n}:** {r.language} ({r.version})" for n, r in sides]
        lines += ["", *_head("Metric", "Score"), *(_cells(f"**{t}**", f"{total[n]:.2%}") for t, n in (("Precision", "precision"), ("Recall", "recall"), ("F1 Score", "f1")))]
        for n in ("precision", "recall", "f1"):
            lines += ["", f"> {_NOTES[n]}"]
    columns = ["Module", "Features (Base)", "Score", "Status", "Details"]
    lines += ["", "## Module Summary", *_head(*([product.upper()] if symmetric else []), *columns)]
    lines += [_row(m, symmetric) for m in modules]
    files = {m["file"]: _module_text(m, shown[m["module"]], symmetric) for m in modules}
    return MatchResult("\n".join(lines).strip(), files)


def match_registries(base: Registry, target: Registry, alpha: float = 0.8, report_type: str = "symmetric", product: str = "lib", now: datetime.datetime | None = None) -> MatchResult:
    """Report of how far the target has what the base has.

    product heads the column of languages in the symmetric report.
    """
    if report_type not in REPORT_TYPES:
        raise ValueError(f"unknown report type {report_type!r}")
    matches, rows = matched_rows(base.features, target.features, alpha)
    matches, rows = matches.persist(), rows.persist()
    try:
        if report_type == "raw":
            return raw_report(rows, base.language, target.language)
        return markdown_report(base, target, matches, rows, report_type == "symmetric", product, now)
    finally:
        rows.unpersist()
        matches.unpersist()


def write_report(result: MatchResult, output: Path) -> None:
    """Writes the main report, and the module reports to a folder beside it, with links between them."""
    output.parent.mkdir(parents=True, exist_ok=True)
    folder = "."
    if result.module_files:
        folder = f"{output.stem}_modules"
        (output.parent / folder).mkdir(parents=True, exist_ok=True)
        for name, text in result.module_files.items():
            (output.parent / folder / name).write_text(text.replace("{master_report}", output.name), encoding="utf-8")
    output.write_text(result.master_content.replace("{modules_dir}", folder), encoding="utf-8")
