"""Command line: `python -m conformix.cli extract ...` and `... report ...`."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.extraction import extract
from .operators.reports import REPORT_TYPES, match_registries, write_report
from .sources import scan, textproto

log = logging.getLogger("conformix")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="conformix", description="API parity between code bases.")
    sub = top.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="features of a source tree")
    x.add_argument("--language", required=True, choices=sorted(scan.LANGUAGES))
    source = x.add_mutually_exclusive_group(required=True)
    for mode in ("file", "dir", "repo"):
        source.add_argument(f"--input-{mode}", type=Path)
    x.add_argument("output", type=Path, help="folder for the registry")
    x.add_argument("--format", nargs="+", choices=["txtpb", "json", "yaml", "parquet"], default=["txtpb"])
    r = sub.add_parser("report", help="parity of two registries")
    r.add_argument("--base", required=True)
    r.add_argument("--target", required=True)
    r.add_argument("--output", required=True, type=Path, help="report, or a folder to name it by languages")
    r.add_argument("--alpha", default=0.8, type=float, help="least score of a match, excluded")
    r.add_argument("--report-type", choices=REPORT_TYPES, default="symmetric")
    for p in (x, r):
        p.add_argument("--prefix", default="lib", help="first part of module keys")
        p.add_argument("-v", "--verbose", action="store_true")
    x.add_argument("--python-package", default="", help="leading folders dropped from namespaces")
    x.add_argument("--java-package", default="", help="leading package dropped from namespaces")
    x.add_argument("--java-version", default="VERSION", help="constant in Version.java")
    return top


def report_name(base: str, target: str, kind: str) -> str:
    """File name of a report from upper-case languages."""
    code = {"PYTHON": "py", "TYPESCRIPT": "ts", "JAVA": "java", "GO": "go"}
    return f"{code.get(base, '')}_{code.get(target, '')}_{kind}.{'csv' if kind == 'raw' else 'md'}"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(levelname)s %(message)s")
    spark = SparkSession.builder.appName("conformix").getOrCreate()
    try:
        if args.command == "extract":
            mode = next(m for m in ("file", "dir", "repo") if getattr(args, f"input_{m}"))
            config = scan.load_config(Path(".")) or None if mode == "repo" else None
            project = scan.Project(args.prefix, args.python_package, args.java_package, args.java_version)
            found = extract(spark, getattr(args, f"input_{mode}"), args.language, mode, config, project)
            log.info("%d files", found.files.count())
            found.features = found.features.persist()
            for r in found.features.groupBy("file_path").count().orderBy("file_path").toLocalIterator():
                log.info("%s: %d features", r["file_path"], r["count"])
            args.output.mkdir(parents=True, exist_ok=True)
            stem = args.output / scan.SUFFIX[scan.LANGUAGES[args.language]]
            for form in args.format:
                writer = {"txtpb": textproto.write_textproto, "json": textproto.write_json, "yaml": textproto.write_yaml}.get(form)
                writer(found, stem.with_suffix("." + form)) if writer else textproto.write_parquet(found, str(stem) + ".parquet")
            log.info("%d features", found.features.count())
            return 0
        base, target = (textproto.read_registry(spark, p) for p in (args.base, args.target))
        output = args.output / report_name(base.language, target.language, args.report_type) if args.output.is_dir() else args.output
        write_report(match_registries(base, target, args.alpha, args.report_type, args.prefix), output)
        return 0
    except (OSError, ValueError) as e:
        log.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
