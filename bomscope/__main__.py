"""python -m bomscope classify FILE [--config F] [--json] | extract FILE [--format F] [--output DIR] [--pages SPEC] [--template F]"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Reader
from .config import ClassifierConfig, ExtractorConfig, load_yaml
from .sinks import files, reports


def _spark() -> SparkSession:
    return SparkSession.builder.appName("bomscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _classify(args: argparse.Namespace) -> int:
    if not os.path.exists(args.file):
        print(f"no such file: {args.file}", file=sys.stderr)
        return 2
    cfg = load_yaml(args.config, ClassifierConfig()) if args.config else None
    found = Reader(_spark(), args.file).classify(cfg)
    show = reports.as_json if args.json else reports.as_text
    print(show(os.path.basename(args.file), found.runs, found.scores))
    return 0


def _extract(args: argparse.Namespace) -> int:
    if not os.path.exists(args.file):
        print(f"no such file: {args.file}", file=sys.stderr)
        return 1
    cfg = load_yaml(args.config, ExtractorConfig()) if args.config else ExtractorConfig()
    reader = Reader(_spark(), args.file)
    try:
        page_runs = (reader.manual_runs(args.pages) if args.pages else reader.found_runs()).persist()
        empty = page_runs.isEmpty()
    except Exception as e:  # noqa: BLE001 - whatever a file's content brings about ends this command alone
        print(f"the pages could not be found: {e}", file=sys.stderr)
        return 1
    if empty:
        print("no parts-list pages found", file=sys.stderr)
        return 0
    name = os.path.basename(args.file)
    got = reader.extract(page_runs, cfg)
    rows = got.rows.where(F.col("source_pdf") == name).persist()
    audit = got.audit.where(F.col("source_pdf") == name).first()
    print(f"{rows.count()} rows")
    for w in audit["consensus_warnings"] if audit else []:
        print(f"  {w}")
    if audit and audit["pages_without_table"]:
        print(f"  no table on pages {audit['pages_without_table']}")
    path = files.output_path(args.file, args.output, args.format)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        if args.format == "csv":
            files.write_csv(rows, out, cfg.output)
        elif args.format == "json":
            files.write_json(rows, audit, name, out, cfg.output)
        elif args.format == "procos":
            files.write_template(rows, args.template or "", out)
        else:
            files.write_xlsx({name: rows}, out, cfg.output)
    print(path)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bomscope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("classify")
    c.add_argument("file")
    c.add_argument("--config")
    c.add_argument("--json", action="store_true")
    e = commands.add_parser("extract")
    e.add_argument("file")
    e.add_argument("--config")
    e.add_argument("--format", choices=["csv", "xlsx", "json", "procos"], default="xlsx")
    e.add_argument("--output")
    e.add_argument("--pages")
    e.add_argument("--template")
    args = parser.parse_args(argv)
    return _classify(args) if args.command == "classify" else _extract(args)


if __name__ == "__main__":
    sys.exit(main())
