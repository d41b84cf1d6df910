"""Command line: python -m frameledger lint DATASET, audit DATASET..."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from frameledger import __version__, logs
from frameledger.checks import CheckContext, CheckEngine
from frameledger.errors import DatasetError
from frameledger.report import Report, as_html, as_json, as_sarif, load_error_json, terminal
from frameledger.sources.loader import load
from frameledger.verdict import exit_code, worst


def _session() -> SparkSession:
    """The session spark-submit gives; on one machine a local one."""
    return SparkSession.builder.appName("frameledger").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def lint(spark: SparkSession, ref: str, deep: bool = False, as_text: bool = True, report: str | None = None, sarif: str | None = None) -> int:
    """Prints the report on a dataset, writes the wanted files, gives the exit code: 0 pass, 1 warnings, 2 failures or a dataset that does not load."""
    try:
        ds = load(spark, ref)
    except DatasetError as e:
        print(load_error_json(ref, e)) if not as_text else print(f"ERROR: {ref!r} could not be loaded: {e}", file=sys.stderr)
        return 2
    try:
        results = CheckEngine().run(ds, CheckContext(deep=deep))
        r = Report(ref, ds.version, ds.num_episodes, ds.info.total_frames, results)
    finally:
        ds.close()
    print(terminal(r, sys.stdout.isatty()) if as_text else as_json(r))
    if report:
        Path(report).write_text(as_html(r), encoding="utf-8")
    if sarif:
        Path(sarif).write_text(as_sarif(r), encoding="utf-8")
    return exit_code(worst(results))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="frameledger", description="Integrity checks for trajectory datasets.")
    p.add_argument("-V", "--version", action="version", version=__version__)
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("lint", help="check one dataset")
    a.add_argument("ref")
    a.add_argument("--deep", action="store_true", help="also what is slow on remote data")
    a.add_argument("--json", action="store_true", help="JSON to standard output")
    a.add_argument("--report", help="write an HTML report")
    a.add_argument("--sarif", help="write a SARIF 2.1.0 report")
    b = sub.add_parser("audit", help="check many datasets")
    b.add_argument("refs", nargs="+")
    b.add_argument("--timeout", type=float, default=60.0)
    b.add_argument("--out", help="write rows and summary as JSON")
    for name in ("fix", "web"):
        sub.add_parser(name, help="not available").add_argument("ref", nargs="?")
    x = p.parse_args(argv)
    logs.configure("DEBUG" if x.verbose else "WARNING")
    if x.command in ("fix", "web"):
        print(f"{x.command} is not available", file=sys.stderr)
        return 2
    spark = _session()
    if x.command == "lint":
        return lint(spark, x.ref, x.deep, not x.json, x.report, x.sarif)
    from frameledger import audit

    runs = audit.audit(spark, x.refs, x.timeout)
    print(audit.summary_text(runs))
    if x.out:
        summary = audit.status_summary(runs).first().asDict()
        about = {"generated_at": datetime.datetime.now(datetime.UTC).isoformat(), "version": __version__, "timeout_seconds": x.timeout}
        Path(x.out).write_text(json.dumps({**about, "summary": summary, "datasets": [json.loads(s) for s in runs.toJSON().collect()]}, indent=2), encoding="utf-8")
    return 0
