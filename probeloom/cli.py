"""``python -m probeloom``: validate a case, assemble an audit, compare two reports."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path
from typing import TextIO

from probeloom.contracts.documents import issues_of
from probeloom.functions.canonical import canonical_text
from probeloom.plans.lifecycle import MANIFEST_NAME, LifecycleError, RunFailed
from probeloom.plans.render import JSON_NAME, MARKDOWN_NAME
from probeloom.sources.documents import JsonDocumentError, read_document

# What is shown for an issue: the first phrase that its message holds decides, so that no value of the input is echoed.
SAFE = (
    ("required property", None),
    ("duplicate", "identifier must be unique across probe groups"),
    ("does not match", "value does not satisfy the required format"),
    ("{subject}", "value does not satisfy the required format"),
    ("additional properties", "object contains unsupported properties"),
    ("is not of type", "value has an invalid type"),
    ("is not one of", "value is not one of the allowed options"),
    ("is too", "value violates the documented length constraint"),
)


def safe_message(message: str) -> str:
    for phrase, shown in SAFE:
        if phrase in message:
            return shown or message
    return "value does not satisfy the contract"


def overlaps(inputs: list[Path], out: Path) -> bool:
    """Whether an input is one of the files that would be written."""
    targets = [out / n for n in (MANIFEST_NAME, JSON_NAME, MARKDOWN_NAME)]
    for i in inputs:
        for t in targets:
            try:
                if i.resolve() == t.resolve() or (i.exists() and t.exists() and os.path.samefile(i, t)):
                    return True
            except OSError:
                continue
    return False


def _session():
    from probeloom.session import build_session

    return build_session(spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=os.environ.get("PROBELOOM_PARTITIONS", "8"))


def validate_case(args, out: TextIO, err: TextIO) -> int:
    try:
        case = read_document(args.case)
    except JsonDocumentError as error:
        print(f"error: {error}", file=err)
        return 2
    issues = issues_of("case", case)
    if issues:
        print("error: the case is not valid", file=err)
        for path, message in issues:
            print(f"- {path}: {safe_message(message)}", file=err)
        return 2
    print(canonical_text({"case_id": case["case_id"], "schema_version": case["schema_version"], "status": "valid"}), file=out)
    return 0


def audit(args, out: TextIO, err: TextIO) -> int:
    from probeloom.plans.audit import AuditInputError, run_audit

    inputs = [args.case, args.baseline, args.edited]
    if overlaps(inputs, args.out):
        print("error: inputs and outputs must not overlap", file=err)
        return 2
    try:
        case, baseline, edited = map(read_document, inputs)
    except JsonDocumentError:
        print("error: an input is no valid JSON document", file=err)
        return 2
    try:
        done = run_audit(_session(), case, baseline, edited, args.out)
    except AuditInputError:
        print("error: the inputs are invalid or incompatible", file=err)
        return 2
    except RunFailed:
        print("error: the audit failed; a failed manifest was written", file=err)
        return 1
    except LifecycleError:
        print("error: the output could not be written", file=err)
        return 1
    shown = {"manifest": done.manifest_path.name, "report_json": done.report_json_path.name, "report_markdown": done.report_markdown_path.name, "run_id": done.run_id, "status": "completed"}
    print(canonical_text(shown), file=out)
    return 0


def compare(args, out: TextIO, err: TextIO) -> int:
    from probeloom.plans.compare import ComparisonError, compare_reports

    try:
        a, b = read_document(args.report_a), read_document(args.report_b)
    except JsonDocumentError:
        print("error: a report is no valid JSON document", file=err)
        return 2
    try:
        print(canonical_text(compare_reports(_session(), a, b)), file=out)
    except ComparisonError as error:
        print(f"error: {error}", file=err)
        return 2
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="probeloom", description="Validate and compare evidence of knowledge edits.")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("validate-case", help="validate a case")
    one.add_argument("case", type=Path)
    one.set_defaults(run=validate_case)
    two = commands.add_parser("audit", help="assemble an audit from a case and two snapshots")
    for name in ("--case", "--baseline", "--edited", "--out"):
        two.add_argument(name, type=Path, required=True)
    two.set_defaults(run=audit)
    three = commands.add_parser("compare", help="compare two reports")
    three.add_argument("report_a", type=Path)
    three.add_argument("report_b", type=Path)
    three.set_defaults(run=compare)
    return top


def main(argv: list[str] | None = None, out: TextIO | None = None, err: TextIO | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args, out or sys.stdout, err or sys.stderr)
