"""The report as JSON and as Markdown in which all text shows as itself."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.contracts.documents import ContractViolation, require
from probeloom.functions.canonical import canonical_bytes, canonical_text
from probeloom.functions.text import escape_markdown, escape_markdown_text
from probeloom.sources.writers import WriteError, write_atomically

JSON_NAME, MARKDOWN_NAME = "audit-report.json", "audit-report.md"


class ReportError(RuntimeError):
    """The report is not valid or could not be written."""


def _shown(value: object) -> str:
    return "null" if value is None else escape_markdown_text(str(value))


def _row(*cells: object) -> str:
    return "| " + " | ".join(map(_shown, cells)) + " |"


def _listed(values: Iterable[object], empty: str) -> list[str]:
    return [f"- {_shown(v)}" for v in values] or [empty]


def _notes(title: str, entry: dict) -> list[str]:
    cited = [f"- {_shown(c['title'])} — {_shown(c['source'])}" for c in entry["citations"]]
    return [title, "", "Warnings:", *_listed(entry["warnings"], "- None recorded."), "", "Citations:", *cited, ""]


def render_markdown(report: dict) -> str:
    """The Markdown of a valid report."""
    run, case = report["manifest"], report["audit_case"]
    facts = {"Status": report["status"], "Generated at": report["generated_at"], "Run ID": run["run_id"], "Model": run["model"]["model_id"], "Model revision": run["model"]["model_revision"], "Tokenizer": run["model"]["tokenizer_id"], "Tokenizer revision": run["model"]["tokenizer_revision"]}
    data = case["dataset"]
    about = {"Case ID": case["case_id"], "Dataset": data["name"], "Dataset version": data.get("version"), "Dataset license": data["license"], "Dataset source": data["source"]}
    table = ["| Field | Value |", "|---|---|"]
    lines = [f"# Knowledge edit audit report: {_shown(report['report_id'])}", "", "> Diagnostic evidence only. It certifies neither the safety of a model nor the absence of harm.", ""]
    lines += ["## Run", "", *table, *(_row(*x) for x in facts.items()), "", "## Audit case", "", *table, *(_row(*x) for x in about.items()), ""]
    lines += ["## Metrics", "", "| Metric | Status | Aggregate | Unit | Coverage |", "|---|---|---:|---|---:|"]
    lines += [_row(m["metric_id"], m["status"], m["aggregate"], m["unit"], m["coverage"]["fraction"]) for m in report["metrics"]]
    lines += ["", "## Metric warnings and citations", ""]
    for m in report["metrics"]:
        lines += _notes(f"### {_shown(m['metric_id'])}", m)
    lines += ["", "## Structural evidence", ""]
    if report["structural_evidence"]:
        lines += ["| Evidence | Type | Status | Values |", "|---|---|---|---|"]
        lines += [_row(e["evidence_id"], e["evidence_type"], e["status"], canonical_text(e["values"])) for e in report["structural_evidence"]]
        lines += ["", "### Structural warnings and citations", ""]
        for e in report["structural_evidence"]:
            lines += _notes(f"#### {_shown(e['evidence_id'])}", e)
    else:
        lines.append("No structural evidence was recorded.")
    for title, values in (("Limitations", report["limitations"]), ("Warnings", report["warnings"])):
        lines += ["", f"## {title}", "", *_listed(values, "None recorded.")]
    return "\n".join(lines) + "\n"


def write_report(report: dict, out: str | Path) -> tuple[Path, Path]:
    """Validate and render in memory, then write the JSON and the Markdown."""
    try:
        require("report", report)
        data, text = canonical_bytes(report) + b"\n", render_markdown(report).encode("utf-8")
        return write_atomically(Path(out) / JSON_NAME, data), write_atomically(Path(out) / MARKDOWN_NAME, text)
    except (ContractViolation, WriteError, TypeError, ValueError) as error:
        raise ReportError("the report is not valid or could not be written") from error


def metric_lines(metrics: DataFrame, by: Column | str, order: str) -> DataFrame:
    """``(report, markdown)``: the metric table of many reports, lines in the order of ``order``."""
    cells = [F.col("metric_id"), F.col("status"), F.coalesce(F.col("aggregate").cast("string"), F.lit("null")), F.col("unit"), F.coalesce(F.col("fraction").cast("string"), F.lit("null"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(escape_markdown(c) for c in cells)), F.lit(" |"))
    rows = metrics.select(F.col(by).alias("report") if isinstance(by, str) else by.alias("report"), F.struct(F.col(order).alias("o"), line.alias("line")).alias("l"))
    return rows.groupBy("report").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("markdown"))
