"""Two reports of one case and baseline, metric by metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probeloom.contracts.documents import VERSION, ContractViolation, at, require
from probeloom.functions.canonical import canonical_text, hash_json
from probeloom.operators import metrics as M
from probeloom.sources.documents import parse_strict


class ComparisonError(ValueError):
    """The reports are not valid or not comparable."""


CONTEXT = (
    ("audit_case", "artifact"), ("manifest", "model", "baseline"), ("manifest", "model", "model_id"), ("manifest", "model", "model_revision"), ("manifest", "model", "tokenizer_id"), ("manifest", "model", "tokenizer_revision"),
    ("manifest", "environment", "device"), ("manifest", "environment", "dtype"), ("manifest", "environment", "quantization"), ("manifest", "generation"), ("manifest", "seeds"),
)
CONTRACT = ("unit", "direction", "reduction")
NOTES = (
    "aggregate deltas are descriptive values of report B less report A; they establish neither improvement nor regression, harm or safety",
    "raw probe and structural values are not reduced here; see the two reports, which are linked by their hashes",
)
OTHER_COMMIT = "the engine commits differ; metrics are compared only where unit, direction and reduction agree"


def metric_rows(spark: SparkSession, report: dict) -> DataFrame:
    rows = [(m["metric_id"], m["status"], None if m["aggregate"] is None else float(m["aggregate"]), float(m["coverage"]["fraction"]), *(m[c] for c in CONTRACT)) for m in report["metrics"]]
    return spark.createDataFrame(rows, "metric_id string, status string, aggregate double, coverage double, unit string, direction string, reduction string")


def compare_reports(spark: SparkSession, first: object, second: object) -> dict:
    """The comparison document; every context field that differs is named in the error."""
    try:
        a, b = (require("report", parse_strict(canonical_text(r))) for r in (first, second))
    except (ContractViolation, TypeError, ValueError, RecursionError) as error:
        raise ComparisonError("both reports must satisfy the report contract") from error
    for name, report in (("a", a), ("b", b)):
        for path in CONTEXT[:2]:
            if not isinstance(at(report, *path, "content_hash"), dict):
                raise ComparisonError(f"report {name} needs a content hash at {'.'.join(path)}")
    unequal = ["$." + ".".join(path) for path in CONTEXT if canonical_text(at(a, *path)) != canonical_text(at(b, *path))]
    if unequal:
        raise ComparisonError("the reports are not comparable; these differ: " + ", ".join(unequal))
    joined = M.reports_with(metric_rows(spark, a), metric_rows(spark, b), "metric_id", [*CONTRACT], "aggregate", "status")
    coverage = {side: {m["metric_id"]: float(m["coverage"]["fraction"]) for m in report["metrics"]} for side, report in (("a", a), ("b", b))}

    def side(row, name: str) -> dict | None:
        if row.metric_id not in coverage[name]:
            return None
        return {"status": row[f"status_{name}"], "aggregate": row[f"aggregate_{name}"], "coverage": coverage[name][row.metric_id]}

    metrics = [{
        "metric_id": r.metric_id, "presence": r.presence, "comparable": r.comparable, **{c: r[f"{c}_a"] if r.comparable else None for c in CONTRACT},
        "report_a": side(r, "a"), "report_b": side(r, "b"), "aggregate_delta_b_minus_a": r.aggregate_delta_b_minus_a, "warnings": list(r.warnings),
    } for r in joined.orderBy("metric_id").collect()]
    same_commit = at(a, "manifest", "engine", "commit") == at(b, "manifest", "engine", "commit")
    model, environment = a["manifest"]["model"], a["manifest"]["environment"]
    return require("comparison", {
        "schema_version": VERSION,
        **{f"report_{n}": {"report_id": r["report_id"], "content_hash": hash_json(r)} for n, r in (("a", a), ("b", b))},
        "comparability": {
            "audit_case_sha256": at(a, *CONTEXT[0], "content_hash", "digest"), "baseline_sha256": at(a, *CONTEXT[1], "content_hash", "digest"),
            **{n: model[n] for n in ("model_id", "model_revision", "tokenizer_id", "tokenizer_revision")}, "device": environment["device"], "dtype": environment["dtype"],
        },
        "metrics": metrics,
        "warnings": [*NOTES, *([] if same_commit else [OTHER_COMMIT])],
    })
