"""Audits, their lifecycle, comparison and reports."""

from probeloom.plans.audit import AuditInputError, AuditResult, audit_many, metric_table, run_audit
from probeloom.plans.compare import ComparisonError, compare_reports
from probeloom.plans.lifecycle import LifecycleError, RunFailed, execute_run, write_manifest
from probeloom.plans.render import ReportError, render_markdown, write_report

__all__ = [
    "AuditInputError",
    "AuditResult",
    "ComparisonError",
    "LifecycleError",
    "ReportError",
    "RunFailed",
    "audit_many",
    "compare_reports",
    "execute_run",
    "metric_table",
    "render_markdown",
    "run_audit",
    "write_manifest",
    "write_report",
]
