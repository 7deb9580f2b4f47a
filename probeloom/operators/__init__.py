"""Operators over evidence, documents and copies of tables."""

from probeloom.operators.diff import diff_tables
from probeloom.operators.editors import PROFILES, BaselineChanged, EditorError, EditorSession, import_artifact, inventory
from probeloom.operators.guards import logits_guards, model_pair_guards, paired_guards, tensor_guards, trace_guards, within_budget
from probeloom.operators.metrics import causal_recovery, coverage_gap, first_duplicates, invalid_transitions, paired_evidence, position_divergence, probe_divergence, reduce_divergence, reduce_paired, reports_with, sequence_log_probability, structural_summary, tensor_differences
from probeloom.operators.protocols import ArtifactSource, ModelState, Scorer, TraceSource
from probeloom.operators.recorded import RecordedModel, score_live, trace
from probeloom.operators.rules import case_rules, metric_rules, probe_rules, violations
from probeloom.operators.shred import flatten_reports, shred_leaves
from probeloom.operators.spans import resolve_paths, substring_starts, token_starts, valid_module_path

__all__ = [
    "ArtifactSource",
    "BaselineChanged",
    "EditorError",
    "EditorSession",
    "ModelState",
    "PROFILES",
    "RecordedModel",
    "Scorer",
    "TraceSource",
    "case_rules",
    "causal_recovery",
    "coverage_gap",
    "diff_tables",
    "first_duplicates",
    "flatten_reports",
    "import_artifact",
    "invalid_transitions",
    "inventory",
    "logits_guards",
    "metric_rules",
    "model_pair_guards",
    "paired_evidence",
    "paired_guards",
    "position_divergence",
    "probe_divergence",
    "probe_rules",
    "reduce_divergence",
    "reduce_paired",
    "reports_with",
    "resolve_paths",
    "score_live",
    "sequence_log_probability",
    "shred_leaves",
    "structural_summary",
    "substring_starts",
    "tensor_differences",
    "tensor_guards",
    "token_starts",
    "trace",
    "trace_guards",
    "valid_module_path",
    "violations",
    "within_budget",
]
