"""The eight document types: their shapes, their rules, and validation of many at once."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from string import Formatter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.contracts.shapes import Choice, Flag, Issue, Items, Json, Maybe, Number, Record, Shape, Table, Text, is_number, is_whole, non_finite
from probeloom.functions.canonical import CANONICAL, RAW
from probeloom.functions.text import COMMIT, IDENTIFIER, SHA256, TENSOR_NAME, UTC_TIMESTAMP

VERSION = "1.0.0"
GROUPS = ("exact", "paraphrase", "locality", "portability", "control")
RIPPLE_GROUPS = ("relation_specificity", "logical_generalization", "subject_aliasing", "compositionality_i", "compositionality_ii", "forgetfulness")

# Bounds, patterns and enumerations of the document contracts.
_ID, _HASH, _UTC = Text(pattern=IDENTIFIER), Text(pattern=SHA256), Text(pattern=UTC_TIMESTAMP)
_TEXT, _REVISION, _NOTE = Text(1, 32768), Text(1, 512), Text(1, 4096)
_VERSION = Choice((VERSION,))
_TEMPLATE = Text(1, 32768, r"(?:[^{}]|\{\{|\}\})*\{subject\}(?:[^{}]|\{\{|\}\})*")
_WARNINGS = Items(_NOTE, most=1000, unique=True)
_CITATIONS = Items(Record({"title": Text(1, 1024), "source": Text(1, 4096)}, {"identifier": Text(1, 512)}), least=1, most=100)
_STATUS = Choice(("complete", "incomplete", "failed"))
_DIRECTION = Choice(("higher-is-better", "lower-is-better", "descriptive-only"))

_PROBE = Record({"probe_id": _ID, "prompt": _TEXT})
_PORTABLE = Record({"probe_id": _ID, "prompt": _TEXT, "expected_relationship": Record({"relation": Choice(("entails", "contradicts", "supports", "is_related_to")), "target": _TEXT})})
CASE = Record(
    {
        "schema_version": _VERSION,
        "case_id": _ID,
        "edit": Record({"subject": _TEXT, "prompt_template": _TEMPLATE, "target_new": _TEXT}, {"target_original": _TEXT}),
        "probes": Record({"exact": Items(_PROBE, 1, 10_000), **{g: Items(_PROBE, 0, 10_000) for g in ("paraphrase", "locality", "control")}, "portability": Items(_PORTABLE, 0, 10_000)}),
        "provenance": Record({"dataset_name": Text(1, 512), "dataset_license": Text(1, 256), "source": Text(1, 2048)}, {"dataset_version": Text(1, 256), "record_id": Text(1, 512), "citation": Text(1, 4096)}),
    },
    {"description": _NOTE},
)

_CONTENT_HASH = Record({"algorithm": Choice(("sha256",)), "encoding": Choice((RAW, CANONICAL)), "digest": _HASH, "size_bytes": Number(0, whole=True)})
_ARTIFACT = Record(
    {"artifact_id": _ID, "kind": Choice(("model-checkpoint", "model-delta", "audit-case", "tokenizer", "dataset", "other"))},
    {"revision": _REVISION, "content_hash": _CONTENT_HASH, "hash_unavailable": Record({"reason": Choice(("not-permitted", "not-accessible", "not-applicable")), "details": _NOTE})},
    one_of=("content_hash", "hash_unavailable"),
)
_CASE_ARTIFACT = Record({**_ARTIFACT.required, "kind": Choice(("audit-case",))}, _ARTIFACT.optional, _ARTIFACT.one_of)
_ENGINE = Record({"version": Text(1, 128), "commit": Text(pattern=COMMIT), "dirty": Flag()})
_ENVIRONMENT = Record({
    "python_version": Text(1, 128), "package_versions": Table(Text(1, 256), least=1, keys=Text(1, 256)), "device": Text(1, 256), "dtype": Text(1, 128),
    "quantization": Record({"method": Text(1, 256), "configuration": Table(Json())}),
})
_EDITOR = Record({"adapter": _ID, "revision": _REVISION, "hyperparameters": Table(Json())})
_SEEDS = Table(Number(0, 4_294_967_295, whole=True), least=1, keys=_ID)
_MODEL = {"model_id": _TEXT, "model_revision": _REVISION, "tokenizer_id": _TEXT, "tokenizer_revision": _REVISION}
SNAPSHOT = Record({
    "schema_version": _VERSION, "snapshot_id": _ID, "state": Choice(("baseline", "edited")), "engine": _ENGINE, "environment": _ENVIRONMENT, "model": Record({**_MODEL, "artifact": _ARTIFACT}),
    "editor": _EDITOR, "generation": Table(Json(), most=256), "seeds": _SEEDS,
    "measurements": Record({
        "target_scores": Items(Record({"probe_id": _ID, "mean_target_log_probability": Number(high=0)}), most=40_000),
        "control_logits": Items(Record({"probe_id": _ID, "logits": Items(Items(Number(), 1, 65_536), 1, 4_096)}), most=10_000),
        "control_temperature": Number(above=0),
    }),
})
MANIFEST = Record({
    "schema_version": _VERSION, "run_id": _ID, "status": Choice(("running", "completed", "failed", "incomplete")), "timestamps": Record({"started_at": _UTC, "ended_at": Maybe(_UTC)}),
    "engine": _ENGINE, "environment": _ENVIRONMENT, "model": Record({**_MODEL, "baseline": _ARTIFACT, "edited": _ARTIFACT}), "audit_case": Record({"schema_version": Text(1, 128), "artifact": _CASE_ARTIFACT}),
    "editor": _EDITOR, "generation": Table(Json()), "seeds": _SEEDS, "failure": Maybe(Record({"stage": _ID, "error_type": _ID, "message": _TEXT})),
})
_COUNT = Number(0, 10_000, whole=True)
METRIC = Record(
    {
        "schema_version": _VERSION, "metric_id": _ID, "status": _STATUS, "direction": _DIRECTION, "unit": Text(1, 128), "aggregate": Maybe(Number()), "reduction": Text(1, 512),
        "coverage": Record({"total": _COUNT, "evaluated": _COUNT, "missing": _COUNT, "fraction": Number(0, 1)}),
        "probes": Items(Record({"probe_id": _ID, "status": Choice(("evaluated", "missing", "failed")), "values": Table(Json()), "missing_reason": Maybe(_NOTE)}), most=10_000),
        "warnings": _WARNINGS, "citations": _CITATIONS,
    },
    {"threshold": Maybe(Record({"operator": Choice(("greater-than", "greater-than-or-equal", "less-than", "less-than-or-equal")), "value": Number(), "passed": Flag()}))},
)
REPORT = Record({
    "schema_version": _VERSION, "report_id": _ID, "status": Choice(("completed", "incomplete", "failed")), "generated_at": _UTC, "manifest": MANIFEST,
    "audit_case": Record({"case_id": _ID, "schema_version": Text(1, 128), "artifact": _CASE_ARTIFACT, "dataset": Record({"name": Text(1, 512), "license": Text(1, 256), "source": Text(1, 2048)}, {"version": Text(1, 256)})}),
    "metrics": Items(METRIC, most=1000),
    "structural_evidence": Items(Record({"evidence_id": _ID, "evidence_type": _ID, "status": _STATUS, "values": Table(Json()), "warnings": _WARNINGS, "citations": _CITATIONS}), most=1000),
    "limitations": Items(_TEXT, 1, 1000, unique=True), "warnings": _WARNINGS,
})
_SIDE = Maybe(Record({"status": _STATUS, "aggregate": Maybe(Number()), "coverage": Number(0, 1)}))
_REFERENCE = Record({"report_id": _ID, "content_hash": Record({**_CONTENT_HASH.required, "encoding": Choice((CANONICAL,))})})
COMPARISON = Record({
    "schema_version": _VERSION, "report_a": _REFERENCE, "report_b": _REFERENCE,
    "comparability": Record({"audit_case_sha256": _HASH, "baseline_sha256": _HASH, **_MODEL, "device": Text(1, 256), "dtype": Text(1, 128)}),
    "metrics": Items(Record({
        "metric_id": _ID, "presence": Choice(("both", "only-a", "only-b")), "comparable": Flag(), "unit": Maybe(Text(1, 128)), "direction": Maybe(_DIRECTION), "reduction": Maybe(Text(1, 512)),
        "report_a": _SIDE, "report_b": _SIDE, "aggregate_delta_b_minus_a": Maybe(Number()), "warnings": _WARNINGS,
    }), most=10_000), "warnings": _WARNINGS,
})
_STATE = Record({"state_id": Text(1, 4096), "artifact_sha256": _HASH})
EDITOR_ARTIFACT = Record({
    "schema_version": _VERSION, "artifact_id": _ID, "artifact_kind": Choice(("synthetic-contract-fixture", "external-export")),
    "editor": Record({"name": _ID, "revision": Text(pattern="[0-9a-f]{40}"), "source_repository": Text(0, 2048), "hyperparameters": Table(Json(), most=256)}),
    "model": Record({"architecture": _ID, "baseline": _STATE, "edited": _STATE}),
    "changed_tensors": Items(Record({"name": Text(pattern=TENSOR_NAME), "shape": Items(Number(1, whole=True), 1, 16), "dtype": Text(1, 128), "device": Text(1, 128), "baseline_sha256": _HASH, "edited_sha256": _HASH}), most=10_000),
})
_WORDS = Text(1, 4096, r".*\S.*")
_ANSWERS = Items(_WORDS, 1, 128, unique=True)
_RIPPLE_PROBE = Record(
    {"probe_id": _ID, "prompt": _WORDS, "expectation": Choice(("edited-target", "baseline-preservation")), "expected_answers": _ANSWERS},
    {"relation": _ID, "condition": Record({"operator": Choice(("all", "any")), "queries": Items(Record({"prompt": _WORDS, "expected_answers": _ANSWERS}), 1, 128)})},
)
RIPPLE = Record({
    "schema_version": _VERSION, "case_id": _ID, "artifact_kind": Choice(("synthetic-contract-fixture", "external-benchmark-case")),
    "edit": Record({"subject": _WORDS, "prompt": _WORDS, "target_new": _WORDS}, {"target_original": _WORDS}),
    "provenance": Record({"dataset_name": _WORDS, "dataset_revision": _WORDS, "dataset_license": _WORDS, "source_url": Text(0, 2048, r"https://[^@\s]+"), "source_revision": Text(pattern="[0-9a-f]{40}")}, {"upstream_case_id": _ID}),
    "probes": Record({g: Items(_RIPPLE_PROBE, most=10_000) for g in RIPPLE_GROUPS}),
})


def at(v: object, *keys: str) -> object:
    """A nested field, None where it is absent or its parent is no object."""
    for k in keys:
        v = v.get(k) if isinstance(v, dict) else None
    return v


def listed(v: object) -> list[tuple[int, dict]]:
    """The objects of an array with their places."""
    return [(i, x) for i, x in enumerate(v) if isinstance(x, dict)] if isinstance(v, list) else []


def repeats(named: Iterable[tuple[object, str]], what: str) -> Iterator[Issue]:
    """Names that were there before, each with the place of the first."""
    first: dict[str, str] = {}
    for name, path in named:
        if isinstance(name, str) and first.setdefault(name, path) != path:
            yield path, f"duplicate {what} {name!r}; first declared at {first[name]}"


def hash_key(reference: object) -> tuple | None:
    """What two content hashes are compared by; None when the hash is unknown."""
    parts = tuple(at(reference, "content_hash", k) for k in ("algorithm", "encoding", "digest"))
    return parts if all(isinstance(p, str) for p in parts) else None


def instant(text: object) -> datetime | None:
    if not isinstance(text, str):
        return None
    try:
        return datetime.fromisoformat(re.sub("Z$", "", text) + "+00:00")
    except ValueError:
        return None


def _targets(doc: dict) -> Iterator[Issue]:
    new = at(doc, "edit", "target_new")
    if isinstance(new, str) and new == at(doc, "edit", "target_original"):
        yield "$.edit.target_original", "must differ from target_new when supplied"


def case_rules(doc: dict) -> Iterator[Issue]:
    template = at(doc, "edit", "prompt_template")
    if isinstance(template, str):
        try:
            names = [name for _, name, _, _ in Formatter().parse(template) if name is not None]
            if names != ["subject"]:
                yield "$.edit.prompt_template", "must contain exactly one {subject} field and no other"
        except ValueError as error:
            yield "$.edit.prompt_template", f"is no valid template: {error}"
    yield from repeats(((p.get("probe_id"), f"$.probes.{g}[{i}].probe_id") for g in GROUPS for i, p in listed(at(doc, "probes", g))), "probe_id")
    yield from _targets(doc)


def snapshot_rules(doc: dict) -> Iterator[Issue]:
    yield from non_finite(doc)
    fields = ("target_scores", "control_logits")
    yield from repeats(((e.get("probe_id"), f"$.measurements.{f}[{i}].probe_id") for f in fields for i, e in listed(at(doc, "measurements", f))), "probe_id")


def manifest_rules(doc: dict) -> Iterator[Issue]:
    before, after = at(doc, "model", "baseline"), at(doc, "model", "edited")
    if isinstance(at(before, "artifact_id"), str) and at(before, "artifact_id") == at(after, "artifact_id"):
        yield "$.model.edited.artifact_id", "must differ from the baseline's"
    if hash_key(before) is not None and hash_key(before) == hash_key(after):
        yield "$.model.edited.content_hash.digest", "must differ from the baseline's"
    times = {n: at(doc, "timestamps", n) for n in ("started_at", "ended_at")}
    for n, text in times.items():
        if isinstance(text, str) and instant(text) is None:
            yield f"$.timestamps.{n}", "must be a valid UTC date-time"
    started, ended = (instant(t) for t in times.values())
    if started and ended and ended < started:
        yield "$.timestamps.ended_at", "must not precede started_at"
    status, failure, end = doc.get("status"), doc.get("failure"), times["ended_at"]
    if status == "running" and end is not None:
        yield "$.timestamps.ended_at", "must be null while running"
    if status in ("completed", "failed", "incomplete") and end is None:
        yield "$.timestamps.ended_at", "is required once the run has ended"
    if status in ("running", "completed") and failure is not None:
        yield "$.failure", f"must be null when {status}"
    if status in ("failed", "incomplete") and failure is None:
        yield "$.failure", f"is required when {status}"


COMPARE: dict[str, Callable[[float, float], bool]] = {
    "greater-than": lambda a, b: a > b,
    "greater-than-or-equal": lambda a, b: a >= b,
    "less-than": lambda a, b: a < b,
    "less-than-or-equal": lambda a, b: a <= b,
}


def metric_rules(doc: dict) -> Iterator[Issue]:
    probes, coverage, status, aggregate = doc.get("probes"), doc.get("coverage"), doc.get("status"), doc.get("aggregate")
    for i, p in listed(probes):
        if p.get("status") == "evaluated" and p.get("missing_reason") is not None:
            yield f"$.probes[{i}].missing_reason", "must be null for an evaluated probe"
        if p.get("status") in ("missing", "failed") and p.get("missing_reason") is None:
            yield f"$.probes[{i}].missing_reason", "is required when evidence is missing"
    if status in ("incomplete", "failed") and doc.get("warnings") == []:
        yield "$.warnings", f"must hold a warning when {status}"
    if status == "failed" and aggregate is not None:
        yield "$.aggregate", "must be null when failed"
    if isinstance(probes, list) and isinstance(coverage, dict):
        yield from repeats(((p.get("probe_id"), f"$.probes[{i}].probe_id") for i, p in listed(probes)), "probe_id")
        evaluated = sum(p.get("status") == "evaluated" for _, p in listed(probes))
        counted = {"total": len(probes), "evaluated": evaluated, "missing": len(probes) - evaluated}
        for name, n in counted.items():
            if is_whole(coverage.get(name)) and coverage[name] != n:
                yield f"$.coverage.{name}", f"must equal {n}, counted from the probes"
        share = evaluated / len(probes) if probes else 0.0
        fraction = coverage.get("fraction")
        if is_number(fraction) and math.isfinite(fraction) and abs(fraction - share) > 1e-12:
            yield "$.coverage.fraction", "must equal evaluated over total, 0 when total is 0"
        if status == "complete" and (counted["missing"] or not evaluated):
            yield "$.status", "complete needs every probe evaluated, and at least one"
        if status == "incomplete" and not counted["missing"]:
            yield "$.status", "incomplete needs a missing or failed probe"
        if not evaluated and aggregate is not None:
            yield "$.aggregate", "must be null when no probes were evaluated"
        if evaluated and status in ("complete", "incomplete") and aggregate is None:
            yield "$.aggregate", "must be present when a probe was evaluated"
    limit, passed, how = at(doc, "threshold", "value"), at(doc, "threshold", "passed"), at(doc, "threshold", "operator")
    if is_number(aggregate) and is_number(limit) and math.isfinite(aggregate) and math.isfinite(limit) and isinstance(passed, bool) and how in COMPARE:
        if passed != COMPARE[how](float(aggregate), float(limit)):
            yield "$.threshold.passed", "must equal the declared comparison"


def _below(prefix: str, issues: Iterable[Issue]) -> Iterator[Issue]:
    return ((prefix + path[1:], message) for path, message in issues)


def report_rules(doc: dict) -> Iterator[Issue]:
    yield from non_finite(doc)
    manifest, metrics, structural, status = doc.get("manifest"), listed(doc.get("metrics")), listed(doc.get("structural_evidence")), doc.get("status")
    if isinstance(manifest, dict):
        yield from _below("$.manifest", manifest_rules(manifest))
    for i, m in metrics:
        yield from _below(f"$.metrics[{i}]", metric_rules(m))
    yield from repeats(((m.get("metric_id"), f"$.metrics[{i}].metric_id") for i, m in metrics), "metric_id")
    if status in ("completed", "incomplete") and doc.get("metrics") == []:
        yield "$.metrics", f"must hold a metric when {status}"
    for name, group in (("structural_evidence", structural),):
        for i, e in group:
            if e.get("status") in ("incomplete", "failed") and e.get("warnings") == []:
                yield f"$.{name}[{i}].warnings", f"must hold a warning when {e['status']}"
    if status in ("incomplete", "failed") and doc.get("warnings") == []:
        yield "$.warnings", f"must hold a warning when {status}"
    if isinstance(status, str) and isinstance(at(manifest, "status"), str) and status != manifest["status"]:
        yield "$.status", f"must equal the manifest's status ({manifest['status']!r})"
    if status == "completed":
        lacking = [f"$.{name}[{i}].status" for name, group in (("metrics", metrics), ("structural_evidence", structural)) for i, e in group if e.get("status") != "complete"]
        yield from ((path, "must be 'complete' when the report is completed") for path in lacking)
        if lacking:
            yield "$.status", "cannot be 'completed' while evidence is incomplete or failed"
    made, ended = instant(doc.get("generated_at")), instant(at(manifest, "timestamps", "ended_at"))
    if isinstance(doc.get("generated_at"), str) and made is None:
        yield "$.generated_at", "must be a valid UTC date-time"
    if made and ended and made < ended:
        yield "$.generated_at", "must not precede the end of the run"
    yield from repeats(((e.get("evidence_id"), f"$.structural_evidence[{i}].evidence_id") for i, e in structural), "evidence_id")
    mine, theirs = doc.get("audit_case"), at(manifest, "audit_case")
    if isinstance(mine, dict) and isinstance(theirs, dict):
        if mine.get("schema_version") != theirs.get("schema_version"):
            yield "$.audit_case.schema_version", "must equal the manifest's"
        a, b = mine.get("artifact"), theirs.get("artifact")
        if isinstance(a, dict) and isinstance(b, dict):
            if mine.get("case_id") != a.get("artifact_id"):
                yield "$.audit_case.case_id", "must equal the identifier of its artifact"
            if a.get("artifact_id") != b.get("artifact_id"):
                yield "$.audit_case.artifact.artifact_id", "must equal the manifest's"
            if hash_key(a) != hash_key(b):
                yield "$.audit_case.artifact.content_hash.digest", "must equal the manifest's"
            elif hash_key(a) is None and a.get("hash_unavailable") != b.get("hash_unavailable"):
                yield "$.audit_case.artifact.hash_unavailable", "must equal the manifest's"


def comparison_rules(doc: dict) -> Iterator[Issue]:
    yield from non_finite(doc)
    metrics = listed(doc.get("metrics"))
    yield from repeats(((m.get("metric_id"), f"$.metrics[{i}].metric_id") for i, m in metrics), "metric_id")
    sides = {"both": (True, True), "only-a": (True, False), "only-b": (False, True)}
    for i, m in metrics:
        have = tuple(isinstance(m.get(s), dict) for s in ("report_a", "report_b"))
        presence, delta, where = m.get("presence"), m.get("aggregate_delta_b_minus_a"), f"$.metrics[{i}].aggregate_delta_b_minus_a"
        if presence in sides and have != sides[presence]:
            yield f"$.metrics[{i}].presence", "must agree with the snapshots that are there"
        if m.get("comparable") is False and delta is not None:
            yield where, "must be null when not comparable"
        if m.get("comparable") is not True:
            continue
        if presence != "both":
            yield f"$.metrics[{i}].comparable", "can be true only when both reports have the metric"
        a, b = at(m, "report_a", "aggregate"), at(m, "report_b", "aggregate")
        if not (is_number(a) and is_number(b)):
            if delta is not None:
                yield where, "must be null when an aggregate is unavailable"
        elif not math.isfinite(float(b) - float(a)):
            if delta is not None:
                yield where, "must be null when the difference is not finite"
        elif not is_number(delta) or abs(float(delta) - (float(b) - float(a))) > 1e-12:
            yield where, "must equal the aggregate of B less that of A"


def editor_rules(doc: dict) -> Iterator[Issue]:
    yield from non_finite(doc)
    before, after = at(doc, "model", "baseline"), at(doc, "model", "edited")
    if isinstance(before, dict) and isinstance(after, dict):
        for n in ("state_id", "artifact_sha256"):
            if before.get(n) == after.get(n):
                yield f"$.model.edited.{n}", "must differ from the baseline's"
    tensors = listed(doc.get("changed_tensors"))
    yield from repeats(((t.get("name"), f"$.changed_tensors[{i}].name") for i, t in tensors), "changed tensor name")
    for i, t in tensors:
        if t.get("baseline_sha256") == t.get("edited_sha256"):
            yield f"$.changed_tensors[{i}].edited_sha256", "must differ from the baseline's for a changed tensor"


def ripple_rules(doc: dict) -> Iterator[Issue]:
    yield from _targets(doc)
    groups = {g: at(doc, "probes", g) for g in RIPPLE_GROUPS}
    yield from repeats(((p.get("probe_id"), f"$.probes.{g}[{i}].probe_id") for g, v in groups.items() for i, p in listed(v)), "probe_id")
    if isinstance(doc.get("probes"), dict) and not any(isinstance(v, list) and v for v in groups.values()):
        yield "$.probes", "must contain a probe"
    upstream, kind = at(doc, "provenance", "upstream_case_id"), doc.get("artifact_kind")
    if isinstance(doc.get("provenance"), dict):
        if kind == "external-benchmark-case" and not isinstance(upstream, str):
            yield "$.provenance.upstream_case_id", "is required for an external case"
        if kind == "synthetic-contract-fixture" and upstream is not None:
            yield "$.provenance.upstream_case_id", "must be left out for a synthetic case"


def metric_document_rules(doc: dict) -> Iterator[Issue]:
    yield from non_finite(doc)
    yield from metric_rules(doc)


def manifest_document_rules(doc: dict) -> Iterator[Issue]:
    yield from manifest_rules(doc)
    yield from non_finite(doc)


KINDS: dict[str, tuple[Shape, Callable[[dict], Iterator[Issue]]]] = {
    "case": (CASE, case_rules),
    "snapshot": (SNAPSHOT, snapshot_rules),
    "manifest": (MANIFEST, manifest_document_rules),
    "metric": (METRIC, metric_document_rules),
    "report": (REPORT, report_rules),
    "comparison": (COMPARISON, comparison_rules),
    "editor": (EDITOR_ARTIFACT, editor_rules),
    "ripple": (RIPPLE, ripple_rules),
}


class ContractViolation(ValueError):
    """A document that breaks its contract, with all issues."""

    def __init__(self, kind: str, issues: list[Issue]) -> None:
        self.kind, self.issues = kind, issues
        super().__init__(f"the {kind} breaks its contract: " + "; ".join(f"{p}: {m}" for p, m in issues))


def issues_of(kind: str, document: object) -> list[Issue]:
    """Everything that is wrong with a document: issues of shape in order, then of the rules."""
    shape, rules = KINDS[kind]
    found = sorted(shape.check(document, "$"))
    return found + list(rules(document)) if isinstance(document, dict) else found


def require(kind: str, document: object) -> dict:
    issues = issues_of(kind, document)
    if issues:
        raise ContractViolation(kind, issues)
    return document


def validate_documents(df: DataFrame, kind: str, id_column: str, payload: str) -> DataFrame:
    """``(id, phase, seq, path, message)`` of every issue of many JSON documents; none when all are valid.

    A text that is null or no strict JSON has one issue of phase ``read``. Documents are checked
    independently, one Arrow batch at a time.
    """
    id_type = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from probeloom.sources.documents import JsonDocumentError, parse_strict

        for b in batches:
            at_row, phases, seqs, paths, messages = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                try:
                    document = parse_strict(text) if text is not None else _missing()
                    found = [("contract", *x) for x in issues_of(kind, document)]
                except (JsonDocumentError, RecursionError) as error:
                    found = [("read", "$", str(error) or "is nested too deeply")]
                for n, (phase, path, message) in enumerate(found):
                    at_row.append(i)
                    phases.append(phase)
                    seqs.append(n)
                    paths.append(path)
                    messages.append(message)
            ids = b.column(0).take(pa.array(at_row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(phases, pa.string()), pa.array(seqs, pa.int32()), pa.array(paths, pa.string()), pa.array(messages, pa.string())], names=[id_column, "phase", "seq", "path", "message"])

    return df.select(F.col(id_column), F.col(payload).cast("string").alias("payload")).mapInArrow(run, f"`{id_column}` {id_type}, phase string, seq int, path string, message string")


def _missing() -> object:
    from probeloom.sources.documents import JsonDocumentError

    raise JsonDocumentError("there is no document")
