"""Small documents for the tests, made here."""

from __future__ import annotations

import copy

from probeloom.functions.canonical import hash_json

HEX = "0123456789abcdef"


def case():
    probe = lambda i, text: {"probe_id": i, "prompt": text}
    return {
        "schema_version": "1.0.0", "case_id": "case-1", "description": "A made-up edit.",
        "edit": {"subject": "Tower", "prompt_template": "The {subject} stands in", "target_new": " Rome", "target_original": " Paris"},
        "probes": {
            "exact": [probe("e1", "The Tower stands in")], "paraphrase": [probe("p1", "Where the Tower is:")], "locality": [probe("l1", "The bridge stands in")],
            "portability": [{**probe("o1", "The Tower's country is"), "expected_relationship": {"relation": "entails", "target": " Italy"}}], "control": [probe("c1", "Two and two are")],
        },
        "provenance": {"dataset_name": "made-up", "dataset_license": "CC0-1.0", "source": "urn:made-up"},
    }


def artifact(name, kind="model-checkpoint", content=1):
    return {"artifact_id": name, "kind": kind, "content_hash": {"algorithm": "sha256", "encoding": "raw-bytes", "digest": HEX[content] * 64, "size_bytes": 10}}


def snapshot(state):
    edited = state == "edited"
    scores = {"e1": (-3.0, -1.0), "p1": (-2.0, -1.25), "l1": (-1.0, -1.1), "o1": (-2.5, -1.5)}
    logits = [[[0.0, 0.0], [0.5, -0.5]], [[0.2, -0.2], [0.4, -0.4]]][edited]
    return {
        "schema_version": "1.0.0", "snapshot_id": f"snap-{state}", "state": state, "engine": {"version": "1", "commit": "a" * 40, "dirty": False},
        "environment": {"python_version": "3.13", "package_versions": {"x": "1"}, "device": "cpu", "dtype": "float32", "quantization": {"method": "none", "configuration": {}}},
        "model": {"model_id": "m", "model_revision": "r", "tokenizer_id": "t", "tokenizer_revision": "r", "artifact": artifact("edit" if edited else "base", "model-delta" if edited else "model-checkpoint", 2 if edited else 1)},
        "editor": {"adapter": "made-up", "revision": "1", "hyperparameters": {"rank": 1}}, "generation": {"temperature": 0}, "seeds": {"python": 1},
        "measurements": {
            "target_scores": [{"probe_id": k, "mean_target_log_probability": v[edited]} for k, v in scores.items()],
            "control_logits": [{"probe_id": "c1", "logits": logits}], "control_temperature": 1.0,
        },
    }


def metric(**more):
    probe = lambda i, ok: {"probe_id": i, "status": "evaluated" if ok else "missing", "values": {}, "missing_reason": None if ok else "not run"}
    return {
        "schema_version": "1.0.0", "metric_id": "m.one", "status": "complete", "direction": "higher-is-better", "unit": "nats", "aggregate": 0.375, "reduction": "mean", "coverage": {"total": 2, "evaluated": 2, "missing": 0, "fraction": 1.0},
        "probes": [probe("a", True), probe("b", True)], "warnings": [], "citations": [{"title": "T", "source": "S"}],
    } | more


def manifest(status="completed"):
    s, c = snapshot("baseline"), case()
    return {
        "schema_version": "1.0.0", "run_id": "run-1", "status": status, "timestamps": {"started_at": "2030-01-01T00:00:00Z", "ended_at": None if status == "running" else "2030-01-01T00:00:01Z"},
        **{n: s[n] for n in ("engine", "environment", "editor", "generation", "seeds")},
        "model": {"model_id": "m", "model_revision": "r", "tokenizer_id": "t", "tokenizer_revision": "r", "baseline": artifact("base"), "edited": artifact("edit", "model-delta", 2)},
        "audit_case": {"schema_version": "1.0.0", "artifact": {"artifact_id": "case-1", "kind": "audit-case", "content_hash": hash_json(c)}}, "failure": None,
    }


def report(*metrics):
    m = manifest()
    return {
        "schema_version": "1.0.0", "report_id": "report-1", "status": "completed", "generated_at": "2030-01-01T00:00:01Z", "manifest": m,
        "audit_case": {"case_id": "case-1", "schema_version": "1.0.0", "artifact": copy.deepcopy(m["audit_case"]["artifact"]), "dataset": {"name": "made-up", "license": "CC0-1.0", "source": "urn:made-up"}},
        "metrics": list(metrics) or [metric()], "structural_evidence": [], "limitations": ["Made up."], "warnings": [],
    }


def editor_artifact(name="ROME", repository="https://github.com/kmeng01/rome", settings=None):
    return {
        "schema_version": "1.0.0", "artifact_id": "x", "artifact_kind": "external-export",
        "editor": {"name": name, "revision": "b" * 40, "source_repository": repository, "hyperparameters": settings if settings is not None else {"layers": [1], "fact_token": "last"}},
        "model": {"architecture": "GPT2LMHeadModel", "baseline": {"state_id": "s0", "artifact_sha256": "1" * 64}, "edited": {"state_id": "s1", "artifact_sha256": "2" * 64}},
        "changed_tensors": [{"name": "w", "shape": [8, 8], "dtype": "float32", "device": "cpu", "baseline_sha256": "3" * 64, "edited_sha256": "4" * 64}],
    }


def ripple():
    probe = {"probe_id": "q1", "prompt": "Q", "expectation": "edited-target", "expected_answers": ["A"], "condition": {"operator": "all", "queries": [{"prompt": "P", "expected_answers": ["B"]}]}}
    return {
        "schema_version": "1.0.0", "case_id": "r1", "artifact_kind": "synthetic-contract-fixture", "edit": {"subject": "s", "prompt": "p", "target_new": "n"},
        "provenance": {"dataset_name": "d", "dataset_revision": "1", "dataset_license": "MIT", "source_url": "https://made.up/x", "source_revision": "c" * 40},
        "probes": {g: [] for g in ("logical_generalization", "subject_aliasing", "compositionality_i", "compositionality_ii", "forgetfulness")} | {"relation_specificity": [probe]},
    }
