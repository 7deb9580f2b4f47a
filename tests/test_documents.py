import copy
import io
import json
from datetime import UTC, datetime, timedelta

import documents as D
import pytest

from probeloom import cli
from probeloom.contracts.documents import issues_of, validate_documents
from probeloom.functions.canonical import canonical_bytes, file_identities, hash_file, hash_json, hash_of, with_identity
from probeloom.operators import editors as E
from probeloom.plans import audit, compare, lifecycle, render
from probeloom.sources.documents import JsonDocumentError, parse_strict, read_document, rename, scan_documents
from probeloom.sources.writers import WriteError, write_atomically


def change(doc, path, value=None, drop=False):
    doc = copy.deepcopy(doc)
    *parents, last = path
    at = doc
    for p in parents:
        at = at[p]
    if drop:
        del at[last]
    else:
        at[last] = value
    return doc


VALID = {"case": D.case(), "snapshot": D.snapshot("baseline"), "manifest": D.manifest(), "metric": D.metric(), "report": D.report(), "editor": D.editor_artifact(), "ripple": D.ripple()}


@pytest.mark.parametrize("kind", VALID)
def test_valid_documents(kind):
    assert issues_of(kind, VALID[kind]) == []
    assert [p for p, _ in issues_of(kind, [])] == ["$"]


LOSS = {"total": 2, "evaluated": 1, "missing": 1, "fraction": 0.5}
BROKEN = [
    ("case", ("edit", "prompt_template"), "no field", "$.edit.prompt_template"), ("case", ("edit", "prompt_template"), "{subject} {subject}", "$.edit.prompt_template"), ("case", ("edit", "prompt_template"), "{subject} {", "$.edit.prompt_template"),
    ("case", ("probes", "paraphrase", 0, "probe_id"), "e1", "$.probes.paraphrase[0].probe_id"), ("case", ("edit", "target_original"), " Rome", "$.edit.target_original"), ("case", ("probes", "exact"), [], "$.probes.exact"),
    ("case", ("case_id",), "-x", "$.case_id"), ("case", ("case_id",), "x\n", "$.case_id"), ("case", ("more",), 1, "$"), ("case", ("description",), "", "$.description"),
    ("snapshot", ("measurements", "control_logits", 0, "probe_id"), "e1", "$.measurements.control_logits[0].probe_id"), ("snapshot", ("measurements", "target_scores", 0, "mean_target_log_probability"), float("nan"), "$.measurements.target_scores[0].mean_target_log_probability"),
    ("snapshot", ("measurements", "target_scores", 0, "mean_target_log_probability"), 0.1, "$.measurements.target_scores[0].mean_target_log_probability"), ("snapshot", ("measurements", "control_temperature"), 0, "$.measurements.control_temperature"),
    ("snapshot", ("unknown",), 1, "$"), ("snapshot", ("seeds", "python"), True, "$.seeds.python"), ("snapshot", ("model", "artifact", "hash_unavailable"), {"reason": "not-permitted", "details": "x"}, "$.model.artifact"),
    ("manifest", ("model", "edited", "artifact_id"), "base", "$.model.edited.artifact_id"), ("manifest", ("model", "edited", "content_hash", "digest"), "1" * 64, "$.model.edited.content_hash.digest"), ("manifest", ("status",), "failed", "$.failure"),
    ("manifest", ("timestamps", "ended_at"), "2029-01-01T00:00:00Z", "$.timestamps.ended_at"), ("manifest", ("timestamps", "ended_at"), "2029-02-30T00:00:00Z", "$.timestamps.ended_at"), ("manifest", ("status",), "running", "$.timestamps.ended_at"),
    ("manifest", ("generation", "temperature"), float("inf"), "$.generation.temperature"), ("metric", ("coverage", "total"), 3, "$.coverage.total"), ("metric", ("coverage", "fraction"), 0.9, "$.coverage.fraction"), ("metric", ("probes", 1, "probe_id"), "a", "$.probes[1].probe_id"),
    ("metric", ("probes", 1, "status"), "missing", "$.status"), ("metric", ("status",), "incomplete", "$.status"), ("metric", ("aggregate",), None, "$.aggregate"), ("metric", ("threshold",), {"operator": "less-than", "value": 0.1, "passed": True}, "$.threshold.passed"),
    ("metric", ("probes", 0, "missing_reason"), "x", "$.probes[0].missing_reason"), ("report", ("metrics", 0, "coverage", "total"), 5, "$.metrics[0].coverage.total"), ("report", ("generated_at",), "2029-01-01T00:00:00Z", "$.generated_at"),
    ("report", ("metrics",), [D.metric(), D.metric()], "$.metrics[1].metric_id"), ("report", ("audit_case", "case_id"), "other", "$.audit_case.case_id"), ("report", ("audit_case", "artifact", "content_hash", "digest"), "5" * 64, "$.audit_case.artifact.content_hash.digest"),
    ("report", ("manifest", "timestamps", "ended_at"), "2029-01-01T00:00:00Z", "$.manifest.timestamps.ended_at"), ("report", ("status",), "failed", "$.status"), ("report", ("metrics", 0, "status"), "incomplete", "$.metrics[0].status"),
    ("editor", ("model", "edited", "state_id"), "s0", "$.model.edited.state_id"), ("editor", ("changed_tensors", 0, "edited_sha256"), "3" * 64, "$.changed_tensors[0].edited_sha256"), ("editor", ("changed_tensors",), D.editor_artifact()["changed_tensors"] * 2, "$.changed_tensors[1].name"),
    ("ripple", ("edit", "target_original"), "n", "$.edit.target_original"), ("ripple", ("probes", "relation_specificity"), [], "$.probes"), ("ripple", ("artifact_kind",), "external-benchmark-case", "$.provenance.upstream_case_id"), ("ripple", ("provenance", "source_revision"), "xyz", "$.provenance.source_revision"),
    ("ripple", ("edit", "subject"), "  ", "$.edit.subject"),
]


@pytest.mark.parametrize("kind, path, value, where", BROKEN)
def test_broken_documents(kind, path, value, where):
    assert where in [p for p, _ in issues_of(kind, change(VALID[kind], path, value))]


def test_missing_field_and_order():
    issues = issues_of("case", change(change(D.case(), ("provenance", "dataset_license"), drop=True), ("case_id",), ""))
    assert ("$.provenance", "'dataset_license' is a required property") in issues and issues == sorted(issues)


def test_many_documents(spark):
    rows = [(1, json.dumps(D.case())), (2, None), (3, "{"), (4, '{"a":1,"a":2}'), (5, json.dumps(change(D.case(), ("case_id",), "-"))), (6, "NaN"), (7, "[" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc int, body string, path string")
    found = validate_documents(df, "case", "doc", "body").collect()
    assert sorted({(r.doc, r.phase) for r in found}) == [(2, "read"), (3, "read"), (4, "read"), (5, "contract"), (6, "read"), (7, "read")]
    assert [r.path for r in found if r.doc == 5] == ["$.case_id"]
    assert validate_documents(df.limit(0), "case", "doc", "body").count() == 0


def test_canonical_json(spark, tmp_path):
    value = {"z": [3, 2, 1], "a": "café"}
    assert hash_json(value)["size_bytes"] == 25 and hash_json(value)["digest"] == "e2e60d33b166052a2e446d8eb90e3249cb7b3714fd2713c75f89fd29160800c1"
    for bad in ({"a": float("nan")}, {1: 2}, (1, 2), {"a": {1}}):
        with pytest.raises((TypeError, ValueError)):
            canonical_bytes(bad)
    df = with_identity(spark.createDataFrame([(1, json.dumps(value)), (2, "{"), (3, None), (4, '{"b":1e-5,"a":1e22}')], "i int, t string"), "t")
    got = {r.i: (r.canonical, r.digest, r.size_bytes) for r in df.collect()}
    assert got[1][1:] == (hash_json(value)["digest"], 25) and got[2] == got[3] == (None, None, None) and got[4][0] == '{"a":1e+22,"b":1e-05}'
    (tmp_path / "f").write_bytes(b"abc")
    assert hash_file(tmp_path / "f", 2) == hash_of(b"abc")
    assert [(r.digest, r.size_bytes) for r in file_identities(spark, str(tmp_path)).collect()] == [(hash_of(b"abc")["digest"], 3)]
    with pytest.raises(ValueError):
        hash_file(tmp_path / "f", 0)


def test_reading(spark, tmp_path):
    files = {"good": b'{"a": 1}', "cut": b'{"a"', "twice": b'{"a":1,"a":1}', "nan": b"NaN", "latin": b'"\xff"', "big": b'"' + b"x" * 100 + b'"'}
    for n, data in files.items():
        (tmp_path / f"{n}.json").write_bytes(data)
    assert read_document(tmp_path / "good.json") == {"a": 1}
    for n in files.keys() - {"good"}:
        with pytest.raises(JsonDocumentError):
            read_document(tmp_path / f"{n}.json", 50)
    with pytest.raises(JsonDocumentError):
        read_document(tmp_path)
    got = {r.path.split("/")[-1]: (r.payload, r.error is None) for r in scan_documents(spark, str(tmp_path), 50).collect()}
    assert got["good.json"] == ('{"a": 1}', True) and all(got[f"{n}.json"] == (None, False) for n in files.keys() - {"good"})
    assert rename({"theirs": {"encoding": "old"}, "x": "old"}, {"theirs": "engine", "old": "new"}) == {"engine": {"encoding": "new"}, "x": "old"}


def test_writing(tmp_path):
    assert write_atomically(tmp_path / "new" / "f", b"1").read_bytes() == b"1"
    (tmp_path / "link").symlink_to(tmp_path / "new")
    (tmp_path / "new" / "g").symlink_to(tmp_path / "new" / "f")
    (tmp_path / "file").write_text("")
    for bad in (tmp_path / "link" / "f", tmp_path / "new" / "g", tmp_path / "file" / "f"):
        with pytest.raises(WriteError):
            write_atomically(bad, b"2")
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == ["f", "g"]


def clock():
    now = datetime(2030, 1, 1, tzinfo=UTC)

    def tick():
        nonlocal now
        now += timedelta(seconds=1)
        return now

    return tick


def test_audit(spark, tmp_path):
    done = audit.run_audit(spark, D.case(), D.snapshot("baseline"), D.snapshot("edited"), tmp_path, clock())
    report = json.loads(done.report_json_path.read_text())
    assert issues_of("report", report) == [] and report["manifest"] == json.loads(done.manifest_path.read_text())
    values = {m["metric_id"].split(".")[0]: m["aggregate"] for m in report["metrics"]}
    assert list(values) == ["efficacy", "generality", "locality", "portability", "control"]
    assert values == pytest.approx({"efficacy": 2.0, "generality": 0.75, "locality": 0.1, "portability": 1.0, "control": 0.0119593830}, abs=1e-9)
    kl = report["metrics"][4]["probes"][0]["values"]
    assert kl["position_kl_divergences"] == pytest.approx([0.0198680718, 0.0040506942], abs=1e-9)
    assert done.run_id == report["manifest"]["run_id"] and report["report_id"] == done.run_id.replace("run-", "report-")
    text = done.report_markdown_path.read_text() + done.report_json_path.read_text()
    assert "stands in" not in text and "Rome" not in text


BAD_PAIRS = [(("seeds", "python"), 2), (("model", "model_id"), "n"), (("model", "artifact", "artifact_id"), "base"), (("model", "artifact", "content_hash", "digest"), "1" * 64), (("snapshot_id",), "snap-baseline"), (("state",), "baseline"), (("measurements", "target_scores"), []), (("measurements", "control_logits"), []), (("measurements", "control_temperature"), 2.0), (("model", "artifact", "kind"), "other"), (("case",), 1)]


@pytest.mark.parametrize("path, value", BAD_PAIRS)
def test_bad_pairs_write_nothing(spark, tmp_path, path, value):
    with pytest.raises(audit.AuditInputError):
        audit.run_audit(spark, D.case(), D.snapshot("baseline"), change(D.snapshot("edited"), path, value), tmp_path / "out")
    assert not (tmp_path / "out").exists()


def test_failing_audit_leaves_a_failed_manifest(spark, tmp_path):
    narrow = lambda s: change(D.snapshot(s), ("measurements", "control_logits", 0, "logits"), [[1.0]])
    with pytest.raises(lifecycle.RunFailed) as caught:
        audit.run_audit(spark, D.case(), narrow("baseline"), narrow("edited"), tmp_path, clock())
    assert caught.value.manifest["status"] == "failed" and caught.value.manifest["failure"]["error_type"] == "ArithmeticError"
    assert [p.name for p in tmp_path.iterdir()] == ["run-manifest.json"]


def test_many_audits(spark):
    table = lambda *docs: spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "audit_id string, payload string")
    edited = D.snapshot("edited")
    better = change(edited, ("measurements", "target_scores", 0, "mean_target_log_probability"), -0.5)
    cases = table(*((i, D.case()) for i in "abcd"), ("e", {}))
    metrics, issues = audit.audit_many(cases, table(*((i, D.snapshot("baseline")) for i in "abcde")), table(("a", edited), ("b", better), ("c", change(edited, ("seeds", "python"), 5)), ("e", edited)))
    got = {(r.audit_id, r.grp): (r.aggregate, r.evaluated) for r in metrics.collect()}
    assert len(got) == 10 and got["a", "exact"] == (2.0, 1) and got["b", "exact"] == (2.5, 1) and got["b", "control"][0] == pytest.approx(0.0119593830)
    found = {}
    for r in issues.collect():
        found.setdefault(r.audit_id, []).append(r.issue)
    assert found.keys() == {"c", "d", "e"} and found["c"] == ["$.seeds must be the same in both snapshots"] and found["d"] == ["the edited is missing"]
    assert len(found["e"]) == 5 and all(i.startswith("case $") for i in found["e"])


def test_every_rule_of_a_pair(spark):
    """All rules at once: what each change breaks, by path."""
    table = lambda docs: spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "audit_id string, payload string")
    edits = [change(D.snapshot("edited"), path, value) for path, value in BAD_PAIRS if path != ("case",)]
    issues = audit.pair_issues(table([D.case()] * len(edits)), table([D.snapshot("baseline")] * len(edits)), table(edits)).collect()
    by = {i: {r.path for r in issues if r.audit_id == str(i)} for i in range(len(edits))}
    assert by == {
        0: {"$.seeds"}, 1: {"$.model.model_id"}, 2: {"$.model.artifact.artifact_id"}, 3: {"$.model.artifact.content_hash"}, 4: {"$.snapshot_id"}, 5: {"$.edited.state"},
        6: {"$.edited.measurements.target_scores"}, 7: {"$.edited.measurements.control_logits"}, 8: {"$.measurements.control_temperature"}, 9: {"$.edited.model.artifact.kind"},
    }


def test_lifecycle(tmp_path):
    seen = []
    done = lifecycle.execute_run(D.manifest("running"), tmp_path, lambda: 7, lambda v, m: seen.append((v, m["status"])), clock=clock())
    assert done.value == 7 and seen == [(7, "completed")] and done.manifest["timestamps"]["ended_at"] == "2030-01-01T00:00:01.000000Z"

    class Odd_(Exception):
        pass

    Odd_.__name__ = "bad name"
    back = lambda: datetime(2029, 1, 1, tzinfo=UTC)

    def fail():
        raise Odd_

    with pytest.raises(lifecycle.RunFailed) as caught:
        lifecycle.execute_run(D.manifest("running"), tmp_path, fail, clock=back)
    assert caught.value.manifest["failure"]["error_type"] == "Exception" and caught.value.manifest["timestamps"]["ended_at"] == "2030-01-01T00:00:00Z"
    for bad in (D.manifest(), {}, change(D.manifest("running"), ("run_id",), "-")):
        with pytest.raises(lifecycle.LifecycleError):
            lifecycle.execute_run(bad, tmp_path, lambda: 1)
    with pytest.raises(lifecycle.LifecycleError):
        lifecycle.execute_run(D.manifest("running"), tmp_path, lambda: 1, stage="no stage")


def test_compare(spark):
    one = lambda **m: D.report(D.metric(**m))
    done = compare.compare_reports(spark, one(), one(aggregate=0.5))
    assert done["metrics"][0]["aggregate_delta_b_minus_a"] == 0.125 and issues_of("comparison", done) == []
    extra = D.report(D.metric(), D.metric(metric_id="a.two"))
    rows = compare.compare_reports(spark, extra, one())["metrics"]
    assert [(r["metric_id"], r["presence"], r["comparable"]) for r in rows] == [("a.two", "only-a", False), ("m.one", "both", True)]
    assert compare.compare_reports(spark, one(), extra)["metrics"][0]["warnings"] == ["metric is absent from report_a"]
    row = compare.compare_reports(spark, one(), one(unit="bits"))["metrics"][0]
    assert not row["comparable"] and row["aggregate_delta_b_minus_a"] is None and row["unit"] is None
    row = compare.compare_reports(spark, one(aggregate=-1e308), one(aggregate=1e308))["metrics"][0]
    assert row["comparable"] and row["aggregate_delta_b_minus_a"] is None and row["warnings"]
    assert len(compare.compare_reports(spark, one(), change(one(), ("manifest", "engine", "commit"), "b" * 40))["warnings"]) == 3
    with pytest.raises(compare.ComparisonError, match="seeds"):
        compare.compare_reports(spark, one(), change(one(), ("manifest", "seeds", "python"), 2))
    with pytest.raises(compare.ComparisonError):
        compare.compare_reports(spark, one(), {})
    tampered = change(done, ("metrics", 0, "aggregate_delta_b_minus_a"), 9.0)
    assert [p for p, _ in issues_of("comparison", tampered)] == ["$.metrics[0].aggregate_delta_b_minus_a"]


def test_markdown_shows_text_as_it_is():
    text = render.render_markdown(D.report(D.metric(metric_id="m_1", warnings=["<b>|`[x]*\n"], unit="a|b")))
    assert "<b>" not in text and "&lt;b&gt;&#124;&#96;&#91;x&#93;&#42;&#10;" in text and "m&#95;1" in text and "a&#124;b" in text


def test_metric_tables_of_many_reports(spark):
    df = spark.createDataFrame([("r", 1, "m_2", "complete", None, "nats", 1.0), ("r", 0, "m1", "complete", 0.5, "a|b", 0.5), ("s", 0, "m1", "failed", 1.0, "nats", None)], "report string, pos int, metric_id string, status string, aggregate double, unit string, fraction double")
    got = {r.report: r.markdown for r in render.metric_lines(df, "report", "pos").collect()}
    assert got == {"r": "| m1 | complete | 0.5 | a&#124;b | 0.5 |\n| m&#95;2 | complete | null | nats | 1.0 |", "s": "| m1 | failed | 1.0 | nats | null |"}


def test_cli(tmp_path, spark):
    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.main([str(a) for a in args], out, err), out.getvalue(), err.getvalue()

    for name, doc in (("case", D.case()), ("base", D.snapshot("baseline")), ("edit", D.snapshot("edited")), ("bad", change(D.case(), ("probes", "paraphrase", 0, "probe_id"), "e1")), ("r1", D.report()), ("r2", D.report(D.metric(aggregate=0.5)))):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert run("validate-case", tmp_path / "case.json") == (0, '{"case_id":"case-1","schema_version":"1.0.0","status":"valid"}\n', "")
    code, out, err = run("validate-case", tmp_path / "bad.json")
    assert (code, out) == (2, "") and "identifier must be unique" in err and "e1" not in err
    assert run("validate-case", tmp_path / "none.json")[0] == 2
    args = ("audit", "--case", tmp_path / "case.json", "--baseline", tmp_path / "base.json", "--edited", tmp_path / "edit.json", "--out")
    code, out, _ = run(*args, tmp_path / "out")
    assert code == 0 and json.loads(out)["status"] == "completed"
    assert run(*(tmp_path / "out" / "run-manifest.json" if a == tmp_path / "case.json" else a for a in args), tmp_path / "out")[0] == 2
    assert run(*(tmp_path / "edit.json" if a == tmp_path / "base.json" else a for a in args), tmp_path / "out2")[0] == 2
    code, out, _ = run("compare", tmp_path / "r1.json", tmp_path / "r2.json")
    assert code == 0 and json.loads(out)["metrics"][0]["aggregate_delta_b_minus_a"] == 0.125
    assert run("compare", tmp_path / "r1.json", tmp_path / "case.json")[0] == 2
    assert json.loads(json.dumps(parse_strict("{}"))) == {}


def test_editor_artifacts(spark):
    rome = D.editor_artifact()
    easy = D.editor_artifact("EasyEdit", "https://github.com/zjunlp/EasyEdit", {"algorithm": "MEMIT", "sequential_edit": False, "return_orig_weights": True})
    assert E.import_artifact(rome, "ROME") == rome and E.import_artifact(easy, "EasyEdit") == easy
    assert [tuple(r) for r in E.inventory(spark, rome).select("name", "pos", "shape").collect()] == [("w", 0, [8, 8])]
    for bad in (change(rome, ("editor", "source_repository"), "https://u:p@x.y/z"), change(rome, ("editor", "source_repository"), "http://x.y"), change(rome, ("editor", "hyperparameters"), {"layers": 1}), change(rome, ("changed_tensors",), []), change(rome, ("model", "architecture"), "Other"), change(rome, ("editor", "name"), "MEND")):
        with pytest.raises(E.EditorError):
            E.import_artifact(bad, "ROME")
    for key, value in (("algorithm", " "), ("sequential_edit", 1), ("return_orig_weights", 1)):
        with pytest.raises(E.EditorError):
            E.import_artifact(change(easy, ("editor", "hyperparameters", key), value), "EasyEdit")
    deep = cur = {}
    for _ in range(9):
        cur["a"] = cur = {}
    for bad in (deep, {"a": [0] * 5000}, {"a": "x" * 5000}, {"": 1}, {"a": float("inf")}):
        assert list(E.settings_issues(bad))


class State:
    def __init__(self, state_id, scores):
        self.state_id, self.scores, self.calls = state_id, list(scores), 0

    def score_target(self, prompt, target):
        self.calls += 1
        score = self.scores.pop(0) if len(self.scores) > 1 else self.scores[0]
        if isinstance(score, Exception):
            raise score
        return score


def test_editor_session():
    doc = D.editor_artifact()
    assert E.EditorSession(doc, State("s0", [1]), State("s1", [2])).score("p", "t") == (1, 2)
    session = E.EditorSession(doc, State("s0", [1, 3]), State("s1", [2]))
    with pytest.raises(E.BaselineChanged):
        session.score("p", "t")
    with pytest.raises(E.EditorError):
        session.score("p", "t")
    with pytest.raises(KeyError):
        E.EditorSession(doc, State("s0", [1]), State("s1", [KeyError("x")])).score("p", "t")
    with pytest.raises(E.BaselineChanged):
        E.EditorSession(doc, State("s0", [1, 9]), State("s1", [KeyError("x")])).score("p", "t")
    same = State("s0", [1])
    for a, b in ((same, same), (State("x", [1]), State("s1", [1])), (State("s0", [1]), State("x", [1]))):
        with pytest.raises(E.EditorError):
            E.EditorSession(doc, a, b)


def test_both_rule_sets_agree(spark):
    """Cases as documents and as typed rows break the same rules; only what concerns a single probe is checked in documents alone."""
    from pyspark.sql import functions as F

    from probeloom.contracts.documents import validate_documents
    from probeloom.operators import rules

    cases = spark.read.parquet("/root/testdata/sf0.01/audit_cases.parquet")
    text = F.to_json(F.struct("schema_version", "case_id", "description", "edit", "probes", "provenance"))
    found = validate_documents(cases.select("case_row", text.alias("payload")), "case", "case_row", "payload").collect()
    typed = rules.violations(cases, ["case_row"], rules.case_rules()).collect()
    # a field that is lacking is an issue of its parent in a document
    want = {(r.case_row, r.path.rsplit(".", 1)[0] if r.message == "is required" else r.path) for r in typed}
    assert {(r.case_row, r.path) for r in found if "[" not in r.path} == want and len(want) > 30
