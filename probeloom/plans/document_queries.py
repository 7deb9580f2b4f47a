"""The document contracts as queries: documents made from the tables, checked, and their issues counted by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.contracts.documents import validate_documents
from probeloom.functions import canonical as C
from probeloom.functions import numeric as N
from probeloom.functions import text as T
from probeloom.plans import audit as A
from probeloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_HEX = {c: c * 64 for c in "abcdef"}
_ID_SQL = "regexp_full_match({c}, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}')"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


def _issues(rows: DataFrame, kind: str, document: Column, nulls: bool = True) -> DataFrame:
    """``(id, path, issues)`` of the documents of rows with an ``id``; ``nulls``: null fields are written."""
    payload = F.to_json(document, {"ignoreNullFields": str(not nulls).lower()})
    found = validate_documents(rows.select("id", payload.alias("payload")), kind, "id", "payload")
    return found.groupBy("id", "path").agg(F.count(F.lit(1)).alias("issues"))


def _paths(source: str, rules: list[tuple[str, str]]) -> str:
    """The same count from predicates; a path may be given by several."""
    each = " UNION ALL ".join(f"SELECT id, {path if path.startswith(('concat', 'p.')) else repr(path)} AS path FROM {source} WHERE coalesce({broken}, false)" for path, broken in rules)
    return f"SELECT id, path, count(*) AS issues FROM ({each}) GROUP BY id, path"


def record(**fields: object) -> Column:
    """A struct of columns and constants."""
    return F.struct(*((v if isinstance(v, Column) else record(**v) if isinstance(v, dict) else F.lit(v)).alias(k) for k, v in fields.items()))


def _hash(digest: Column | str) -> dict:
    return {"algorithm": "sha256", "encoding": "raw-bytes", "digest": digest, "size_bytes": 10}


def _artifact(name: Column | str, kind: str, digest: Column | str) -> dict:
    return {"artifact_id": name, "kind": kind, "content_hash": _hash(digest)}


def _run(name: Column | str) -> dict:
    """What a manifest and a snapshot say about the run."""
    return {
        "engine": {"version": "1", "commit": "a" * 40, "dirty": False},
        "environment": {"python_version": "3.13", "package_versions": {"x": "1"}, "device": "cpu", "dtype": "float32", "quantization": {"method": "none", "configuration": {"bits": 8}}},
        "editor": {"adapter": name, "revision": "1", "hyperparameters": {"rank": 1}}, "generation": {"temperature": 0}, "seeds": {"python": 1},
    }


_NAMES = {"model_id": "m", "model_revision": "r", "tokenizer_id": "t", "tokenizer_revision": "r"}


def _manifest(run_id: Column | str, status: Column | str, started: Column | str, ended: Column, failure: Column, edited_id: Column | str, edited_digest: Column | str, case: dict) -> dict:
    return {
        "schema_version": "1.0.0", "run_id": run_id, "status": status, "timestamps": {"started_at": started, "ended_at": ended}, **_run("made-up"),
        "model": {**_NAMES, "baseline": _artifact("base", "model-checkpoint", _HEX["a"]), "edited": _artifact(edited_id, "model-delta", edited_digest)},
        "audit_case": {"schema_version": "1.0.0", "artifact": case}, "failure": failure,
    }


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "metric_results").withColumn("id", F.concat_ws("|", "report_id", "metric_id"))


_RESULTS_SQL = "WITH r AS (SELECT *, concat_ws('|', report_id, metric_id) AS id FROM metric_results)"


@query(f"""{_RESULTS_SQL}, m AS (SELECT *, CASE status WHEN 'complete' THEN 'completed' ELSE coalesce(status, 'running') END AS state, coverage.missing > 0 AS failure FROM r)
{_paths("m", [
    ("$.run_id", "NOT " + _ID_SQL.format(c="report_id")), ("$.status", "state NOT IN ('running', 'completed', 'failed', 'incomplete')"), ("$.timestamps.started_at", "generated_at IS NULL"),
    ("$.timestamps.ended_at", "ingested_at < generated_at"), ("$.timestamps.ended_at", "state = 'running' AND ingested_at IS NOT NULL"), ("$.timestamps.ended_at", "state IN ('completed', 'failed', 'incomplete') AND ingested_at IS NULL"),
    ("$.failure", "state IN ('running', 'completed') AND failure"), ("$.failure", "state IN ('failed', 'incomplete') AND NOT coalesce(failure, false)"),
    ("$.model.edited.artifact_id", "metric_id LIKE 'control%'"), ("$.model.edited.content_hash.digest", "metric_id LIKE 'locality%'"),
])}""")
def q_manifest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Run manifests: identity, lifecycle, times and failure, states that must differ."""
    status = F.when(F.col("status") == "complete", "completed").otherwise(F.coalesce("status", F.lit("running")))
    failure = F.when(F.col("coverage.missing") > 0, record(stage="score", error_type="Missing", message="probes are missing"))
    doc = _manifest(
        F.col("report_id"), status, T.utc_text(F.col("generated_at")), T.utc_text(F.col("ingested_at")), failure, F.when(F.col("metric_id").startswith("control"), "base").otherwise("edit"),
        F.when(F.col("metric_id").startswith("locality"), _HEX["a"]).otherwise(_HEX["b"]), _artifact("case-1", "audit-case", _HEX["c"]),
    )
    return _issues(_results(spark, sf), "manifest", record(**doc))


def _metric(status: Column | str, aggregate: Column | float, coverage: dict | Column, probes: Column, warnings: Column, threshold: Column | None = None) -> dict:
    doc = {
        "schema_version": "1.0.0", "metric_id": F.coalesce("metric_id", F.lit("m")), "status": status, "direction": "higher-is-better", "unit": "nats", "aggregate": aggregate, "reduction": "mean", "coverage": coverage,
        "probes": probes, "warnings": warnings, "citations": F.array(record(title="T", source="S")),
    }
    return doc if threshold is None else {**doc, "threshold": threshold}


_HOLDS = "CASE threshold.operator WHEN 'greater-than' THEN aggregate > threshold.value WHEN 'greater-than-or-equal' THEN aggregate >= threshold.value WHEN 'less-than' THEN aggregate < threshold.value WHEN 'less-than-or-equal' THEN aggregate <= threshold.value END"


@query(f"""{_RESULTS_SQL}, m AS (SELECT *, coverage.total AS n, coverage.evaluated AS k, coverage.evaluated / nullif(coverage.total, 0) AS share, warnings[1:1] AS w FROM r WHERE coverage.total IS NOT NULL AND coverage.evaluated IS NOT NULL)
{_paths("m", [
    ("$.status", "status IS NULL OR status NOT IN ('complete', 'incomplete', 'failed')"), ("$.status", "status = 'complete' AND k < n"), ("$.status", "status = 'complete' AND n = 0"), ("$.status", "status = 'incomplete' AND k = n"),
    ("$.aggregate", "aggregate IS NOT NULL AND NOT isfinite(aggregate)"), ("$.aggregate", "status = 'failed' AND aggregate IS NOT NULL"), ("$.aggregate", "k = 0 AND aggregate IS NOT NULL"),
    ("$.aggregate", "k > 0 AND status IN ('complete', 'incomplete') AND aggregate IS NULL"), ("$.coverage.missing", "coverage.missing <> n - k"), ("$.coverage.missing", "coverage.missing IS NULL"),
    ("$.coverage.fraction", "coverage.fraction IS NULL OR NOT isfinite(coverage.fraction) OR coverage.fraction < 0 OR coverage.fraction > 1"),
    ("$.coverage.fraction", "isfinite(coverage.fraction) AND abs(coverage.fraction - coalesce(share, 0.0)) > 1e-12"), ("$.probes[0].missing_reason", "n > 0 AND n % 3 = 0"),
    ("$.warnings", "warnings IS NULL"), ("$.warnings", "status IN ('incomplete', 'failed') AND len(w) = 0"), ("$.threshold.operator", "threshold IS NOT NULL AND (threshold.operator IS NULL OR threshold.operator NOT IN ('greater-than', 'greater-than-or-equal', 'less-than', 'less-than-or-equal'))"),
    ("$.threshold.value", "threshold IS NOT NULL AND (threshold.value IS NULL OR NOT isfinite(threshold.value))"), ("$.threshold.passed", "threshold IS NOT NULL AND threshold.passed IS NULL"),
    ("$.threshold.passed", f"isfinite(aggregate) AND isfinite(threshold.value) AND threshold.passed <> {_HOLDS}"),
])}""")
def q_metric_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Metric results with one entry per probe: status, coverage recounted, aggregate, threshold, reasons."""
    n, k = F.col("coverage.total"), F.col("coverage.evaluated")
    rows = _results(spark, sf).where(n.isNotNull() & k.isNotNull())

    def probe(i: Column) -> Column:
        there = i < k
        odd = (i == 0) & (n % 3 == 0)
        return F.struct(
            F.concat(F.lit("p"), i.cast("string")).alias("probe_id"), F.when(there, "evaluated").otherwise("missing").alias("status"), F.struct(i.alias("n")).alias("values"),
            F.when(there != odd, F.lit(None).cast("string")).otherwise(F.lit("not run")).alias("missing_reason"),
        )

    probes = F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>")), probe)
    doc = _metric(F.col("status"), F.col("aggregate"), F.col("coverage"), probes, F.slice("warnings", 1, 1), F.col("threshold"))
    return _issues(rows, "metric", record(**doc))


@query(f"""{_RESULTS_SQL}, m AS (SELECT *, CASE status WHEN 'complete' THEN 'completed' ELSE status END AS state FROM r WHERE generated_at IS NOT NULL AND ingested_at IS NOT NULL AND case_id IS NOT NULL AND {_ID_SQL.format(c="case_id")})
{_paths("m", [
    ("$.status", "state IS NULL OR state NOT IN ('completed', 'incomplete', 'failed')"), ("$.status", "state <> 'completed'"), ("$.warnings", "state IN ('incomplete', 'failed')"), ("$.generated_at", "ingested_at < generated_at"),
    ("$.audit_case.case_id", "metric_id LIKE 'control%'"), ("$.audit_case.artifact.artifact_id", "metric_id LIKE 'control%'"), ("$.audit_case.artifact.content_hash.digest", "metric_id LIKE 'generality%'"),
    ("$.metrics[1].metric_id", "metric_id LIKE 'efficacy%'"),
])}""")
def q_report_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Audit reports: agreement with the manifest, with the case and within the metrics."""
    rows = _results(spark, sf).where(F.col("generated_at").isNotNull() & F.col("ingested_at").isNotNull() & T.is_identifier(F.col("case_id")))
    control = F.col("metric_id").startswith("control")
    probe = F.array(record(probe_id="p", status="evaluated", values={"n": 1}, missing_reason=F.lit(None).cast("string")))
    none = F.array().cast("array<string>")
    one = record(**_metric("complete", 0.5, {"total": 1, "evaluated": 1, "missing": 0, "fraction": 1.0}, probe, none))
    manifest = _manifest("run-1", "completed", "2000-01-01T00:00:00Z", T.utc_text(F.col("generated_at")), F.lit(None).cast("string"), "edit", _HEX["b"], _artifact(F.col("case_id"), "audit-case", _HEX["c"]))
    artifact = _artifact(F.when(control, "other").otherwise(F.col("case_id")), "audit-case", F.when(F.col("metric_id").startswith("generality"), _HEX["d"]).otherwise(_HEX["c"]))
    doc = {
        "schema_version": "1.0.0", "report_id": "report-1", "status": F.when(F.col("status") == "complete", "completed").otherwise(F.col("status")), "generated_at": T.utc_text(F.col("ingested_at")), "manifest": manifest,
        "audit_case": {"case_id": F.col("case_id"), "schema_version": "1.0.0", "artifact": artifact, "dataset": {"name": "made-up", "license": "CC0-1.0", "source": "urn:made-up"}},
        "metrics": F.when(F.col("metric_id").startswith("efficacy"), F.array(one, one)).otherwise(F.array(one)), "structural_evidence": none, "limitations": F.array(F.lit("made up")), "warnings": none,
    }
    return _issues(rows, "report", record(**doc))


_SCORES_SQL = """
WITH p AS (SELECT report_id AS id, metric_id || '.' || probe_id AS probe, baseline_mean_log_probability AS score, row_number() OVER (PARTITION BY report_id ORDER BY evidence_id, ingested_at, metric_id, probe_id) - 1 AS i
  FROM probe_evidence WHERE report_id IS NOT NULL AND metric_id NOT LIKE 'control%' AND evidence_id IS NOT NULL AND ingested_at IS NOT NULL AND probe_id IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY id, probe ORDER BY i) AS again, concat('$.measurements.target_scores[', i, ']') AS place FROM p)
"""


@query(_SCORES_SQL + _paths("d", [
    ("concat(place, '.probe_id')", "NOT " + _ID_SQL.format(c="probe")), ("concat(place, '.probe_id')", "again > 1"), ("concat(place, '.mean_target_log_probability')", "score IS NULL OR NOT isfinite(score) OR score > 0"),
]))
def q_snapshot_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of a report's baseline scores: redelivered probes, missing and unfit scores."""
    rows = table(spark, sf, "probe_evidence").where("report_id IS NOT NULL AND metric_id NOT LIKE 'control%' AND evidence_id IS NOT NULL AND ingested_at IS NOT NULL AND probe_id IS NOT NULL")
    score = F.struct("evidence_id", "ingested_at", "metric_id", "probe_id", F.col("baseline_mean_log_probability").alias("score"))
    rows = rows.groupBy(F.col("report_id").alias("id")).agg(F.array_sort(F.collect_list(score)).alias("scores"))
    scores = F.transform("scores", lambda s: F.struct(F.concat(s["metric_id"], F.lit("."), s["probe_id"]).alias("probe_id"), s["score"].alias("mean_target_log_probability")))
    doc = {
        "schema_version": "1.0.0", "snapshot_id": "snap", "state": "baseline", **_run("made-up"), "model": {**_NAMES, "artifact": _artifact("base", "model-checkpoint", _HEX["a"])},
        "measurements": {"target_scores": scores, "control_logits": F.array().cast("array<string>"), "control_temperature": 1.0},
    }
    return _issues(rows, "snapshot", record(**doc))


_SIDE_SQL = "SELECT report_id, metric_id, max(aggregate) FILTER (isfinite(aggregate)) AS v FROM {t} WHERE report_id IS NOT NULL AND metric_id IS NOT NULL GROUP BY 1, 2"


@query(f"""
WITH a AS ({_SIDE_SQL.format(t="metric_results")}), b AS ({_SIDE_SQL.format(t="metric_results_mirror")}),
j AS (SELECT concat_ws('|', report_id, metric_id) AS id, metric_id, a.v AS a, b.v AS b, a.l, b.r FROM (SELECT *, 1 AS l FROM a) a FULL JOIN (SELECT *, 1 AS r FROM b) b USING (report_id, metric_id))
{_paths("j", [
    ("$.metrics[0].presence", "l IS NULL OR r IS NULL"), ("$.metrics[0].aggregate_delta_b_minus_a", "a IS NULL OR b IS NULL"), ("$.metrics[0].aggregate_delta_b_minus_a", "a IS NOT NULL AND b IS NOT NULL AND metric_id LIKE 'locality%'"),
])}""")
def q_comparison_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Report comparisons that state every metric as present on both sides, with differences of which some are wrong."""
    def side(name: str, c: str) -> DataFrame:
        rows = table(spark, sf, name).where("report_id IS NOT NULL AND metric_id IS NOT NULL")
        return rows.groupBy("report_id", "metric_id").agg(F.max(F.when(N.finite(F.col("aggregate")), F.col("aggregate"))).alias(c), F.lit(True).alias(f"in_{c}"))

    rows = side("metric_results", "a").join(side("metric_results_mirror", "b"), ["report_id", "metric_id"], "full").withColumn("id", F.concat_ws("|", "report_id", "metric_id"))
    shown = lambda c: F.when(F.col(f"in_{c}"), record(status="complete", aggregate=F.col(c), coverage=1.0))
    delta = F.col("b") - F.col("a") + F.when(F.col("metric_id").startswith("locality"), 1.0).otherwise(0.0)
    reference = {"report_id": "r", "content_hash": {**_hash(_HEX["a"]), "encoding": C.CANONICAL}}
    metric = record(
        metric_id="m", presence="both", comparable=True, unit="nats", direction="higher-is-better", reduction="mean", report_a=shown("a"), report_b=shown("b"), aggregate_delta_b_minus_a=F.coalesce(delta, F.lit(0.5)), warnings=F.array().cast("array<string>")
    )
    doc = {
        "schema_version": "1.0.0", "report_a": reference, "report_b": reference, "comparability": {"audit_case_sha256": _HEX["a"], "baseline_sha256": _HEX["b"], **_NAMES, "device": "cpu", "dtype": "float32"},
        "metrics": F.array(metric), "warnings": F.array().cast("array<string>"),
    }
    return _issues(rows, "comparison", record(**doc))


@query("WITH c AS (SELECT case_row AS id, intake_wave AS w, case_row % 7 AS m FROM audit_cases)" + _paths("c", [
    ("$.changed_tensors[1].name", "w = 2"), ("$.changed_tensors[0].edited_sha256", "w = 3"), ("$.model.edited.state_id", "w = 4"), ("$.model.edited.artifact_sha256", "w = 5"), ("$.editor.revision", "m = 1"),
    ("$.changed_tensors[0].shape[1]", "m = 2"), ("$.changed_tensors[0].shape", "m = 3"), ("$.artifact_id", "m = 4"),
]))
def q_editor_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Editor artifacts: names and hashes of changed tensors, shapes, states."""
    wave, m = F.col("intake_wave"), F.col("case_row") % 7
    rows = table(spark, sf, "audit_cases").withColumn("id", F.col("case_row"))
    shape = F.when(m == 2, F.array(F.lit(8), F.lit(0))).when(m == 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(8), F.lit(8)))
    tensor = lambda name, shape, edited: record(name=name, shape=shape, dtype="float32", device="cpu", baseline_sha256=_HEX["a"], edited_sha256=edited)
    doc = {
        "schema_version": "1.0.0", "artifact_id": F.when(m == 4, "-bad").otherwise("artifact"), "artifact_kind": "external-export",
        "editor": {"name": "ROME", "revision": F.when(m == 1, "abc").otherwise("a" * 40), "source_repository": "https://made-up.example/x", "hyperparameters": {"layers": 1}},
        "model": {"architecture": "Made-Up", "baseline": {"state_id": "s1", "artifact_sha256": _HEX["a"]}, "edited": {"state_id": F.when(wave == 4, "s1").otherwise("s2"), "artifact_sha256": F.when(wave == 5, _HEX["a"]).otherwise(_HEX["b"])}},
        "changed_tensors": F.array(tensor("w.0", shape, F.when(wave == 3, _HEX["a"]).otherwise(_HEX["b"])), tensor(F.when(wave == 2, "w.0").otherwise("w.1"), F.array(F.lit(4), F.lit(4)), F.lit(_HEX["c"]))),
    }
    return _issues(rows, "editor", record(**doc))


@query("""
WITH c AS (SELECT case_row AS id, * FROM audit_cases),
p AS (SELECT id, unnest(probes.exact) AS x, unnest(range(len(probes.exact))) AS i FROM c),
d AS (SELECT id, x.probe_id AS probe_id, x.prompt AS prompt, concat('$.probes.relation_specificity[', i, ']') AS place, row_number() OVER (PARTITION BY id, x.probe_id ORDER BY i) AS again FROM p)
SELECT id, path, sum(issues)::BIGINT AS issues FROM (""" + _paths("c", [
    ("$.edit", "edit.subject IS NULL"), ("$.edit", "edit.target_new IS NULL"), ("$.edit.target_original", "edit.target_original = edit.target_new"), ("$.edit.subject", "trim(edit.subject) = ''"),
    ("$.case_id", "NOT " + _ID_SQL.format(c="case_id")), ("$", "case_id IS NULL"), ("$.probes", "len(coalesce(probes.exact, [])) = 0"), ("$.provenance.upstream_case_id", "intake_wave % 2 = 0"),
]) + " UNION ALL " + _paths("d", [
    ("concat(place, '')", "probe_id IS NULL"), ("concat(place, '')", "prompt IS NULL"), ("concat(place, '.probe_id')", "NOT " + _ID_SQL.format(c="probe_id")), ("concat(place, '.probe_id')", "again > 1 AND probe_id IS NOT NULL"), ("concat(place, '.prompt')", "trim(prompt) = ''"),
]) + ") GROUP BY id, path")
def q_ripple_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ripple cases made of the audit cases: targets, identifiers over the groups, origin."""
    rows = table(spark, sf, "audit_cases").withColumn("id", F.col("case_row"))
    probe = lambda p: F.struct(p["probe_id"].alias("probe_id"), p["prompt"].alias("prompt"), F.lit("edited-target").alias("expectation"), F.array(F.lit("yes")).alias("expected_answers"))
    none = F.array().cast("array<string>")
    groups = {g: none for g in ("logical_generalization", "subject_aliasing", "compositionality_i", "compositionality_ii", "forgetfulness")}
    doc = {
        "schema_version": "1.0.0", "case_id": F.col("case_id"), "artifact_kind": F.when(F.col("intake_wave") % 2 == 0, "external-benchmark-case").otherwise("synthetic-contract-fixture"),
        "edit": {"subject": F.col("edit.subject"), "prompt": "p", "target_new": F.col("edit.target_new"), "target_original": F.col("edit.target_original")},
        "provenance": {"dataset_name": "n", "dataset_revision": "r", "dataset_license": "l", "source_url": "https://made-up.example/x", "source_revision": "a" * 40},
        "probes": {"relation_specificity": F.transform(F.coalesce(F.col("probes.exact"), F.array()), probe), **groups},
    }
    return _issues(rows, "ripple", record(**doc), nulls=False)


@query("""
WITH t AS (SELECT raw_id, payload FROM raw_reports)
SELECT raw_id, CASE WHEN json_valid(payload) THEN 'contract' ELSE 'read' END AS phase FROM t
""")
def q_strict_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a payload can be read as strict JSON at all (none is a whole report of the contract)."""
    rows = table(spark, sf, "raw_reports").select(F.col("raw_id").cast("bigint").alias("id"), "payload")
    return validate_documents(rows, "report", "id", "payload").select(F.col("id").alias("raw_id"), "phase").distinct()


_CANONICAL_SQL = """
WITH k AS (SELECT case_row, list_filter([
  CASE WHEN provenance.citation IS NOT NULL THEN '"citation":' || to_json(provenance.citation) END, CASE WHEN provenance.dataset_license IS NOT NULL THEN '"dataset_license":' || to_json(provenance.dataset_license) END,
  CASE WHEN provenance.dataset_name IS NOT NULL THEN '"dataset_name":' || to_json(provenance.dataset_name) END, CASE WHEN provenance.dataset_version IS NOT NULL THEN '"dataset_version":' || to_json(provenance.dataset_version) END,
  CASE WHEN provenance.record_id IS NOT NULL THEN '"record_id":' || to_json(provenance.record_id) END, CASE WHEN provenance.source IS NOT NULL THEN '"source":' || to_json(provenance.source) END], lambda x: x IS NOT NULL) AS f,
  to_json(case_id) AS c, case_id IS NULL AS no_case FROM audit_cases),
t AS (SELECT case_row, '{' || CASE WHEN no_case THEN '' ELSE '"case_id":' || c || ',' END || '"provenance":{' || array_to_string(f, ',') || '},"wave":1}' AS canonical FROM k)
"""


@query(_CANONICAL_SQL + "SELECT case_row, canonical, sha256(canonical) AS digest, octet_length(encode(canonical))::BIGINT AS size_bytes FROM t")
def q_canonical_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical form, digest and size of documents whose keys come in another order."""
    rows = table(spark, sf, "audit_cases")
    doc = F.to_json(F.struct(F.lit(1).alias("wave"), F.struct(*(F.col(f"provenance.{n}").alias(n) for n in ("source", "record_id", "dataset_version", "dataset_name", "dataset_license", "citation"))).alias("provenance"), F.col("case_id").alias("case_id")))
    return C.with_identity(rows.select("case_row", doc.alias("payload")), "payload").drop("payload")


@query(_CANONICAL_SQL + """, d AS (SELECT case_row, sha256(canonical) AS a, octet_length(encode(canonical)) AS n, sha256('b' || case_row) AS b, sha256('e' || case_row) AS e FROM t),
w AS (SELECT case_row, '{"audit_case":{"algorithm":"sha256","digest":"' || a || '","encoding":"canonical-json-v1","size_bytes":' || n || '},"baseline_snapshot":"' || b || '","edited_snapshot":"' || e || '"}' AS whole FROM d)
SELECT case_row, 'run-' || substr(sha256(whole), 1, 24) AS run_id, 'report-' || substr(sha256(whole), 1, 24) AS report_id FROM w""")
def q_run_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Identity of a run from the identities of its three inputs, and of its report."""
    known = q_canonical_identity(spark, sf)
    side = lambda c: F.sha2(F.concat(F.lit(c), F.col("case_row").cast("string")), 256)
    run = C.run_id_column(F.col("digest"), F.col("size_bytes"), side("b"), side("e"))
    return known.select("case_row", run.alias("run_id"), C.report_id_column(run).alias("report_id"))


_GROUP = "CASE WHEN metric_id LIKE 'efficacy%' THEN 'exact' WHEN metric_id LIKE 'generality%' THEN 'paraphrase' WHEN metric_id LIKE 'locality%' THEN 'locality' WHEN metric_id LIKE 'portability%' THEN 'portability' END"
_PAIRS_SQL = f"""
WITH p AS (SELECT report_id AS audit_id, {_GROUP} AS grp, metric_id || '.' || probe_id AS probe_id, max(baseline_mean_log_probability) AS b, max(edited_mean_log_probability) AS e FROM probe_evidence
  WHERE report_id IS NOT NULL AND {_GROUP} IS NOT NULL AND probe_id IS NOT NULL AND isfinite(baseline_mean_log_probability) AND isfinite(edited_mean_log_probability) GROUP BY 1, 2, 3)
"""


def _audits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases and the two snapshots of every report, as JSON documents."""
    rows = table(spark, sf, "probe_evidence").withColumn("grp", F.expr(_GROUP))
    rows = rows.where(F.col("report_id").isNotNull() & F.col("grp").isNotNull() & F.col("probe_id").isNotNull() & N.finite(F.col("baseline_mean_log_probability")) & N.finite(F.col("edited_mean_log_probability")))
    rows = rows.groupBy(F.col("report_id").alias("audit_id"), "grp", F.concat("metric_id", F.lit("."), "probe_id").alias("probe_id")).agg(F.max("baseline_mean_log_probability").alias("b"), F.max("edited_mean_log_probability").alias("e"))
    group = lambda g: F.array_sort(F.collect_list(F.when(F.col("grp") == g, F.struct("probe_id", F.lit("prompt").alias("prompt"))))).alias(g)
    side = lambda c: F.collect_list(F.struct("probe_id", F.col(c).alias("mean_target_log_probability")))
    whole = rows.groupBy("audit_id").agg(*(group(g) for g in ("exact", "paraphrase", "locality", "portability")), side("b").alias("b"), side("e").alias("e"))
    cases = whole.select("audit_id", F.to_json(F.struct(F.struct("exact", "paraphrase", "locality", "portability", F.array().cast("array<string>").alias("control")).alias("probes"))).alias("payload"))
    snapshot = lambda c: whole.select("audit_id", F.to_json(F.struct(F.struct(F.col(c).alias("target_scores")).alias("measurements"))).alias("payload"))
    return cases, snapshot("b"), snapshot("e")


@query(_PAIRS_SQL + "SELECT audit_id, grp, probe_id, round(e - b, 6) AS signed_delta, round(CASE WHEN grp = 'locality' THEN abs(e - b) ELSE e - b END, 6) AS contribution FROM p")
def q_audit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every probe of every case joined with its scores in both snapshots."""
    return A.paired_scores(*_audits(spark, sf)).select("audit_id", "grp", "probe_id", F.round("signed_delta", 6).alias("signed_delta"), F.round("contribution", 6).alias("contribution"))


@query(_PAIRS_SQL + "SELECT audit_id, grp, round(avg(CASE WHEN grp = 'locality' THEN abs(e - b) ELSE e - b END), 10) AS aggregate, count(*) AS evaluated FROM p GROUP BY 1, 2")
def q_audit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of many audits at once, from their documents."""
    return A.metric_table(*_audits(spark, sf)).withColumn("aggregate", F.round("aggregate", 10))
