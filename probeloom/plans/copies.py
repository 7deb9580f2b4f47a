"""Queries over two copies of the metric results and over the nested raw reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.operators.diff import diff_tables
from probeloom.operators.shred import flatten_reports, shred_leaves
from probeloom.sources.tables import table

FIELDS = {"aggregate": ("number", "aggregate"), "coverage_fraction": ("number", "coverage.fraction"), "status": ("text", "status")}


def p1_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Every key missing on a side and every differing field, with both values as text."""
    return diff_tables(
        table(spark, sf, "metric_results"), table(spark, sf, "metric_results_mirror"), ["report_id", "metric_id"], FIELDS,
        order_by="ingested_at", tolerance=1e-9, only_left="only_primary", only_right="only_mirror",
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_differences(spark, sf).select("report_id", "metric_id", "finding")


def p5_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_reports(table(spark, sf, "raw_reports"), "metric")


def p5_probes(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_reports(table(spark, sf, "raw_reports"), "probe")


def p5_citations(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_reports(table(spark, sf, "raw_reports"), "citation")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Probes and citations of every metric of every payload, with their place in the metric."""
    flat = flatten_reports(table(spark, sf, "raw_reports"), "probe", "citation")
    name = F.when(F.col("kind") == "probe", F.col("probe_id")).otherwise(F.col("title"))
    return flat.select("raw_id", "metric_id", F.col("kind").alias("child"), "child_pos", name.alias("child_name"))


def p5_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Every leaf of every payload with its repetition and definition level; numbers as such, all else as text."""
    leaves = shred_leaves(table(spark, sf, "raw_reports"))
    is_number = F.col("kind") == "number"
    leaves = leaves.withColumn("ordinals", F.array_join(F.transform("ordinals", lambda n: n.cast("string")), ","))
    return leaves.withColumn("number", F.when(is_number, F.col("value").try_cast("double"))).withColumn("value", F.when(~is_number, F.col("value")))


QUERIES = {f.__name__: f for f in (p1_found, p1_differences, p5_found, p5_metrics, p5_probes, p5_citations, p5_leaves)}

_LATEST = """
SELECT report_id, metric_id, status, aggregate, coverage.fraction AS fraction
FROM {t} QUALIFY row_number() OVER (PARTITION BY report_id, metric_id ORDER BY ingested_at DESC NULLS LAST) = 1
"""

_NUMBER = """(a.{c} IS NULL) <> (b.{c} IS NULL) OR (a.{c} IS NOT NULL AND b.{c} IS NOT NULL AND (isnan(a.{c}) <> isnan(b.{c})
  OR (NOT isnan(a.{c}) AND NOT isnan(b.{c}) AND a.{c} <> b.{c} AND abs(a.{c} - b.{c}) > 1e-9)))"""

_APART = """CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN (a.{c} IS NULL) <> (b.{c} IS NULL) WHEN isnan(a.{c}) OR isnan(b.{c}) THEN NOT (isnan(a.{c}) AND isnan(b.{c}))
  ELSE a.{c} <> b.{c} AND abs(a.{c} - b.{c}) > 1e-9 END"""

_DIFFERENCES = f"""
WITH a AS ({_LATEST.format(t="metric_results")}), b AS ({_LATEST.format(t="metric_results_mirror")}),
j AS (SELECT a.*, 1 AS l FROM a), k AS (SELECT b.*, 1 AS r FROM b),
pairs AS (SELECT a.report_id, a.metric_id, {_APART.format(c="aggregate")} AS da, {_APART.format(c="fraction")} AS df, a.status IS DISTINCT FROM b.status AS ds,
    a.aggregate AS la, b.aggregate AS ra, a.fraction AS lf, b.fraction AS rf, a.status AS ls, b.status AS rs
  FROM a JOIN b ON a.report_id IS NOT DISTINCT FROM b.report_id AND a.metric_id IS NOT DISTINCT FROM b.metric_id),
found AS (
  SELECT j.report_id, j.metric_id, 'only_primary' AS finding, NULL::DOUBLE AS left_number, NULL::DOUBLE AS right_number, NULL AS left_text, NULL AS right_text
    FROM j LEFT JOIN k ON j.report_id IS NOT DISTINCT FROM k.report_id AND j.metric_id IS NOT DISTINCT FROM k.metric_id WHERE k.r IS NULL
  UNION ALL SELECT k.report_id, k.metric_id, 'only_mirror', NULL, NULL, NULL, NULL FROM k LEFT JOIN j ON j.report_id IS NOT DISTINCT FROM k.report_id AND j.metric_id IS NOT DISTINCT FROM k.metric_id WHERE j.l IS NULL
  UNION ALL SELECT report_id, metric_id, 'aggregate', la, ra, NULL, NULL FROM pairs WHERE da
  UNION ALL SELECT report_id, metric_id, 'coverage_fraction', lf, rf, NULL, NULL FROM pairs WHERE df
  UNION ALL SELECT report_id, metric_id, 'status', NULL, NULL, ls, rs FROM pairs WHERE ds)
"""

_START = "ltrim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13))"
# payloads that are complete JSON, opened for as long as they are a text; the report in each; its metrics in whatever shape
_WHOLE = f"""
WITH RECURSIVE q AS (
  SELECT raw_id, {_START} AS t FROM raw_reports WHERE json_valid({_START})
  UNION ALL SELECT raw_id, json_extract_string(t, '$') FROM q WHERE json_type(t) = 'VARCHAR' AND json_valid(json_extract_string(t, '$'))
), whole AS (SELECT raw_id, t::JSON AS j FROM q WHERE json_type(t) <> 'VARCHAR')
"""
_METRICS = f"""{_WHOLE},
report AS (SELECT raw_id, CASE WHEN json_type(j, '$.report') = 'OBJECT' THEN json_extract(j, '$.report') ELSE j END AS j FROM whole WHERE json_type(j) = 'OBJECT'),
m AS (
  SELECT raw_id, j, e.key::BIGINT AS metric_pos, e.value AS m, e.value ->> '$.metric_id' AS metric_id FROM report, json_each(j, '$.metrics') e WHERE json_type(j, '$.metrics') = 'ARRAY'
  UNION ALL SELECT raw_id, j, 0, j -> '$.metrics', j ->> '$.metrics.metric_id' FROM report WHERE json_exists(j, '$.metrics.metric_id')
  UNION ALL SELECT raw_id, j, row_number() OVER (PARTITION BY raw_id ORDER BY e.id) - 1, e.value, coalesce(e.value ->> '$.metric_id', e.key) FROM report, json_each(j, '$.metrics') e
    WHERE json_type(j, '$.metrics') = 'OBJECT' AND NOT json_exists(j, '$.metrics.metric_id') AND json_type(e.value) = 'OBJECT'
)
"""
_CHILDREN = f"""{_METRICS},
g AS (SELECT raw_id, j, metric_pos, metric_id, k.child, k.name, m -> k.grp AS g FROM m, (VALUES ('probe', '$.probes', '$.probe_id'), ('citation', '$.citations', '$.title')) k(child, grp, name)),
c AS (
  SELECT raw_id, j, metric_pos, metric_id, child, name, x.at AS child_pos, x.value AS v FROM g, LATERAL (SELECT e.key::BIGINT AS at, e.value FROM json_each(g) e) x WHERE json_type(g) = 'ARRAY' AND json_type(x.value) = 'OBJECT'
  UNION ALL SELECT raw_id, j, metric_pos, metric_id, child, name, 0, g FROM g WHERE json_type(g) = 'OBJECT'
)
"""


def _texts(of: str, **paths: str) -> str:
    return ", ".join(f"{of} ->> '$.{p}' AS {n}" for n, p in paths.items())


def _numbers(of: str, **paths: str) -> str:
    return ", ".join(f"try_cast({of} ->> '$.{p}' AS DOUBLE) AS {n}" for n, p in paths.items())


_DELTAS = ("baseline_mean_log_probability", "edited_mean_log_probability", "signed_delta", "absolute_delta", "contribution", "mean_kl_divergence")
_STEPS = r"""regexp_extract_all(fullkey, '\."(?:[^"\\]|\\.)*"|\.[^."\[]+|\[\d+\]')"""

ORACLE = {
    "p5_found": f"{_CHILDREN} SELECT raw_id, metric_id, child, child_pos, json_extract_string(v, name) AS child_name FROM c",
    "p5_probes": f"""{_CHILDREN} SELECT raw_id, metric_pos, child_pos, metric_id, {_texts("j", report_id="report_id")}, {_texts("v", probe_id="probe_id", status="status", missing_reason="missing_reason")},
{_numbers("v", **{d: f"values.{d}" for d in _DELTAS})} FROM c WHERE child = 'probe'""",
    "p5_citations": f"""{_CHILDREN} SELECT raw_id, metric_pos, child_pos, metric_id, {_texts("j", report_id="report_id")}, {_texts("v", title="title", source="source", identifier="identifier")}
FROM c WHERE child = 'citation'""",
    "p5_metrics": f"""{_METRICS} SELECT raw_id, metric_pos, metric_id,
{_texts("j", report_id="report_id", generated_at="generated_at", run_id="manifest.run_id", adapter="manifest.editor.adapter", hyperparameters="manifest.editor.hyperparameters", seeds="manifest.seeds", failure="manifest.failure", case_id="audit_case.case_id")},
{_texts("m", direction="direction", unit="unit", reduction="reduction", warnings="warnings", threshold_operator="threshold.operator", threshold_passed="threshold.passed", status="status")},
{_numbers("m", threshold_value="threshold.value", aggregate="aggregate", coverage_fraction="coverage.fraction")},
{", ".join(f"trunc(try_cast(m ->> '$.coverage.{n}' AS DOUBLE))::BIGINT AS coverage_{n}" for n in ("total", "evaluated", "missing"))} FROM m WHERE json_type(m) = 'OBJECT'""",
    "p5_leaves": f"""{_WHOLE},
t AS (SELECT raw_id, t.id, {_STEPS} AS steps, regexp_extract_all(fullkey, '\\[(\\d+)\\]', 1)::BIGINT[] AS ordinals, t.type AS kind, t.value AS v
  FROM whole, json_tree(j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{{}}', '[]')),
u AS (SELECT raw_id, id, list_aggregate(list_transform(steps, lambda s: CASE WHEN s[1] = '[' THEN '[]' ELSE trim(s[2:], '"') END), 'string_agg', '.') AS path, ordinals,
  (len(steps) - (kind = 'NULL')::INT)::INT AS def, kind, v FROM t),
w AS (SELECT *, lag(ordinals) OVER (PARTITION BY raw_id, path ORDER BY id) AS before FROM u)
SELECT raw_id, path, array_to_string(ordinals, ',') AS ordinals, CASE WHEN before IS NULL THEN 0 ELSE coalesce(list_position(list_transform(list_zip(before, ordinals), lambda p: p[1] <> p[2]), true), 0) END::INT AS rep, def,
  CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE WHEN kind IN ('VARCHAR', 'BOOLEAN') THEN v ->> '$' END AS value, CASE WHEN kind NOT IN ('VARCHAR', 'BOOLEAN', 'NULL', 'OBJECT', 'ARRAY') THEN (v ->> '$')::DOUBLE END AS number
FROM w""",
    "p1_found": f"""
WITH a AS ({_LATEST.format(t="metric_results")}), b AS ({_LATEST.format(t="metric_results_mirror")}),
j AS (SELECT a.*, 1 AS l FROM a), k AS (SELECT b.*, 1 AS r FROM b),
pairs AS (SELECT a.report_id, a.metric_id, {_NUMBER.format(c="aggregate")} AS da, {_NUMBER.format(c="fraction")} AS df, a.status IS DISTINCT FROM b.status AS ds
  FROM a JOIN b ON a.report_id IS NOT DISTINCT FROM b.report_id AND a.metric_id IS NOT DISTINCT FROM b.metric_id)
SELECT j.report_id, j.metric_id, 'only_primary' AS finding FROM j LEFT JOIN k ON j.report_id IS NOT DISTINCT FROM k.report_id AND j.metric_id IS NOT DISTINCT FROM k.metric_id WHERE k.r IS NULL
UNION ALL SELECT k.report_id, k.metric_id, 'only_mirror' FROM k LEFT JOIN j ON j.report_id IS NOT DISTINCT FROM k.report_id AND j.metric_id IS NOT DISTINCT FROM k.metric_id WHERE j.l IS NULL
UNION ALL SELECT report_id, metric_id, 'aggregate' FROM pairs WHERE da
UNION ALL SELECT report_id, metric_id, 'coverage_fraction' FROM pairs WHERE df
UNION ALL SELECT report_id, metric_id, 'status' FROM pairs WHERE ds
""",
    "p1_differences": f"{_DIFFERENCES} SELECT report_id, metric_id, finding, left_number, right_number, left_text, right_text FROM found",
}
