"""The reference operators as queries over the test tables, with their SQL equivalents.

Tables of the audit domain are used as they are; vectors stand for logits and weights, lines of
orders for traced modules, events for runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.functions import numeric as N
from probeloom.functions import text as T
from probeloom.operators import metrics as M
from probeloom.operators import rules as R
from probeloom.operators import spans as S
from probeloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


def _score(c: str) -> Column:
    """Scores have six decimals; as decimals they are subtracted and summed exactly."""
    return F.when(N.finite(F.col(c)), F.col(c)).cast("decimal(18,6)")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence of every probe, redelivered rows once."""
    rows = table(spark, sf, "probe_evidence").select("evidence_id", "case_id", "report_id", "metric_id", "probe_id", _score("baseline_mean_log_probability").alias("b"), _score("edited_mean_log_probability").alias("e")).distinct()
    return M.paired_evidence(rows, "b", "e", F.col("metric_id").startswith("locality"))


_EVIDENCE_SQL = """
WITH p AS (SELECT DISTINCT evidence_id, case_id, report_id, metric_id, probe_id,
  CASE WHEN isfinite(baseline_mean_log_probability) THEN baseline_mean_log_probability::DECIMAL(18,6) END AS b,
  CASE WHEN isfinite(edited_mean_log_probability) THEN edited_mean_log_probability::DECIMAL(18,6) END AS e FROM probe_evidence),
ev AS (SELECT *, e - b AS d, CASE WHEN metric_id LIKE 'locality%' THEN abs(e - b) ELSE e - b END AS c FROM p)
"""
_REDUCE_SQL = _EVIDENCE_SQL + """
SELECT {by}, count(*) AS total, count(c) AS evaluated, sum(c)::DOUBLE / nullif(count(c), 0) AS aggregate, count(*) - count(c) AS missing, count(c) / count(*) AS fraction,
  CASE WHEN count(c) = count(*) THEN NULL WHEN count(c) = 0 THEN 'aggregate unavailable: evaluated 0 of ' || count(*) || ' probes because every pair is incomplete'
  ELSE 'partial coverage: evaluated ' || count(c) || ' of ' || count(*) || ' probes; aggregate excludes ' || (count(*) - count(c)) || ' missing probes' END AS warning
FROM ev {where} GROUP BY {by}
"""


def _paired(metric: M.PairedMetric):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return M.reduce_paired(_evidence(spark, sf).where(F.col("metric_id") == metric.metric_id), ["case_id"])

    run.__doc__ = f"{metric.metric_id} of every case."
    return run


for _metric in M.PAIRED:
    _name = f"q_paired_{_metric.metric_id.split('.')[0]}"
    query(_REDUCE_SQL.format(by="case_id", where=f"WHERE metric_id = '{_metric.metric_id}'"), _name)(_paired(_metric))


@query(_REDUCE_SQL.format(by="case_id, metric_id", where=""))
def q_paired_all(spark: SparkSession, sf: str) -> DataFrame:
    """All paired metrics of all cases in one pass."""
    return M.reduce_paired(_evidence(spark, sf), ["case_id", "metric_id"])


@query(_EVIDENCE_SQL + "SELECT evidence_id, (e IS NOT NULL AND b IS NOT NULL) AS complete, d::DOUBLE AS signed_delta, abs(d)::DOUBLE AS absolute_delta, c::DOUBLE AS contribution FROM ev")
def q_probe_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select("evidence_id", "complete", *(F.col(c).cast("double").alias(c) for c in ("signed_delta", "absolute_delta", "contribution")))


@query(_REDUCE_SQL.format(by="report_id, metric_id", where=""))
def q_coverage_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return M.reduce_paired(_evidence(spark, sf), ["report_id", "metric_id"])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 10.0).alias("z"))


_LSE = "list_max({z}) + ln(list_sum(list_transform({z}, lambda x: exp(x - list_max({z})))))"
_TOKENS_SQL = f"WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 10.0) AS z FROM embeddings), t AS (SELECT vec_id, vec_id // 4 AS sequence_id, z[label + 1] - ({_LSE.format(z='z')}) AS lp FROM v) "


@query(_TOKENS_SQL + "SELECT vec_id, round(lp, 6) AS log_probability FROM t")
def q_token_logprob(spark: SparkSession, sf: str) -> DataFrame:
    return M.token_log_probabilities(_vectors(spark, sf), "z", "label").select("vec_id", F.round("log_probability", 6).alias("log_probability"))


@query(_TOKENS_SQL + "SELECT sequence_id, round(sum(lp), 6) AS sum_log_probability, round(avg(lp), 6) AS mean_log_probability, count(*) AS tokens FROM t GROUP BY 1")
def q_sequence_logprob(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).withColumn("sequence_id", F.expr("vec_id div 4"))
    out = M.sequence_log_probability(rows, ["sequence_id"], "z", "label")
    return out.select("sequence_id", F.round("sum_log_probability", 6).alias("sum_log_probability"), F.round("mean_log_probability", 6).alias("mean_log_probability"), "tokens")


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    # one shuffle on the probe serves the pairing and the mean over its positions
    v = _vectors(spark, sf).withColumn("probe_id", F.expr("vec_id div 8")).withColumn("position", F.expr("(vec_id % 8) div 2")).repartition("probe_id")
    pairs = v.groupBy("probe_id", "position").agg(F.first(F.when(F.col("vec_id") % 2 == 0, F.col("z")), True).alias("b"), F.first(F.when(F.col("vec_id") % 2 == 1, F.col("z")), True).alias("e"))
    return M.position_divergence(pairs, "b", "e", 0.5).drop("b", "e")


_KL_SQL = f"""
WITH v AS (SELECT vec_id, vec_id // 8 AS probe_id, (vec_id % 8) // 2 AS position, list_transform(embedding, lambda x: x::DOUBLE * 10.0 / 0.5) AS z FROM embeddings),
l AS (SELECT vec_id, probe_id, position, list_transform(z, lambda x: x - m) AS lp FROM (SELECT *, {_LSE.format(z='z')} AS m FROM v)),
k AS (SELECT a.probe_id, a.position, greatest(0.0, list_sum(list_transform(list_zip(a.lp, b.lp), lambda p: exp(p[1]) * (p[1] - p[2])))) AS kl
  FROM (SELECT * FROM l WHERE vec_id % 2 = 0) a FULL JOIN (SELECT * FROM l WHERE vec_id % 2 = 1) b USING (probe_id, position)),
q AS (SELECT probe_id, count(*) AS positions, CASE WHEN count(kl) = count(*) THEN avg(kl) END AS mean_kl, CASE WHEN count(kl) = count(*) THEN count(*) ELSE 0 END AS evaluated_positions FROM k GROUP BY 1)
"""


@query(_KL_SQL + "SELECT probe_id, positions, round(mean_kl, 6) AS mean_kl, evaluated_positions FROM q")
def q_control_kl(spark: SparkSession, sf: str) -> DataFrame:
    return M.probe_divergence(_positions(spark, sf), ["probe_id"]).withColumn("mean_kl", F.round("mean_kl", 6)).withColumn("evaluated_positions", F.col("evaluated_positions").cast("bigint"))


@query(_KL_SQL + "SELECT count(*) AS total, count(mean_kl) AS evaluated, round(avg(mean_kl), 6) AS aggregate, sum(positions)::BIGINT AS total_positions, sum(evaluated_positions)::BIGINT AS evaluated_positions, count(mean_kl) / count(*) AS fraction FROM q")
def q_control_kl_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return M.reduce_divergence(M.probe_divergence(_positions(spark, sf), ["probe_id"])).withColumn("aggregate", F.round("aggregate", 6)).drop("warning")


def _tensors(spark: SparkSession, sf: str, iterations: int | None = None) -> DataFrame:
    """Sixteen vectors make a tensor: eight rows before and eight after; an incomplete one is missing."""
    v = _vectors(spark, sf).withColumn("name", F.expr("vec_id div 16")).withColumn("row", F.expr("vec_id % 16"))
    inventory = table(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("name")).distinct()
    side = lambda low: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("row").between(low, low + 7), F.struct("row", "z")))), lambda r: r["z"]))
    pairs = v.groupBy("name").agg(F.count(F.lit(1)).alias("n"), side(0).alias("b"), side(8).alias("e")).where(F.col("n") == 16).drop("n")
    width = None if iterations is None else "width"
    return M.tensor_differences(inventory.withColumn("width", F.lit(64)), pairs, "name", "b", "e", columns=width, iterations=iterations).drop("width")


_TENSOR_SQL = """
WITH v AS (SELECT vec_id // 16 AS name, vec_id % 16 AS r, list_transform(embedding, lambda x: x::DOUBLE * 10.0) AS z FROM embeddings),
p AS (SELECT name, flatten(list(z ORDER BY r) FILTER (r < 8)) AS b, flatten(list(z ORDER BY r) FILTER (r >= 8)) AS e FROM v GROUP BY 1 HAVING count(*) = 16),
n AS (SELECT name, sqrt(list_dot_product(b, b)) AS bn, sqrt(list_dot_product(e, e)) AS en, list_transform(list_zip(b, e), lambda x: x[2] - x[1]) AS d FROM p),
t AS (SELECT i.name, bn, en, sqrt(list_dot_product(d, d)) AS dn, d FROM (SELECT DISTINCT name FROM v) i LEFT JOIN n USING (name))
"""
_R6 = ("baseline_norm", "edited_norm", "delta_norm", "relative_norm")


@query(_TENSOR_SQL + "SELECT name, CASE WHEN dn IS NULL THEN 'missing' ELSE 'evaluated' END AS status, round(bn, 6) AS baseline_norm, round(en, 6) AS edited_norm, round(dn, 6) AS delta_norm, round(dn / nullif(bn, 0), 6) AS relative_norm FROM t")
def q_structural_frobenius(spark: SparkSession, sf: str) -> DataFrame:
    return _tensors(spark, sf).select("name", "status", *(F.round(c, 6).alias(c) for c in _R6))


@query(_TENSOR_SQL + """SELECT count(*) AS total, count(dn) AS evaluated, round(sqrt(sum(dn * dn)), 6) AS aggregate_delta, round(sqrt(sum(dn * dn)) / sqrt(sum(bn * bn)), 6) AS aggregate_relative, count(dn) / count(*) AS fraction,
CASE WHEN count(dn) = 0 THEN 'unavailable' WHEN count(dn) < count(*) THEN 'incomplete' ELSE 'complete' END AS status,
CASE WHEN count(dn) = count(*) THEN '' ELSE 'partial structural coverage: evaluated ' || count(dn) || ' of ' || count(*) || ' inventoried tensors; aggregates exclude ' || (count(*) - count(dn)) || CASE WHEN count(*) - count(dn) = 1 THEN ' missing tensor; ' ELSE ' missing tensors; ' END END
 || 'structural magnitude is descriptive evidence only and is not automatically interpreted as semantic harm or model safety' AS warning FROM t""")
def q_structural_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    out = M.structural_summary(_tensors(spark, sf)).withColumn("warning", F.array_join("warnings", "; ")).drop("warnings")
    return out.withColumn("aggregate_delta", F.round("aggregate_delta", 6)).withColumn("aggregate_relative", F.round("aggregate_relative", 6))


_SPECTRAL_SQL = _TENSOR_SQL + """
, m AS (SELECT name, dn, list_transform(range(8), lambda i: list_transform(d[i * 64 + 1 : i * 64 + 64], lambda x: x / dn)) AS m FROM t WHERE dn IS NOT NULL),
s AS (SELECT *, list_transform(m, lambda r: sqrt(list_dot_product(r, r))) AS ns FROM m),
g AS (SELECT name, dn, m, list_transform(m[list_position(ns, list_max(ns))], lambda x: x / list_max(ns)) AS v0,
  list_transform(range(64), lambda a: list_transform(range(64), lambda b: list_sum(list_transform(m, lambda r: r[a + 1] * r[b + 1])))) AS gram FROM s),
w AS (SELECT name, dn, m, list_reduce(list_prepend(v0, list_transform(range(20), lambda i: v0)), lambda v, dummy:
  list_transform([list_transform(gram, lambda row: list_dot_product(row, v))], lambda u: list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))))[1]) AS v FROM g)
SELECT name, round(dn * sqrt(list_sum(list_transform(m, lambda r: pow(list_dot_product(r, v), 2)))), 6) AS spectral_norm FROM w
"""


@query(_SPECTRAL_SQL)
def q_structural_spectral(spark: SparkSession, sf: str) -> DataFrame:
    """Estimate by twenty power iterations of every complete tensor."""
    return _tensors(spark, sf, 20).where(F.col("spectral_norm").isNotNull()).select("name", F.round("spectral_norm", 6).alias("spectral_norm"))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(18,2) AS r, max(l_extendedprice::DECIMAL(18,2)) OVER o AS c, min(l_extendedprice::DECIMAL(18,2)) OVER o AS k FROM lineitem WINDOW o AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, l_partkey, (r - k)::DOUBLE AS delta, (r - k)::DOUBLE / nullif((c - k)::DOUBLE, 0) AS recovery, CASE WHEN c = k THEN 'recovery unavailable because the clean and corrupted scores are equal' END AS warning FROM w
""")
def q_causal_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Each line is a restored module; the dearest line stands for the clean run, the cheapest for the corrupted one."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey")
    runs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("r"))
    runs = runs.withColumn("c", F.max("r").over(order)).withColumn("k", F.min("r").over(order))
    runs = runs.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("c") - F.col("k")).cast("double").alias("c"), F.lit(0.0).alias("k"), (F.col("r") - F.col("k")).cast("double").alias("r"))
    return M.causal_recovery(runs, "c", "k", "r").drop("c", "k", "r")


_CUT = "timestamp '2024-01-16 00:00:00'"


@query(f"""
WITH a AS (SELECT event_type AS metric_id, avg(value) AS agg, count(*) % 3 AS n, 'u' AS unit FROM events WHERE ts < {_CUT} AND event_type <> 'click' GROUP BY 1),
b AS (SELECT event_type AS metric_id, avg(value) AS agg, count(*) % 3 AS n, CASE WHEN event_type = 'view' THEN 'w' ELSE 'u' END AS unit FROM events WHERE ts >= {_CUT} AND event_type <> 'error' GROUP BY 1)
SELECT metric_id, CASE WHEN a.agg IS NULL THEN 'only-b' WHEN b.agg IS NULL THEN 'only-a' ELSE 'both' END AS presence,
  (a.agg IS NOT NULL AND b.agg IS NOT NULL AND a.unit = b.unit) AS comparable, round(CASE WHEN a.unit = b.unit THEN b.agg - a.agg END, 6) AS delta,
  CASE WHEN a.agg IS NULL THEN 'metric is absent from report_a' WHEN b.agg IS NULL THEN 'metric is absent from report_b' WHEN a.unit <> b.unit THEN 'metric contract differs across reports: unit' ELSE '' END AS warnings
FROM a FULL JOIN b USING (metric_id)
""")
def q_report_compare(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "value", "ts")
    cut = F.expr(_CUT.replace("timestamp", "timestamp_ntz"))

    def report(rows: DataFrame, unit: Column) -> DataFrame:
        return rows.groupBy(F.col("event_type").alias("metric_id")).agg(F.avg("value").alias("aggregate")).withColumn("unit", unit).withColumn("status", F.lit("complete"))

    a = report(events.where((F.col("ts") < cut) & (F.col("event_type") != "click")), F.lit("u"))
    b = report(events.where((F.col("ts") >= cut) & (F.col("event_type") != "error")), F.when(F.col("metric_id") == "view", F.lit("w")).otherwise(F.lit("u")))
    out = M.reports_with(a, b, "metric_id", ["unit"], "aggregate", "status")
    return out.select("metric_id", "presence", "comparable", F.round("aggregate_delta_b_minus_a", 6).alias("delta"), F.array_join("warnings", "; ").alias("warnings"))


@query("""
SELECT c_custkey, s_suppkey, array_to_string(list_filter([CASE WHEN c_name IS DISTINCT FROM s_name THEN 'name' END, CASE WHEN c_nationkey IS DISTINCT FROM s_nationkey THEN 'nation' END,
  CASE WHEN (c_acctbal > 0) IS DISTINCT FROM (s_acctbal > 0) THEN 'balance' END], lambda x: x IS NOT NULL), ', ') AS mismatches FROM customer JOIN supplier ON c_custkey = s_suppkey
""")
def q_context_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    fields = M.mismatched_fields({"name": F.col("c_name"), "nation": F.col("c_nationkey"), "balance": F.col("c_acctbal") > 0}, {"name": F.col("s_name"), "nation": F.col("s_nationkey"), "balance": F.col("s_acctbal") > 0})
    return rows.select("c_custkey", "s_suppkey", F.array_join(fields, ", ").alias("mismatches"))


@query("""
SELECT k AS case_id, side FROM (SELECT DISTINCT case_id AS k, 'missing' AS side FROM audit_cases WHERE case_id NOT IN (SELECT case_id FROM probe_evidence WHERE case_id IS NOT NULL) AND case_id IS NOT NULL
UNION ALL SELECT DISTINCT case_id, 'extra' FROM probe_evidence WHERE case_id NOT IN (SELECT case_id FROM audit_cases WHERE case_id IS NOT NULL) AND case_id IS NOT NULL)
""")
def q_exact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Cases without evidence and evidence without a case."""
    ids = lambda t: table(spark, sf, t).select("case_id").where(F.col("case_id").isNotNull())
    return M.coverage_gap(ids("audit_cases"), ids("probe_evidence"), "case_id")


_LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(f"""
WITH w AS (SELECT *, row_number() OVER o AS occurrence, first_value(l_partkey) OVER o AS first_part FROM lineitem WINDOW o AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE_ORDER)}))
SELECT l_orderkey, l_linenumber, occurrence, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS path, l_orderkey || '/' || l_linenumber || '/' || first_part AS first_path FROM w WHERE occurrence > 1
""")
def q_first_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_ORDER)
    out = M.first_duplicates(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in _LINE_ORDER], F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"))
    return out.select("l_orderkey", "l_linenumber", F.col("occurrence").cast("bigint").alias("occurrence"), "path", "first_path")


_PROBES_SQL = "WITH p AS (" + " UNION ALL ".join(f"SELECT case_row, '{g}' AS grp, {i} AS o, unnest(range(len(probes.{g}))) AS pos, unnest(probes.{g}).probe_id AS probe_id, unnest(probes.{g}).prompt AS prompt, edit.subject AS subject FROM audit_cases" for i, g in enumerate(R.GROUPS)) + ") "


@query("""
WITH w AS (SELECT report_id, metric_id, probe_id, evidence_id, ingested_at, evidence_id || '@' || strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') AS path, row_number() OVER o AS occurrence,
  first_value(evidence_id || '@' || strftime(ingested_at, '%Y-%m-%dT%H:%M:%S')) OVER o AS first_path FROM probe_evidence WHERE probe_id IS NOT NULL AND ingested_at IS NOT NULL
  WINDOW o AS (PARTITION BY report_id, metric_id, probe_id ORDER BY ingested_at, evidence_id))
SELECT report_id, metric_id, probe_id, occurrence, path, first_path FROM w WHERE occurrence > 1
""")
def q_repeated_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Probes of a metric that were delivered again, with the delivery that came first."""
    rows = table(spark, sf, "probe_evidence").where("probe_id IS NOT NULL AND ingested_at IS NOT NULL").select("report_id", "metric_id", "probe_id", "evidence_id", "ingested_at")
    path = F.concat(F.col("evidence_id").cast("string"), F.lit("@"), F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss"))
    out = M.first_duplicates(rows, ["report_id", "metric_id", "probe_id"], [F.col("ingested_at"), F.col("evidence_id")], path)
    return out.select("report_id", "metric_id", "probe_id", F.col("occurrence").cast("bigint").alias("occurrence"), "path", "first_path")


@query(_PROBES_SQL + "SELECT case_row, grp, count(*) AS probes, count(DISTINCT prompt) AS prompts FROM p GROUP BY 1, 2")
def q_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.case_probes(table(spark, sf, "audit_cases"), ["case_row"]).groupBy("case_row", "grp").agg(F.count(F.lit(1)).alias("probes"), F.count_distinct("prompt").alias("prompts"))


@query(_PROBES_SQL + """, s AS (SELECT case_row, grp, pos, list_filter(range(length(prompt) - length(subject) + 1), lambda i: substring(prompt, i + 1, length(subject)) = subject) AS st FROM p WHERE subject <> '' AND prompt IS NOT NULL)
SELECT case_row, grp, pos::INT AS pos, len(st)::INT AS places, CASE WHEN len(st) = 1 THEN st[1]::INT END AS start FROM s""")
def q_subject_span(spark: SparkSession, sf: str) -> DataFrame:
    """Where the subject stands in each prompt, when it does so once."""
    cases = table(spark, sf, "audit_cases").withColumn("subject", F.col("edit.subject"))
    rows = R.case_probes(cases, ["case_row", "subject"]).where((F.col("subject") != "") & F.col("prompt").isNotNull())
    rows = rows.withColumn("starts", S.substring_starts(F.col("prompt"), F.col("subject")))
    return rows.select("case_row", "grp", "pos", F.size("starts").alias("places"), S.unique_start(F.col("starts")).alias("start"))


@query(_PROBES_SQL + """, s AS (SELECT case_row, grp, pos, string_split(prompt, ' ') AS t, string_split(subject, ' ') AS u FROM p WHERE subject IS NOT NULL AND prompt IS NOT NULL),
m AS (SELECT *, list_filter(range(len(t) - len(u) + 1), lambda i: t[i + 1 : i + len(u)] = u) AS st FROM s)
SELECT case_row, grp, pos::INT AS pos, CASE WHEN len(st) = 1 THEN st[1]::INT END AS start FROM m""")
def q_token_subsequence(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "audit_cases").withColumn("subject", F.col("edit.subject"))
    rows = R.case_probes(cases, ["case_row", "subject"]).where(F.col("subject").isNotNull() & F.col("prompt").isNotNull())
    return rows.select("case_row", "grp", "pos", S.unique_start(S.token_starts(F.split("prompt", " "), F.split("subject", " "))).alias("start"))


@query("SELECT doc_id, coalesce(regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}'), false) AS source_ok, coalesce(regexp_full_match(lang, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}'), false) AS lang_ok FROM documents")
def q_identifier_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.is_identifier(F.col("source")).alias("source_ok"), T.is_identifier(F.col("lang")).alias("lang_ok"))


@query("""
SELECT report_id, metric_id, threshold.operator AS operator, threshold.passed AS passed, CASE WHEN isfinite(aggregate) AND isfinite(threshold.value) THEN CASE threshold.operator WHEN 'greater-than' THEN aggregate > threshold.value
  WHEN 'greater-than-or-equal' THEN aggregate >= threshold.value WHEN 'less-than' THEN aggregate < threshold.value WHEN 'less-than-or-equal' THEN aggregate <= threshold.value END END AS holds FROM metric_results WHERE threshold IS NOT NULL
""")
def q_threshold_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "metric_results").where(F.col("threshold").isNotNull())
    return rows.select("report_id", "metric_id", F.col("threshold.operator").alias("operator"), F.col("threshold.passed").alias("passed"), T.threshold_holds(F.col("threshold.operator"), F.col("aggregate"), F.col("threshold.value")).alias("holds"))


@query("""
SELECT report_id, metric_id, strftime(generated_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS generated, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS ingested, coalesce(ingested_at < generated_at, false) AS reversed FROM metric_results
""")
def q_timestamp_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "metric_results").select("report_id", "metric_id", T.utc_text(F.col("generated_at")).alias("generated"), T.utc_text(F.col("ingested_at")).alias("ingested"))
    return rows.withColumn("reversed", F.coalesce(T.utc_time(F.col("ingested")) < T.utc_time(F.col("generated")), F.lit(False)))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def q_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query("SELECT submission_id, 'run-' || substr(sha256(sha256(payload) || ':' || sha256(coalesce(channel, ''))), 1, 24) AS run_id FROM case_submissions")
def q_run_id(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.sha2(F.concat(F.sha2("payload", 256), F.lit(":"), F.sha2(F.coalesce("channel", F.lit("")), 256)), 256)
    return table(spark, sf, "case_submissions").select("submission_id", F.concat(F.lit("run-"), F.substring(whole, 1, 24)).alias("run_id"))


def _escape_sql(c: str) -> str:
    for what, by in T.ESCAPES:
        quoted = f"chr({ord(what)})"
        c = f"replace({c}, {quoted}, '{by}')"
    return c


@query(f"SELECT doc_id, sha256({_escape_sql('text')}) AS digest, length({_escape_sql('text')})::INT AS escaped_length FROM documents")
def q_markdown_escape(spark: SparkSession, sf: str) -> DataFrame:
    escaped = T.escape_markdown(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(escaped, 256).alias("digest"), F.length(escaped).alias("escaped_length"))


@query("""
SELECT DISTINCT case_id, metric_id, (length(metric_id) BETWEEN 1 AND 4096 AND len(list_filter(string_split(metric_id, '.'), lambda s: NOT regexp_full_match(s, '[A-Za-z][A-Za-z0-9_]*|0|[1-9][0-9]*') OR length(s) > 256)) = 0) AS metric_ok,
 coalesce(length(case_id) BETWEEN 1 AND 4096 AND len(list_filter(string_split(case_id, '.'), lambda s: NOT regexp_full_match(s, '[A-Za-z][A-Za-z0-9_]*|0|[1-9][0-9]*') OR length(s) > 256)) = 0, false) AS case_ok FROM metric_results
""")
def q_module_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "metric_results").select("case_id", "metric_id").distinct()
    return rows.select("case_id", "metric_id", S.valid_module_path(F.col("metric_id")).alias("metric_ok"), S.valid_module_path(F.col("case_id")).alias("case_ok"))


_READS_SQL = "WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) "


@query(_READS_SQL + "SELECT user_id, b AS before, e AS edited, a AS after FROM (SELECT user_id, max(event_type) FILTER (n = 1) AS b, max(event_type) FILTER (n = 2) AS e, max(event_type) FILTER (n = 3) AS a FROM r GROUP BY 1) WHERE b IS DISTINCT FROM a")
def q_contamination(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    reads = table(spark, sf, "events").withColumn("n", n).groupBy("user_id").agg(*(F.max(F.when(F.col("n") == k, F.col("event_type"))).alias(c) for k, c in ((1, "before"), (2, "edited"), (3, "after"))))
    return M.contaminated(reads, "before", "edited", "after")


_STATES = {None: ("view", "click"), "view": ("click", "view"), "click": ("purchase", "view"), "purchase": ("view",), "error": ("view",)}


@query("WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT event_id, user_id, event_type, previous FROM w WHERE NOT coalesce(CASE " + " ".join(f"WHEN previous {'IS NULL' if k is None else f'= {k!r}'} THEN event_type IN {v + (v[0],)}" for k, v in _STATES.items()) + " ELSE false END, false)")
def q_manifest_transitions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return M.invalid_transitions(events, ["user_id"], "event_type", [F.col("ts"), F.col("event_id")], _STATES).drop("ts")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_open_object(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""
WITH d AS (SELECT report_id, metric_id, coverage FROM metric_results QUALIFY row_number() OVER (PARTITION BY report_id, metric_id ORDER BY ingested_at DESC) = 1),
p AS (SELECT report_id, metric_id, count(*) AS total, count(*) FILTER (usable) AS evaluated FROM (SELECT DISTINCT evidence_id, report_id, metric_id, coalesce(isfinite(absolute_delta), false) AS usable FROM probe_evidence) GROUP BY 1, 2),
j AS (SELECT d.*, coalesce(total, 0) AS total, coalesce(evaluated, 0) AS evaluated FROM d LEFT JOIN p USING (report_id, metric_id)),
e AS (SELECT report_id, metric_id, 'total' AS field, coverage.total AS declared, total AS counted FROM j UNION ALL SELECT report_id, metric_id, 'evaluated', coverage.evaluated, evaluated FROM j UNION ALL SELECT report_id, metric_id, 'missing', coverage.missing, total - evaluated FROM j)
SELECT * FROM e WHERE declared <> counted
""")
def q_usable_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Declared coverage against the probes whose difference is a finite number."""
    declared = table(spark, sf, "metric_results").groupBy("report_id", "metric_id").agg(F.max_by("coverage", "ingested_at").alias("coverage"))
    probes = table(spark, sf, "probe_evidence").select("evidence_id", "report_id", "metric_id", N.finite(F.col("absolute_delta")).alias("evaluated")).distinct()
    return R.coverage_recount(declared, probes, ["report_id", "metric_id"])


def _rules_sql(id_column: str, source: str, rules: list[tuple[int, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {id_column}, {n} AS seq, '{path}' AS path, '{message}' AS message FROM {source} WHERE coalesce({broken}, false)" for n, path, message, broken in rules)


def _case_rules_sql() -> str:
    """The same rules, numbered alike, as SQL predicates."""
    wrong = lambda c, most: f"{c} IS NOT NULL AND length({c}) NOT BETWEEN 1 AND {most}"
    checks = ["schema_version IS DISTINCT FROM '1.0.0'", "coalesce(NOT regexp_full_match(case_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}'), true)", wrong("description", 4096)]
    for n in ("subject", "prompt_template", "target_new"):
        checks += [f"edit.{n} IS NULL", wrong(f"edit.{n}", 32768)]
    checks += [wrong("edit.target_original", 32768), "edit.prompt_template IS NOT NULL AND NOT regexp_full_match(edit.prompt_template, '(?:[^{}]|\\{\\{|\\}\\})*\\{subject\\}(?:[^{}]|\\{\\{|\\}\\})*')", "edit.target_new = edit.target_original"]
    for g in R.GROUPS:
        checks += [f"probes.{g} IS NULL", f"len(probes.{g}) > 10000"]
    checks.append("len(probes.exact) = 0")
    for n in ("dataset_name", "dataset_license", "source"):
        checks += [f"provenance.{n} IS NULL", wrong(f"provenance.{n}", R.LENGTHS[n])]
    checks += [wrong(f"provenance.{n}", R.LENGTHS[n]) for n in ("dataset_version", "record_id", "citation")]
    return " UNION ALL ".join(f"SELECT case_row, {n} AS seq FROM audit_cases WHERE coalesce({c}, false)" for n, c in enumerate(checks))


@query(_case_rules_sql())
def q_case_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the contract that a case breaks."""
    return R.violations(table(spark, sf, "audit_cases"), ["case_row"], R.case_rules()).select("case_row", "seq")


@query("""
SELECT report_id, metric_id, ingested_at, unnest(list_filter([
 CASE WHEN coalesce(status NOT IN ('complete', 'incomplete', 'failed'), true) THEN 0 END, CASE WHEN NOT isfinite(aggregate) THEN 1 END, CASE WHEN coverage.missing <> coverage.total - coverage.evaluated THEN 2 END,
 CASE WHEN isfinite(coverage.fraction) AND abs(coverage.fraction - CASE WHEN coverage.total = 0 THEN 0.0 ELSE coverage.evaluated / coverage.total END) > 1e-12 THEN 3 END,
 CASE WHEN status = 'complete' AND coverage.missing <> 0 THEN 4 END, CASE WHEN status = 'incomplete' AND coverage.missing = 0 THEN 5 END, CASE WHEN coverage.evaluated = 0 AND aggregate IS NOT NULL THEN 6 END,
 CASE WHEN coverage.evaluated > 0 AND status IN ('complete', 'incomplete') AND aggregate IS NULL THEN 7 END,
 CASE WHEN isfinite(aggregate) AND isfinite(threshold.value) AND threshold.passed <> CASE threshold.operator WHEN 'greater-than' THEN aggregate > threshold.value WHEN 'greater-than-or-equal' THEN aggregate >= threshold.value WHEN 'less-than' THEN aggregate < threshold.value WHEN 'less-than-or-equal' THEN aggregate <= threshold.value END THEN 8 END,
 CASE WHEN status IN ('incomplete', 'failed') AND coalesce(len(warnings), 0) < 1 THEN 9 END], lambda x: x IS NOT NULL)) AS seq FROM metric_results
""")
def q_metric_rules(spark: SparkSession, sf: str) -> DataFrame:
    return R.violations(table(spark, sf, "metric_results"), ["report_id", "metric_id", "ingested_at"], R.metric_rules()).select("report_id", "metric_id", "ingested_at", "seq")


@query("""
SELECT evidence_id, ingested_at, unnest(list_filter([
 CASE WHEN coalesce(NOT regexp_full_match(probe_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}'), true) THEN 0 END,
 CASE WHEN baseline_mean_log_probability IS NOT NULL AND NOT (isfinite(baseline_mean_log_probability) AND baseline_mean_log_probability <= 0) THEN 1 END,
 CASE WHEN edited_mean_log_probability IS NOT NULL AND NOT (isfinite(edited_mean_log_probability) AND edited_mean_log_probability <= 0) THEN 2 END,
 CASE WHEN CASE WHEN baseline_mean_log_probability IS NOT NULL AND edited_mean_log_probability IS NOT NULL THEN missing_reason IS NOT NULL ELSE missing_reason IS NULL OR trim(missing_reason) = '' OR length(missing_reason) > 4096 END THEN 3 END,
 CASE WHEN isfinite(signed_delta) AND isfinite(absolute_delta) AND abs(signed_delta) <> absolute_delta THEN 4 END], lambda x: x IS NOT NULL)) AS seq FROM probe_evidence
""")
def q_scored_probe_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of a probe's evidence, where a probe counts as evaluated when both scores are there."""
    both = F.col("baseline_mean_log_probability").isNotNull() & F.col("edited_mean_log_probability").isNotNull()
    return R.violations(table(spark, sf, "probe_evidence").withColumn("probe_status", F.when(both, "evaluated").otherwise("missing")), ["evidence_id", "ingested_at"], R.probe_rules()).select("evidence_id", "ingested_at", "seq")
