"""Operators of the evidence chain over the domain tables: preflight, traces, places, guards, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.functions import numeric as N
from probeloom.operators import guards as G
from probeloom.operators import metrics as M
from probeloom.operators import recorded, rules
from probeloom.operators import spans as S
from probeloom.plans import audit as A
from probeloom.plans.document_queries import _HEX, _NAMES, _artifact, _run, record
from probeloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


def _union(source: str, columns: str, rules_: list[tuple[str, str]], name: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{text}' AS {name} FROM {source} WHERE coalesce({broken}, false)" for text, broken in rules_)


@query("WITH c AS (SELECT case_row::VARCHAR AS audit_id, intake_wave AS w, len(list_filter(coalesce(probes.exact, []), lambda p: p.probe_id IS NOT NULL)) AS n FROM audit_cases) " + _union("c", "audit_id", [
    ("$.seeds", "w = 1"), ("$.model.model_id", "w = 2"), ("$.edited.state", "w = 3"), ("$.edited.measurements.target_scores", "w = 4 AND n > 0"), ("$.snapshot_id", "w = 5"), ("$.editor", "w = 5"),
    ("$.model.artifact.content_hash", "w = 3"), ("$.measurements.control_temperature", "w = 2"),
], "path"))
def q_audit_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with two snapshots each, of which every wave breaks other rules of a pair."""
    wave, none = F.col("intake_wave"), F.array().cast("array<struct<probe_id:string,prompt:string>>")
    rows = table(spark, sf, "audit_cases").withColumn("audit_id", F.col("case_row").cast("string"))
    exact = F.transform(F.filter(F.coalesce(F.col("probes.exact"), F.array()), lambda p: p["probe_id"].isNotNull()), lambda p: F.struct(p["probe_id"].alias("probe_id"), F.lit("x").alias("prompt")))
    case = record(probes={"exact": exact, "paraphrase": none, "locality": none, "portability": none, "control": none})
    scores = F.transform(exact, lambda p: F.struct(p["probe_id"].alias("probe_id"), F.lit(-1.0).alias("mean_target_log_probability")))

    def snapshot(edited: bool) -> Column:
        on = lambda k, yes, no: F.when(wave == k, yes).otherwise(no) if edited else F.lit(no)
        doc = {
            "snapshot_id": on(5, "s-a", "s-b") if edited else "s-a", "state": on(3, "baseline", "edited") if edited else "baseline", **_run(on(5, "other", "made-up")), "seeds": {"python": on(1, 2, 1)},
            "model": {**_NAMES, "model_id": on(2, "n", "m"), "artifact": _artifact("edit" if edited else "base", "model-checkpoint", on(3, _HEX["a"], _HEX["b"]) if edited else _HEX["a"])},
            "measurements": {"target_scores": F.when(wave == 4, F.array().cast("array<struct<probe_id:string,mean_target_log_probability:double>>")).otherwise(scores) if edited else scores, "control_logits": F.array().cast("array<string>"), "control_temperature": on(2, 2.0, 1.0)},
        }
        return record(**doc)

    text = lambda c: rows.select("audit_id", F.to_json(c).alias("payload"))
    return A.pair_issues(text(case), text(snapshot(False)), text(snapshot(True))).select("audit_id", "path")


@query("""
WITH v AS (SELECT vec_id // 8 AS a, (vec_id % 8) // 4 AS p, (vec_id % 4) // 2 AS pos, vec_id % 2 AS s, list_transform(embedding, lambda x: x::DOUBLE * 10.0) AS z FROM embeddings),
j AS (SELECT b.a, b.p, b.pos, b.z AS x, e.z AS y FROM v b JOIN v e ON b.a = e.a AND b.p = e.p AND b.pos = e.pos WHERE b.s = 0 AND e.s = 1),
l AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda t: exp(t - list_max(x))))) AS lx, list_max(y) + ln(list_sum(list_transform(y, lambda t: exp(t - list_max(y))))) AS ly FROM j)
SELECT a::VARCHAR AS audit_id, 'p' || p AS probe_id, pos::INT AS position, len(x)::INT AS vocabulary, round(list_sum(list_transform(list_zip(x, y), lambda t: exp(t[1] - lx) * (t[1] - lx - t[2] + ly))), 6) AS kl FROM l
""")
def q_control_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Control probes of every case joined with their logits in both snapshots, position by position."""
    v = table(spark, sf, "embeddings").selectExpr("cast(vec_id div 8 as string) as audit_id", "concat('p', (vec_id % 8) div 4) as probe_id", "(vec_id % 4) div 2 as pos", "vec_id % 2 as side", "transform(embedding, x -> cast(x as double) * 10.0D) as z")
    whole = v.groupBy("audit_id", "probe_id", "pos").agg(F.max(F.when(F.col("side") == 0, F.col("z"))).alias("b"), F.max(F.when(F.col("side") == 1, F.col("z"))).alias("e")).where(F.col("b").isNotNull() & F.col("e").isNotNull())
    placed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("z")))), lambda r: r["z"]).alias(c)
    probes = whole.groupBy("audit_id", "probe_id").agg(placed("b"), placed("e"))
    audits = probes.groupBy("audit_id").agg(F.collect_list(F.struct("probe_id", "b", "e")).alias("ps"))
    cases = audits.select("audit_id", F.to_json(record(probes={"control": F.transform("ps", lambda p: F.struct(p["probe_id"].alias("probe_id"), F.lit("x").alias("prompt")))})).alias("payload"))
    side = lambda c: audits.select("audit_id", F.to_json(record(measurements={"control_logits": F.transform("ps", lambda p: F.struct(p["probe_id"].alias("probe_id"), p[c].alias("logits"))), "control_temperature": 1.0})).alias("payload"))
    return A.control_positions(cases, side("b"), side("e")).select("audit_id", "probe_id", "position", "vocabulary", F.round("kl", 6).alias("kl"))


_TRACE_SQL = """
WITH e AS (SELECT report_id AS t, metric_id || '/' || probe_id AS m, metric_id LIKE 'control%' AS control, CASE WHEN isfinite(edited_mean_log_probability) THEN edited_mean_log_probability END AS s,
  CASE WHEN isfinite(baseline_mean_log_probability) THEN baseline_mean_log_probability END AS b FROM probe_evidence WHERE report_id IS NOT NULL AND probe_id IS NOT NULL),
r AS (SELECT t, m, max(s) AS s, max(b) AS b, bool_or(control) AS control FROM e GROUP BY 1, 2),
w AS (SELECT t, max(s) AS c, min(b) AS k FROM r GROUP BY 1),
lack AS (SELECT t, string_agg(m, ', ' ORDER BY m) AS ms FROM r WHERE s IS NULL AND NOT control GROUP BY 1),
bad AS (SELECT t, 'a clean or corrupted run is missing' AS issue FROM w WHERE c IS NULL OR k IS NULL UNION ALL SELECT t, 'modules missing: ' || ms || '; unexpected: ' FROM lack
  UNION ALL SELECT t, 'more than one corruption' FROM (SELECT t, count(DISTINCT len(m) > 60) AS n FROM r WHERE s IS NOT NULL AND NOT control GROUP BY 1) JOIN w USING (t) WHERE n > 1 OR (n = 1 AND w.k IS NOT NULL AND t IN (SELECT t FROM r WHERE s IS NOT NULL AND NOT control AND len(m) > 60)))
"""


def _traces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reports as traces: the best edited score is the clean run, the worst baseline the corrupted one, probes are modules."""
    finite = lambda c: F.when(N.finite(F.col(c)), F.col(c))
    rows = table(spark, sf, "probe_evidence").where("report_id IS NOT NULL AND probe_id IS NOT NULL")
    rows = rows.groupBy(F.col("report_id").alias("trace_id"), F.concat("metric_id", F.lit("/"), "probe_id").alias("module")).agg(F.max(finite("edited_mean_log_probability")).alias("s"), F.max(finite("baseline_mean_log_probability")).alias("b"), F.bool_or(F.col("metric_id").startswith("control")).alias("control"))
    whole = rows.groupBy("trace_id").agg(F.max("s").alias("clean"), F.min("b").alias("corrupted"))
    one = lambda kind, c, corruption: whole.where(F.col(c).isNotNull()).select("trace_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("module"), F.col(c).alias("score"), F.lit(corruption).alias("corruption_id"))
    asked = rows.where(~F.col("control"))
    restored = asked.where(F.col("s").isNotNull()).select("trace_id", F.lit("restored").alias("kind"), "module", F.col("s").alias("score"), F.when(F.length("module") > 60, "noise-2").otherwise("noise-1").alias("corruption_id"))
    runs = one("clean", "clean", "none").unionByName(one("corrupted", "corrupted", "noise-1")).unionByName(restored)
    return recorded.trace(runs, asked.select("trace_id", "module", F.lit(0).alias("ord")))


@query(_TRACE_SQL + """SELECT r.t AS trace_id, r.m AS module, round(r.s - w.k, 6) AS delta, round((r.s - w.k) / nullif(w.c - w.k, 0), 6) AS recovery FROM r JOIN w USING (t) WHERE r.s IS NOT NULL AND NOT r.control AND r.t NOT IN (SELECT t FROM bad)""")
def q_recorded_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Recoveries of the traces without an issue."""
    return _traces(spark, sf)[0].select("trace_id", "module", F.round("delta", 6).alias("delta"), F.round("recovery", 6).alias("recovery"))


@query(_TRACE_SQL + "SELECT DISTINCT t AS trace_id, issue FROM bad")
def q_trace_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Traces with modules that did not come back, more than one corruption or a run too few."""
    return _traces(spark, sf)[1]


@query("""
WITH n AS (SELECT DISTINCT metric_id AS p FROM metric_results WHERE metric_id IS NOT NULL),
a AS (SELECT p AS path, p AS node, NULL::INT AS failed_at FROM n UNION ALL SELECT p || '.7', NULL, len(string_split(p, '.')) FROM n UNION ALL SELECT 'X' || p, NULL, 0 FROM n UNION ALL SELECT p || '._x', NULL, -1 FROM n
  UNION ALL SELECT DISTINCT string_split(p, '.')[1], string_split(p, '.')[1], NULL FROM n)
SELECT path, node, failed_at::INT AS failed_at FROM a
""")
def q_module_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Paths followed through the tree of the metric names; a mapping is looked up before a field."""
    names = table(spark, sf, "metric_results").select(F.col("metric_id").alias("p")).where("p IS NOT NULL").distinct()
    head = F.substring_index("p", ".", 1)
    own = names.select(F.lit("root").alias("parent"), head.alias("segment"), F.lit("module").alias("source"), head.alias("child")).distinct()
    rest = names.select(head.alias("parent"), F.expr("substr(p, instr(p, '.') + 1)").alias("segment"), F.lit("mapping").alias("source"), F.col("p").alias("child"))
    wrong = rest.select("parent", "segment", F.lit("field").alias("source"), F.lit("a field").alias("child"))
    paths = names.select("p").unionByName(names.select(F.concat("p", F.lit(".7")).alias("p"))).unionByName(names.select(F.concat(F.lit("X"), "p").alias("p"))).unionByName(names.select(F.concat("p", F.lit("._x")).alias("p"))).unionByName(own.select(F.col("child").alias("p")))
    out = S.resolve_paths(paths.select(F.col("p").alias("path"), F.lit("root").alias("root")), own.unionByName(rest).unionByName(wrong))
    return out.select("path", "node", F.col("failed_at").cast("int").alias("failed_at"))


_PROMPTS_SQL = "WITH p AS (" + " UNION ALL ".join(f"SELECT case_row, intake_wave AS wave, '{g}' AS grp, unnest(range(len(probes.{g})))::INT AS pos, unnest(probes.{g}).prompt AS prompt, edit.subject AS subject, edit.target_new AS target FROM audit_cases" for g in rules.GROUPS) + ")"


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "audit_cases").select("case_row", F.col("intake_wave").alias("wave"), F.col("edit.subject").alias("subject"), F.col("edit.target_new").alias("target"), "probes")
    return rules.case_probes(cases, ["case_row", "wave", "subject"]).join(cases.select("case_row", F.col("target").alias("own_target")), "case_row")


@query(_PROMPTS_SQL + """, q AS (SELECT *, instr(prompt, subject) - 1 AS a, instr(prompt, subject) - 1 + length(subject) AS z, string_split(prompt, ' ') AS t FROM p WHERE subject <> '' AND instr(prompt, subject) > 0),
o AS (SELECT *, list_transform(range(len(t)), lambda i: list_sum(list_transform(t[1 : i], lambda w: length(w) + 1))) AS s0 FROM q),
k AS (SELECT *, list_filter(range(len(t)), lambda i: coalesce(s0[i + 1], 0) < z AND coalesce(s0[i + 1], 0) + length(t[i + 1]) > a AND length(t[i + 1]) > 0) AS x FROM o)
SELECT case_row, grp, pos, array_to_string(x, ',') AS tokens, len(x) > 0 AND x[-1] - x[1] = len(x) - 1 AS contiguous,
 NOT contains(subject, ' ') AS covered FROM k""")
def q_token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens (words) of a prompt whose characters overlap the first place of the subject, and whether they cover it."""
    rows = _prompts(spark, sf).where("subject <> '' AND instr(prompt, subject) > 0").withColumn("a", F.expr("instr(prompt, subject) - 1")).withColumn("z", F.expr("instr(prompt, subject) - 1 + length(subject)"))
    offsets = F.expr("transform(split(prompt, ' '), (w, i) -> struct(cast(aggregate(slice(split(prompt, ' '), 1, i), 0, (n, v) -> n + length(v) + 1) as int) as start, cast(aggregate(slice(split(prompt, ' '), 1, i), 0, (n, v) -> n + length(v) + 1) + length(w) as int) as end))")
    rows = rows.withColumn("o", offsets).withColumn("x", S.overlapping_tokens(F.col("o"), F.col("a"), F.col("z")))
    return rows.select("case_row", "grp", "pos", F.array_join(F.transform("x", lambda i: i.cast("string")), ",").alias("tokens"), S.contiguous(F.col("x")).alias("contiguous"), S.covers(F.col("o"), F.col("a"), F.col("z")).alias("covered"))


@query(_PROMPTS_SQL + """, q AS (SELECT *, string_split(prompt, ' ') AS t, string_split(target, ' ') AS u FROM p WHERE prompt IS NOT NULL AND target IS NOT NULL)
SELECT case_row, grp, pos, CASE WHEN wave = 2 AND grp = 'exact' THEN NULL ELSE array_to_string(list_transform(range(len(u)), lambda i: len(t) - 1 + i), ',') END AS rows FROM q""")
def q_aligned_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of logits that predict the target after a prompt; none where the whole text is not tokenised as the prompt is."""
    rows = _prompts(spark, sf).where("prompt IS NOT NULL AND own_target IS NOT NULL").withColumn("t", F.split("prompt", " ")).withColumn("u", F.split("own_target", " "))
    whole = F.concat(F.when((F.col("wave") == 2) & (F.col("grp") == "exact"), F.concat(F.array(F.lit("other")), F.slice("t", F.lit(2), F.size("t")))).otherwise(F.col("t")), F.col("u"))
    logits = F.sequence(F.lit(0), F.size("t") + F.size("u") - 1)
    return rows.withColumn("r", S.target_rows(F.col("t"), whole, logits)).select("case_row", "grp", "pos", F.array_join(F.transform("r", lambda i: i.cast("string")), ",").alias("rows"))


_BOTH_SQL = """
WITH a AS (SELECT report_id, metric_id, max(aggregate) FILTER (isfinite(aggregate)) AS v, max(coverage.total) AS total, max(status) AS status, 1 AS l FROM metric_results WHERE report_id IS NOT NULL AND metric_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT report_id, metric_id, max(aggregate) FILTER (isfinite(aggregate)) AS v, max(coverage.total) AS total, max(status) AS status, 1 AS r FROM metric_results_mirror WHERE report_id IS NOT NULL AND metric_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT report_id, metric_id, a.v AS x, b.v AS y, a.total AS tx, b.total AS ty, a.status AS sx, b.status AS sy, l, r FROM a FULL JOIN b USING (report_id, metric_id))
"""


def _copies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    def one(name: str) -> DataFrame:
        rows = table(spark, sf, name).where("report_id IS NOT NULL AND metric_id IS NOT NULL").groupBy("report_id", "metric_id")
        return rows.agg(F.max(F.when(N.finite(F.col("aggregate")), F.col("aggregate"))).alias("aggregate"), F.max("coverage.total").alias("total"), F.max("status").alias("status"))

    return one("metric_results"), one("metric_results_mirror")


@query(_BOTH_SQL + """SELECT report_id, metric_id, CASE WHEN l IS NULL THEN 'only-b' WHEN r IS NULL THEN 'only-a' ELSE 'both' END AS presence, coalesce(l = 1 AND r = 1 AND tx IS NOT DISTINCT FROM ty, false) AS comparable,
  round(CASE WHEN l = 1 AND r = 1 AND tx IS NOT DISTINCT FROM ty THEN y - x END, 6) + 0.0 AS delta, array_to_string(list_filter([CASE WHEN l IS NULL THEN 'metric is absent from report_a' END, CASE WHEN r IS NULL THEN 'metric is absent from report_b' END,
  CASE WHEN l = 1 AND r = 1 AND tx IS DISTINCT FROM ty THEN 'metric contract differs across reports: total' END,
  CASE WHEN l = 1 AND r = 1 AND tx IS NOT DISTINCT FROM ty AND (x IS NULL OR y IS NULL) THEN 'aggregate delta unavailable because at least one aggregate is null' END,
  CASE WHEN l = 1 AND r = 1 AND tx IS NOT DISTINCT FROM ty AND (sx <> 'complete' OR sy <> 'complete') THEN 'at least one metric result is not complete' END], lambda w: w IS NOT NULL), '; ') AS warnings FROM j""")
def q_metric_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The two systems' metrics compared, second less first."""
    a, b = _copies(spark, sf)
    out = M.reports_with(a, b, ["report_id", "metric_id"], ["total"], "aggregate", "status")
    return out.select("report_id", "metric_id", "presence", "comparable", (F.round("aggregate_delta_b_minus_a", 6) + F.lit(0.0)).alias("delta"), F.array_join("warnings", "; ").alias("warnings"))


@query(_BOTH_SQL + "SELECT report_id, metric_id, x AS before, y AS after FROM j WHERE l = 1 AND r = 1 AND x IS DISTINCT FROM y")
def q_changed_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Results that do not read the same again; between the reads others were taken."""
    a, b = _copies(spark, sf)
    reads = a.select("report_id", "metric_id", F.col("aggregate").alias("before"), F.col("total").alias("edited")).join(b.select("report_id", "metric_id", F.col("aggregate").alias("after")), ["report_id", "metric_id"])
    return M.contaminated(reads, "before", "edited", "after").select("report_id", "metric_id", "before", "after")


@query("""
WITH g AS (SELECT report_id, metric_id, probe_id, baseline_mean_log_probability AS b, edited_mean_log_probability AS e, missing_reason AS m FROM probe_evidence),
x AS (""" + _union("g", "report_id, metric_id, probe_id", [
    ("probe identifier", "probe_id IS NULL OR NOT regexp_full_match(probe_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}')"), ("baseline score not finite and at most 0", "b IS NOT NULL AND NOT (isfinite(b) AND b <= 0)"), ("edited score not finite and at most 0", "e IS NOT NULL AND NOT (isfinite(e) AND e <= 0)"),
    ("missing reason", "CASE WHEN b IS NOT NULL AND e IS NOT NULL THEN m IS NOT NULL ELSE m IS NULL OR trim(m) = '' OR length(m) > 4096 END"),
], "rule") + """ UNION ALL SELECT report_id, metric_id, probe_id, 'duplicate probe' FROM g GROUP BY ALL HAVING count(*) > 1)
SELECT report_id, metric_id, probe_id, rule, count(*) AS rows FROM x GROUP BY ALL
""".replace("'duplicate probe' FROM g GROUP BY ALL", "'duplicate probe' FROM g GROUP BY 1, 2, 3"))  # fmt: skip
def q_paired_guards(spark: SparkSession, sf: str) -> DataFrame:
    """What the evidence as delivered may not bring into a paired reduction."""
    found = G.paired_guards(table(spark, sf, "probe_evidence"), ["report_id", "metric_id"], "probe_id", "baseline_mean_log_probability", "edited_mean_log_probability", "missing_reason")
    return found.groupBy("report_id", "metric_id", "probe_id", "rule").agg(F.count(F.lit(1)).alias("rows"))


@query("WITH v AS (SELECT vec_id // 4 AS probe_id, vec_id % 5 AS m, vec_id % 7 AS k FROM embeddings WHERE vec_id % 4 = 0) " + _union("v", "probe_id::VARCHAR AS probe_id", [
    ("baseline logits", "m = 1"), ("baseline logits", "m = 2"), ("edited logits", "k = 3"), ("position counts differ", "k = 2"), ("vocabulary sizes differ", "m = 3 OR k = 3"), ("missing reason", "k = 5"),
], "rule"))
def q_logits_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Logits that have no divergence: ragged, not finite, too narrow, of other shapes on the two sides."""
    rows = table(spark, sf, "embeddings").where("vec_id % 4 = 0").selectExpr("cast(vec_id div 4 as string) as probe_id", "vec_id % 5 as m", "vec_id % 7 as k", "transform(embedding, x -> cast(x as double)) as z")
    z = F.col("z")
    base = F.when(F.col("m") == 1, F.array(z, F.slice(z, 1, 3))).when(F.col("m") == 2, F.array(F.concat(F.array(F.lit(float("nan"))), F.slice(z, 2, 63)), z)).when(F.col("m") == 3, F.array(F.slice(z, 1, 3), F.slice(z, 1, 3))).otherwise(F.array(z, z))
    edited = F.when(F.col("k") == 3, F.array(F.slice(z, 1, 1), F.slice(z, 1, 1))).when(F.col("k") == 2, F.array(z)).otherwise(F.array(z, z))
    reason = F.when(F.col("k") == 5, "odd")
    rows = rows.select("probe_id", base.alias("baseline"), edited.alias("edited"), reason.alias("missing_reason"), F.lit(1).alias("g"))
    return G.logits_guards(rows, ["g"]).select("probe_id", "rule")


@query("""
WITH t AS (SELECT vec_id AS name, vec_id % 6 AS m FROM embeddings), x AS (""" + _union("t", "name::VARCHAR AS name", [
    ("shape", "m = 1"), ("baseline values", "m = 1"), ("baseline values", "m = 2"), ("edited values", "m = 1"), ("edited values", "m = 3"), ("not in the inventory", "m = 4"), ("missing reason", "m = 5"), ("difference not finite", "m = 2 OR m = 3"), ("duplicate pair", "m = 5"), ("missing reason", "m = 5"),
], "rule") + ") SELECT name, rule FROM x")
def q_tensor_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Tensors that may not enter a structural reduction: shape against values, inventory, reasons, repeats."""
    rows = table(spark, sf, "embeddings").selectExpr("cast(vec_id as string) as name", "vec_id % 6 as m", "transform(embedding, x -> cast(x as double)) as z", "1 as g")
    m, z = F.col("m"), F.col("z")
    inventory = rows.where(m != 4).select("g", "name", F.when(m == 1, F.array(F.lit(8), F.lit(0))).otherwise(F.array(F.lit(8), F.lit(8))).alias("shape"))
    pairs = rows.select("g", "name", F.when(m == 2, F.slice(z, 1, 3)).otherwise(z).alias("baseline"), F.when(m == 3, F.concat(F.array(F.lit(float("inf"))), F.slice(z, 2, 63))).otherwise(z).alias("edited"), F.when(m == 5, "odd").alias("missing_reason"))
    return G.tensor_guards(inventory, pairs.unionByName(pairs.where("missing_reason IS NOT NULL")), ["g"]).select("name", "rule")


@query("WITH c AS (SELECT case_row::VARCHAR AS pair_id, intake_wave AS w FROM audit_cases) " + _union("c", "pair_id", [
    ("baseline state", "w = 1"), ("edited state", "w = 2"), ("states are the same", "w = 3"), ("models differ", "w = 4"), ("tokenizers differ", "w = 5"),
], "rule"))
def q_model_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of model states that do not belong together."""
    w = F.col("intake_wave")
    on = lambda k, yes, no: F.when(w == k, yes).otherwise(no)
    pairs = table(spark, sf, "audit_cases").select(
        F.col("case_row").cast("string").alias("pair_id"), on(1, "edited", "baseline").alias("baseline_kind"), on(2, "baseline", "edited").alias("edited_kind"), F.lit("s1").alias("baseline_state_id"), on(3, "s1", "s2").alias("edited_state_id"),
        F.lit("m").alias("baseline_model_id"), on(4, "n", "m").alias("edited_model_id"), F.lit("t").alias("baseline_tokenizer_id"), on(5, "u", "t").alias("edited_tokenizer_id"),
    )
    return G.model_pair_guards(pairs)


@query("WITH c AS (SELECT case_row::VARCHAR AS trace_id, edit, intake_wave AS w, case_row % 4 AS m FROM audit_cases) " + _union("c", "trace_id", [
    ("prompt", "edit.prompt_template IS NULL OR trim(edit.prompt_template) = ''"), ("subject", "edit.subject IS NULL OR trim(edit.subject) = ''"), ("target", "edit.target_new IS NULL OR trim(edit.target_new) = ''"),
    ("no module", "m = 1"), ("module repeated", "m = 2"), ("seed", "w = 2 OR w = 3"),
], "rule"))
def q_trace_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Trace requests made of the cases that cannot be run."""
    m, w = F.col("case_row") % 4, F.col("intake_wave")
    modules = F.when(m == 1, F.array().cast("array<string>")).when(m == 2, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    seed = F.when(w == 2, F.lit(-1).cast("bigint")).when(w == 3, F.lit(4_294_967_296)).otherwise(F.lit(1).cast("bigint"))
    rows = table(spark, sf, "audit_cases").select(F.col("case_row").cast("string").alias("trace_id"), F.col("edit.prompt_template").alias("prompt"), F.col("edit.subject").alias("subject"), F.col("edit.target_new").alias("target"), modules.alias("modules"), seed.alias("seed"))
    return G.trace_guards(rows)


@query("""
WITH r AS (SELECT DISTINCT report_id, metric_id, max(coverage.total) AS n FROM metric_results WHERE report_id IS NOT NULL AND metric_id IS NOT NULL AND coverage.total IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY report_id ORDER BY metric_id ROWS UNBOUNDED PRECEDING) AS running FROM r)
SELECT report_id, metric_id, n, running::BIGINT AS running FROM s WHERE running > 12 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY metric_id) = 1
""")
def q_probe_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The metric at which a report has more than twelve probes in all."""
    rows = table(spark, sf, "metric_results").where("report_id IS NOT NULL AND metric_id IS NOT NULL AND coverage.total IS NOT NULL").groupBy("report_id", "metric_id").agg(F.max("coverage.total").alias("n"))
    return G.within_budget(rows, [F.col("metric_id")], "n", 12, ["report_id"])


_MOVES = {None: ("complete", "incomplete"), "incomplete": ("complete", "incomplete"), "complete": ("complete",)}


@query("""
WITH w AS (SELECT DISTINCT report_id, metric_id, ingested_at, status FROM metric_results WHERE report_id IS NOT NULL AND metric_id IS NOT NULL AND ingested_at IS NOT NULL),
l AS (SELECT *, lag(status) OVER (PARTITION BY report_id, metric_id ORDER BY ingested_at, status) AS previous FROM w)
SELECT report_id, metric_id, ingested_at, status, previous FROM l WHERE NOT coalesce(CASE WHEN previous IS NULL THEN status IN ('complete', 'incomplete') WHEN previous = 'incomplete' THEN status IN ('complete', 'incomplete') WHEN previous = 'complete' THEN status = 'complete' END, false)
""")
def q_status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of a metric whose status may not follow the one before."""
    rows = table(spark, sf, "metric_results").where("report_id IS NOT NULL AND metric_id IS NOT NULL AND ingested_at IS NOT NULL").select("report_id", "metric_id", "ingested_at", "status").distinct()
    return M.invalid_transitions(rows, ["report_id", "metric_id"], "status", [F.col("ingested_at"), F.col("status")], _MOVES)
