"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm import dedup, digest, leak, mixing, mojibake, sampling, topn
from probeloom.session import materialize
from probeloom.sources.tables import table

PROBE_GROUPS = ("exact", "paraphrase", "locality", "portability", "control")
SAMPLE_RATE = 0.0125  # chance per probe of a case
SAMPLE_SALT = "case-sample"
DELTAS = ("absolute_delta", "signed_delta")
RANK_ERROR = 0.005  # of the percentiles of p3_found
POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Cases weighted by their number of probes; ``first_wave`` says since when a case is chosen."""
    cases = table(spark, sf, "audit_cases")
    probes = sum((F.coalesce(F.size(F.col(f"probes.{g}")), F.lit(0)) * F.col(f"probes.{g}").isNotNull().cast("int") for g in PROBE_GROUPS), F.lit(0))
    weight = F.greatest(F.coalesce(probes, F.lit(0)), F.lit(1)).cast("double")
    return sampling.stable_sample(cases, "case_id", weight, "intake_wave", rate=SAMPLE_RATE, salt=SAMPLE_SALT)


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Certified percentiles per metric and batch, and per metric alone (``batch_id`` null, ``scope`` metric)."""
    rows = table(spark, sf, "probe_evidence")
    batches = materialize(digest.merge_digests(digest.partial_digests(rows, ["metric_id", "batch_id"], DELTAS), ["metric_id", "batch_id"]))
    own = digest.certify(rows, digest.estimates(batches, ["metric_id", "batch_id"], POINTS), ["metric_id", "batch_id"], DELTAS, POINTS)
    whole = digest.merge_digests(batches, ["metric_id"])
    alone = digest.certify(rows, digest.estimates(whole, ["metric_id"], POINTS), ["metric_id"], DELTAS, POINTS)
    return own.withColumn("scope", F.lit("batch")).unionByName(alone.withColumn("batch_id", F.lit(None).cast("string")).withColumn("scope", F.lit("metric")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a metric with a long tail of ``absolute_delta`` or a low median of ``signed_delta``, by estimates whose counted rank error is within the bound."""
    found = digest.percentiles(table(spark, sf, "probe_evidence"), ["metric_id", "batch_id"], DELTAS, (0.5, 0.95), max_error=RANK_ERROR)
    at = lambda p: F.max(F.when(F.col("percentile") == p, F.col("value")))
    both = found.groupBy("metric_id", "batch_id", "field").agg(at(0.5).alias("median"), at(0.95).alias("high"))
    tail = (F.col("field") == "absolute_delta") & (F.col("high") >= 6 * F.col("median"))
    low = (F.col("field") == "signed_delta") & (F.col("median") <= -0.4)
    return both.where(tail | low).select("metric_id", "batch_id", "field")


def p3_certified(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the counted rank error of every percentile per metric and batch is within the bound."""
    found = digest.percentiles(table(spark, sf, "probe_evidence"), ["metric_id", "batch_id"], DELTAS, POINTS, max_error=RANK_ERROR)
    return found.select("metric_id", "batch_id", "field", "percentile", "n", (F.col("rank_error") <= F.greatest(F.lit(RANK_ERROR), 1 / F.col("n"))).alias("within"))


def p4_copies(spark: SparkSession, sf: str) -> DataFrame:
    """One representative per record with the number of its copies."""
    _, records = dedup.spelling_copies(table(spark, sf, "case_submissions"), "submission_id", "payload")
    return records.select(F.col("kept_id").alias("submission_id"), "copies")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    members, _ = dedup.spelling_copies(table(spark, sf, "case_submissions"), "submission_id", "payload")
    return members.where(F.col("id") != F.col("kept_id")).select("kept_id", F.col("id").alias("copy_id"))


def p6_top3(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "probe_evidence")
    return topn.top_n(rows, ["case_id", "metric_id"], "absolute_delta", ["probe_id", "evidence_id"], 3)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_top3(spark, sf).select("case_id", "metric_id", "evidence_id")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that print at least twelve consecutive words of an item, with the longest run."""
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), min_words=12)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def _sizes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Targets, and the token counts of the pages of sources that have one."""
    targets = table(spark, sf, "mix_targets")
    pages = table(spark, sf, "documents").join(targets.select("source"), "source", "left_semi")
    return targets, mixing.token_sizes(pages)


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source."""
    targets, sizes = _sizes(spark, sf)
    sizes = materialize(sizes)
    plan = mixing.source_plan(targets, sizes)
    return mixing.shares(plan, mixing.mix(sizes, plan))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that stay below their share of the mix although it uses all of their pages as often as it may."""
    return p8_shares(spark, sf).where((F.col("mixed") < F.col("wanted")) & (F.col("mixed") == F.col("max_repeats") * F.col("available"))).select("source")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of the mix with their repeats."""
    targets, sizes = _sizes(spark, sf)
    sizes = materialize(sizes)
    return mixing.mix(sizes, mixing.source_plan(targets, sizes))


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Wrongly decoded lines with the text as it was, where the bytes survive."""
    documents = table(spark, sf, "documents")
    return mojibake.wrong_decoding(documents, mojibake.learn(documents))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_restored(spark, sf).select("doc_id", "line_no")


QUERIES = {f.__name__: f for f in (p2_sample, p3_found, p3_percentiles, p3_certified, p4_found, p4_copies, p6_found, p6_top3, p7_found, p7_leaks, p8_found, p8_mix, p8_shares, p9_found, p9_restored)}

_WEIGHT = "greatest(1, " + " + ".join(f"coalesce(len(probes.{g}), 0)" for g in PROBE_GROUPS) + ")::DOUBLE"
_UNIT = f"(('0x' || substr(sha256('{SAMPLE_SALT}:' || case_id), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"
_TOP = """
SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, metric_id ORDER BY absolute_delta DESC, probe_id, evidence_id) AS rank
  FROM (SELECT DISTINCT case_id, metric_id, absolute_delta, probe_id, evidence_id FROM probe_evidence WHERE isfinite(absolute_delta))
) WHERE rank <= 3
"""

# letters and digits of a text without case, however its accents are coded
_FOLD = "regexp_replace(nfc_normalize(lower(nfc_normalize({x}))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"
_PROMPTS = "list_sort(list_distinct(list_transform(json_extract_string(j, '$.probes.{g}[*].prompt'), lambda x: {fold})))"
_RECORDS = f"""
WITH p AS (SELECT submission_id AS id, ltrim(payload, chr(65279)) AS t FROM case_submissions WHERE json_valid(ltrim(payload, chr(65279)))),
r AS (SELECT id, {_FOLD.format(x="coalesce(CASE WHEN json_type(j, '$.edit.prompt_template') = 'VARCHAR' THEN j ->> '$.edit.prompt_template' END, '')")} AS template,
  {_PROMPTS.format(g="exact", fold=_FOLD.format(x="x"))} AS exact, {_PROMPTS.format(g="paraphrase", fold=_FOLD.format(x="x"))} AS paraphrase FROM (SELECT id, t::JSON AS j FROM p)),
g AS (SELECT min(id) AS kept_id, count(*) AS copies, list(id) AS ids FROM r WHERE template <> '' OR len(exact) > 0 OR len(paraphrase) > 0 GROUP BY template, exact, paraphrase)
"""

ORACLE = {
    "p4_copies": f"{_RECORDS} SELECT kept_id AS submission_id, copies FROM g",
    "p4_found": f"{_RECORDS} SELECT kept_id, copy_id FROM (SELECT kept_id, unnest(ids) AS copy_id FROM g) WHERE copy_id <> kept_id",
    # the outcome is the same in characters as in tokens
    "p8_found": """
WITH a AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source), j AS (SELECT m.*, coalesce(a.n, 0) AS n FROM mix_targets m LEFT JOIN a USING (source))
SELECT source FROM j WHERE max_repeats * n < target_share * (SELECT sum(n) FROM j)
""",
    "p2_sample": f"""
SELECT case_id, max(w) AS weight, least(1.0, max(w) * {SAMPLE_RATE}) AS probability, min(CASE WHEN u < w * {SAMPLE_RATE} THEN intake_wave END) AS first_wave
FROM (SELECT case_id, intake_wave, {_WEIGHT} AS w, {_UNIT} AS u FROM audit_cases WHERE case_id IS NOT NULL)
GROUP BY case_id HAVING max(u) < max(w) * {SAMPLE_RATE}
""",
    "p3_found": """
WITH v AS (SELECT metric_id, batch_id, 'absolute_delta' AS field, absolute_delta AS x FROM probe_evidence UNION ALL SELECT metric_id, batch_id, 'signed_delta', signed_delta FROM probe_evidence),
q AS (SELECT metric_id, batch_id, field, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.95) AS h FROM v WHERE isfinite(x) GROUP BY ALL)
SELECT metric_id, batch_id, field FROM q WHERE (field = 'absolute_delta' AND h >= 6 * m) OR (field = 'signed_delta' AND m <= -0.4)
""",
    "p3_certified": f"""
WITH v AS (SELECT metric_id, batch_id, 'absolute_delta' AS field, absolute_delta AS x FROM probe_evidence UNION ALL SELECT metric_id, batch_id, 'signed_delta', signed_delta FROM probe_evidence)
SELECT metric_id, batch_id, field, percentile::DOUBLE AS percentile, count(*) AS n, true AS within FROM v, (SELECT unnest([{", ".join(map(str, POINTS))}]) AS percentile) WHERE isfinite(x) GROUP BY ALL
""",
    "p6_found": _TOP.format(columns="case_id, metric_id, evidence_id"),
    "p6_top3": _TOP.format(columns="case_id, metric_id, absolute_delta, probe_id, evidence_id, rank"),
}
