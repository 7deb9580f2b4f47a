"""Rules over typed tables: every row that breaks one, with the path and the rule's message."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.functions import numeric as N
from probeloom.functions import text as T

Rule = tuple[str, str, Column]  # path, message, whether the row breaks it (null: it does not)


def violations(rows: DataFrame, ids: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``(*ids, seq, path, message)``: one row for every rule that a row breaks, in one pass."""
    found = F.array_compact(F.array(*(
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(i).alias("seq"), F.lit(path).alias("path"), F.lit(message).alias("message"))) for i, (path, message, broken) in enumerate(rules)
    )))
    return rows.select(*ids, F.explode(found).alias("v")).select(*ids, "v.*")


GROUPS = ("exact", "paraphrase", "locality", "portability", "control")
#: Greatest lengths of the texts of a case.
LENGTHS = {"description": 4096, "edit": 32768, "dataset_name": 512, "dataset_version": 256, "dataset_license": 256, "source": 2048, "record_id": 512, "citation": 4096}
_TEMPLATE = r"(?:[^{}]|\{\{|\}\})*\{subject\}(?:[^{}]|\{\{|\}\})*"


def case_rules() -> list[Rule]:
    """Rules of an audit case that concern the case as a whole."""
    def required(path: str, c: Column, most: int) -> list[Rule]:
        return [(path, "is required", c.isNull()), (path, "has a wrong length", c.isNotNull() & ~T.has_length(c, 1, most))]

    def optional(path: str, c: Column, most: int) -> list[Rule]:
        return [(path, "has a wrong length", c.isNotNull() & ~T.has_length(c, 1, most))]

    edit, origin, probes = (lambda n: F.col(f"edit.{n}")), (lambda n: F.col(f"provenance.{n}")), (lambda n: F.col(f"probes.{n}"))
    rules: list[Rule] = [("$.schema_version", "is not supported", ~F.col("schema_version").eqNullSafe(F.lit("1.0.0"))), ("$.case_id", "is no identifier", ~T.is_identifier(F.col("case_id")))]
    rules += optional("$.description", F.col("description"), LENGTHS["description"])
    for n in ("subject", "prompt_template", "target_new"):
        rules += required(f"$.edit.{n}", edit(n), LENGTHS["edit"])
    rules += optional("$.edit.target_original", edit("target_original"), LENGTHS["edit"])
    rules.append(("$.edit.prompt_template", "must hold {subject} once and no other field", edit("prompt_template").isNotNull() & ~T.matches(edit("prompt_template"), _TEMPLATE)))
    rules.append(("$.edit.target_original", "must differ from target_new", edit("target_new") == edit("target_original")))
    for g in GROUPS:
        rules.append((f"$.probes.{g}", "is required", probes(g).isNull()))
        rules.append((f"$.probes.{g}", "has more than 10000 probes", F.size(probes(g)) > 10_000))
    rules.append(("$.probes.exact", "must hold a probe", probes("exact").isNotNull() & (F.size(probes("exact")) == 0)))
    for n in ("dataset_name", "dataset_license", "source"):
        rules += required(f"$.provenance.{n}", origin(n), LENGTHS[n])
    for n in ("dataset_version", "record_id", "citation"):
        rules += optional(f"$.provenance.{n}", origin(n), LENGTHS[n])
    return rules


def case_probes(cases: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``(*ids, grp, grp_ord, pos, probe_id, prompt, relation, target)``: one row per probe."""
    def group(i: int, g: str) -> Column:
        more = g == "portability"
        return F.transform(F.coalesce(F.col(f"probes.{g}"), F.array()), lambda p, at: F.struct(
            F.lit(g).alias("grp"), F.lit(i).alias("grp_ord"), at.cast("int").alias("pos"), p["probe_id"].alias("probe_id"), p["prompt"].alias("prompt"),
            (p["expected_relationship"]["relation"] if more else F.lit(None).cast("string")).alias("relation"), (p["expected_relationship"]["target"] if more else F.lit(None).cast("string")).alias("target"),
        ))

    return cases.select(*ids, F.explode(reduce(F.concat, [group(i, g) for i, g in enumerate(GROUPS)])).alias("p")).select(*ids, "p.*")


def metric_rules() -> list[Rule]:
    """Rules of a metric result against its own fields."""
    cov = lambda n: F.col(f"coverage.{n}")
    expected = F.when(cov("total") == 0, F.lit(0.0)).otherwise(cov("evaluated") / F.when(cov("total") != 0, cov("total")))
    known = F.col("status").isin("complete", "incomplete", "failed")
    return [
        ("$.status", "is unknown", F.coalesce(~known, F.lit(True))),
        ("$.aggregate", "must be a finite number", F.col("aggregate").isNotNull() & ~N.finite(F.col("aggregate"))),
        ("$.coverage.missing", "must be total less evaluated", cov("missing") != cov("total") - cov("evaluated")),
        ("$.coverage.fraction", "must be evaluated over total", N.finite(cov("fraction")) & (F.abs(cov("fraction") - expected) > 1e-12)),
        ("$.status", "complete needs every probe evaluated", (F.col("status") == "complete") & (cov("missing") != 0)),
        ("$.status", "incomplete needs a missing probe", (F.col("status") == "incomplete") & (cov("missing") == 0)),
        ("$.aggregate", "must be null when nothing was evaluated", (cov("evaluated") == 0) & F.col("aggregate").isNotNull()),
        ("$.aggregate", "must be there when a probe was evaluated", (cov("evaluated") > 0) & F.col("status").isin("complete", "incomplete") & F.col("aggregate").isNull()),
        ("$.threshold.passed", "must equal the declared comparison", F.col("threshold.passed") != T.threshold_holds(F.col("threshold.operator"), F.col("aggregate"), F.col("threshold.value"))),
        ("$.warnings", "must hold a warning unless complete", F.col("status").isin("incomplete", "failed") & (F.coalesce(F.size("warnings"), F.lit(0)) < 1)),
    ]


def probe_rules() -> list[Rule]:
    """Rules of one probe's evidence."""
    scores = F.col("baseline_mean_log_probability"), F.col("edited_mean_log_probability")
    complete = F.col("probe_status") == "evaluated"
    return [
        ("$.probe_id", "is no identifier", ~T.is_identifier(F.col("probe_id"))),
        *((f"$.{n}_mean_log_probability", "must be finite and not above 0", c.isNotNull() & ~(N.finite(c) & (c <= 0))) for n, c in zip(("baseline", "edited"), scores)),
        ("$.missing_reason", "must be there exactly when evidence is missing", ~T.valid_missing_reason(F.col("missing_reason"), complete)),
        ("$.absolute_delta", "must be the size of signed_delta", N.finite(F.col("signed_delta")) & N.finite(F.col("absolute_delta")) & (F.abs(F.col("signed_delta")) != F.col("absolute_delta"))),
    ]


def coverage_recount(declared: DataFrame, probes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Declared coverage that the probes do not bear out: ``(*key, field, declared, counted)``.

    ``probes`` holds one row per probe with ``evaluated`` (boolean); a key without probes counts 0.
    """
    counted = probes.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.count_if("evaluated").alias("evaluated"))
    rows = declared.join(counted, list(key), "left").fillna(0, ["total", "evaluated"]).withColumn("missing", F.col("total") - F.col("evaluated"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"coverage.{f}").alias("declared"), F.col(f).alias("counted")) for f in ("total", "evaluated", "missing"))))
    return rows.select(*key, each.alias("e")).select(*key, "e.*").where(F.col("declared") != F.col("counted"))
