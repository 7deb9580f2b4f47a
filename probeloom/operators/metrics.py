"""The metric engine: paired reductions, sequence scores, divergence, structure and tracing.

Every operator takes any number of cases, probes or tensors at once; the grouping columns are
parameters. Missing evidence stays null and keeps its row; it is never counted as zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.functions import numeric as N


@dataclass(frozen=True)
class PairedMetric:
    """How a probe group is reduced: by the signed or by the absolute difference."""

    group: str
    metric_id: str
    direction: str
    absolute: bool


#: The paired metrics in the order of their groups.
PAIRED = (
    PairedMetric("exact", "efficacy.mean_target_log_probability_delta", "higher-is-better", False),
    PairedMetric("paraphrase", "generality.mean_target_log_probability_delta", "higher-is-better", False),
    PairedMetric("locality", "locality.mean_absolute_target_log_probability_delta", "lower-is-better", True),
    PairedMetric("portability", "portability.mean_expected_target_log_probability_delta", "higher-is-better", False),
)
CONTROL_METRIC = "control.mean_kl_divergence"
REDUCTION = "arithmetic_mean_over_available_probes"


def paired_evidence(pairs: DataFrame, baseline: str, edited: str, absolute: Column | bool = False) -> DataFrame:
    """One row per probe with ``signed_delta``, ``absolute_delta``, ``contribution`` and ``complete``.

    The differences are null unless both sides are there. ``absolute``: whether the contribution
    of a row is the absolute difference.
    """
    flag = absolute if isinstance(absolute, Column) else F.lit(absolute)
    both = F.col(baseline).isNotNull() & F.col(edited).isNotNull()
    out = pairs.withColumn("complete", both).withColumn("signed_delta", F.col(edited) - F.col(baseline))
    out = out.withColumn("absolute_delta", F.abs("signed_delta"))
    return out.withColumn("contribution", F.when(flag, F.col("absolute_delta")).otherwise(F.col("signed_delta")))


def coverage_warning(evaluated: Column, total: Column, what: str = "probes", singular: str | None = None) -> Column:
    """The coverage remark of a reduction, null when it is complete."""
    missing = total - evaluated
    noun = F.lit(what) if singular is None else F.when(missing == 1, F.lit(singular)).otherwise(F.lit(what))
    noun = F.concat(F.lit("missing "), F.regexp_replace(noun, "^control ", ""))
    none = F.concat(F.lit("aggregate unavailable: evaluated 0 of "), total, F.lit(f" {what} because every pair is incomplete"))
    some = F.concat(F.lit("partial coverage: evaluated "), evaluated, F.lit(" of "), total, F.lit(f" {what}; aggregate excludes "), missing, F.lit(" "), noun)
    return F.when(missing == 0, F.lit(None)).when(evaluated == 0, none).otherwise(some)


def reduce_paired(evidence: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean contribution over the complete pairs of each group, with its coverage.

    A group without a complete pair has a null aggregate and a coverage of 0. Decimal
    contributions are summed exactly.
    """
    out = evidence.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("contribution").alias("evaluated"),
        F.sum("contribution").cast("double").alias("aggregate"),
    )
    out = out.withColumn("aggregate", F.try_divide("aggregate", "evaluated"))
    out = out.withColumn("missing", F.col("total") - F.col("evaluated")).withColumn("fraction", F.col("evaluated") / F.col("total"))
    return out.withColumn("warning", coverage_warning(F.col("evaluated"), F.col("total")))


def token_log_probabilities(rows: DataFrame, logits: str, target: str) -> DataFrame:
    """``log_probability`` of the target entry of every row of logits; null when it is out of range."""
    return rows.withColumn("log_probability", N.selected_log_softmax(F.col(logits), F.col(target)))


def sequence_log_probability(rows: DataFrame, by: Sequence[str], logits: str, target: str) -> DataFrame:
    """Sum and mean of the token log-probabilities of each sequence."""
    return token_log_probabilities(rows, logits, target).groupBy(*by).agg(
        F.sum("log_probability").alias("sum_log_probability"), F.avg("log_probability").alias("mean_log_probability"), F.count(F.lit(1)).alias("tokens")
    )


def position_divergence(pairs: DataFrame, baseline: str, edited: str, temperature: float = 1.0) -> DataFrame:
    """``kl`` of every position; null where a side is missing."""
    both = F.col(baseline).isNotNull() & F.col(edited).isNotNull()
    return pairs.withColumn("kl", F.when(both, N.directed_kl(F.col(baseline), F.col(edited), temperature)))


def probe_divergence(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over the positions of each probe; a probe with a missing position has none.

    Its known positions still count in ``positions``.
    """
    out = positions.groupBy(*by).agg(F.count(F.lit(1)).alias("positions"), F.count("kl").alias("known"), F.avg("kl").alias("mean_kl"))
    whole = F.col("known") == F.col("positions")
    return out.withColumn("mean_kl", F.when(whole, F.col("mean_kl"))).withColumn("evaluated_positions", F.when(whole, F.col("positions")).otherwise(F.lit(0))).drop("known")


def reduce_divergence(probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the probes' means: every probe weighs the same, however many positions it has."""
    out = probes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("mean_kl").alias("evaluated"), F.avg("mean_kl").alias("aggregate"),
        F.sum("positions").alias("total_positions"), F.sum("evaluated_positions").alias("evaluated_positions"),
    )
    out = out.withColumn("fraction", F.when(F.col("total") > 0, F.col("evaluated") / F.col("total")))
    return out.withColumn("warning", coverage_warning(F.col("evaluated"), F.col("total"), "control probes", "control probe"))


# Remarks of structural evidence.
NO_RELATIVE = "relative delta Frobenius norm unavailable because baseline norm is zero"
NOT_RANK_2 = "spectral estimate unavailable because the tensor is not rank 2"
ESTIMATE = "spectral norm is a deterministic power-iteration estimate, not an exact SVD"
NO_EVIDENCE = "tensor evidence is missing"
NO_AGGREGATE = "aggregate relative delta unavailable because evaluated baseline norm is zero"
DESCRIPTIVE = "structural magnitude is descriptive evidence only and is not automatically interpreted as semantic harm or model safety"


def tensor_differences(inventory: DataFrame, pairs: DataFrame, name: str, baseline: str, edited: str, *, columns: str | None = None, iterations: int | None = None) -> DataFrame:
    """Norms of every inventoried tensor; tensors without a complete pair keep a row of nulls.

    ``pairs`` holds flat values. With ``iterations`` the spectral norm is estimated for tensors
    whose ``columns`` (width of a row of a rank-2 tensor) is not null. The relative norm is null
    on a zero baseline.
    """
    rows = inventory.join(pairs, name, "left")
    both = F.col(baseline).isNotNull() & F.col(edited).isNotNull()
    rows = rows.withColumn("status", F.when(both, F.lit("evaluated")).otherwise(F.lit("missing")))
    rows = rows.withColumn("_delta", F.when(both, N.difference(F.col(baseline), F.col(edited))))
    rows = rows.withColumn("baseline_norm", F.when(both, N.euclidean(F.col(baseline)))).withColumn("edited_norm", F.when(both, N.euclidean(F.col(edited))))
    rows = rows.withColumn("delta_norm", N.euclidean(F.col("_delta"))).withColumn("relative_norm", F.try_divide("delta_norm", "baseline_norm"))
    if iterations is not None:
        if not 1 <= iterations <= 1000 or isinstance(iterations, bool):
            raise ValueError("iterations must lie between 1 and 1000")
        width = F.col(columns) if columns else F.lit(None).cast("int")
        matrix = F.transform(F.sequence(F.lit(0), (F.size("_delta") / width).cast("int") - 1), lambda r: F.slice(F.col("_delta"), r * width + 1, width))
        rows = rows.withColumn("spectral_norm", F.when(both & width.isNotNull(), N.power_iteration(matrix, iterations)))
    remarks = [F.when(both & (F.col("baseline_norm") == 0.0), F.lit(NO_RELATIVE))]
    if iterations is not None:
        remarks += [F.when(both & width.isNull(), F.lit(NOT_RANK_2)), F.when(both & width.isNotNull(), F.lit(ESTIMATE))]
    remarks.append(F.when(~both, F.lit(NO_EVIDENCE)))
    return rows.withColumn("warnings", F.array_compact(F.array(*remarks))).drop("_delta", baseline, edited)


def structural_summary(tensors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Norm over the tensors' norms, with status and coverage; null when none is evaluated."""
    square = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    out = tensors.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count("delta_norm").alias("evaluated"), square("delta_norm").alias("aggregate_delta"), square("baseline_norm").alias("_base"))
    out = out.withColumn("aggregate_relative", F.try_divide("aggregate_delta", "_base"))
    evaluated, total = F.col("evaluated"), F.col("total")
    missing = total - evaluated
    partial = F.concat(F.lit("partial structural coverage: evaluated "), evaluated, F.lit(" of "), total, F.lit(" inventoried tensors; aggregates exclude "), missing, F.when(missing == 1, F.lit(" missing tensor")).otherwise(F.lit(" missing tensors")))
    none = F.concat(F.lit("structural aggregates unavailable: evaluated 0 of "), total, F.lit(" inventoried tensors"))
    remarks = F.array(F.when(missing == 0, F.lit(None)).when(evaluated == 0, none).otherwise(partial), F.when(F.col("_base") == 0.0, F.lit(NO_AGGREGATE)), F.lit(DESCRIPTIVE))
    out = out.withColumn("warnings", F.array_compact(remarks)).drop("_base")
    out = out.withColumn("fraction", F.when(F.col("total") > 0, F.col("evaluated") / F.col("total")))
    status = F.when(F.col("evaluated") == 0, F.lit("unavailable")).when(F.col("evaluated") < F.col("total"), F.lit("incomplete")).otherwise(F.lit("complete"))
    return out.withColumn("status", status)


ZERO_GAP = "recovery unavailable because the clean and corrupted scores are equal"


def causal_recovery(runs: DataFrame, clean: str, corrupted: str, restored: str) -> DataFrame:
    """``delta`` and ``recovery`` of every restored module; not clipped, null on a zero gap."""
    gap = F.col(clean) - F.col(corrupted)
    out = runs.withColumn("delta", F.col(restored) - F.col(corrupted))
    return out.withColumn("recovery", F.try_divide(F.col("delta"), gap)).withColumn("warning", F.when(gap == 0, F.lit(ZERO_GAP)))


def single_corruption(runs: DataFrame, trace: str, corruption: str) -> DataFrame:
    """Traces whose runs did not all use one corruption."""
    return runs.groupBy(trace).agg(F.count_distinct(corruption).alias("corruptions")).where(F.col("corruptions") != 1)


def module_mismatch(requested: DataFrame, returned: DataFrame, trace: str, module: str) -> DataFrame:
    """Per trace the requested modules that are missing and the returned ones that are unexpected, sorted."""
    a = requested.select(trace, module).distinct().withColumn("asked", F.lit(True))
    b = returned.select(trace, module).distinct().withColumn("given", F.lit(True))
    both = a.join(b, [trace, module], "full").where(F.col("asked").isNull() | F.col("given").isNull())
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col(module)))), ", ")
    return both.groupBy(trace).agg(names("given").alias("missing"), names("asked").alias("unexpected"))


def reports_with(first: DataFrame, second: DataFrame, key: Sequence[str] | str, contract: Sequence[str], aggregate: str, status: str) -> DataFrame:
    """Metric by metric comparison of two reports, B minus A.

    ``presence`` tells which report has the metric. A difference is given only when both have it
    under one contract (the columns ``contract``) and both aggregates are there; one that is not
    finite is null, with a warning, and stays comparable.
    """
    keys = [key] if isinstance(key, str) else list(key)
    named = lambda df, side: df.select(*keys, F.lit(True).alias(f"in_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in (*contract, aggregate, status)))
    rows = named(first, "a").join(named(second, "b"), keys, "full")
    have = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    presence = F.when(have, F.lit("both")).when(F.col("in_a").isNotNull(), F.lit("only-a")).otherwise(F.lit("only-b"))
    unequal = F.array_compact(F.array(*(F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), F.lit(c)) for c in contract))) if contract else F.array().cast("array<string>")
    a, b = F.col(f"{aggregate}_a").cast("double"), F.col(f"{aggregate}_b").cast("double")
    rows = rows.withColumn("presence", presence).withColumn("_unequal", F.when(have, unequal).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("comparable", have & (F.size("_unequal") == 0)).withColumn("_d", b - a)
    delta = F.when(F.col("comparable") & N.finite(F.col("_d")), F.col("_d"))
    warnings = F.array_compact(F.array(
        F.when(F.col("presence") == "only-b", F.lit("metric is absent from report_a")),
        F.when(F.col("presence") == "only-a", F.lit("metric is absent from report_b")),
        F.when(F.size("_unequal") > 0, F.concat(F.lit("metric contract differs across reports: "), F.array_join("_unequal", ", "))),
        F.when(F.col("comparable") & (a.isNull() | b.isNull()), F.lit("aggregate delta unavailable because at least one aggregate is null")),
        F.when(F.col("comparable") & F.col("_d").isNotNull() & ~N.finite(F.col("_d")), F.lit("aggregate delta is outside the finite float range")),
        F.when(F.col("comparable") & ((F.col(f"{status}_a") != "complete") | (F.col(f"{status}_b") != "complete")), F.lit("at least one metric result is not complete")),
    ))
    return rows.withColumn("aggregate_delta_b_minus_a", delta).withColumn("warnings", warnings).drop("_unequal", "_d", "in_a", "in_b")


def first_duplicates(rows: DataFrame, key: Sequence[str], order: Sequence[Column], path: Column) -> DataFrame:
    """Every row of a key but its first by ``order``, with the path of the first."""
    window = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("path", path).withColumn("occurrence", F.row_number().over(window)).withColumn("first_path", F.first("path").over(window))
    return marked.where(F.col("occurrence") > 1)


def coverage_gap(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Identifiers on one side only: ``(key, side)`` with side ``missing`` or ``extra``."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def mismatched_fields(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields that differ, in the order of ``a``; null equals null."""
    return F.array_compact(F.array(*(F.when(~a[n].eqNullSafe(b[n]), F.lit(n)) for n in a)))


def contaminated(reads: DataFrame, before: str, edited: str, after: str) -> DataFrame:
    """Pairs of which the baseline, read again after the edit was scored, is not what it was."""
    return reads.where(~F.col(before).eqNullSafe(F.col(after)))


#: The states a run may go to from each state.
TRANSITIONS = {None: ("running",), "running": ("completed", "failed", "incomplete")}


def invalid_transitions(events: DataFrame, run: Sequence[str], state: str, order: Sequence[Column], allowed: dict = TRANSITIONS) -> DataFrame:
    """Events whose state may not follow the state before them in their run."""
    previous = F.lag(state).over(Window.partitionBy(*run).orderBy(*order))
    rows = events.withColumn("previous", previous)
    good = F.lit(False)
    for source, targets in allowed.items():
        good = good | ((F.col("previous").isNull() if source is None else F.col("previous") == source) & F.col(state).isin(*targets))
    return rows.where(~F.coalesce(good, F.lit(False)))
