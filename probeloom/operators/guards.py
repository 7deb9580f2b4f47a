"""What a reduction must not be given, as relations: ``(…, rule, detail)`` per offending row.

The caller decides whether any row is fatal. Limits are guards that name what exceeds them;
nothing is ever cut off.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.functions import numeric as N
from probeloom.functions import text as T

#: Limits of one reduction.
MAX_PROBES, MAX_POSITIONS, MAX_VOCABULARY, MAX_LOGITS = 10_000, 4_096, 65_536, 10_000_000
MAX_TENSORS, MAX_ELEMENTS, MAX_ALL_ELEMENTS, MAX_MULTIPLICATIONS = 10_000, 1_000_000, 10_000_000, 50_000_000


def _rows(df: DataFrame, ids: Sequence[str], checks: Sequence[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in checks)))
    return df.select(*ids, F.explode(found).alias("rule"))


def _repeated(df: DataFrame, by: Sequence[str], name: str, rule: str) -> DataFrame:
    return df.groupBy(*by, name).count().where(F.col("count") > 1).select(*by, name, F.lit(rule).alias("rule"))


def _over(df: DataFrame, by: Sequence[str], limit: int, name: str, rule: str, weight: Column | None = None) -> DataFrame:
    """Groups that exceed a limit, as rows without a name."""
    total = F.sum(weight) if weight is not None else F.count(F.lit(1))
    return df.groupBy(*by).agg(total.alias("n")).where(F.col("n") > limit).select(*by, F.lit(None).cast("string").alias(name), F.lit(rule).alias("rule"))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def paired_guards(pairs: DataFrame, by: Sequence[str], probe: str = "probe_id", baseline: str = "baseline", edited: str = "edited", reason: str = "missing_reason") -> DataFrame:
    """Probes that may not enter a paired reduction."""
    score = lambda c: F.col(c).isNotNull() & ~(N.finite(F.col(c)) & (F.col(c) <= 0))
    whole = F.col(baseline).isNotNull() & F.col(edited).isNotNull()
    rows = _rows(pairs, [*by, probe], [
        ("probe identifier", ~T.is_identifier(F.col(probe))), ("baseline score not finite and at most 0", score(baseline)), ("edited score not finite and at most 0", score(edited)),
        ("missing reason", ~T.valid_missing_reason(F.col(reason), whole)),
    ])
    return _all([rows, _repeated(pairs, by, probe, "duplicate probe"), _over(pairs, by, MAX_PROBES, probe, "too many probes")])


def logits_guards(probes: DataFrame, by: Sequence[str], probe: str = "probe_id", baseline: str = "baseline", edited: str = "edited", reason: str = "missing_reason") -> DataFrame:
    """Control probes, with logits as arrays of rows, that have no divergence."""
    width = lambda c: F.size(F.get(F.col(c), F.lit(0)))

    def shape(c: str) -> Column:
        sizes = F.array_distinct(F.transform(F.col(c), F.size))
        fits = F.size(c).between(1, MAX_POSITIONS) & (F.size(sizes) == 1) & width(c).between(2, MAX_VOCABULARY)
        return F.col(c).isNotNull() & ~(fits & F.forall(F.col(c), N.all_finite))

    both = F.col(baseline).isNotNull() & F.col(edited).isNotNull()
    rows = _rows(probes, [*by, probe], [
        ("probe identifier", ~T.is_identifier(F.col(probe))), ("baseline logits", shape(baseline)), ("edited logits", shape(edited)),
        ("position counts differ", both & (F.size(baseline) != F.size(edited))), ("vocabulary sizes differ", both & (width(baseline) != width(edited))),
        ("missing reason", ~T.valid_missing_reason(F.col(reason), both)),
    ])
    values = sum((F.when(F.col(c).isNotNull(), F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda n, r: n + F.size(r))).otherwise(F.lit(0)) for c in (baseline, edited)), F.lit(0))
    return _all([rows, _repeated(probes, by, probe, "duplicate probe"), _over(probes, by, MAX_PROBES, probe, "too many probes"), _over(probes, by, MAX_LOGITS, probe, "too many logits", values)])


def tensor_guards(inventory: DataFrame, pairs: DataFrame, by: Sequence[str], name: str = "name", shape: str = "shape", baseline: str = "baseline", edited: str = "edited", reason: str = "missing_reason", iterations: int | None = None) -> DataFrame:
    """Tensors that may not enter a structural reduction; limits count tensors without values too."""
    elements = F.aggregate(F.col(shape), F.lit(1).cast("bigint"), lambda n, d: n * d)
    listed = inventory.select(*by, name, shape, elements.alias("elements"))
    known = _rows(listed, [*by, name], [("shape", ~(F.size(shape).between(1, 16) & F.forall(shape, lambda d: d > 0))), ("too many elements", F.col("elements") > MAX_ELEMENTS)])
    keys = [*by, name]
    strangers = pairs.join(inventory.select(*keys), keys, "left_anti").select(*keys, F.lit("not in the inventory").alias("rule"))
    joined = pairs.join(listed, keys)
    whole = F.col(baseline).isNotNull() & F.col(edited).isNotNull()
    wrong = lambda c: F.col(c).isNotNull() & ((F.size(c) != F.col("elements")) | ~N.all_finite(F.col(c)))
    values = _rows(joined, keys, [
        ("baseline values", wrong(baseline)), ("edited values", wrong(edited)), ("missing reason", ~T.valid_missing_reason(F.col(reason), whole)),
        ("difference not finite", whole & ~N.all_finite(N.difference(F.col(baseline), F.col(edited)))),
    ])
    counts = [_repeated(inventory, by, name, "duplicate tensor"), _repeated(pairs, by, name, "duplicate pair"), _over(listed, by, MAX_TENSORS, name, "too many tensors"), _over(listed, by, MAX_ALL_ELEMENTS, name, "too many elements in all", F.col("elements"))]
    if iterations is not None:
        work = F.when(F.size(shape) == 2, 2 * F.col("elements") * iterations).otherwise(F.lit(0))
        counts.append(_over(joined.where(whole), by, MAX_MULTIPLICATIONS, name, "too much work for the spectral estimate", work))
    return _all([known, strangers, values, *counts])


def within_budget(rows: DataFrame, order: Sequence[Column], weight: str, limit: int, by: Sequence[str]) -> DataFrame:
    """The first row of each group at which the running total of ``weight`` exceeds ``limit``."""
    running = rows.withColumn("running", F.sum(weight).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return running.where(F.col("running") > limit).withColumn("_n", first).where(F.col("_n") == 1).drop("_n")


def model_pair_guards(pairs: DataFrame) -> DataFrame:
    """Pairs of model states that do not belong together; columns as in the checks, with ``pair_id``."""
    return _rows(pairs, ["pair_id"], [
        ("baseline state", ~F.col("baseline_kind").eqNullSafe(F.lit("baseline"))), ("edited state", ~F.col("edited_kind").eqNullSafe(F.lit("edited"))), ("states are the same", F.col("baseline_state_id").eqNullSafe(F.col("edited_state_id"))),
        ("models differ", ~F.col("baseline_model_id").eqNullSafe(F.col("edited_model_id"))), ("tokenizers differ", ~F.col("baseline_tokenizer_id").eqNullSafe(F.col("edited_tokenizer_id"))),
    ])


def trace_guards(requests: DataFrame) -> DataFrame:
    """Trace requests ``(trace_id, prompt, subject, target, modules, seed)`` that cannot be run."""
    blank = lambda c: F.col(c).isNull() | T.is_blank(F.col(c))
    return _rows(requests, ["trace_id"], [
        ("prompt", blank("prompt")), ("subject", blank("subject")), ("target", blank("target")), ("no module", F.coalesce(F.size("modules"), F.lit(0)) < 1),
        ("module repeated", F.size(F.array_distinct("modules")) != F.size("modules")), ("seed", F.col("seed").isNull() | ~F.col("seed").between(0, 4_294_967_295)),
    ])
