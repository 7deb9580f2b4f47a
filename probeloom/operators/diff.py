"""Differences between two copies of one dataset.

Each side is reduced to its current row per key, unpivoted to key-field-value cells and unioned
with a sign (+1 left, -1 right). Grouping the cells by key and field then shows what does not
cancel: a key whose presence cells do not sum to zero is missing on one side; a text cell differs
when the signed count of one of its values is not zero, a number cell when its signed sum, or the
signed count of its nulls, NaNs or infinities, is not. Only one shuffle on the key is needed: the
unpivot and the groupings of the cells keep the partitioning of the first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELL = "struct<num:double,txt:string>"


def _side(df: DataFrame, sign: int, keys: Sequence[str], fields: Mapping[str, tuple[str, str]], order_by: str | None) -> DataFrame:
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    for i, (_, (kind, expr)) in enumerate(fields.items()):
        parts.append(F.expr(expr).cast("double" if kind == "number" else "string").alias(f"f{i}"))
    parts.append((F.col(order_by) if order_by else F.lit(None).cast("timestamp")).alias("at"))
    return df.select(*parts).withColumn("sign", F.lit(sign))


def diff_tables(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, tuple[str, str]],
    *,
    order_by: str | None = None,
    tolerance: float = 1e-9,
    only_left: str = "only_left",
    only_right: str = "only_right",
) -> DataFrame:
    """Rows ``(*keys, finding, left_number, right_number, left_text, right_text)`` for everything that does not cancel.

    ``fields`` maps the name of a finding to ``("number" | "text", SQL expression)``. Of several
    rows with one key on a side the one with the latest ``order_by`` counts (null is the oldest;
    rows of one instant are told apart by a hash of their fields, so the choice is the same in
    every run). Null keys are keys like any other. Texts differ unless both are null or the same
    string; numbers when exactly one is null, exactly one is NaN, or they are more than
    ``tolerance`` apart (equal infinities are not). Either table may be empty; columns not named do not matter. A key held by a third of
    all rows is combined before the shuffle, so it arrives as one row per task.
    """
    names = list(fields)
    key_names = [f"k{i}" for i in range(len(keys))]
    parts = [f"f{i}" for i in range(len(names))]
    both = _side(left, 1, keys, fields, order_by).unionByName(_side(right, -1, keys, fields, order_by))
    order = F.struct("at", F.xxhash64(*parts))
    row = F.struct(*parts)
    one = both.groupBy(*key_names).agg(
        F.max_by(F.when(F.col("sign") == 1, row), F.when(F.col("sign") == 1, order)).alias("l"),
        F.max_by(F.when(F.col("sign") == -1, row), F.when(F.col("sign") == -1, order)).alias("r"),
    )

    def cells(side: str, sign: int) -> Column:
        """The side's presence cell and its value cells; no cells when the key is absent there."""
        def cell(i: int | None, kind: str) -> Column:
            value = F.lit(None) if i is None else F.col(side)[f"f{i}"]
            num = value if kind == "number" else F.lit(None)
            txt = value if kind == "text" else F.lit(None)
            return F.struct(
                F.lit(-1 if i is None else i).alias("field"),
                F.struct(num.cast("double").alias("num"), txt.cast("string").alias("txt")).cast(_CELL).alias("v"),
                F.lit(sign).alias("sign"),
            )

        made = [cell(None, "key"), *(cell(i, fields[n][0]) for i, n in enumerate(names))]
        return F.when(F.col(side).isNotNull(), F.array(*made)).otherwise(F.array().cast(f"array<struct<field:int,v:{_CELL},sign:int>>"))

    cell_rows = one.select(*key_names, F.explode(F.concat(cells("l", 1), cells("r", -1))).alias("c")).select(*key_names, "c.*")
    num, sign = F.col("v.num"), F.col("sign")
    kinds = {"nulls": num.isNull(), "nans": F.isnan(num), "ups": num == float("inf"), "downs": num == float("-inf")}
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != float("inf"))
    values = cell_rows.groupBy(*key_names, "field", F.col("v.txt").alias("txt")).agg(
        F.sum("sign").alias("balance"),
        *(F.sum(F.when(is_so, sign).otherwise(0)).alias(kind) for kind, is_so in kinds.items()),
        F.sum(F.when(finite, num * sign).otherwise(0.0)).alias("apart"),
        F.max(F.when(sign == 1, num)).alias("ln"),
        F.max(F.when(sign == -1, num)).alias("rn"),
    )
    grouped = values.groupBy(*key_names, "field").agg(
        F.sum("balance").alias("balance"),
        F.max(F.abs("balance")).alias("uneven"),
        *(F.sum(kind).alias(kind) for kind in kinds),
        F.sum("apart").alias("apart"),
        F.max("ln").alias("ln"),
        F.max("rn").alias("rn"),
        F.max(F.when(F.col("balance") > 0, F.col("txt"))).alias("lt"),
        F.max(F.when(F.col("balance") < 0, F.col("txt"))).alias("rt"),
    )
    number = reduce(lambda a, b: a | b, (F.col(kind) != 0 for kind in kinds)) | (F.abs("apart") > F.lit(tolerance))
    uncancelled = F.when(F.col("field") < 0, F.col("balance") != 0)
    finding = F.when(F.col("field") < 0, F.when(F.col("balance") > 0, F.lit(only_left)).otherwise(F.lit(only_right)))
    for i, name in enumerate(names):
        # a value cell that only one side has belongs to a key reported as missing already
        uncancelled = uncancelled.when(F.col("field") == i, (F.col("balance") == 0) & (number if fields[name][0] == "number" else F.col("uneven") != 0))
        finding = finding.when(F.col("field") == i, F.lit(name))
    return grouped.where(uncancelled).select(
        *(F.col(k).alias(name) for k, name in zip(key_names, keys)),
        finding.alias("finding"),
        F.col("ln").alias("left_number"), F.col("rn").alias("right_number"), F.col("lt").alias("left_text"), F.col("rt").alias("right_text"),
    )
