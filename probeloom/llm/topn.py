"""The best N items of every group, from the highest scores down.

Scores are cut into descending bands by filters on the stored column, which reach the scan. Each
band is ranked exactly (all ties of a score lie in one band), groups that are filled are left out
of the bands below before anything is sorted, and the last band a group needs finishes it by the
full tie rule. The rank limit is applied within each task before the shuffle. Groups large enough
to matter for one task are known from a count, of which there can be only :data:`HOT_SHARE`; their
rows are ranked in salted shares first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.session import materialize

#: A group is hot when it holds more than one in so many rows; there are at most as many such groups.
HOT_SHARE = 5_000
#: Share of the rows in the top band, and in each that follows, from the top.
BANDS = (0.3,)
SALTS = 32
#: Most filled groups, and bytes of their keys, that are sent to every executor; more are left out after the rank limit by a shuffle.
FILLED_ROWS, FILLED_BYTES = 50_000, 4 << 20
INF = float("inf")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"h_{k}"]) for k in keys))


def top_n(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], n: int, *, bands: Sequence[float] = BANDS) -> DataFrame:
    """``(*keys, score, *ties, rank)``: the first ``n`` items of each group.

    Order: score descending, then ``ties`` ascending (strings by bytes, nulls first). Rows alike
    in group, score and ties are one item. Rows whose score is null, NaN or infinite take no
    part; null keys form groups. Groups with fewer items give what they have; an empty table
    gives no rows; other columns do not matter.
    """
    keys, ties = list(keys), list(ties)
    # on the column as it is, so that the scan can skip; NaN is above all numbers
    raw = df.select(*keys, score, *ties).where(F.col(score).isNotNull() & (F.col(score) > -INF) & (F.col(score) < INF))

    def rows(low: float | None = None, high: float | None = None) -> DataFrame:
        part = raw if low is None else raw.where(F.col(score) >= low)
        part = part if high is None else part.where(F.col(score) < high)
        return part.withColumn(score, F.col(score).cast("double") + F.lit(0.0))

    facts = raw.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(score).cast("double"), [1 - b for b in bands], 1000).alias("edges")).first()
    if not facts["n"]:
        return rows().withColumn("rank", F.lit(1)).limit(0)
    edges = sorted({float(e) for e in facts["edges"]}, reverse=True)
    named = [F.col(k).alias(f"h_{k}") for k in keys]
    # at most HOT_SHARE groups: a bounded broadcast
    hot = materialize(raw.groupBy(*keys).count().where(F.col("count") * HOT_SHARE > facts["n"]).select(*named, F.lit(True).alias("is_hot")))
    any_hot = not hot.isEmpty()
    order = [F.desc(score), *(F.asc(t) for t in ties)]

    def best(part: DataFrame, by: Sequence[str]) -> DataFrame:
        """The first n different items by dense rank, which Spark limits before the shuffle too."""
        return part.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

    filled: DataFrame | None = None
    sendable = False
    taken: list[DataFrame] = []
    for i in range(len(edges) + 1):
        band = rows(edges[i] if i < len(edges) else None, edges[i - 1] if i else None)
        if filled is not None and sendable:
            band = band.join(F.broadcast(filled), _same(band, filled, keys), "left_anti")
        if any_hot:
            salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(0))
            marked = band.join(F.broadcast(hot), _same(band, hot, keys), "left").select(*keys, score, *ties, salt.alias("salt"))
            band = best(marked, [*keys, "salt"]).select(*keys, score, *ties).distinct()
        own = best(band, keys).select(*keys, score, *ties).distinct()
        if filled is not None and not sendable:
            own = own.join(filled, _same(own, filled, keys), "left_anti")
        taken.append(materialize(own) if i < len(edges) else own)
        if i < len(edges):
            so_far = reduce(DataFrame.unionByName, taken)
            filled = materialize(so_far.groupBy(*keys).count().where(F.col("count") >= n).select(*named))
            size = filled.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(F.octet_length(F.col(f"h_{k}").cast("string")), F.lit(0)) + 16 for k in keys), F.lit(0))).alias("bytes")).first()
            sendable = size["n"] <= FILLED_ROWS and (size["bytes"] or 0) <= FILLED_BYTES
    return reduce(DataFrame.unionByName, taken).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
