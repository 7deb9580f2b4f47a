"""Percentiles of very large columns from merging centroid digests.

A digest clusters sorted values so that a cluster near quantile q holds at most about
``pi * sqrt(q * (1 - q)) / compression`` of the weight (the arcsine size function).
Digests are merged by clustering their centroids again, so digests of partitions, batches or
days combine into the digest of the whole; they meet in a tree of fixed fan-in, and a task holds
one group at a time. A second pass counts the rows below and at every estimate and so certifies
its rank error; where that is beyond the bound asked for, finer digests follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.session import materialize

COMPRESSION = 600
#: Most rows of estimates that are sent to every executor; beyond it the counting pass shuffles.
BROADCAST_ROWS = 20_000
#: Rows that a task gathers before it clusters them.
CHUNK = 1 << 18
#: Partitions whose digests of a group one task merges; more meet in several rounds.
FAN_IN = 256
SALTS = 16
#: Centroids that a task keeps before it hands its digests on.
HELD = 1 << 20
#: How much finer the digests are, and how often, where an estimate misses the bound.
FINER, ROUNDS = 4, 3


def cluster(code: np.ndarray, mean: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids ``(code, mean, weight)`` of weighted values, for all groups ``code`` at once.

    Values go to the cluster that the size function gives to the middle of their rank; groups of
    up to ``compression / 4`` values stay exact.
    """
    if not len(code):
        return code, mean, weight
    order = np.lexsort((mean, code))
    code, mean, weight = code[order], mean[order], weight[order]
    starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
    sizes = np.diff(np.append(starts, len(code)))
    total = np.repeat(np.add.reduceat(weight, starts), sizes)
    before = np.cumsum(weight) - weight
    before -= np.repeat(before[starts], sizes)
    q = np.clip((before + weight / 2) / total, 0.0, 1.0)
    bucket = np.floor(compression / math.pi * np.arcsin(2 * q - 1)).astype(np.int64)
    exact = np.repeat(sizes <= compression // 4, sizes)
    bucket = np.where(exact, np.arange(len(code)), bucket)
    change = np.flatnonzero((np.diff(code, prepend=code[0] - 1) != 0) | (np.diff(bucket, prepend=bucket[0] - 1) != 0))
    out_weight = np.add.reduceat(weight, change)
    first = mean[change]
    # relative to the first value of the cluster: equal values keep their value exactly
    out_mean = first + np.add.reduceat((mean - np.repeat(first, np.diff(np.append(change, len(code))))) * weight, change) / out_weight
    return code[change], out_mean, out_weight


def quantile(mean: np.ndarray, weight: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at quantile ``q``, between the centroids on either side of it."""
    middle = np.cumsum(weight) - weight / 2
    return float(np.interp(q * weight.sum(), np.concatenate(([0.0], middle, [weight.sum()])), np.concatenate(([low], mean, [high]))))


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", field string, n bigint, low double, high double, means array<double>, weights array<double>"


def _batch(keys: pa.Table, names: Sequence[str], field: pa.Array, code: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """One row per group; ``groups``: the first row of ``keys`` and ``field`` that has each code."""
    starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
    offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
    take = pa.array(groups)
    n = np.round(np.add.reduceat(weight, starts)).astype(np.int64)
    arrays = [keys.column(k).combine_chunks().take(take) if isinstance(keys.column(k), pa.ChunkedArray) else keys.column(k).take(take) for k in names]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    arrays += [field.take(take), pa.array(n), pa.array(low), pa.array(high), pa.ListArray.from_arrays(offsets, pa.array(mean)), pa.ListArray.from_arrays(offsets, pa.array(weight))]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "field", "n", "low", "high", "means", "weights"])


def _codes(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A dense code per row for the combination of the columns, and the first row of each code."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for name in names:
        part = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
        own = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    _, first = np.unique(code, return_index=True)
    return code, first


def partial_digests(df: DataFrame, keys: Sequence[str], fields: Sequence[str], compression: int = COMPRESSION) -> DataFrame:
    """Digests of every partition: one row per group and field in it (several for long partitions)."""
    keys, fields = list(keys), list(fields)

    schema = _schema(df, keys)

    def digest(table: pa.Table) -> pa.Table:
        code, first = _codes(table, keys)
        made = []
        for field in fields:
            value = table.column(field).combine_chunks().to_numpy(zero_copy_only=False)
            ok = np.isfinite(value)
            if not ok.any():
                continue
            c, m, w = cluster(code[ok], value[ok] + 0.0, np.ones(int(ok.sum())), compression)
            there = np.unique(c)
            low, high = np.full(len(first), np.inf), np.full(len(first), -np.inf)
            np.minimum.at(low, code[ok], value[ok])
            np.maximum.at(high, code[ok], value[ok])
            name = pa.array([field] * table.num_rows).dictionary_encode().dictionary_decode()
            made.append(_batch(table, keys, name, c, m, w, low[there], high[there], first[there]))
        return pa.Table.from_batches(made) if made else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, done = [], 0, None
        for batch in chain(batches, (None,)):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK or batch is None and rows:
                new = digest(pa.Table.from_batches(held))
                done = new if done is None else done if new is None else _merged(pa.concat_tables([done, new]), keys, compression)
                held, rows = [], 0
                if done is not None and len(done.column("means").combine_chunks().flatten()) > HELD:
                    yield from done.to_batches()
                    done = None
        if done is not None:
            yield from done.to_batches()

    plain = df.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields))
    return plain.mapInArrow(run, schema)


def _merged(table: pa.Table, keys: Sequence[str], compression: int) -> pa.Table:
    """One digest per group of the digests of a table."""
    code, first = _codes(table, [*keys, "field"])
    lengths = np.diff(table.column("means").combine_chunks().offsets.to_numpy())
    flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    c, m, w = cluster(np.repeat(code, lengths), flat("means"), flat("weights"), compression)
    low, high = np.full(len(first), np.inf), np.full(len(first), -np.inf)
    np.minimum.at(low, code, table.column("low").to_numpy())
    np.maximum.at(high, code, table.column("high").to_numpy())
    return pa.Table.from_batches([_batch(table, list(keys), table.column("field").combine_chunks(), c, m, w, low, high, first)])


def _merge_round(partials: DataFrame, keys: Sequence[str], compression: int) -> DataFrame:
    """Digests ``(*keys, field, part, ...)`` merged where group and part agree, one group after the other."""
    keys = list(keys)
    by = [*keys, "field", "part"]
    schema = _schema(partials, keys) + ", part bigint"
    names = [*keys, "field", "n", "low", "high", "means", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; what may go on in the next batch is held back."""
        open_group: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if open_group is not None:
                table = pa.concat_tables([open_group, table])
            code, _ = _codes(table, by)
            cut = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            if cut:
                yield from with_part(table.slice(0, cut))
            # the last group as far as it came, as one digest
            open_group = pa.Table.from_batches(list(with_part(table.slice(cut))))
        if open_group is not None:
            yield from open_group.to_batches()

    def with_part(table: pa.Table) -> Iterator[pa.RecordBatch]:
        made = _merged(table.combine_chunks(), [*keys, "part"], compression)
        yield from made.select([*names, "part"]).combine_chunks().to_batches()

    spread = partials.select(*names, "part").repartition(*by).sortWithinPartitions(*by)
    return spread.mapInArrow(run, schema)


def merge_digests(partials: DataFrame, keys: Sequence[str], compression: int = COMPRESSION) -> DataFrame:
    """One digest per group of ``keys`` and field, whatever the digests of ``partials`` stand for.

    Dropping a key (say the batch) merges the batches into the digest of the whole. Digests meet
    in a tree: each task merges those of up to :data:`FAN_IN` partitions, as they come, so a group
    of any number of digests is never in one task before it is that few.
    """
    own = partials.select(*keys, "field", "n", "low", "high", "means", "weights").withColumn("part", F.spark_partition_id().cast("bigint"))
    parts = partials.rdd.getNumPartitions()
    while True:
        own = own.withColumn("part", F.floor(F.col("part") / FAN_IN))
        own = _merge_round(own, keys, compression)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return own.drop("part")


def estimates(digests: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """``(*keys, field, n, values)``: the value at each of ``points``, in their order."""
    keys, points = list(keys), [float(p) for p in points]
    kinds = dict(digests.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means, weights = b.column("means"), b.column("weights")
            at, m, w = means.offsets.to_numpy(), means.values.to_numpy(), weights.values.to_numpy()
            wat, low, high = weights.offsets.to_numpy(), b.column("low").to_numpy(), b.column("high").to_numpy()
            made = [[quantile(m[at[i] : at[i + 1]], w[wat[i] : wat[i + 1]], low[i], high[i], p) for p in points] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("field"), b.column("n"), pa.array(made, type=pa.list_(pa.float64()))], names=[*keys, "field", "n", "values"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", field string, n bigint, values array<double>"
    return digests.select(*keys, "field", "n", "low", "high", "means", "weights").mapInArrow(run, schema)


def certify(df: DataFrame, found: DataFrame, keys: Sequence[str], fields: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Second pass: ``(*keys, field, percentile, value, n, rank_low, rank_high, rank_error)``.

    ``rank_low`` and ``rank_high`` are the shares of the group's finite values below and up to
    the estimate, ``rank_error`` how far the percentile lies outside them. The estimates go to
    all executors only when there are at most :data:`BROADCAST_ROWS` of them; more are joined by
    a shuffle in which every group is split into :data:`SALTS` salted shares.
    """
    keys, points = list(keys), list(points)
    found = materialize(found)
    small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields)))
    rows = df.select(*keys, pairs.alias("p")).select(*keys, "p.field", "p.x").where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    right = found.select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col("field").alias("e_field"), "values")
    on = [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys] + [F.col("field") == F.col("e_field")]
    if small:
        right = F.broadcast(right)
    else:
        right = right.withColumn("e_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        on.append(F.col("salt") == F.col("e_salt"))
    counted = rows.join(right, on, "inner").groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.col("x") < F.col("values")[i]).alias(f"lt{i}") for i in range(len(points))),
        *(F.count_if(F.col("x") <= F.col("values")[i]).alias(f"le{i}") for i in range(len(points))),
        *(F.first(F.col("values")[i]).alias(f"v{i}") for i in range(len(points))),
    )
    each = F.explode(F.array(*(
        F.struct(F.lit(float(p)).alias("percentile"), F.col(f"v{i}").alias("value"), (F.col(f"lt{i}") / F.col("rows")).alias("rank_low"), (F.col(f"le{i}") / F.col("rows")).alias("rank_high"))
        for i, p in enumerate(points)
    )))
    out = counted.select(*keys, "field", F.col("rows").alias("n"), each.alias("e")).select(*keys, "field", "n", "e.*")
    error = F.greatest(F.lit(0.0), F.col("rank_low") - F.col("percentile"), F.col("percentile") - F.col("rank_high"))
    return out.withColumn("rank_error", error)


def percentiles(df: DataFrame, keys: Sequence[str], fields: Sequence[str], points: Sequence[float], *, compression: int = COMPRESSION, max_error: float | None = None) -> DataFrame:
    """Certified percentiles of the finite values of ``fields`` for every group of ``keys``.

    Null, NaN and infinite values take no part; a group without a finite value has no row. Null
    keys form a group of their own. Ties, repeated rows and empty tables are handled; columns
    that are not named do not matter. With ``max_error`` the groups of which a counted rank error
    is beyond it are digested again, :data:`FINER` times as finely, up to :data:`ROUNDS` times;
    the certificate of what remains says how far it is off.
    """
    keys = list(keys)
    digests = merge_digests(partial_digests(df, keys, fields, compression), keys, compression)
    found = certify(df, estimates(digests, keys, points), keys, fields, points)
    if max_error is None:
        return found
    kept = []
    for again in range(1, ROUNDS + 1):
        found = materialize(found)
        missed = found.where(F.col("rank_error") > F.greatest(F.lit(max_error), 1 / F.col("n"))).select(*(F.col(k).alias(f"m_{k}") for k in keys)).distinct()
        if missed.isEmpty():
            break
        missed = materialize(missed)
        mine = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
        kept.append(found.join(missed, mine, "left_anti"))
        rest = df.select(*keys, *fields).join(missed, mine, "left_semi")
        finer = compression * FINER**again
        found = certify(rest, estimates(merge_digests(partial_digests(rest, keys, fields, finer), keys, finer), keys, points), keys, fields, points)
    for part in kept:
        found = found.unionByName(part)
    return found
