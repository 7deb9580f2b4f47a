"""Records that differ only in their spelling, collapsed by sorting their canonical form.

Canonical records are range-partitioned by their whole key (and id, so that one key may span
many partitions), sorted on disk where memory ends, and scanned for runs of equal keys. The scan
gives every record its run's first id, which is the representative, and at the end of a run how
many copies it had. Only a partition's first and last run can go on in a neighbour; what they are
there is stitched from two rows per partition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeloom.session import materialize
from probeloom.sources.nested import loads

#: Characters of keys that a sorted partition holds on average at most.
PARTITION = 64 << 20


def fold(text: str) -> str:
    """Letters and digits of a text, without case; accented letters in their decomposed form."""
    if text.isascii():
        return "".join(filter(str.isalnum, text.lower()))
    plain = "".join(c for c in text if unicodedata.category(c) != "Cf")
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFD", plain).casefold())
    out, after_letter = [], False
    for c in plain:
        kind = unicodedata.category(c)[0]
        if kind in "LN" or (kind == "M" and after_letter):
            out.append(c)
            after_letter = kind in "LM"
        else:
            after_letter = False
    return "".join(out)


def canonical_record(payload: str | None) -> str | None:
    """The record's canonical form, or None when the payload is no such record.

    The template, the set of exact prompts and the set of paraphrase prompts, each folded; a
    missing, null or oddly typed part counts as empty. Payloads may be nested to any depth.
    """
    try:
        value = loads(payload.lstrip("﻿")) if payload else None
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    edit, probes = value.get("edit"), value.get("probes")
    template = edit.get("prompt_template") if isinstance(edit, dict) else None

    def prompts(group: str) -> list[str]:
        items = probes.get(group) if isinstance(probes, dict) else None
        items = items if isinstance(items, list) else [items] if items else []
        texts = (i.get("prompt") if isinstance(i, dict) else i for i in items)
        return sorted({fold(t) for t in texts if isinstance(t, str)})

    parts = [fold(template) if isinstance(template, str) else "", *("\x1e".join(prompts(g)) for g in ("exact", "paraphrase"))]
    return "\x1f".join(parts) if any(parts) else None


def canonical_keys(df: DataFrame, id_column: str, payload: str) -> DataFrame:
    """``(id, key)`` of every payload that is a record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([canonical_record(t) for t in b.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), keys], names=["id", "key"]).filter(pc.is_valid(keys))

    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(payload).alias("payload")).mapInArrow(run, "id bigint, key string")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in one sorted partition.

    A row ``(part, edge, id, kept_id)`` per record, then ``(part, edge, kept_id, copies)`` per run;
    ``edge`` is 0 in the partition's first run, 1 in its last, null in others. The rows of the two
    edge runs carry their key. Memory holds a batch and the ids of the open run.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["part", "edge", "id", "kept_id", "copies", "key"]

    def rows(edge: int | None, ids: pa.Array | None, kept: np.ndarray, copies: np.ndarray | None = None, key: str | None = None) -> pa.RecordBatch:
        n = len(kept)
        columns = [np.full(n, part, dtype=np.int32), pa.nulls(n, pa.int32()) if edge is None else np.full(n, edge, dtype=np.int32), pa.nulls(n, pa.int64()) if ids is None else ids]
        columns += [kept, pa.nulls(n, pa.int64()) if copies is None else copies, pa.array([key] * n, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    def of_open(edge: int | None) -> Iterator[pa.RecordBatch]:
        """The open run's records that wait."""
        yield from (rows(edge, a, np.full(len(a), kept)) for a in held)

    key, kept, copies, first = None, 0, 0, True  # the open run
    held: list[pa.Array] = []  # its ids, told apart only when it is known whether it is the last
    for batch in batches:
        keys, ids = batch.column("key"), batch.column("id")
        n = batch.num_rows
        if not n:
            continue
        starts = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
        if key is None:
            key, kept = keys[0].as_py(), ids[0].as_py()
        elif keys[0].as_py() != key:
            starts = np.concatenate([[0], starts])
        to = int(starts[0]) if len(starts) else n
        if to:
            copies += to
            held.append(ids.slice(0, to))
        if first:  # a run that fills the partition is its first as well as its last
            yield from of_open(0)
            held = []
        if not len(starts):
            continue
        yield from of_open(None)
        yield rows(0 if first else None, None, np.array([kept]), np.array([copies]), key if first else None)
        first, last = False, int(starts[-1])
        if last > to:
            sizes = np.diff(starts)
            lows = ids.take(pa.array(starts[:-1])).to_numpy()
            yield rows(None, ids.slice(to, last - to), np.repeat(lows, sizes))
            yield rows(None, None, lows, sizes)
        key, kept, copies, held = keys[last].as_py(), ids[last].as_py(), n - last, [ids.slice(last)]
    if key is not None:
        yield from of_open(1)
        yield rows(0 if first else 1, None, np.array([kept]), np.array([copies]), key)


def collapse(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, kept_id)`` and representatives ``(kept_id, copies)``: the smallest id of each key and the key's rows.

    ``keys`` holds ``(id, key)`` without nulls; it is read three times (for its size, for the
    range bounds and for the sort) and should be a table. Keys are compared in full. A key of any
    number of rows is spread over as many partitions as its ids need; there are more partitions
    than ``spark.sql.shuffle.partitions`` where the keys ask for it.
    """
    spark = keys.sparkSession
    size = keys.agg(F.sum(F.length("key").cast("bigint") + 16)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    ordered = keys.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    runs = materialize(ordered.mapInArrow(_scan, "part int, edge int, id bigint, kept_id bigint, copies bigint, key string"))
    # two rows per partition, of the runs that can go on in a neighbour
    edges = runs.where(F.col("id").isNull() & F.col("edge").isNotNull())
    same = Window.partitionBy("key")
    stitched = materialize(edges.select("part", "edge", F.min("kept_id").over(same).alias("true_id"), F.sum("copies").over(same).alias("total"), (F.row_number().over(same.orderBy("kept_id", "part")) == 1).alias("leads")))
    both = runs.drop("key").join(F.broadcast(stitched), ["part", "edge"], "left")
    members = both.where(F.col("id").isNotNull()).select("id", F.coalesce("true_id", "kept_id").alias("kept_id"))
    heads = both.where(F.col("id").isNull() & F.coalesce("leads", F.lit(True))).select(F.coalesce("true_id", "kept_id").alias("kept_id"), F.coalesce("total", "copies").alias("copies"))
    return members, heads


def spelling_copies(df: DataFrame, id_column: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, kept_id)`` and representatives ``(kept_id, copies)`` of the payloads that are records.

    Payloads that are null, damaged or hold none of the compared texts are no records and have
    no row. Rows with a null id are left out; a repeated id counts as often as it occurs.
    """
    return collapse(materialize(canonical_keys(df, id_column, payload)))
