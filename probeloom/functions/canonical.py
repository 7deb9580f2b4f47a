"""Canonical JSON and content identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of what a digest was taken of.
CANONICAL, RAW = "canonical-json-v1", "raw-bytes"


def canonical_text(value: object) -> str:
    """Sorted keys, no spaces, text as it is; tuples, keys that are no text and non-finite numbers are refused."""
    def native(v: object) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                if not isinstance(k, str):
                    raise TypeError("object keys must be text")
                native(x)
        elif isinstance(v, list):
            for x in v:
                native(x)
        elif v is not None and not isinstance(v, (str, int, float, bool)):
            raise TypeError(f"{type(v).__name__} is no JSON value")

    native(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def canonical_bytes(value: object) -> bytes:
    return canonical_text(value).encode("utf-8")


def hash_of(data: bytes, encoding: str = RAW) -> dict[str, object]:
    return {"algorithm": "sha256", "encoding": encoding, "digest": hashlib.sha256(data).hexdigest(), "size_bytes": len(data)}


def hash_json(value: object, encoding: str = CANONICAL) -> dict[str, object]:
    return hash_of(canonical_bytes(value), encoding)


def hash_file(path: str | Path, chunk: int = 1 << 20) -> dict[str, object]:
    """Digest of a local file, read in chunks."""
    if chunk <= 0:
        raise ValueError("chunk must be positive")
    state, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while piece := f.read(chunk):
            state.update(piece)
            size += len(piece)
    return {"algorithm": "sha256", "encoding": RAW, "digest": state.hexdigest(), "size_bytes": size}


def run_id(case_hash: dict[str, object], baseline: dict[str, object], edited: dict[str, object]) -> str:
    """Identity of a run, from the content of its three inputs."""
    whole = hash_json({"audit_case": case_hash, "baseline_snapshot": baseline["digest"], "edited_snapshot": edited["digest"]})
    return f"run-{whole['digest'][:24]}"


def run_id_column(case_digest: Column, case_size: Column, baseline_digest: Column, edited_digest: Column, encoding: str = CANONICAL) -> Column:
    """:func:`run_id` of many runs, from the digests of canonical documents."""
    case = F.concat(F.lit('{"algorithm":"sha256","digest":"'), case_digest, F.lit(f'","encoding":"{encoding}","size_bytes":'), case_size.cast("string"), F.lit("}"))
    whole = F.concat(F.lit('{"audit_case":'), case, F.lit(',"baseline_snapshot":"'), baseline_digest, F.lit('","edited_snapshot":"'), edited_digest, F.lit('"}'))
    return F.concat(F.lit("run-"), F.substring(F.sha2(whole, 256), 1, 24))


def report_id_column(run: Column) -> Column:
    """Identity of the report of a run."""
    return F.regexp_replace(run, "^run-", "report-")


def canonical_column(payload: Column) -> Column:
    """Canonical form of JSON texts; null for a text that is no strict JSON."""
    @F.pandas_udf("string")
    def canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from probeloom.sources.documents import JsonDocumentError, parse_strict

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else canonical_text(parse_strict(t))
            except (JsonDocumentError, TypeError, ValueError, RecursionError):
                return None

        for series in texts:
            yield series.map(one)

    return canonical(payload)


def with_identity(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``canonical``, ``digest`` and ``size_bytes`` of JSON texts; all null where they are no strict JSON."""
    out = df.withColumn("canonical", canonical_column(F.col(payload)))
    return out.withColumn("digest", F.sha2("canonical", 256)).withColumn("size_bytes", F.octet_length("canonical").cast("bigint"))


def file_identities(spark, glob: str) -> DataFrame:
    """``(path, digest, size_bytes)`` of files, whole files per row."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size_bytes"))
