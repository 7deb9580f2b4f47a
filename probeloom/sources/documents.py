"""Strict JSON documents: bounded, UTF-8, no repeated keys, no numbers beyond JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024


class JsonDocumentError(ValueError):
    """The document cannot be read as strict JSON."""


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise JsonDocumentError("an object repeats a key")
    return out


def _refuse(name: str) -> object:
    raise JsonDocumentError(f"{name} is no JSON number")


def parse_strict(text: str | bytes) -> object:
    try:
        if isinstance(text, bytes):
            text = text.decode("utf-8")
        return json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)
    except JsonDocumentError:
        raise
    except (ValueError, RecursionError) as error:
        raise JsonDocumentError("the document is not valid JSON") from error


def read_document(path: str | Path, max_bytes: int = MAX_BYTES) -> object:
    """One local document of at most ``max_bytes``."""
    path = Path(path)
    try:
        if not path.is_file():
            raise JsonDocumentError("the input is no regular file")
        with path.open("rb") as f:
            data = f.read(max_bytes + 1)
    except OSError as error:
        raise JsonDocumentError("the input cannot be read") from error
    if len(data) > max_bytes:
        raise JsonDocumentError(f"the document is larger than {max_bytes} bytes")
    return parse_strict(data)


def scan_documents(spark: SparkSession, glob: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, size_bytes, payload, error)`` of every file; a file that is too large is not read."""
    files = spark.read.format("binaryFile").load(glob)
    large = F.col("length") > max_bytes
    rows = files.select("path", F.col("length").alias("size_bytes"), F.when(~large, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, errors = [], []
            for data in b.column(2).to_pylist():
                try:
                    if data is None:
                        raise JsonDocumentError(f"the document is larger than {max_bytes} bytes")
                    parse_strict(data)
                    payloads.append(data.decode("utf-8"))
                    errors.append(None)
                except JsonDocumentError as error:
                    payloads.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(payloads, pa.string()), pa.array(errors, pa.string())], names=["path", "size_bytes", "payload", "error"])

    return rows.mapInArrow(run, "path string, size_bytes bigint, payload string, error string")


def rename(document: object, names: dict[str, str]) -> object:
    """Foreign field names and labels replaced by ours, by a map that the caller supplies.

    Keys of objects and texts of the field ``encoding`` are replaced; all else stays.
    """
    if isinstance(document, dict):
        return {names.get(k, k): names.get(v, v) if k == "encoding" and isinstance(v, str) else rename(v, names) for k, v in document.items()}
    if isinstance(document, list):
        return [rename(v, names) for v in document]
    return document
