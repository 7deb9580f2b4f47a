"""Snapshots that arrive as files, taken up once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probeloom.contracts.documents import validate_documents

SCHEMA = "snapshot_id string, received_at timestamp, payload string"


def snapshot_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """JSON lines of ``folder`` as a stream, a repeated snapshot within ``delay`` once."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    return rows.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["snapshot_id"])


def ingest(stream: DataFrame, kind: str, table: str, issues: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append valid documents to ``table`` and the issues of the others to ``issues``, batch by batch.

    A batch that is repeated after a failure overwrites its own folder, so nothing is doubled.
    """
    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        found = validate_documents(rows, kind, "snapshot_id", "payload")
        found.write.mode("overwrite").parquet(f"{issues}/batch={number}")
        bad = rows.sparkSession.read.parquet(f"{issues}/batch={number}").select("snapshot_id").distinct()
        good = rows.join(bad, "snapshot_id", "left_anti").withColumn("digest", F.sha2("payload", 256))
        good.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if each is not None:
            each(good, number)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
