"""Session defaults and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_numbers = itertools.count()


def build_session(app: str = "probeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators are written for (UTC, AQE, ANSI).

    ``conf`` entries use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting gets another one: a temporary folder in local mode
    (tests), else a folder below the SQL warehouse, which executors share as well.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    own = getattr(spark.sparkContext, "_probeloom_dir", None)
    if own is None:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            own = "file://" + tempfile.mkdtemp(prefix="probeloom-")
        else:
            own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_probeloom"
        spark.sparkContext._probeloom_dir = own
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, but computes the plan once, keeps the columns
    compressed and prunable, and survives the loss of executors. The folder is deleted when the
    application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-table-{next(_numbers)}"
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _made(spark).append(where)
    return spark.read.schema(df.schema).parquet(path)


def _made(spark: SparkSession) -> list:
    """Folders of the tables that :func:`materialize` wrote and that are still there."""
    context = spark.sparkContext
    if not hasattr(context, "_probeloom_tables"):
        context._probeloom_tables = []
    return context._probeloom_tables


def release(spark: SparkSession, kept: int = 0) -> None:
    """Delete the tables that :func:`materialize` wrote, but for the first ``kept``; results that need them must be done."""
    tables = _made(spark)
    for where in tables[kept:]:
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del tables[kept:]


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write within are deleted at the end, also when it fails."""
    kept = len(_made(spark))
    try:
        yield
    finally:
        release(spark, kept)
