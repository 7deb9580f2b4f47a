"""Parquet tables of a scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` below ``directory``; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
