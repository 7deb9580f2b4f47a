"""A sample that is the same in every run and only grows as records arrive.

Consistent weighted Poisson sampling: a record is chosen when the hash of its identifier, taken
as a number in [0, 1), is below ``weight * rate``. The state keeps the largest weight an
identifier ever had, so its inclusion probability never falls and a chosen record stays chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 52  # 13 hexadecimal digits, exact in a double


def unit_hash(identifier: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the identifier and the salt alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(salt + ":"), identifier.cast("string")), 256), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**HASH_BITS))


def running_weights(records: DataFrame, identifier: str, weight: Column, wave: str, rate: float, salt: str, state: DataFrame | None = None) -> DataFrame:
    """State after ``records``: ``(identifier, weight, first_wave)``, one row per identifier.

    ``weight`` is the running maximum; ``first_wave`` the earliest wave at which the identifier
    was below its threshold, null while it is not chosen. ``state`` is the result of an earlier
    call; extending it wave by wave gives what one call over all waves gives. Null identifiers
    cannot be sampled and are left out; null, NaN and negative weights count as 0. Rows of one
    identifier are combined before the shuffle, however many they are.
    """
    safe = F.when(weight.isNull() | F.isnan(weight) | (weight < 0), F.lit(0.0)).otherwise(weight)
    rows = records.where(F.col(identifier).isNotNull()).select(F.col(identifier).alias("id"), safe.alias("w"), F.col(wave).cast("int").alias("wave"))
    rows = rows.select("id", "w", F.when(unit_hash(F.col("id"), salt) < F.col("w") * rate, F.col("wave")).alias("first"))
    if state is not None:
        rows = rows.unionByName(state.select(F.col(identifier).alias("id"), F.col("weight").alias("w"), F.col("first_wave").alias("first")))
    return rows.groupBy("id").agg(F.max("w").alias("weight"), F.min("first").alias("first_wave")).withColumnRenamed("id", identifier)


def stable_sample(records: DataFrame, identifier: str, weight: Column, wave: str, *, rate: float, salt: str = "sample", state: DataFrame | None = None) -> DataFrame:
    """The chosen identifiers with their weight, probability and the wave that first chose them."""
    weights = running_weights(records, identifier, weight, wave, rate, salt, state)
    chosen = unit_hash(F.col(identifier), salt) < F.col("weight") * rate
    return weights.where(chosen).select(identifier, "weight", F.least(F.lit(1.0), F.col("weight") * rate).alias("probability"), "first_wave")
