"""Joins and groupings that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, keys: list[str], n: str, per_slot: int) -> DataFrame:
    """Keys with more than `per_slot` rows and the number of slots each is spread over. There are at most
    (rows / per_slot) of them, which bounds what `salted_join` broadcasts."""
    return counts.where(F.col(n) > per_slot).select(
        *keys, F.ceil(F.col(n) / F.lit(per_slot)).cast("int").alias("_slots")
    )


def salted_join(many: DataFrame, one: DataFrame, hot: DataFrame, keys: list[str], spread: Column, how: str = "inner"):
    """Join `many` (skewed on `keys`) with `one` (one row per key). Rows of a hot key are spread over its slots by
    the hash of `spread`; the single matching row is repeated once per slot."""
    many = many.join(F.broadcast(hot), keys, "left").withColumn(
        "_slot", F.when(F.col("_slots").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_slots")).cast("int"))
    ).drop("_slots")
    one = (
        one.join(F.broadcast(hot), keys, "left")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1)))
        .drop("_slots")
    )
    return many.join(one, [*keys, "_slot"], how).drop("_slot")
