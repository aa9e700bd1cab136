"""Aggregation and top-k that don't put a hot key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def salted_distinct_count(rows: DataFrame, key: str, value: str, name: str, salts: int = 64) -> DataFrame:
    """Exact distinct count per key, with a hot key spread over ``salts`` tasks.

    Equal values share a salt, so the per-salt counts add up exactly.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    parts = salted.groupBy(key, "_salt").agg(F.count_distinct(value).alias("_n"))
    return parts.groupBy(key).agg(F.sum("_n").alias(name))


def top_k_per_group(rows: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps ``k`` per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
