"""Comparing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value", atol: float = 1e-4, rtol: float = 0.01) -> DataFrame:
    """One row: cells, missing (on one side only), max_abs_diff, all_close (within atol), bad_relative (beyond rtol of the right value)."""
    a, b = F.col("_a"), F.col("_b")
    both = left.select(*keys, F.col(value).cast("double").alias("_a")).join(right.select(*keys, F.col(value).cast("double").alias("_b")), keys, "full_outer")
    diff = F.abs(a - b)
    lone = a.isNull() | b.isNull()
    return both.agg(
        F.count("*").alias("cells"), F.count_if(lone).alias("missing"), F.max(diff).alias("max_abs_diff"),
        F.coalesce(F.bool_and(~lone & (diff <= atol)), F.lit(True)).alias("all_close"), F.count_if(~lone & (diff > rtol * F.abs(b))).alias("bad_relative"),
    )


def worst_cells(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value", most: int = 10) -> DataFrame:
    """The cells of the largest differences, at most most of them, ties by key."""
    both = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys)
    return both.select(*keys, F.abs(F.col("_a") - F.col("_b")).alias("diff")).orderBy(F.desc("diff"), *keys).limit(most)
