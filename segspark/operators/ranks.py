"""Ranks within groups and running numbers of distinct values, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .segment import join_split
from .sparse import number_rows


def distinct_numbers(rows: DataFrame, by: list[str], value: str, out: str = "number") -> DataFrame:
    """(by, value, out): the distinct pairs of group and value, numbered from 0 in order of group, then value.

    Copies go before anything is dealt; pairs are dealt by ranges of the whole order, so a group of any share is numbered in many tasks. Nulls are values, the smallest.
    """
    return number_rows(rows.select(*by, value).distinct(), out, [*by, value])


def distinct_offsets(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, ptr_begin, ptr_end) of every group that has rows: the number of distinct values in all groups before it, and with its own. Empty rows give none."""
    numbered = distinct_numbers(rows, by, value, "_number")
    return numbered.groupBy(*by).agg(F.min("_number").alias("ptr_begin"), (F.max("_number") + 1).alias("ptr_end"))


def dense_ranks(rows: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """rows with out, a new column: the rank from 0 of value among the distinct values of its group by.

    A rank is a distinct pair's number less that of its group's first, so no window holds a group; hot groups and hot pairs are split in the joins. Nulls in
    either column are values and come first; equal rows have one rank; an empty table gives none.
    """
    numbered = stash(distinct_numbers(rows, by, value, "_number").withColumn("_group", F.struct(*by)), "numbers")
    begins = stash(numbered.groupBy("_group").agg(F.min("_number").alias("_begin")), "begins")
    pair = F.struct(*by, value)
    ranks = stash(join_split(numbered, begins, "_group").select(pair.alias("_pair"), (F.col("_number") - F.col("_begin")).alias(out)), "ranks")
    return join_split(rows.withColumn("_pair", pair), ranks, "_pair").drop("_pair")
