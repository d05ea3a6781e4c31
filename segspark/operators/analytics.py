"""Analytics over tables of measurements."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nearest_power_of_two, uniform
from ..session import stash
from .segment import join_split
from .tree import JointTree


def index_features(items: DataFrame, by: str = "dataname", value: str = "idx") -> DataFrame:
    """(by, size, max, std, mean, avg) of index vectors; std over the population, avg = size / max."""
    stats = items.groupBy(by).agg(F.count("*").alias("size"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), F.avg(value).alias("mean"))
    return stats.withColumn("avg", F.try_divide(F.col("size"), F.col("max")))


def best_rows(rows: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of the largest score, a number, per group; of equal ones the first by ties. NaN is the largest score, null the smallest.

    One aggregate: each task keeps its best row of a group, so a group of any size moves one row a task.
    """
    worth = F.col(score)
    if rows.schema[score].dataType.typeName() in ("byte", "short", "integer", "long"):
        falling = [F.bitwise_not(worth)]  # unlike a minus it can't overflow
    else:
        falling = [~F.isnan(worth), -worth]
    best = F.min_by(F.struct(*rows.columns), F.struct(worth.isNull(), *falling, *ties))
    return rows.groupBy(*by).agg(best.alias("_best")).select("_best.*")


def summarize(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, min, mean, max) of value."""
    return rows.groupBy(*by).agg(F.min(value).alias(f"min_{value}"), F.avg(value).alias(f"mean_{value}"), F.max(value).alias(f"max_{value}"))


def geometric_mean(value: Column) -> Column:
    """Through the mean of logarithms, so that long groups don't overflow."""
    return F.exp(F.avg(F.ln(value)))


def ratio_of(rows: DataFrame, by: list[str], label: str, value: str, base: str, others: list[str], how=geometric_mean) -> DataFrame:
    """(by, one column per label in others): how(value) of base over how(value) of the label."""
    of = lambda name: how(F.when(F.col(label) == name, F.col(value)))
    return rows.groupBy(*by).agg(*[(of(base) / of(name)).alias(name) for name in others])


def share_of_total(rows: DataFrame, by: list[str], label: str, value: str, named: list[str], rest: str = "Others") -> DataFrame:
    """(by, label, share): percent of the group's sum of value for the named labels and for what remains."""
    name = F.when(F.col(label).isin(*named), F.col(label)).otherwise(rest)
    sums = rows.groupBy(*by, name.alias(label)).agg(F.sum(value).alias("_sum"))
    return sums.select(*by, label, (100 * F.col("_sum") / F.sum("_sum").over(Window.partitionBy(*by))).alias("share"))


def ratio_to_first(rows: DataFrame, by: list[str], value: str, order: list[Column], out: str = "ratio") -> DataFrame:
    """rows with the value of the group's first row, in ascending order, over the row's own.

    First values are aggregated, one a group, and joined back; where there are too many to broadcast, hot groups are split. Nulls in by are a group, nulls in order come first.
    """
    group = F.struct(*by)
    firsts = stash(rows.groupBy(group.alias("_group")).agg(F.min_by(value, F.struct(*order)).alias("_first")), "firsts")
    found = join_split(rows.withColumn("_group", group), firsts, "_group")
    return found.select(*rows.columns, (F.col("_first") / F.col(value)).alias(out))


def melt(rows: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, values, name, value)


def pivot(rows: DataFrame, index: list[str], column: str, values: list, value: str) -> DataFrame:
    """One column per listed value of column; of several cells the smallest."""
    return rows.groupBy(*index).pivot(column, values).agg(F.min(value))


def merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def outer_merge_least(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on, value_x, value_y, value): all keys of either side, and the smaller of what is there."""
    joined = left.select(*on, F.col(value).alias(f"{value}_x")).join(right.select(*on, F.col(value).alias(f"{value}_y")), on, "full_outer")
    return joined.withColumn(value, F.least(f"{value}_x", f"{value}_y"))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All combinations of two small dimension tables."""
    return left.crossJoin(right)


def lookup(rows: DataFrame, measured: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with value by several keys; 0 where nothing was measured."""
    return rows.join(measured.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def sort_by_labels(rows: DataFrame, column: str, labels: list[str], *then: str) -> DataFrame:
    """Order by a list of labels; other values come first."""
    return rows.orderBy(F.array_position(F.lit(labels), F.col(column)), *then)


def top(rows: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(value), *ties).limit(k)


def distinct_sorted(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def stack_rows(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns go by name and may be missing."""
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def side_by_side(frames: list[DataFrame], key: str) -> DataFrame:
    """Columns of frames that share a row key."""
    return fold(lambda a, b: a.join(b, key), frames)


class ConfigModel:
    """One regression tree of all outputs over (feature_size, size, avg), fitted on 80 % of the rows; predictions are powers of two."""

    INPUTS = ("feature_size", "size", "avg")

    def __init__(self, outputs: list[str], depth: int = 5, seed: int = 42):
        self.outputs, self.depth, self.seed = outputs, depth, seed

    def in_train(self, keys: list[str]) -> Column:
        """Whether a row is one of the 80 %: a number drawn by seed and keys decides, so reruns and other partitionings agree."""
        return uniform(self.seed, *(F.col(k) for k in keys)) < 0.8

    def split(self, rows: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows to fit and rows to test; keys (all columns if not given) tell rows apart."""
        chosen = self.in_train(keys or rows.columns)
        return rows.where(chosen), rows.where(~chosen)

    def fit(self, rows: DataFrame) -> ConfigModel:
        self.tree = JointTree(list(self.INPUTS), self.outputs, self.depth).fit(rows)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        snapped = {f"pred_{c}": nearest_power_of_two(F.greatest(F.rint(f"pred_{c}"), F.lit(1.0))) for c in self.outputs}
        return self.tree.predict(rows).withColumns(snapped)


def root_mean_squared_error(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg(F.pow(a - b, 2)))
