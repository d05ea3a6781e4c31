"""Index vectors: generators, noise, and scaling up or down."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normal, uniform
from .sparse import lookup_rows, number_rows, running_sum

LADDER = 12


def synthetic_index(spark: SparkSession, keys: int, least: int, most: int, total: int, cv: float, seed: int = 0) -> DataFrame:
    """Sorted items(pos, idx) of total rows: segment lengths are normal around total / keys with the coefficient of variation cv, clamped.

    Lengths are drawn per key (see scalars.normal(), so reruns agree), summed up in blocks, cut at total; the last key takes what remains. Positions look their key up.
    """
    mean = total / keys
    drawn = F.round(normal(seed, F.col("id")) * (cv * mean) + mean).cast("long")
    lengths = spark.range(keys).select(F.col("id").alias("idx"), F.least(F.greatest(drawn, F.lit(least)), F.lit(most)).cast("long").alias("n"))
    ends = running_sum(lengths, F.col("n"), "end", ["idx"])
    begin, end = F.col("end") - F.col("n"), F.when(F.col("idx") == keys - 1, F.lit(total)).otherwise(F.least("end", F.lit(total)))
    rows = ends.select(F.col("idx").alias("row"), begin.alias("ptr_begin"), end.cast("long").alias("ptr_end"))
    return lookup_rows(rows, spark.range(total).withColumnRenamed("id", "pos")).select("pos", F.col("row").alias("idx"))


def random_graph(ids: DataFrame, edges: int, dim: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """nodes(id, x) of ids(id), which are 0 .. n - 1, and edges(src, k, dst, w): so many out of every node to uniform others, with uniform weights and vectors. Reruns agree."""
    n = ids.count()
    out = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(edges - 1))).alias("k"))
    drawn = lambda what, *keys: uniform(seed, F.lit(what), *keys)
    table = out.select("src", "k", F.floor(drawn("dst", F.col("src"), F.col("k")) * n).alias("dst"), drawn("w", F.col("src"), F.col("k")).alias("w"))
    return ids.select("id", F.array(*[drawn("x", F.col("id"), F.lit(k)) for k in range(dim)]).alias("x")), table


def renumber(items: DataFrame) -> DataFrame:
    """items(pos, idx) sorted by idx, positions anew."""
    return number_rows(items.select("idx", F.col("pos").alias("_was")), "pos", ["idx", "_was"]).select("pos", "idx")


def noise_augment(items: DataFrame, variant: int = 0, seed: int = 0) -> DataFrame:
    """items(pos, idx) with noise below (rows - largest idx) / largest idx, sorted again; every variant has a seed of its own. Noise is drawn by seed and position, so reruns agree."""
    size, largest = items.agg(F.count("*"), F.max("idx")).first()
    span = int(max((size - (largest or 1)) / max(largest or 1, 1), 1))
    noisy = items.select("pos", (F.col("idx") + F.floor(uniform(seed + variant, F.col("pos")) * span)).cast("long").alias("idx"))
    return renumber(noisy)


def down_sample(items: DataFrame, scale: int, n: int | None = None) -> DataFrame:
    """(pos, idx): round(n / scale) evenly spaced rows, their values floor(idx / scale); n is the number of rows, counted if not given."""
    n = items.count() if n is None else n
    new = round(n / scale)
    wanted = items.sparkSession.range(new).select(F.col("id").alias("new_pos"), F.floor(F.col("id") * n / F.lit(max(new, 1))).cast("long").alias("pos"))
    return wanted.join(items, "pos").select(F.col("new_pos").alias("pos"), F.floor(F.col("idx") / scale).cast("long").alias("idx"))


def up_sample(items: DataFrame, scale: int, n: int | None = None) -> DataFrame:
    """(pos, idx): scale rows for each, interpolated at half-pixel centres and clamped at the ends, values floor(value * scale); n as above."""
    n = items.count() if n is None else n
    at = items.select(F.col("pos"), F.col("idx").alias("_low"))
    after = items.select((F.col("pos") - 1).alias("pos"), F.col("idx").alias("_high"))
    spot = (F.col("id") + 0.5) / scale - 0.5
    wanted = items.sparkSession.range(n * scale).withColumn("_at", F.greatest(spot, F.lit(0.0))).withColumn("pos", F.least(F.floor("_at"), F.lit(n - 1)).cast("long"))
    both = wanted.join(at, "pos").join(after, "pos", "left")
    part = F.col("_at") - F.col("pos")
    value = F.col("_low") + part * (F.coalesce("_high", "_low") - F.col("_low"))
    return both.select(F.col("id").alias("pos"), F.floor(value * scale).cast("long").alias("idx"))


def scale_exponents(rows: int) -> list[int]:
    """The powers of two of the ladder: down from floor(log2(rows / 1000)), then up."""
    base = max(rows // 1000, 1).bit_length() - 1
    return [base - i for i in range(LADDER)]


def scale_ladder(items: DataFrame) -> DataFrame:
    """(step, pos, idx): items at LADDER sizes, down-sampled while the exponent is positive, then up-sampled."""
    n = items.count()
    steps = [down_sample(items, 2**e, n) if e > 0 else up_sample(items, 2**-e, n) if e < 0 else items.select("pos", "idx") for e in scale_exponents(n)]
    return fold(DataFrame.union, [scaled.select(F.lit(step).alias("step"), "pos", "idx") for step, scaled in enumerate(steps)])


def arg_sort(items: DataFrame) -> DataFrame:
    """(rank, pos): positions in order of idx, ties by position."""
    return number_rows(items.select("idx", "pos"), "rank", ["idx", "pos"]).select("rank", "pos")
