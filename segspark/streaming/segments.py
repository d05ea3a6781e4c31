"""Segment sums over a stream of edges. Beyond parity: the batch operators, kept up to date as edges arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import reduce_vectors


def streaming_gather_sum(edges: DataFrame, nodes: DataFrame, dim: int, weighted: bool = True) -> DataFrame:
    """(id, x): running weighted sums per destination of streamed edges(src, dst, w) against a fixed node table.

    A stream-static join and a stateful aggregation; run it in update or complete mode. State holds one vector per destination.
    """
    joined = edges.join(nodes.select(F.col("id").alias("src"), "x"), "src").withColumnRenamed("dst", "id")
    return reduce_vectors(joined, ["id"], "x", "sum", dim, F.coalesce("w", F.lit(1.0)) if weighted else None)


def windowed_degree(edges: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(start, id, degree) of streamed edges(time, src, dst) per tumbling window; edges later than late are dropped by the watermark."""
    counts = edges.withWatermark(time, late).groupBy(F.window(time, width), F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return counts.select(F.col("window.start").alias("start"), "id", "degree")
