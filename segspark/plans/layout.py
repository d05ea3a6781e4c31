"""How vectors are reduced: the one physical choice that Spark leaves to us.

Spark has no element-wise array aggregate. One aggregate per component keeps everything inside generated code, with partial
aggregation before the exchange, as long as the plan has fewer fields than spark.sql.codegen.maxFields (100 by
default). Wider vectors are cut into chunks of WIDTH components that are reduced as rows of their own. Collecting the
vectors of a key and folding them would need all of a hub's rows in one task, so that is never done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reduction

WIDTH = 64


def dim_of(vectors: DataFrame, column: str | Column = "x") -> int:
    """The length of the longest vector; 0 if there is none. One pass over the column; callers that know the length pass it on instead."""
    column = F.col(column) if isinstance(column, str) else column
    return vectors.agg(F.max(F.when(column.isNotNull(), F.size(column)))).first()[0] or 0


def reduce_vectors(rows: DataFrame, keys: list[str], column: str, how: str | list[str], dim: int, weight: Column | None = None) -> DataFrame:
    """(keys, column) with the vectors of column, times weight if given, reduced by component; components that a shorter vector lacks count for nothing.

    Several reductions are taken in one aggregate, their results joined end to end.
    """
    aggregates = [reduction(h) for h in ([how] if isinstance(how, str) else how)]
    scaled = (lambda v: v) if weight is None else (lambda v: F.col("_weight") * v)
    rows = rows.select(*keys, column) if weight is None else rows.select(*keys, column, weight.alias("_weight"))
    wide = max(1, WIDTH // len(aggregates))
    if dim <= wide:
        return rows.groupBy(*keys).agg(F.array(*[a(scaled(F.get(column, F.lit(k)))) for a in aggregates for k in range(dim)]).cast("array<double>").alias(column))
    chunks = F.array(*[F.slice(column, k + 1, wide) for k in range(0, dim, wide)])
    pieces = rows.select(*[c for c in rows.columns if c != column], F.posexplode(chunks).alias("_chunk", "_part"))
    parts = F.array(*[F.array(*[a(scaled(F.get("_part", F.lit(k)))) for k in range(wide)]) for a in aggregates])
    reduced = pieces.groupBy(*keys, "_chunk").agg(parts.alias("_parts"))
    ordered = F.array_sort(F.collect_list(F.struct("_chunk", "_parts")))
    of = lambda i: F.flatten(F.transform(ordered, lambda s: s["_parts"][i]))
    whole = F.concat(*[F.slice(of(i), 1, dim) for i in range(len(aggregates))])
    return reduced.groupBy(*keys).agg(whole.cast("array<double>").alias(column))
