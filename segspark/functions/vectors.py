"""Vectors as array columns, and as long rows (keys, k, value)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(vectors: DataFrame, keys: list[str], column: str = "x", value: str = "value") -> DataFrame:
    return vectors.select(*keys, F.posexplode(column).alias("k", value))


def to_vectors(rows: DataFrame, keys: list[str], value: str = "value", column: str = "x") -> DataFrame:
    """The inverse of to_long(); a vector is as long as its key has rows."""
    ordered = F.array_sort(F.collect_list(F.struct("k", value)))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda s: s[value]).alias(column))


def _inner(a: pa.Array, b: pa.Array) -> pa.Array:
    """Inner products of two lists of vectors; null where one is null or has a null component, or where lengths differ."""
    offsets = [np.asarray(x.offsets, dtype=np.int64) - x.offsets[0].as_py() for x in (a, b)]
    known = np.asarray(a.is_valid()) & np.asarray(b.is_valid()) & (np.diff(offsets[0]) == np.diff(offsets[1]))
    if not known.all():
        at = pa.array(np.flatnonzero(known))
        some = _inner(a.take(at), b.take(at))
        return some.take(pa.array(np.where(known, np.cumsum(known) - 1, 0), mask=~known))
    flat = [x.flatten() for x in (a, b)]
    gaps = flat[0].null_count or flat[1].null_count
    product = np.multiply(*(x.to_numpy(zero_copy_only=False) for x in flat))
    starts, sizes = offsets[0][:-1], np.diff(offsets[0])
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0]:
        sums = product.reshape(len(sizes), -1).sum(axis=1)
    else:
        sums = np.where(sizes > 0, np.add.reduceat(np.r_[product, 0.0], np.minimum(starts, len(product))), 0.0) if len(sizes) else np.empty(0)
    return pa.array(sums, mask=np.isnan(sums) if gaps else None)


def dot(a: Column, b: Column) -> Column:
    """The inner product of vectors of any length, over whole Arrow batches: a fold over array cells costs several times as much."""
    return F.arrow_udf(_inner, "double")(a, b)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once a row: what a lambda only refers to is worked out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scale(a: Column, factor) -> Column:
    return F.transform(a, lambda v: v * factor)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def axpy(factor, a: Column, b: Column) -> Column:
    """factor * a + b."""
    return F.zip_with(a, b, lambda x, y: x * factor + y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def relu(a: Column) -> Column:
    return F.transform(a, lambda v: F.greatest(v, F.lit(0.0)))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)), F.lit(eps))
    return let(norm, lambda n: F.transform(a, lambda v: v / n))
