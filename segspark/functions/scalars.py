"""Reductions by name and small column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_REDUCES: dict[str, Callable[..., Column]] = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "prod": F.product}
_ALIASES = {"amax": "max", "amin": "min"}


def reduction(name: str) -> Callable[..., Column]:
    """The aggregate of a reduce name: sum, mean, max (amax), min (amin) or prod."""
    found = _REDUCES.get(_ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown reduction {name!r}; known are {', '.join([*_REDUCES, *_ALIASES])}")
    return found


def uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 to below 1 that seed and keys alone decide: reruns, other partitionings and other engines agree.

    The first 13 hex digits of the MD5 of seed and keys joined by ':', in units of 2 ** -52.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number, likewise: the Box-Muller transform of two uniform ones."""
    one, two = uniform(seed, F.lit("r"), *keys), uniform(seed, F.lit("t"), *keys)
    return F.sqrt(-2 * F.log(1 - one)) * F.cos(two * (2 * math.pi))


def nearest_power_of_two(x: Column) -> Column:
    """2 to the rounded base-2 logarithm (half to even)."""
    return F.pow(F.lit(2.0), F.rint(F.log2(x)))


def inverse_sqrt(x: Column) -> Column:
    """x ** -0.5, and 0 where that isn't finite."""
    return F.when(x > 0, F.pow(x, F.lit(-0.5))).otherwise(0.0)


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("long")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def gflops(entries: Column, features: Column, millis: Column) -> Column:
    """Multiply-adds per time of a sparse product, in billions a second from milliseconds."""
    return entries * features / millis / 1e6


def sddmm_gflops(edges: Column, features: Column, seconds: Column) -> Column:
    return 2 * edges * features / seconds / 1e9


def dataset_name(path: Column) -> Column:
    """The last path segment without the suffix of index files."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "_idx\\.npy.*$", "")


def capitalized(text: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def relabel(column: Column, labels: dict[str, str]) -> Column:
    """Labels by a fixed table; values outside of it are null."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)
