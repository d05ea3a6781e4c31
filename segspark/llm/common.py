"""Connected components and joins on hot keys; tables in the cluster's shared folder come from the session helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, scratch, stash

__all__ = ["components", "discard", "join_hot", "least_of", "roots", "scratch", "stash"]

#: Rows of one key that are joined in one task.
HOT = 4096


def join_hot(rows: DataFrame, found: DataFrame, key: str, by: str | list[str], limit: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with found(key, n, ...), which has one row for each key and the number n of its rows.

    Keys of more than limit rows are split: their rows by the hash of by, their one row of found repeated for each part. The list of these
    keys has at most one entry for limit rows and is joined as its size on disk suggests.
    """
    by = [by] if isinstance(by, str) else by
    limit = HOT if limit is None else limit
    parts = F.ceil(F.col("n") / limit).cast("int")
    hot = stash(found.where(F.col("n") > limit).select(key, parts.alias("_parts")), "hot")
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")).drop("_parts")
    right = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [key, "_part"], how).drop("_part")


def least_of(rows: DataFrame, key: str, value: str, by: str, out: str, limit: int | None = None) -> DataFrame:
    """rows with the column out: the smallest value among the rows of their key. Hot keys are split by the hash of by."""
    least = stash(rows.groupBy(key).agg(F.min(value).alias(out), F.count("*").alias("n")), "least")
    return join_hot(rows, least, key, by, limit).drop("n")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the places 0 .. n - 1 that each is connected to by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        following = root.copy()
        for ends in (i, j, root[i], root[j]):
            np.minimum.at(following, ends, least)
        following = following[following]
        if (following == root).all():
            return root
        root = following


def stars(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every node to the smallest that the pairs of places (i, j) connect it with: the same few ends, however often and wherever they are found."""
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order] = np.arange(len(nodes))
    root = roots(len(nodes), rank[i], rank[j])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[order[moved]], nodes[order[root[moved]]]


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(u, v): one row (node, component) per node that has an edge.

    component is the smallest node reachable. Alternates large-star and small-star
    steps; each round is two aggregations and two joins over the edges and is written to the
    shared folder, and the number of rounds grows with the logarithm of the
    longest chain. Nothing but a row count and a checksum reaches the driver. A hub's edges to larger nodes are split; those to smaller ones, of which
    a node keeps one for each edge that it came with, are not. Self-loops and null ends are ignored; an empty input gives an empty result.
    """
    current = stash(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = _signature(current)
    while before[0]:
        both = current.union(current.select("v", "u"))
        low = stash(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "low")
        upward = both.where("v > u")
        joined = upward.join(low, "u") if low.where(F.col("n") > HOT).isEmpty() else join_hot(upward, low, "u", "v")
        large = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stash(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(current, low)
        current, after = following, _signature(following)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
