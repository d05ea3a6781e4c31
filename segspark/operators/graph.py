"""Graph tables: loading, validation, self loops, symmetric normalisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import inverse_sqrt
from .sparse import coalesce_edges, weighted_degree

DEFAULT_WIDTH = 32


@dataclass
class Graph:
    """nodes(id, x, y) and edges(eid?, src, dst, w)."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_tables(cls, nodes: DataFrame, edges: DataFrame, width: int = DEFAULT_WIDTH) -> Graph:
        """Fill what is absent: zero features of the given width, weight 1."""
        x = F.coalesce("x", F.array_repeat(F.lit(0.0), width)) if "x" in nodes.columns else F.array_repeat(F.lit(0.0), width)
        w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
        return cls(nodes.withColumn("x", x), edges.withColumn("w", w))

    def summary(self) -> DataFrame:
        """One row: num_nodes, num_edges, in_channels, num_classes."""
        classes = F.coalesce(F.max("y") + 1, F.lit(0)) if "y" in self.nodes.columns else F.lit(0)
        of_nodes = self.nodes.agg(F.count("*").alias("num_nodes"), F.coalesce(F.max(F.size("x")), F.lit(0)).cast("long").alias("in_channels"), classes.cast("long").alias("num_classes"))
        return of_nodes.join(self.edges.agg(F.count("*").alias("num_edges")), F.lit(True))


def drop_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.lit(1.0))


def wrap_negative(edges: DataFrame, num_nodes: int, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Negative ids count from the end."""
    return edges.withColumns({c: F.when(F.col(c) < 0, F.col(c) + num_nodes).otherwise(F.col(c)) for c in columns})


def validate_index(edges: DataFrame, num_nodes: int, columns: tuple[str, ...] = ("src", "dst"), strict: bool = False) -> DataFrame:
    """edges with valid: whether all ids lie in 0 .. num_nodes - 1. With strict a bad id fails the job where it is read."""
    for c in columns:
        if dict(edges.dtypes).get(c) not in ("bigint", "int"):
            raise TypeError(f"{c} must be an integer column")
    valid = F.lit(True)
    for c in columns:
        valid &= F.coalesce((F.col(c) >= 0) & (F.col(c) < num_nodes), F.lit(False))
    if strict:
        valid = F.when(valid, valid).otherwise(F.raise_error(F.lit("an id lies outside of the node table")).cast("boolean"))
    return edges.withColumn("valid", valid)


def missing_nodes(edges: DataFrame, nodes: DataFrame, column: str = "src") -> DataFrame:
    """(id) that edges name and nodes lack."""
    return edges.select(F.col(column).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w) with (i, i, 1) appended for every node, whether or not it has a loop."""
    return edges.select("src", "dst", "w").union(nodes.select(F.col("id"), F.col("id"), F.lit(1.0)))


def add_remaining_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """(src, dst, w) with exactly one loop per node: its own weight (the largest, if it has several) or fill."""
    loops = edges.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.max("w").alias("w"))
    ours = nodes.select("id").join(loops, "id", "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.coalesce("w", F.lit(fill)).alias("w"))
    return edges.where("src <> dst").select("src", "dst", "w").union(ours)


def merge_loops(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with the loops of a node added up to one; other edges as they are."""
    others = edges.where("src <> dst").select("src", "dst", F.coalesce("w", F.lit(1.0)).alias("w"))
    return others.union(coalesce_edges(edges.where("src = dst")))


def fill_diagonal(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """(src, dst, w) with the diagonal set to fill."""
    return edges.where("src <> dst").select("src", "dst", "w").union(nodes.select(F.col("id"), F.col("id"), F.lit(fill)))


def norm_parts(edges: DataFrame, nodes: DataFrame, improved: bool = False, self_loops: bool = True, flow: str = "source_to_target") -> tuple[DataFrame, DataFrame]:
    """What gcn_norm() multiplies: edges (src, dst, w) with their loops, and (id, d) with degree ** -0.5 of every node. A product with normalised edges is d times the product of these edges with d times the vectors."""
    if flow not in ("source_to_target", "target_to_source"):
        raise ValueError(f"unknown flow {flow!r}")
    if "w" not in edges.columns:
        edges = edges.withColumn("w", F.lit(1.0))
    edges = edges.withColumn("w", F.coalesce("w", F.lit(1.0)))
    edges = add_remaining_self_loops(edges, nodes, 2.0 if improved else 1.0) if self_loops else edges.select("src", "dst", "w")
    scale = weighted_degree(edges, "dst" if flow == "source_to_target" else "src", nodes).select("id", inverse_sqrt(F.col("degree")).alias("d"))
    return edges, scale


def gcn_norm(edges: DataFrame, nodes: DataFrame, improved: bool = False, self_loops: bool = True, flow: str = "source_to_target") -> DataFrame:
    """(src, dst, w) with w / sqrt(degree[src] * degree[dst]), degrees as weight sums at dst (at src if the flow is reversed), 0 for degree 0."""
    edges, scale = norm_parts(edges, nodes, improved, self_loops, flow)
    joined = edges.join(scale.withColumnsRenamed({"id": "src", "d": "_s"}), "src").join(scale.withColumnsRenamed({"id": "dst", "d": "_t"}), "dst")
    return joined.select("src", "dst", (F.col("_s") * F.col("w") * F.col("_t")).alias("w"))
