"""Derivatives of the products, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import dim_of
from ..session import stash, stashed
from . import cells
from .sddmm import sddmm
from .segment import SAMPLE, fill_segments, gather
from .sparse import csr_to_coo, transpose
from .spmm import gather_scatter, gather_weight_scatter


def gather_scatter_grad(edges: DataFrame, grad: DataFrame, nodes: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, x): dX[s] = sum of dY[dst] over the edges out of s, one row per node."""
    return gather_scatter(transpose(edges), grad, dim=dim, num_nodes=nodes.select("id"))


def gather_weight_scatter_grad(edges: DataFrame, grad: DataFrame, nodes: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, x): dX[s] = sum of w * dY[dst] over the edges out of s, one row per node."""
    return gather_weight_scatter(transpose(edges), grad, dim=dim, num_nodes=nodes.select("id"))


def weight_grad(edges: DataFrame, grad: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with value = dw = <dY[dst], X[src]>."""
    return sddmm(edges, grad, nodes)


def segment_sum_grad(items: DataFrame, grad: DataFrame) -> DataFrame:
    """(pos, idx, x): every item takes its segment's gradient."""
    return gather(items.select("pos", "idx"), grad).select("pos", "idx", "x")


def csr_product_grad(rows: DataFrame, entries: DataFrame, grad: DataFrame, nodes: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The gradients of csr_product(): (id, x) of the nodes, and (pos, value) of the entries.

    Where Spark doesn't broadcast both tables of nodes, entries and vectors are dealt once to the cells of a grid, from which both gradients are taken: in one query that uses both, Spark reuses the exchange.
    """
    edges_of = lambda e: csr_to_coo(rows, e).select("pos", F.col("col").alias("src"), F.col("row").alias("dst"), "w")
    edges = edges_of(entries)
    if cells.applies(edges, grad, nodes) and (dim := dim or dim_of(grad)):
        # gradients flow against the edges; the sample is drawn before rows are looked up, so that no lookup of all entries is run or written for it
        seen = transpose(edges_of(entries.sample(1 / SAMPLE, seed=1)).select("src", "dst"))
        sources, targets = (stashed(n.select("id", F.col("x").cast("array<double>").alias("_x")), "vectors") for n in (grad, nodes))
        grid = cells.plan_both(seen, sources, targets, dim)
        weighed = transpose(edges).select("src", "dst", F.array(F.coalesce(F.col("w").cast("double"), F.lit(1.0))).alias("_x"), F.col("pos").cast("long").alias("pos"))
        dealt = cells.deal(grid, weighed, sources, targets, ("pos",))
        return fill_segments(cells.reduce_dealt(dealt, ["sum"], dim, 1), nodes.select(F.col("id").cast("long")), dim), cells.products_dealt(dealt, "pos")
    edges = stash(edges, "edges")
    return gather_weight_scatter_grad(edges, grad, nodes, dim), weight_grad(edges, grad, nodes).select("pos", "value")
