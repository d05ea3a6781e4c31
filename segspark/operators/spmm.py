"""Sparse times dense: edges gather node vectors and reduce them by destination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reduction
from ..plans.layout import dim_of, reduce_vectors
from . import cells
from .segment import fill_segments, ids_below, join_split
from .sparse import csr_to_coo, unblock
from .stored import StoredGraph


#: Products of heads and components that are aggregates of one plan.
CELLS = 96


def _messages(edges: DataFrame | StoredGraph, nodes: DataFrame, weighted: bool) -> DataFrame:
    """(id, x and, if weighted, w): the vector at the source of every edge, by its destination."""
    cols = [F.col("dst").alias("id")] + ([F.coalesce("w", F.lit(1.0)).alias("w")] if weighted else [])
    if isinstance(edges, StoredGraph):
        return edges.messages(nodes).select(*cols, "x")
    return join_split(edges.select("src", *cols), nodes.select(F.col("id").alias("src"), "x"), "src")


def _reduced(edges: DataFrame | StoredGraph, nodes: DataFrame, reduces: list[str], dim: int, weighted: bool) -> DataFrame:
    """(id, x): the reductions of all messages, end to end; over a grid where nodes are not broadcast and it sends less."""
    for reduce in reduces:
        reduction(reduce)  # raises if unknown
    if not isinstance(edges, StoredGraph) and dim and cells.applies(edges, nodes):
        grid, nodes = cells.plan(edges, nodes.select("id", "x"), dim, dim * len(reduces))
        if grid:
            x = F.array(F.coalesce(F.col("w").cast("double"), F.lit(1.0))) if weighted else F.array().cast("array<double>")
            return cells.reduce_edges(grid, edges.select("src", "dst", x.alias("_x")), nodes.select("id", F.col("x").cast("array<double>").alias("_x")), reduces, dim, int(weighted))
    return reduce_vectors(_messages(edges, nodes, weighted), ["id"], "x", reduces, dim, F.col("w") if weighted else None)


def _product(edges: DataFrame | StoredGraph, nodes: DataFrame, reduce: str, dim: int | None, num_nodes, fill: bool, weighted: bool) -> DataFrame:
    dim = dim or dim_of(nodes)
    out = _reduced(edges, nodes, [reduce], dim, weighted)
    if fill and isinstance(edges, StoredGraph) and num_nodes is None:
        num_nodes = edges.nodes
    return fill_segments(out, ids_below(edges, "dst", num_nodes), dim) if fill else out


def gather_scatter_several(edges: DataFrame | StoredGraph, nodes: DataFrame, reduces: list[str], dim: int | None = None, num_nodes: int | DataFrame | None = None) -> DataFrame:
    """(id, x): the results of gather_scatter() for each of reduces, end to end; edges meet nodes once, and one aggregate takes all reductions of a component.

    Nodes are filled as there; components that a shorter vector lacks count for nothing.
    """
    dim = dim or dim_of(nodes)
    if isinstance(edges, StoredGraph) and num_nodes is None:
        num_nodes = edges.nodes
    out = _reduced(edges, nodes, reduces, dim, False)
    return fill_segments(out, ids_below(edges, "dst", num_nodes), dim * len(reduces))


def gather_scatter(edges: DataFrame | StoredGraph, nodes: DataFrame, reduce: str = "sum", dim: int | None = None, num_nodes: int | DataFrame | None = None, fill: bool = True) -> DataFrame:
    """(id, x): for every destination of edges(src, dst) the reduced vectors of nodes(id, x) at its sources.

    Duplicate edges count as often as they occur. Destinations 0 .. num_nodes - 1 (to the largest if not given) all appear with fill; those
    without edges are zero; a stored graph's are all of its nodes. Messages are never materialised: join, product and partial aggregation are one stage. The edges of a hub among the sources are split where
    vectors are shuffled; one among the destinations costs a row a task.
    """
    return _product(edges, nodes, reduce, dim, num_nodes, fill, False)


def gather_weight_scatter(edges: DataFrame | StoredGraph, nodes: DataFrame, reduce: str = "sum", dim: int | None = None, num_nodes: int | DataFrame | None = None, fill: bool = True) -> DataFrame:
    """gather_scatter() with every vector times the edge's weight w; a null weight is 1."""
    return _product(edges, nodes, reduce, dim, num_nodes, fill, True)


def csr_product(rows: DataFrame, entries: DataFrame, nodes: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, x) of compressed rows(row, ptr_begin, ptr_end) and entries(pos, col, w): one row per matrix row."""
    edges = csr_to_coo(rows, entries).select(F.col("col").alias("src"), F.col("row").alias("dst"), "w")
    return gather_weight_scatter(edges, nodes, dim=dim, num_nodes=rows.select(F.col("row").alias("id")))


def mh_spmm(edges: DataFrame, nodes: DataFrame, heads: int, dim: int, reduce: str = "sum", num_nodes: int | DataFrame | None = None, shifts: list[float] | None = None) -> DataFrame:
    """(id, x): x[h] = reduce of w[h] * x[h] over the edges; w is an array per edge, x an array of heads per node.

    With shifts, x is one vector per node that all heads share, head h being x + shifts[h]; so one vector moves, not one for each head.
    Where nodes are broadcast, up to CELLS products are aggregates of one plan. Wider ones go by heads: a head's vectors are rows of their own, cut into chunks where they are long.
    Nodes that aren't broadcast meet the edges on a grid where that sends less.
    """
    reduction(reduce)
    empty = F.array_repeat(F.array_repeat(F.lit(0.0), dim), heads)
    if cells.applies(edges, nodes):
        grid, nodes = cells.plan(edges, nodes.select("id", "x"), dim if shifts else heads * dim, heads * dim)
        if grid:
            flat = F.col("x") if shifts else F.flatten(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: of_length(F.get("x", h), dim)))
            sums = cells.reduce_edges(grid, edges.select("src", "dst", F.col("w").cast("array<double>").alias("_x")), nodes.select("id", flat.cast("array<double>").alias("_x")), [reduce], heads * dim, heads, shifts)
            out = sums.select("id", F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice("x", h * dim + 1, dim)).alias("x"))
            return ids_below(edges, "dst", num_nodes).join(out, "id", "left").select("id", F.coalesce("x", empty).alias("x"))
    if shifts:
        shifted = lambda s: F.transform("x", lambda v: v + s)
        nodes = nodes.select("id", F.array(*[shifted(s) for s in shifts]).alias("x"))
    joined = join_split(edges.select("src", F.col("dst").alias("id"), "w"), nodes.select(F.col("id").alias("src"), "x"), "src")
    if heads * dim <= CELLS:
        aggregate = reduction(reduce)
        products = F.array(*[F.array(*[aggregate(F.col("w")[h] * F.col("x")[h][k]) for k in range(dim)]) for h in range(heads)])
        out = joined.groupBy("id").agg(products.cast("array<array<double>>").alias("x"))
    else:
        each = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.struct(h.alias("h"), F.get("w", h).alias("w"), F.get("x", h).alias("x")))
        by_head = reduce_vectors(joined.select("id", F.inline(each)), ["id", "h"], "x", reduce, dim, F.col("w"))
        ordered = F.array_sort(F.collect_list(F.struct("h", "x")))
        out = by_head.groupBy("id").agg(F.transform(ordered, lambda s: s["x"]).alias("x"))
    return ids_below(edges, "dst", num_nodes).join(out, "id", "left").select("id", F.coalesce("x", empty).alias("x"))


def of_length(x: Column, dim: int) -> Column:
    """x cut or filled up with nulls to dim components."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.get(x, k))


def mh_spmm_transposed(edges: DataFrame, weights: DataFrame, nodes: DataFrame, heads: int, dim: int, reduce: str = "sum", num_nodes: int | DataFrame | None = None) -> DataFrame:
    """mh_spmm() with weights in long form (h, eid, w): they are gathered per edge first (heads rows each)."""
    per_edge = weights.groupBy("eid").agg(F.array(*[F.max(F.when(F.col("h") == h, F.col("w"))) for h in range(heads)]).alias("w"))
    return mh_spmm(edges.select("eid", "src", "dst").join(per_edge, "eid"), nodes, heads, dim, reduce, num_nodes)


def blocked_product(tiles: DataFrame, nodes: DataFrame, window: int, dim: int | None = None, num_rows: int | DataFrame | None = None) -> DataFrame:
    """The product of a matrix in block form: its cells as edges."""
    edges = unblock(tiles, window).select(F.col("col").alias("src"), F.col("row").alias("dst"), "w")
    return gather_weight_scatter(edges, nodes, dim=dim, num_nodes=num_rows)


def message_and_aggregate(edges: DataFrame, nodes: DataFrame, reduce: str = "sum", weighted: bool = False, **options) -> DataFrame:
    """What a graph layer aggregates: with or without weights."""
    return _product(edges, nodes, reduce, options.get("dim"), options.get("num_nodes"), options.get("fill", True), weighted)
