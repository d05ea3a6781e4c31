"""Sampled dense-dense products: one inner product per edge, over a grid of node blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import dot
from ..session import stash, stashed, will_broadcast
from .segment import SHARE, hubs
from .sparse import csr_to_coo

#: Bytes of vectors of either side that one cell of the grid holds, and edges whose products are worked out at once.
BYTES, EDGES = 1 << 26, 1 << 11
#: Bytes of vectors that may be sent for an edge before the grid has fewer cells than the cluster has partitions.
EDGE_BYTES = 32
#: More parts than a cell is ever split into.
_PARTS = 1 << 20


def grid(left_bytes: int, right_bytes: int, cells: int) -> tuple[int, int]:
    """Sides (rows, columns) of the grid: so many cells at least, blocks of BYTES at most, and then the fewest bytes of vectors sent: a vector of the left goes to every column, one of the right to every row."""
    least = [max(1, -(-b // BYTES)) for b in (left_bytes, right_bytes)]
    shapes = []
    for rows in range(least[0], max(least[0], cells) + 1):
        columns = max(least[1], -(-cells // rows))
        shapes.append((left_bytes * columns + right_bytes * rows, rows, columns))
        if columns == least[1]:
            break
    return min(shapes)[1:]


class Block:
    """The vectors of one block by id. A vector that is null or has a null component is not known."""

    def __init__(self, pieces: list[tuple[pa.Array, pa.Array]]):
        ids = np.concatenate([np.empty(0, dtype=np.int64), *(i.to_numpy() for i, _ in pieces)])
        lists = [x for _, x in pieces]
        sizes = np.concatenate([np.empty(0, dtype=np.int64), *(np.diff(np.asarray(x.offsets)) for x in lists)])
        self.sizes = sizes
        flat = [x.flatten() for x in lists]
        self.known = np.concatenate([np.empty(0, dtype=bool), *(np.asarray(x.is_valid()) for x in lists)])
        x = np.concatenate([np.empty(0), *(f.to_numpy(zero_copy_only=False) for f in flat)]).astype(float)
        row = np.repeat(np.arange(len(sizes)), sizes)
        gap = np.concatenate([np.empty(0, dtype=bool), *(np.asarray(f.is_null()) for f in flat)])
        self.known[row[gap]] = False
        x[gap] = 0
        wide = int(sizes.max(initial=0))
        self.x = np.zeros((len(sizes), wide))
        self.x[row, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
        order = np.argsort(ids, kind="stable")
        self.ids, self.order = ids[order], order

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ids, and whether they are there."""
        if not len(self.ids):
            return np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return self.order[at], self.ids[at] == ids


def inner_products(left: Block, right: Block, dst: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The places of the edges whose nodes are there, and their products: null where a vector is not known or lengths differ."""
    (i, here), (j, there) = left.find(dst), right.find(src)
    at = np.flatnonzero(here & there)
    i, j = i[at], j[at]
    wide = min(left.x.shape[1], right.x.shape[1])
    out = np.empty(len(at))
    for s in range(0, len(at), EDGES):
        out[s : s + EDGES] = np.einsum("ij,ij->i", left.x[i[s : s + EDGES], :wide], right.x[j[s : s + EDGES], :wide])
    return at, pa.array(out, mask=~(left.known[i] & right.known[j] & (left.sizes[i] == right.sizes[j])))


def sddmm(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """edges with value = <left[dst], right[src]>; vectors of any length. Edges without either node go. Ids of nodes are unique.

    Where Spark broadcasts both tables of nodes no edge moves; otherwise the products are worked out over a grid.
    A product is null where a vector is null, holds a null or differs in length.
    """
    if not (will_broadcast(left) and will_broadcast(right)):
        return grid_sddmm(edges, left, right)
    joined = edges.join(left.select(F.col("id").alias("dst"), F.col("x").alias("_a")), "dst").join(right.select(F.col("id").alias("src"), F.col("x").alias("_b")), "src")
    return joined.select(*edges.columns, dot(F.col("_a"), F.col("_b")).alias("value"))


def cells_for(edges: int, left_bytes: int, right_bytes: int, partitions: int, cores: int) -> int:
    """Cells of the grid: SHARE a partition, but no more than keep the vectors sent at about EDGE_BYTES an edge, and so many in any case that every core has some."""
    sides = EDGE_BYTES * edges / max(1.0, 2 * (left_bytes * right_bytes) ** 0.5)
    return max(1, min(SHARE * partitions, max(int(sides**2), SHARE * cores)))


def grid_sddmm(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """sddmm() over a grid of node blocks.

    Nodes are dealt into blocks by a hash, edges to the cells of the grid of these blocks: a cell holds its two blocks and its edges pass by. So a vector is sent once for every row or column of the grid, not
    once for every edge, and the grid has so few cells that this stays in proportion to the edges. Hubs are spread over a row or column; a cell with more than twice its share of the edges is split.
    """
    spark = edges.sparkSession
    size = F.coalesce(F.sum(F.size("x").cast("long")), F.lit(0))
    of_left = left.agg(size).first()[0]
    of_right = of_left if right is left else right.agg(size).first()[0]
    edges = stashed(edges, "edges")
    cells = cells_for(edges.count(), 8 * of_left, 8 * of_right, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows, columns = grid(8 * of_left, 8 * of_right, cells)
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n))
    names = edges.columns
    placed = edges.select((block("dst", rows) * columns + block("src", columns)).alias("_cell"), *(F.col(c).alias(f"_edge_{c}") for c in names))
    hot = stash(hubs(placed, "_cell", max(1, rows * columns // 2)), "hot")
    key = lambda part, kind: ((F.col("_cell") * _PARTS + part) * 4 + kind).alias("_key")
    part = F.pmod(F.xxhash64(*placed.columns), F.coalesce("_parts", F.lit(1)).cast("long"))
    placed = placed.join(F.broadcast(hot), "_cell", "left")  # fewer cells than hubs() says
    # an empty list, because Arrow's writer takes time for every null list before in the batch whenever a row is added
    placed = placed.select(key(part, 2), F.array().cast("array<double>").alias("_x"), *(f"_edge_{c}" for c in names))

    def sent(nodes: DataFrame, kind: int) -> DataFrame:
        id_, x = F.col("id").cast("long").alias("_id"), F.col("x").cast("array<double>").alias("_x")
        if kind == 0:
            to = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: block("id", rows) * columns + c)
        else:
            to = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * columns + block("id", columns))
        cells = nodes.select(F.explode(to).alias("_cell"), id_, x).join(F.broadcast(hot), "_cell", "left")
        return cells.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).select(key(F.col("_part"), kind), "_id", "_x")

    at_dst, at_src = names.index("dst"), names.index("src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, blocks = None, ([], []), None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
                if s == e:
                    continue
                if cell != keys[s] >> 2:
                    cell, held, blocks = keys[s] >> 2, ([], []), None
                kind = keys[s] & 3
                if kind < 2:
                    held[kind].append((batch.column(1).slice(s, e - s), batch.column(2).slice(s, e - s)))
                    continue
                if blocks is None:
                    blocks, held = tuple(Block(h) for h in held), ([], [])
                columns_ = [batch.column(3 + i).slice(s, e - s) for i in range(len(names))]
                ends = [columns_[i].cast(pa.int64()) for i in (at_dst, at_src)]
                whole = np.asarray(ends[0].is_valid()) & np.asarray(ends[1].is_valid())
                dst, src = (c.fill_null(0).to_numpy() for c in ends)
                at, value = inner_products(*blocks, dst, src)
                keep = whole[at]
                if len(at) < len(dst) or not keep.all():
                    at, value = pa.array(at[keep]), value.filter(pa.array(keep))
                    columns_ = [c.take(at) for c in columns_]
                yield pa.RecordBatch.from_arrays([*columns_, value], names=[*names, "value"])

    rows_ = sent(left, 0).unionByName(sent(right, 1)).unionByName(placed, allowMissingColumns=True).select("_key", "_id", "_x", *(f"_edge_{c}" for c in names))
    dealt = rows_.repartition(F.shiftright("_key", 2)).sortWithinPartitions("_key")
    return dealt.mapInArrow(run, StructType([*edges.schema.fields, StructField("value", DoubleType())]))


def weighted_sddmm(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """sddmm() times the edge's weight; a null weight is 1."""
    return sddmm(edges, left, right).withColumn("value", F.col("value") * F.coalesce("w", F.lit(1.0)))


def sddmm_csr(rows: DataFrame, entries: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(pos, row, col, value) of a matrix in compressed rows."""
    edges = stash(csr_to_coo(rows, entries).select("pos", F.col("row").alias("dst"), F.col("col").alias("src")), "edges")
    return sddmm(edges, left, right).select("pos", F.col("dst").alias("row"), F.col("src").alias("col"), "value")
