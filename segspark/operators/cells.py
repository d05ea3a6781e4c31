"""Sums over edges on a grid of node blocks, for tables of nodes that Spark doesn't broadcast.

An edge is dealt once, to the cell of its destination's and its source's block, and lies there in order of its destination. A vector is sent once for every block of destinations, and a sum leaves a cell once,
so what moves grows with the edges and with nodes times a side of the grid, not with nodes times tasks. NumPy adds up runs of edges in the task that holds the cell; Spark merges the sums of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import reduction
from ..plans.layout import WIDTH
from ..session import stash, stashed, will_broadcast
from .sddmm import Block, inner_products
from .segment import SAMPLE, SHARE, hubs

#: Bytes of vectors that a cell holds at most, and edges that it has about, if there are very many.
BYTES, EDGES = 1 << 26, 1 << 22
#: Bytes of vectors and sums that may be sent for an edge before the grid has fewer cells than the cluster has partitions.
EDGE_BYTES = 16
#: More parts than a cell is ever split into.
_PARTS = 1 << 20


@dataclass
class Grid:
    """blocks of destinations and of sources; hot are the cells (_cell, _parts) that are split."""

    rows: int
    columns: int
    hot: DataFrame

    def block(self, column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(n))

    def cell(self) -> Column:
        return self.block("dst", self.rows) * self.columns + self.block("src", self.columns)


def shape(vector_bytes: int, sum_bytes: int, cells: int, target_bytes: int = 0) -> tuple[int, int]:
    """Blocks (of destinations, of sources): so many cells at least, BYTES of vectors in a block at most, and then the fewest bytes sent: a vector to every block of destinations, a sum from every block of sources and, if destinations have vectors too, each of these to every block of sources."""
    (least, fewest), best = (max(1, -(-b // BYTES)) for b in (vector_bytes, target_bytes)), []
    for columns in range(least, max(least, cells) + 1):
        rows = max(fewest, -(-cells // columns))
        best.append((vector_bytes * rows + (sum_bytes + target_bytes) * columns, rows, columns))
    return min(best)[1:]


def _cells(spark: SparkSession, edges: int, sent: int, back: int) -> int:
    """How many cells for so many edges, with bytes of vectors sent to and sums and vectors sent along the other side of the grid."""
    partitions, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    sides = EDGE_BYTES * edges / max(1.0, 2 * (sent * back) ** 0.5)
    return max(min(SHARE * partitions, max(int(sides**2), SHARE * cores)), edges // EDGES)


def _grid(seen: DataFrame, rows: int, columns: int) -> Grid:
    """The grid of these sides, its hot cells from a sample of the edges."""
    grid = Grid(rows, columns, None)
    grid.hot = stash(hubs(seen.select(grid.cell().alias("_cell")), "_cell", max(1, rows * columns // 2)), "hot")
    return grid


def plan(edges: DataFrame, nodes: DataFrame, vector: int, total: int) -> tuple[Grid | None, DataFrame]:
    """The grid for edges(src, dst) and nodes(id, x) with vectors of so many numbers and sums of so many, and the nodes as a written table; no grid where sums taken by task are smaller than what the grid sends.

    The numbers of edges and destinations, and the hot cells, come from a sample of the edges, which decides nothing but how rows are dealt.
    """
    spark = edges.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = stash(edges.select("src", "dst").sample(1 / SAMPLE, seed=1), "seen")
    count, targets = seen.agg(F.count("*"), F.approx_count_distinct("dst")).first()
    nodes, count = stashed(nodes, "vectors"), count * SAMPLE
    vectors, sums = 8 * vector * nodes.count(), 8 * total * targets
    rows, columns = shape(vectors, sums, _cells(spark, count, vectors, sums))
    if vectors * rows + min(sums * columns, 8 * total * count) >= vectors + min(sums * partitions, 8 * total * count):
        return None, nodes
    return _grid(seen, rows, columns), nodes


def plan_both(seen: DataFrame, sources: DataFrame, targets: DataFrame, dim: int) -> Grid:
    """The grid for edges that need the vectors of both ends, of dim numbers, and whose sums have as many; seen(src, dst) is one edge in SAMPLE."""
    seen = stash(seen.select("src", "dst"), "seen")
    count, reached = seen.agg(F.count("*"), F.approx_count_distinct("dst")).first()
    count *= SAMPLE
    sent, held, sums = 8 * dim * sources.count(), 8 * dim * targets.count(), 8 * dim * reached
    return _grid(seen, *shape(sent, sums, _cells(seen.sparkSession, count, sent, sums + held), held))


def applies(edges: DataFrame, *nodes: DataFrame) -> bool:
    """Whether a grid may be of use: some table of nodes is not broadcast, and ids are whole numbers."""
    kinds = {dict(edges.dtypes).get("src"), dict(edges.dtypes).get("dst"), *(dict(n.dtypes).get("id") for n in nodes)}
    return kinds <= {"bigint", "int", "smallint", "tinyint"} and not all(will_broadcast(n) for n in nodes)


def deal(grid: Grid, edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(_key, _a, _b, _x, keep): edges(src, dst, _x, keep), sources(id, _x) and, if given, targets(id, _x) by cell; in a cell, vectors come before edges, and edges are in order of dst, then src. keep are columns of edges of type long."""
    key = lambda part, kind: ((F.col("_cell") * _PARTS + part) * 4 + kind).alias("_key")
    part = F.pmod(F.xxhash64("_a", "_b", "_x", *keep), F.coalesce("_parts", F.lit(1)).cast("long"))
    split = lambda rows: rows.join(F.broadcast(grid.hot), "_cell", "left")  # noqa: E731 - fewer cells than hubs() says
    placed = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(grid.cell().alias("_cell"), F.col("src").cast("long").alias("_a"), F.col("dst").cast("long").alias("_b"), "_x", *keep)
    rows = split(placed).select(key(part, 2), "_a", "_b", "_x", *keep)
    to_all = lambda n, at: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))
    sent = [(sources, 1, to_all(grid.rows, lambda r: r * grid.columns + grid.block("id", grid.columns)))]
    if targets is not None:
        sent.append((targets, 0, to_all(grid.columns, lambda c: grid.block("id", grid.rows) * grid.columns + c)))
    for nodes, kind, cells in sent:
        each = split(nodes.where("id IS NOT NULL").select(cells.alias("_cell"), F.col("id").cast("long").alias("_a"), "_x"))
        each = each.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        rows = rows.union(each.select(key(F.col("_part"), kind), "_a", F.lit(0).cast("long"), "_x", *(F.lit(0).cast("long") for _ in keep)))
    return rows.repartition(F.shiftright("_key", 2)).sortWithinPartitions("_key", "_b", "_a")


def dense(lists: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The first wide components of lists as a matrix, zero where there is none, and where there are some (None: everywhere)."""
    n, flat = len(lists), lists.flatten()
    sizes = np.diff(np.asarray(lists.offsets)) if n else np.empty(0, dtype=np.int64)
    if not lists.null_count and not flat.null_count and (sizes == wide).all():
        return flat.to_numpy().reshape(n, wide), None
    sizes = np.where(np.asarray(lists.is_valid()), sizes, 0)
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = (at < wide) & np.asarray(flat.is_valid())
    values, there = np.zeros((n, wide)), np.zeros((n, wide), dtype=bool)
    values[row[keep], at[keep]] = flat.to_numpy(zero_copy_only=False)[keep]
    there[row[keep], at[keep]] = True
    return values, None if there.all() else there


class Vectors:
    """The vectors of a block by id."""

    def __init__(self, pieces: list[tuple[np.ndarray, pa.Array]], wide: int):
        ids = np.concatenate([np.empty(0, dtype=np.int64), *(i for i, _ in pieces)])
        parts = [dense(x, wide) for _, x in pieces]
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.x = np.concatenate([np.empty((0, wide)), *(x for x, _ in parts)])
        gaps = any(t is not None for _, t in parts)
        self.there = np.concatenate([np.ones(x.shape, dtype=bool) if t is None else t for x, t in parts]) if gaps else None

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ids, and whether they are there."""
        if not len(self.ids):
            return np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return self.order[at], self.ids[at] == ids


@dataclass
class Run:
    """Edges of one cell, in order of dst, and the blocks of vectors there."""

    key: int
    sources: Vectors
    targets: Vectors
    src: np.ndarray
    dst: np.ndarray
    x: pa.Array
    kept: list[pa.Array]


def runs(batches: Iterator[pa.RecordBatch], wide: int, target_wide: int = 0, block: Callable = Vectors) -> Iterator[Run]:
    """The runs of deal(); block makes a block of pieces (ids, lists) and a width. Without target_wide the vectors of destinations are passed over."""
    cell, held, blocks = None, ([], []), None
    for batch in batches:
        keys, a, b, x, *kept = batch.columns
        keys, a, b = keys.to_numpy(), a.to_numpy(), b.to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            if s == e:
                continue
            if cell != keys[s] >> 2:
                cell, held, blocks = keys[s] >> 2, ([], []), None
            if keys[s] & 3 < 2:
                if keys[s] & 3 or target_wide:
                    held[keys[s] & 3].append((a[s:e].copy(), x.slice(s, e - s)))
                continue
            if blocks is None:
                blocks, held = (block(held[1], wide), block(held[0], target_wide)), ([], [])
            yield Run(int(cell), *blocks, a[s:e], b[s:e], x.slice(s, e - s), [k.slice(s, e - s) for k in kept])


def starts_of(dst: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])


def lists_of(x: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as lists, null where there is nothing."""
    flat = pa.array(np.ascontiguousarray(x).reshape(-1), mask=None if there is None else ~there.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


#: How a reduction goes over the components of a run, and what takes the place of a component that isn't there.
_RUNS = {"sum": (np.add, 0.0), "max": (np.maximum, -np.inf), "min": (np.fmin, np.inf), "prod": (np.multiply, 1.0)}
_MERGED = {"mean": ["sum", "count"], "amax": ["max"], "amin": ["min"]}


def merge(sums: DataFrame, reduces: list[str], dim: int) -> DataFrame:
    """(id, x) of the cells' sums(id, _at, x): _at counts chunks of WIDTH components within what the reductions are made of."""
    pieces = [p for r in reduces for p in _MERGED.get(r, [r])]
    chunks, wide = -(-dim // WIDTH), min(dim, WIDTH)
    kinds = {p: "sum" if p == "count" else p for p in pieces}
    by_kind = {k: F.array(*[reduction(k)(F.get("x", F.lit(i))) for i in range(wide)]) for k in set(kinds.values())}
    if len(by_kind) == 1:
        merged = next(iter(by_kind.values()))
    else:
        ats = lambda k: [i * chunks + c for i, p in enumerate(pieces) if kinds[p] == k for c in range(chunks)]
        merged = F.coalesce(*[F.when(F.col("_at").isin(ats(k)), cells) for k, cells in by_kind.items()])
    if len(pieces) * chunks == 1:
        return sums.groupBy("id").agg(merged.cast("array<double>").alias("x"))
    parts = sums.groupBy("id", "_at").agg(merged.cast("array<double>").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "x")))
    of = lambda i: F.slice(F.flatten(F.transform(F.slice(ordered, i * chunks + 1, chunks), lambda s: s["x"])), 1, dim)
    whole, i = [], 0
    for r in reduces:
        n = len(_MERGED.get(r, [r]))
        whole.append(of(i) if n == 1 else F.zip_with(of(i), of(i + 1), lambda a, b: a / b))
        i += n
    return parts.groupBy("id").agg(F.concat(*whole).alias("x"))


def reduce_edges(grid: Grid, edges: DataFrame, nodes: DataFrame, reduces: list[str], dim: int, weights: int = 0, shifts: list[float] | None = None) -> DataFrame:
    """reduce_dealt() of edges(src, dst, _x) and nodes(id, _x)."""
    return reduce_dealt(deal(grid, edges, nodes), reduces, dim, weights, shifts)


def reduce_dealt(dealt: DataFrame, reduces: list[str], dim: int, weights: int = 0, shifts: list[float] | None = None) -> DataFrame:
    """(id, x): for every dst the reductions, end to end, of the vectors at the sources of the edges of deal(); components that are not there count for nothing.

    _x of an edge holds as many weights, each for an equal part of the dim components. With shifts, nodes have one vector for all of these parts, and part h is that vector plus shifts[h].
    """
    pieces = [p for r in reduces for p in _MERGED.get(r, [r])]
    chunks, per = -(-dim // WIDTH), dim // weights if weights else dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, per if shifts else dim):
            at, here = r.sources.find(r.src)
            at, dst = at[here], r.dst[here]
            if not len(at):
                continue
            w, w_there = dense(r.x, weights) if weights else (None, None)
            w, w_there = (None if v is None else v[here] for v in (w, w_there))
            starts = starts_of(dst)
            for c in range(chunks):
                cut = np.arange(c * WIDTH, min(dim, (c + 1) * WIDTH))
                of = cut % per if shifts else cut
                same = slice(int(of[0]), int(of[-1]) + 1) if of[-1] - of[0] == len(of) - 1 else of
                x = r.sources.x[:, same][at]
                there = None if r.sources.there is None else r.sources.there[:, same][at]
                head = cut // per
                if shifts:
                    x += np.asarray(shifts, dtype=float)[head]
                if weights:
                    x *= w[:, head[:1]] if head[0] == head[-1] else w[:, head]
                    if w_there is not None:
                        there = w_there[:, head] if there is None else there & w_there[:, head]
                counts = None if there is None else np.add.reduceat(there.astype(float), starts, axis=0)
                for i, piece in enumerate(pieces):
                    if piece == "count":
                        n = np.diff(np.r_[starts, len(dst)]).astype(float)
                        found = np.repeat(n[:, None], len(cut), axis=1) if counts is None else counts
                    else:
                        f, blank = _RUNS[piece]
                        found = f.reduceat(x if there is None else np.where(there, x, blank), starts, axis=0)
                    columns = [pa.array(dst[starts]), pa.array(np.full(len(starts), i * chunks + c, dtype=np.int32)), lists_of(found, None if counts is None else counts > 0)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "_at", "x"])

    return merge(dealt.mapInArrow(run, "id long, _at int, x array<double>"), reduces, dim)


def products_dealt(dealt: DataFrame, keep: str) -> DataFrame:
    """(keep, value): for every edge of deal() whose nodes are both there, with this one column kept, the inner product of its source's and its destination's vector; null where sddmm() says."""

    def block(pieces: list[tuple[np.ndarray, pa.Array]], _: int) -> Block:
        return Block([(pa.array(ids), x) for ids, x in pieces])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, 1, 1, block):
            at, value = inner_products(r.sources, r.targets, r.src, r.dst)
            yield pa.RecordBatch.from_arrays([r.kept[0].take(pa.array(at)), value], names=[keep, "value"])

    return dealt.mapInArrow(run, f"{keep} long, value double")


def attend(grid: Grid, edges: DataFrame, sources: DataFrame, targets: DataFrame, heads: int, dim: int, leaky: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(dst, _ones, _sums) per head: the sums of c and of c * x[src] over distinct edges, c = exp(s - the largest s of dst), s = leaky(a[src] + b[dst]).

    sources(id, _x) hold the heads' vectors end to end, then their scores a; targets(id, _x) scores b. A cell shifts its sums by its own largest s of a destination; where cells meet, they are
    scaled to the largest of all, so edges move once. A null score counts for nothing.
    """
    wide = heads * dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for r in runs(batches, wide + heads, heads):
            new = np.r_[last != (r.key, r.dst[0], r.src[0]), (r.dst[1:] != r.dst[:-1]) | (r.src[1:] != r.src[:-1])]
            last = r.key, r.dst[-1], r.src[-1]
            (at, here), (to, there) = r.sources.find(r.src), r.targets.find(r.dst)
            keep = new & here & there
            at, to, dst = at[keep], to[keep], r.dst[keep]
            if not len(at):
                continue
            x, starts = r.sources.x[at], starts_of(dst)
            s = leaky(x[:, wide:] + r.targets.x[to])
            known = np.ones(s.shape, dtype=bool)
            if r.sources.there is not None:
                known &= r.sources.there[at, wide:]
            if r.targets.there is not None:
                known &= r.targets.there[to]
            top = np.maximum.reduceat(np.where(known, s, -np.inf), starts, axis=0)
            base = np.repeat(np.where(np.isneginf(top), 0.0, top), np.diff(np.r_[starts, len(dst)]), axis=0)
            with np.errstate(invalid="ignore"):
                c = np.where(known, np.exp(s - base), 0.0)
                x = np.where(np.repeat(known, dim, axis=1), np.repeat(c, dim, axis=1) * x[:, :wide], 0.0)
            ones, sums, some = (f.reduceat(v, starts, axis=0) for f, v in ((np.add, c), (np.add, x), (np.maximum, known)))
            yield pa.RecordBatch.from_arrays([pa.array(dst[starts]), lists_of(top, some), lists_of(ones, some), lists_of(sums)], names=["dst", "_top", "_ones", "_sums"])

    cells = deal(grid, edges, sources, targets).mapInArrow(run, "dst long, _top array<double>, _ones array<double>, _sums array<double>")
    # a destination has a row a cell and batch of its column, never one an edge
    tops = [F.max(F.get("_top", F.lit(h))).over(Window.partitionBy("dst")).alias(f"_top{h}") for h in range(heads)]
    scaled = cells.select("*", *tops).select("dst", "_ones", "_sums", F.array(*[F.exp(F.get("_top", F.lit(h)) - F.col(f"_top{h}")) for h in range(heads)]).alias("_scale"))
    at = lambda name, i: F.get(name, F.lit(i))
    of_ones = F.array(*[F.sum(at("_ones", h) * at("_scale", h)) for h in range(heads)])
    of_sums = F.array(*[F.array(*[F.sum(at("_sums", h * dim + k) * at("_scale", h)) for k in range(dim)]) for h in range(heads)])
    return scaled.groupBy("dst").agg(of_ones.alias("_ones"), of_sums.alias("_sums"))
