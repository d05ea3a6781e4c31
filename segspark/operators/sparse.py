"""Sparse matrices: degrees, compressed rows, transposition, symmetry, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .segment import _PLACE, bases_of, deal, ids_below

#: Running sums are taken in blocks of about so many consecutive rows.
BLOCK = 1 << 16
#: Cells of a tile that are aggregates of one plan.
CELLS = 64


def running_sum(rows: DataFrame, value, out: str, order: list[str], inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """rows with the sum of value over all rows up to (with inclusive) each in the given order.

    The sum is a total one over order; rows equal in all of it stand together. Two phases: rows are dealt by ranges of the whole order,
    the sums of blocks are added up first (one row a block), then each block runs on its own. No window spans the table or a key.
    """
    blocked = deal(rows.withColumn("_value", value), order, block)
    within = Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum("_value").over(within) - (F.lit(0) if inclusive else F.col("_value"))
    summed = blocked.withColumn("_local", local).join(bases_of(blocked, "_value", []), "_block").withColumn(out, F.coalesce("_base", F.lit(0)) + F.col("_local"))
    return summed.drop("_at", "_block", "_value", "_local", "_base")


def number_rows(rows: DataFrame, out: str, order: list[str], block: int = BLOCK, keep: list[str | Column] | None = None) -> DataFrame:
    """rows with their position from 0 in the given order: the place that each has in its partition of deal(), and the number of rows in the partitions before. One range sort, no window over rows.

    With keep, only these columns, worked out after the sort, are written and returned beside the position.
    """
    dealt = deal(rows, order, block, *([keep] if keep else [])).drop("_block").withColumn("_block_range", F.shiftright("_at", _PLACE))
    before = Window.orderBy("_block_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_block_range").agg(F.count("*").alias("_n"))
    bases = counts.select("_block_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # a row a partition; without the hint Spark, which can't tell the size of a window, deals all rows by partition for this join
    return dealt.join(F.broadcast(bases), "_block_range").withColumn(out, F.col("_base") + F.col("_at").bitwiseAND((1 << _PLACE) - 1)).drop("_at", "_block_range", "_base")


def degree(edges: DataFrame, key: str = "dst", num_nodes: int | DataFrame | None = None) -> DataFrame:
    """(id, degree) of all nodes; 0 without edges."""
    counts = edges.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("degree"))
    return ids_below(edges, key, num_nodes).join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def weighted_degree(edges: DataFrame, key: str = "dst", num_nodes: int | DataFrame | None = None) -> DataFrame:
    """(id, degree) as sums of weights; a missing weight is 1."""
    sums = edges.groupBy(F.col(key).alias("id")).agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("degree"))
    return ids_below(edges, key, num_nodes).join(sums, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def degree_variance(edges: DataFrame, key: str = "dst", num_nodes: int | DataFrame | None = None) -> DataFrame:
    """One row: the population variance of row lengths, empty rows included."""
    return degree(edges, key, num_nodes).agg(F.var_pop("degree").alias("variance"))


def coalesce_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, w): duplicates added up."""
    return edges.groupBy("src", "dst").agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("w"))


def coo_to_csr(edges: DataFrame, row: str = "dst", num_rows: int | DataFrame | None = None) -> DataFrame:
    """Row pointers (row, ptr_begin, ptr_end) of all rows; rows without entries begin where they end."""
    counts = degree(edges, row, num_rows).select(F.col("id").alias("row"), F.col("degree").alias("_n"))
    ends = running_sum(counts, F.col("_n"), "ptr_end", ["row"])
    return ends.select("row", (F.col("ptr_end") - F.col("_n")).alias("ptr_begin"), "ptr_end")


def csr_entries(edges: DataFrame, row: str = "dst", col: str = "src") -> DataFrame:
    """(pos, col, w): the entries in order of row, then column, then weight, numbered from 0."""
    weights = F.coalesce("w", F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
    rows = edges.select(F.col(row).alias("_row"), F.col(col).alias("col"), weights.alias("w"))
    return number_rows(rows, "pos", ["_row", "col", "w"], keep=["col", "w"]).select("pos", "col", "w")


def _cut(spans: DataFrame, wide: int) -> DataFrame:
    """spans(row, _from, _to) cut at the multiples of wide."""
    first, last = F.expr(f"_from div {wide}"), F.expr(f"(_to - 1) div {wide}")
    cut = spans.withColumn("_cut", F.explode(F.sequence(first, last)))
    return cut.select("row", F.greatest("_from", F.col("_cut") * wide).alias("_from"), F.least("_to", (F.col("_cut") + 1) * wide).alias("_to"))


def lookup_rows(rows: DataFrame, positions: DataFrame, wide: int = BLOCK) -> DataFrame:
    """positions(pos, ...) with row: the one of compressed rows(row, ptr_begin, ptr_end) whose pointers enclose pos. Positions outside of all rows go.

    An interval join by ranges of positions: rows are cut at the borders of ranges of wide positions (long rows first at coarser ones, so that no array of cuts is long), and within a range each position
    takes the last row that begins before it. A range holds at most wide rows and the positions asked for in it; neither a long row nor its positions are ever in one place.
    """
    spans = rows.where("ptr_end > ptr_begin").select("row", F.col("ptr_begin").alias("_from"), F.col("ptr_end").alias("_to"))
    marks = _cut(_cut(spans, wide << 16), wide).select(F.col("_from").alias("_at"), F.struct("row", "_to").alias("_mark"))
    kept, kind = [c for c in positions.columns if c != "pos"], dict(positions.dtypes)["pos"]
    asked = positions.select(F.col("pos").alias("_at"), F.struct(F.lit(True).alias("_is"), *kept).alias("_asked"))
    both = asked.unionByName(marks, allowMissingColumns=True).withColumn("_range", F.expr(f"_at div {wide}"))
    upto = Window.partitionBy("_range").orderBy("_at", F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_mark", F.last("_mark", ignorenulls=True).over(upto)).where("_asked IS NOT NULL AND _at < _mark._to")
    return found.select(*(F.col("_at").cast(kind).alias(c) if c == "pos" else F.col("_asked")[c].alias(c) for c in positions.columns), F.col("_mark.row").alias("row"))


def csr_to_coo(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(row, col, w, pos): every entry with its row, which lookup_rows() finds."""
    return lookup_rows(rows, entries.select("pos", "col", "w")).select("row", "col", "w", "pos")


def transpose(edges: DataFrame) -> DataFrame:
    """Rows and columns swapped."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)


def csr_to_csc(rows: DataFrame, entries: DataFrame, num_cols: int | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Column pointers and entries (col holds the row) of a matrix in compressed rows."""
    swapped = stash(csr_to_coo(rows, entries).select(F.col("col").alias("dst"), F.col("row").alias("src"), "w"), "swapped")
    return coo_to_csr(swapped, num_rows=num_cols), csr_entries(swapped)


def symmetrize(edges: DataFrame) -> DataFrame:
    """(src, dst) with every mirrored edge, each once.

    Edges are read once, and pairs are made distinct regardless of direction, before the mirror images double their number. An unknown end is a value like any other.
    """
    forward = F.col("src").isNull() | F.coalesce(F.col("src") <= F.col("dst"), F.lit(False))
    ends = [F.when(forward, F.col(a)).otherwise(F.col(b)) for a, b in (("src", "dst"), ("dst", "src"))]
    pairs = edges.select(ends[0].alias("src"), ends[1].alias("dst")).distinct()
    one, other = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.select(F.inline(F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(one)).otherwise(F.array(one, other))))


def sort_edges(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """Edges dealt by ranges of dst and sorted by (dst, src) within: the whole is in order, without one task seeing it all."""
    dealt = edges.repartitionByRange(partitions, "dst") if partitions else edges.repartitionByRange("dst")
    return dealt.sortWithinPartitions("dst", "src")


def save_sorted(edges: DataFrame, table: str, buckets: int) -> None:
    """Persist edges bucketed and sorted by dst, so that aggregations by dst need no exchange."""
    edges.write.bucketBy(buckets, "dst").sortBy("dst", "src").mode("overwrite").saveAsTable(table)


def block_columns(edges: DataFrame, window: int, wide: int, unique: bool = False) -> DataFrame:
    """Entries (row, col, w) with win, place (rank of the column among the window's), blk and slot within the block.

    Duplicate entries are added up first, unless the caller says that there are none (unique). A window is as many rows as window says; the last may be shorter.
    """
    weight = F.coalesce("w", F.lit(1.0)).alias("w")
    merged = edges.select("row", "col", weight) if unique else edges.groupBy("row", "col").agg(F.sum(weight).alias("w"))
    place = F.dense_rank().over(Window.partitionBy("win").orderBy("col")) - 1
    placed = merged.withColumn("win", F.floor(F.col("row") / window)).withColumn("place", place.cast("long"))
    return placed.withColumn("blk", F.floor(F.col("place") / wide)).withColumn("slot", F.col("place") % wide)


def block_format(edges: DataFrame, window: int = 8, wide: int = 8, unique: bool = False) -> DataFrame:
    """Tiles (win, blk, width, cols, vals): vals holds window rows of width values; the last tile of a window may be narrower."""
    placed = block_columns(edges, window, wide, unique)
    widths = F.max("slot") + 1
    if window * wide <= CELLS:  # one plain aggregate a cell: no lists, no maps, all in generated code
        cell = (F.col("row") % window) * wide + F.col("slot")
        of_cells = [F.coalesce(F.max(F.when(cell == i, F.col("w"))), F.lit(0.0)).alias(f"_{i}") for i in range(window * wide)]
        columns = F.slice(F.array(*[F.max(F.when(F.col("slot") == s, F.col("col"))) for s in range(wide)]), F.lit(1), widths.cast("int"))
        tiles = placed.groupBy("win", "blk").agg(widths.alias("width"), columns.alias("cols"), *of_cells)
        kept = lambda n: F.array(*[F.col(f"_{r * wide + s}") for r in range(window) for s in range(n)])
        vals = kept(wide)
        for n in range(1, wide):
            vals = F.when(F.col("width") == n, kept(n)).otherwise(vals)
        return tiles.select("win", "blk", "width", "cols", vals.alias("vals"))
    cells = F.map_from_entries(F.collect_list(F.struct(((F.col("row") % window) * wide + F.col("slot")).alias("at"), "w")))
    cols = F.transform(F.array_sort(F.collect_set(F.struct("slot", "col"))), lambda s: s["col"])
    tiles = placed.groupBy("win", "blk").agg(widths.alias("width"), cols.alias("cols"), cells.alias("_cells"))
    at = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda r: F.transform(F.sequence(F.lit(0), (F.col("width") - 1).cast("int")), lambda s: r * wide + s)))
    vals = F.transform(at, lambda i: F.coalesce(F.try_element_at("_cells", i.cast("long")), F.lit(0.0)))
    return tiles.select("win", "blk", "width", "cols", vals.alias("vals"))


def block_pointers(edges: DataFrame, window: int = 8, wide: int = 8, num_rows: int | None = None, pad_rows_to: int | None = None) -> DataFrame:
    """(win, ptr_begin, ptr_end): running numbers of distinct columns per window, over all windows of the (padded) rows."""
    size = num_rows if num_rows is not None else (edges.agg(F.max("row")).first()[0] or 0) + 1
    if pad_rows_to:
        size += pad_rows_to - size % pad_rows_to
    windows = edges.sparkSession.range(-(-size // window)).withColumnRenamed("id", "win")
    counts = edges.select(F.floor(F.col("row") / window).alias("win"), "col").distinct().groupBy("win").agg(F.count("*").alias("_n"))
    all_counts = windows.join(counts, "win", "left").select("win", F.coalesce("_n", F.lit(0)).alias("_n"))
    return running_sum(all_counts, F.col("_n"), "ptr_end", ["win"]).select("win", (F.col("ptr_end") - F.col("_n")).alias("ptr_begin"), "ptr_end")


def unblock(tiles: DataFrame, window: int = 8) -> DataFrame:
    """(row, col, w) of the tiles' non-zero cells."""
    cells = tiles.select("win", "width", "cols", F.posexplode("vals").alias("_i", "w")).where("w <> 0")
    col = F.element_at("cols", (F.col("_i") % F.col("width") + 1).cast("int"))
    return cells.select((F.col("win") * window + F.floor(F.col("_i") / F.col("width"))).alias("row"), col.alias("col"), "w")
