"""Segment reduction: rows with a key and a vector, reduced by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import to_long, to_vectors, zeros
from ..functions.scalars import reduction
from ..plans.layout import dim_of, reduce_vectors
from ..session import stash, will_broadcast


def ids_below(rows: DataFrame, key: str, size: int | DataFrame | None) -> DataFrame:
    """(id) of all segments: those of a DataFrame(id), 0 .. size - 1, or 0 .. the largest key."""
    if isinstance(size, DataFrame):
        return size.select(F.col("id").cast("long"))
    if size is None:
        largest = rows.agg(F.max(key)).first()[0]
        size = 0 if largest is None else largest + 1
    return rows.sparkSession.range(size)


def fill_segments(reduced: DataFrame, ids: DataFrame, dim: int) -> DataFrame:
    """(id, x) with zeros for the ids that reduced(id, x) lacks, whatever the reduction was."""
    return ids.join(reduced, "id", "left").select("id", F.coalesce("x", zeros(dim)).alias("x"))


def index_scatter(items: DataFrame, reduce: str = "sum", dim: int | None = None, num_segments: int | DataFrame | None = None, fill: bool = True, key: str = "idx", sorted: bool = True) -> DataFrame:  # noqa: A002
    """Reduce the vectors x of items(idx, x) by idx: (id, x).

    reduce is sum, mean, max, min or prod. With fill the segments 0 .. num_segments - 1 (to the largest key if not given) all appear and
    empty ones are zero; without it only those that have rows. sorted is accepted and doesn't matter: hash aggregation needs no order.
    """
    dim = dim or dim_of(items)
    out = reduce_vectors(items.withColumnRenamed(key, "id") if key != "id" else items, ["id"], "x", reduce, dim)
    return fill_segments(out, ids_below(items, key, num_segments), dim) if fill else out


def index_scatter_axis(values: DataFrame, index: DataFrame, axis: str, reduce: str = "sum") -> DataFrame:
    """Reduce long rows values(axes..., v) along one axis: index(<axis>, idx) maps the axis's positions to segments.

    Works for any axis and any number of them; returns the other axes, idx and v.
    """
    others = [c for c in values.columns if c not in (axis, "v")]
    return values.join(index.select(axis, "idx"), axis).groupBy(*others, "idx").agg(reduction(reduce)("v").alias("v"))


def scatter_columns(vectors: DataFrame, index: DataFrame, reduce: str = "sum") -> DataFrame:
    """Reduce the components of vectors(id, x) by index(k, idx): (id, x) with one component per segment."""
    long = to_long(vectors, ["id"], value="v")
    reduced = index_scatter_axis(long, index, "k", reduce).withColumnRenamed("idx", "k")
    return to_vectors(reduced, ["id"], "v")


#: One row in so many is looked at for keys that many rows share; a key with more than one part in SHARE * spark.sql.shuffle.partitions of these is split.
SAMPLE, SHARE = 16, 4


def hubs(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, _parts): the keys that hold so large a share of rows that one task would be slowed by them, and into how many parts they go.

    Shares come from a sample of the key column, which decides nothing but how rows are dealt. There are fewer than SHARE * spark.sql.shuffle.partitions such keys, however large the table;
    most, if given, takes that number's place.
    """
    most = most or SHARE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stash(rows.select(key).sample(1 / SAMPLE, seed=1).groupBy(key).agg(F.count("*").alias("_n")), "shares")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.where(F.col("_n") * most > total).select(key, F.ceil(F.col("_n") * most / F.lit(max(total, 1))).cast("int").alias("_parts"))


def join_split(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table, which has one row for each key; a key that a large share of rows has is split.

    Where Spark broadcasts the table no row moves and nothing is split. Otherwise the rows of a hub are dealt over several parts by a hash of all
    their columns, and the hub's one row of table is repeated for each part.
    """
    if will_broadcast(table):
        return rows.join(table, key)
    found = stash(hubs(rows, key), "hubs")
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
    left = rows.join(F.broadcast(found), key, "left").withColumn("_part", part).drop("_parts")  # fewer keys than hubs() says
    right = table.join(F.broadcast(found), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def gather(index: DataFrame, nodes: DataFrame, key: str = "idx") -> DataFrame:
    """The vector of nodes(id, x) for every row of index; rows without a node go. Rows of a hub are split."""
    return join_split(index, nodes.select(F.col("id").alias(key), "x"), key)


def run_lengths(items: DataFrame) -> DataFrame:
    """(idx, begin, length) of the runs of items(pos, idx) that is sorted by idx."""
    return items.groupBy("idx").agg(F.min("pos").alias("begin"), F.count("*").alias("length"))


def segment_boundaries(items: DataFrame, block: int = 1 << 16) -> DataFrame:
    """items(pos, idx) with is_start: whether idx differs from that of the row before (the first row starts a segment).

    Blocks of positions are compared on their own; only the last row of a block is handed to the next one.
    """
    blocks = items.withColumn("_block", F.floor(F.col("pos") / block))
    lasts = blocks.groupBy("_block").agg(F.max_by("idx", "pos").alias("_last"), F.lit(True).alias("_known"))
    carried = lasts.select(F.lead("_block").over(Window.orderBy("_block")).alias("_block"), "_last", "_known").where("_block is not null")
    within = Window.partitionBy("_block").orderBy("pos")
    rows = blocks.withColumn("_first", F.row_number().over(within) == 1).withColumn("_before", F.lag("idx").over(within)).join(carried, "_block", "left")
    before = F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_before"))
    return rows.select(*items.columns, (~F.col("idx").eqNullSafe(before) | (F.col("_first") & F.col("_known").isNull())).alias("is_start"))


def deal(rows: DataFrame, order: list[str], block: int = 1 << 16, keep: list[str | Column] | None = None) -> DataFrame:
    """rows in the given order with _at, which grows in this order, and _block: at most block consecutive rows have one, whatever the keys' shares.

    Rows are dealt by ranges of the whole order to as many partitions as the cluster has set for shuffles, sorted there, and numbered as they stream: the upper bits of _at are the
    partition, the others the place in it. Written once, because ranges come from a sample and must not be drawn anew for the second phase; of the columns only those in keep, if given.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stash(placed.select(*(keep or rows.columns), "_at", F.expr(f"_at div {block}").alias("_block")), "dealt")


#: Bits of _at below the partition.
_PLACE = 33


def plus(a: Column, b: Column) -> Column:
    """a + b, where a null counts for nothing; null if both are."""
    return F.coalesce(a + b, a, b)


def bases_of(blocked: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, _block, _base): what the blocks before a block sum to, for each value of keys.

    Two levels: blocks are summed up within a partition of deal(), partitions across; no window spans more than one partition's blocks or all partitions.
    """
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"), F.shiftright(F.min("_at"), _PLACE).alias("_block_range"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy(*keys, "_block_range").agg(F.sum("_sum").alias("_total")).withColumn("_before", F.sum("_total").over(before(keys, "_block_range")))
    ranges = ranges.select("_before", *(F.col(c).alias(f"_r{c}") for c in (*keys, "_block_range")))
    inner = sums.withColumn("_within", F.sum("_sum").over(before([*keys, "_block_range"], "_block")))
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in (*keys, "_block_range")]
    return inner.join(ranges, same).select(*keys, "_block", plus(F.col("_before"), F.col("_within")).alias("_base"))


def segmented_scan(items: DataFrame, value: str = "v", block: int = 1 << 16) -> DataFrame:
    """items(pos, idx, value) with running: the sum of value so far within the segment.

    Blocks of rows run on their own; what a segment holds in the blocks before is added from one row per block and segment.
    """
    blocked = deal(items, ["idx", "pos"], block)
    bases = bases_of(blocked, value, ["idx"]).select(F.col("_block").alias("_of"), F.col("idx").alias("_idx"), "_base")
    within = Window.partitionBy("_block", "idx").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_local", F.sum(value).over(within))
    rows = local.join(bases, (F.col("_block") == F.col("_of")) & F.col("idx").eqNullSafe(F.col("_idx")))
    return rows.select(*items.columns, plus(F.col("_base"), F.col("_local")).alias("running"))
