"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

WORD = "[^ \\t-\\r]+"
#: Documents of one source and size are dealt over so many slices (two hex digits of the id's MD5), so that no run of equal sizes is ranked in one task.
SLICE_DIGITS = 2
#: No source is stretched over so many times its size.
MOST = 3


def word_count(text):
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from sizes(source, size), one or more rows a source.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes by them. A target stops at most
    times its source's size; the excess is shared again by weight among the others until none is above. That fixed point is
    least(most * size, level * weight) for one level, read off the sources sorted by size / weight: it is the first level that
    the next source can't be capped by. One row a source is all that is sorted.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    each = each.withColumn("weight", weight)
    steepest = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = steepest.rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumns({
        "place": F.row_number().over(steepest),
        "free": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0)),
        "rest": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    fits = F.col("free") * F.col("weight") <= most * F.col("source_size") * F.col("rest")
    level = F.min(F.when(fits, F.struct("place", (F.col("free").cast("double") / F.col("rest")).alias("level")))).over(Window.partitionBy())
    target = F.least((most * F.col("source_size")).cast("double"), level["level"] * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, key=None, seed: int = 0) -> DataFrame:
    """sized(doc_id, source, size, ...) with the columns source_size, target, copies.

    Within a source the documents stand in order of size, then slice of the id's MD5, then id (then key, a tie-break). Each
    expects target / source_size copies; the running sum starts at one offset in [0, 1) per source, and a document is taken
    once for every whole number that it crosses. As equal sizes stand together the taken words stay within about the
    largest document of the target. The order and the offset depend on the rows only, so reruns agree.

    Ranks come from counts per (source, size, slice), so neither a hot source nor a hot size meets in one task.
    """
    sized = sized.withColumn("_slice", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, SLICE_DIGITS))
    sized = sized.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # never null, so that ranking and joining share one exchange
    counts = stash(sized.groupBy("_source", "source", "size", "_slice").agg(F.count("*").alias("n")), "counts")
    per_size = counts.groupBy("_source", "source", "size").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_size.select("_source", "size", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("below"))
    within = Window.partitionBy("_source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 2.0**32
    targets = source_targets(per_size.select("source", (F.col("size") * F.col("n")).alias("size"))).withColumn("offset", offset)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), "source_size", "target", "offset")
    places = slices.drop("source", "n").join(starts, ["_source", "size"]).join(targets, "_source")
    places = stash(places.select("_source", "size", "_slice", (F.col("below") + F.col("before")).alias("_start"), "source_size", "target", "offset"), "places")
    ties = [F.col("doc_id")] + ([key] if key is not None else [])
    keys = ["_source", "size", "_slice"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ties))
    rows = sized.withColumn("_rank", rank).join(places, keys)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    end = (F.col("_start") + F.col("_rank")).cast("double")
    crossed = F.floor(end * share + F.col("offset")) - F.floor((end - 1) * share + F.col("offset"))
    return rows.withColumn("copies", F.least(crossed, F.lit(MOST)).cast("int")).drop("_source", "_slice", "_start", "_rank", "offset")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null text: size 0. Null source: a source of its own, last. A source without words has target 0 and is not taken. Rows
    that repeat id and text count separately. Equal sizes stand in order of a hash of the id, then the id, then the text. Texts of any length count
    whole; a long one may be taken up to 3 times. Other columns are ignored. An empty table gives none.
    """
    sized = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of docs as many times as copies() says, with all its columns, whatever their names.

    Null texts have size 0, a null source is one of its own, last, and a source without words is not taken. Documents of equal size stand in order of a hash of their id,
    then id, then text; rows that repeat count separately. An empty table gives none.
    """
    names = docs.columns
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.struct(*names).alias("_row"))
    taken = copies(packed, F.xxhash64(f"_row.{text_col}")).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
