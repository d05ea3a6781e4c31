"""The operators' inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sparse import number_rows
from .session import table


def node_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").count()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, x): embeddings in thousandths, whole-valued so that sums are exact in any order."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.round(e.cast("double") * 1000)).alias("x"))


def edges(spark: SparkSession, d: str, dst: str = "l_suppkey") -> DataFrame:
    """(src, dst, w): part (modulo the node count) to supplier, weighted by quantity."""
    n = node_count(spark, d)
    return table(spark, d, "lineitem").select((F.col("l_partkey") % n).alias("src"), F.expr(dst.format(n=n)).cast("long").alias("dst"), F.col("l_quantity").cast("double").alias("w"))


SQUARE = "l_orderkey % {n}"
GAP = "3 * l_suppkey"


def numbered_edges(spark: SparkSession, d: str, dst: str = "l_suppkey") -> DataFrame:
    """edges() with eid, the row's number in a total order of lineitem."""
    n = node_count(spark, d)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice"]
    ends = [(F.col("l_partkey") % n).alias("src"), F.expr(dst.format(n=n)).cast("long").alias("dst"), F.col("l_quantity").cast("double").alias("w")]
    return number_rows(table(spark, d, "lineitem").select(*order), "eid", order, keep=ends).select("eid", "src", "dst", "w")


def links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst) of the square graph."""
    return edges(spark, d, SQUARE).select("src", "dst").distinct()


def items(spark: SparkSession, d: str) -> DataFrame:
    """(pos, idx, x): embeddings by label."""
    return nodes(spark, d).withColumnRenamed("id", "pos").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").cast("long").alias("idx")), "pos")


#: Heads that a node's vector is cut into.
HEADS = 8


def head_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, x) with the vector cut into HEADS heads of equal length."""
    wide = F.floor(F.size("x") / HEADS).cast("int")
    return nodes(spark, d).select("id", F.transform(F.sequence(F.lit(0), F.lit(HEADS - 1)), lambda h: F.slice("x", h * wide + 1, wide)).alias("x"))


def head_edges(spark: SparkSession, d: str, numbered: bool = False) -> DataFrame:
    """(src, dst, w) with the quantity times 1 to HEADS as weights."""
    rows = numbered_edges(spark, d) if numbered else edges(spark, d)
    return rows.withColumn("w", F.transform(F.sequence(F.lit(1), F.lit(HEADS)), lambda h: h * F.col("w")))


def results(spark: SparkSession, d: str) -> DataFrame:
    """(dataname, feature_size, method, time): events as a table of measurements."""
    method = F.element_at(F.lit(["base", "csr", "ours"]), (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id"), F.col("event_type").alias("dataname"), F.pmod(F.col("user_id"), F.lit(8)).alias("feature_size"), method.alias("method"), F.col("value").alias("time"))
