"""Plans: what is pushed to the scan, where shuffles stand, what stays in the JVM."""

import re

from pyspark.sql import functions as F

from segspark import fixtures as fx
from segspark.operators import layers, segment, sparse, spmm

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    text = plan(spmm.gather_weight_scatter(fx.edges(spark, SF), fx.nodes(spark, SF), dim=64, num_nodes=10))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert any(set(s.split(",")) == {"l_partkey:bigint", "l_suppkey:bigint", "l_quantity:double"} for s in schemas)
    assert not re.search("Python|Pandas|Arrow", text)


def test_a_filter_on_the_result_reaches_the_scan(spark):
    text = plan(spmm.gather_scatter(fx.edges(spark, SF), fx.nodes(spark, SF), dim=64, fill=False).where("id = 7"))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(l_suppkey,7\)", text)


def test_aggregation_is_partial_before_the_exchange(spark):
    text = plan(segment.index_scatter(fx.items(spark, SF), dim=64, fill=False))
    assert text.index("partial_sum") > text.index("Exchange hashpartitioning(id")


def test_bucketed_edges_need_no_exchange(spark):
    sparse.save_sorted(fx.edges(spark, SF), "bucketed_edges", 4)
    text = plan(spark.table("bucketed_edges").groupBy("dst").agg(F.sum("w")))
    assert "Exchange" not in text
    spark.sql("DROP TABLE bucketed_edges")


def test_running_sums_have_no_window_over_the_table(spark):
    text = plan(sparse.csr_entries(fx.edges(spark, SF)))
    single = [line for line in text.splitlines() if "Window" in line and "_block" not in line and "_row" not in line]
    assert not single


def test_linear_layers_are_one_arrow_pass(spark):
    text = plan(layers.apply(fx.nodes(spark, SF), layers.mlp([([[1.0] * 64] * 4, None), ([[1.0] * 4] * 2, None)])))
    assert len(re.findall("ArrowEvalPython", text)) == 1
