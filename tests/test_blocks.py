"""Blocks of running sums hold a bounded number of rows, whatever the keys."""

import itertools

import pytest
from pyspark.sql import functions as F

from segspark import fixtures as fx
from segspark.operators import sddmm, segment, sparse
from segspark.operators.segment import hubs


@pytest.fixture(scope="module")
def hot(spark):
    """2,000 rows of keys 0 to 9, most of them 3."""
    return spark.range(2000).select(F.col("id").alias("pos"), F.when(F.col("id") % 4 == 0, F.col("id") % 10).otherwise(3).alias("idx"), (F.col("id") % 7).alias("v"))


def test_a_hot_key_is_dealt_over_blocks(hot):
    sizes = [r["count"] for r in segment.deal(hot, ["idx", "pos"], 200).groupBy("_block").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 600


def test_no_task_numbers_more_than_twice_its_share(spark):
    """All edges of the largest tables: few distinct destinations, and then one that holds a third of all rows."""
    edges = fx.edges(spark, "/root/testdata/sf0.1")
    hot = edges.withColumn("dst", F.when(F.pmod(F.xxhash64("src", "dst", "w"), F.lit(3)) == 0, 7).otherwise(F.col("dst")))
    for rows in (edges, hot):
        sizes = [r["count"] for r in segment.deal(rows, ["dst", "src", "w"], sparse.BLOCK).groupBy("_block").count().collect()]
        assert len(sizes) >= 9 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_running_sums_use_these_blocks(hot, monkeypatch):
    seen, deal = [], sparse.deal
    monkeypatch.setattr(sparse, "deal", lambda *a: seen.append(deal(*a)) or seen[-1])
    got = sparse.number_rows(hot, "place", ["idx", "pos"], block=200).collect()
    assert seen[0].select("_block").distinct().count() >= 5
    assert [r.place for r in sorted(got, key=lambda r: (r.idx, r.pos))] == list(range(2000))


def test_segmented_scan_crosses_blocks(hot):
    rows = sorted(hot.collect(), key=lambda r: (r.idx, r.pos))
    want = {}
    for _, group in itertools.groupby(rows, key=lambda r: r.idx):
        group = list(group)
        want |= dict(zip((r.pos for r in group), itertools.accumulate(r.v for r in group), strict=True))
    assert {r.pos: r.running for r in segment.segmented_scan(hot, block=200).collect()} == want


def test_vectors_sent_stay_in_proportion_to_edges():
    """Ten times the edges, nodes and partitions: ten times the bytes of vectors, not ten times as many for each row and column of a larger grid."""
    sent = []
    for times in (1, 10, 100):
        edges, size = 50_000 * times, 500_000 * times
        rows, columns = sddmm.grid(size, size, sddmm.cells_for(edges, size, size, 100 * times, 8))
        sent.append(size * (rows + columns) / times)
    assert max(sent) <= 1.5 * min(sent)


def test_cells_of_average_size_are_not_split(spark):
    rows = spark.range(64_000).selectExpr("id % 32 AS cell")
    assert hubs(rows, "cell", 16).count() == 0
    hot = rows.union(spark.range(30_000).selectExpr("0L AS cell"))
    assert [r.cell for r in hubs(hot, "cell", 16).collect()] == [0]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_symmetrize_reads_edges_once_and_moves_a_pair_once(spark):
    rows = [(1, 2), (2, 1), (3, 3), (None, 4), (4, None), (None, None), (5, 6), (5, 6)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    found = sparse.symmetrize(edges)
    assert exchanges(found) == 1
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {*rows, *((b, a) for a, b in rows)}
    assert exchanges(sparse.symmetrize(edges.distinct())) <= 2


def test_numbering_writes_only_what_is_kept(hot, monkeypatch):
    seen, deal = [], sparse.deal
    monkeypatch.setattr(sparse, "deal", lambda *a: seen.append(deal(*a)) or seen[-1])
    got = sparse.number_rows(hot, "place", ["idx", "pos"], keep=["v"]).collect()
    assert set(seen[0].columns) == {"v", "_at", "_block"}
    rows = sorted(hot.collect(), key=lambda r: (r.idx, r.pos))
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == [r.v for r in rows]


def test_tiles_are_plain_aggregates(spark):
    """Neither lists nor maps nor a second merge of distinct entries; narrow tiles, gaps and negative weights as by the general way."""
    entries = spark.createDataFrame([(0, 5, 1.5), (0, 7, -2.0), (1, 5, 3.0), (3, 9, 0.0), (4, 1, 2.0), (9, 2, None), (9, 4, 5.0), (9, 6, 1.0)], "row long, col long, w double")
    found = sparse.block_format(entries, 4, 2, unique=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and exchanges(found) == 1
    got = {(r.win, r.blk): (r.width, r.cols, r.vals) for r in found.collect()}
    assert got == {
        (0, 0): (2, [5, 7], [1.5, -2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (0, 1): (1, [9], [0.0, 0.0, 0.0, 0.0]),
        (1, 0): (1, [1], [2.0, 0.0, 0.0, 0.0]), (2, 0): (2, [2, 4], [0.0, 0.0, 1.0, 5.0, 0.0, 0.0, 0.0, 0.0]), (2, 1): (1, [6], [0.0, 1.0, 0.0, 0.0]),
    }
