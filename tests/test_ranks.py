"""Ranks, offsets, best rows and ratios of groups of any size, against plain loops; scratch spaces."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from segspark.operators import analytics, ranks
from segspark.session import scratch_space, stash


@pytest.fixture(params=["broadcast", "shuffled"])
def joins(spark, request):
    """Joins of small tables, and what large ones meet."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    if request.param == "shuffled":
        for k, v in zip(kept, ("-1", "false", "8"), strict=True):
            spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def _first(value):
    return (value is not None, value or 0)


def test_dense_ranks_and_offsets(joins):
    """A group on a third of all rows, a pair on a fifth, nulls in both columns, repeated rows."""
    drawn = random.Random(3)
    rows = [(i, 7 if i % 3 == 0 else drawn.choice([None, 1, 2, 3]), 5 if i % 5 == 0 else drawn.choice([None, *range(40)])) for i in range(900)]
    rows += rows[:50]
    frame = joins.createDataFrame(rows, "tag long, win long, col long")
    values = {w: sorted({c for _, g, c in rows if g == w}, key=_first) for w in {w for _, w, _ in rows}}
    want = sorted((t, _first(w), _first(c), values[w].index(c)) for t, w, c in rows)
    found = ranks.dense_ranks(frame, ["win"], "col", "place")
    assert found.columns == ["tag", "win", "col", "place"]
    assert sorted((r.tag, _first(r.win), _first(r.col), r.place) for r in found.collect()) == want
    at, offsets = 0, []
    for w in sorted(values, key=_first):
        offsets.append((w, at, at + len(values[w])))
        at += len(values[w])
    assert sorted(map(tuple, ranks.distinct_offsets(frame, ["win"], "col").collect()), key=lambda r: r[1]) == offsets
    nothing = frame.where("false")
    assert ranks.dense_ranks(nothing, ["win"], "col").count() == ranks.distinct_offsets(nothing, ["win"], "col").count() == 0


def test_ranks_within_several_columns(spark):
    frame = spark.createDataFrame([("a", 1, 2.5), ("a", 1, -1.0), ("a", 2, 9.0), ("b", 1, 2.5), ("a", 1, 2.5)], "g string, h long, v double")
    assert sorted(map(tuple, ranks.dense_ranks(frame, ["g", "h"], "v").collect())) == [("a", 1, -1.0, 0), ("a", 1, 2.5, 1), ("a", 1, 2.5, 1), ("a", 2, 9.0, 0), ("b", 1, 2.5, 0)]


def test_no_task_ranks_a_whole_group(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(kept, ("-1", "false", "8"), strict=True):
        spark.conf.set(k, v)
    try:
        frame = spark.range(8000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"), "id")
        found = ranks.dense_ranks(frame, ["g"], "id")
        assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) <= 2 * 8000 / 8
        assert found.where("g = 0").agg(F.sum("rank")).first()[0] == sum(range(2667))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_best_rows_of_any_scores(spark):
    frame = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("a", 3.0, 4), ("a", 3.0, 3), ("n", math.nan, 1), ("n", 9.0, 2), (None, None, 7), (None, None, 6)], "g string, t double, m long")
    assert {(r.g, r.m) for r in analytics.best_rows(frame, ["g"], "t", ["m"]).collect()} == {("a", 3), ("n", 1), (None, 6)}
    whole = spark.createDataFrame([("a", -(2**63), 1), ("a", 2**63 - 1, 2), ("b", -(2**63), 3), ("b", None, 4)], "g string, t long, m long")
    found = analytics.best_rows(whole, ["g"], "t", ["m"])
    assert {(r.g, r.m) for r in found.collect()} == {("a", 2), ("b", 3)} and found.columns == whole.columns
    assert "Window" not in found._jdf.queryExecution().toString()
    assert analytics.best_rows(whole.where("false"), ["g"], "t", ["m"]).count() == 0


def test_ratio_to_first_of_hot_groups(joins):
    rows = [(i, None if i % 3 == 0 else f"g{i % 7}", i % 11, float(1 + i % 13)) for i in range(600)]
    frame = joins.createDataFrame(rows, "id long, g string, o long, t double")
    first = {}
    for i, g, o, t in rows:
        first[g] = min(first.get(g, (o, i, t)), (o, i, t))
    found = analytics.ratio_to_first(frame, ["g"], "t", [F.col("o"), F.col("id")])
    assert {r.id: r.ratio for r in found.collect()} == {i: first[g][2] / t for i, g, _, t in rows}
    assert found.columns == [*frame.columns, "ratio"] and "Window" not in found._jdf.queryExecution().toString()


def test_scratch_space(spark):
    here = lambda frame: os.path.exists(frame._stashed_at.removeprefix("file:"))
    with scratch_space(spark):
        outer = stash(spark.range(3))
        with scratch_space(spark):
            inner = stash(spark.range(4))
            assert inner.count() == 4
        assert here(outer) and not here(inner) and outer.count() == 3
    after = stash(spark.range(2))
    assert not here(outer) and here(after)
    with pytest.raises(ZeroDivisionError), scratch_space(spark):
        failed = stash(spark.range(1))
        raise ZeroDivisionError
    assert not here(failed)
