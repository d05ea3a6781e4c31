"""Stored graphs: layers over tables in the same buckets equal layers over plain tables, and move sums only."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark import queries
from segspark.functions import vectors
from segspark.operators import graph, layers, segment, sparse, spmm
from segspark.operators.stored import StoredGraph
from segspark.session import stash

N, M = 60, 3000
SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def plain(spark):
    """No broadcast by size, 8 tasks: what a large graph meets."""
    kept = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def _graph(spark, hub=True):
    rng = np.random.default_rng(3)
    src, dst = rng.integers(0, N, M), rng.integers(0, N - 5, M)
    if hub:
        src[::3], dst[1::3] = 7, 4
    w, x = rng.integers(-5, 9, M).astype(float), rng.integers(-9, 9, (N, 5)).astype(float)
    edges = spark.createDataFrame([(int(s), int(t), float(v)) for s, t, v in zip(src, dst, w, strict=True)], "src long, dst long, w double")
    return edges, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), (src, dst, w, x)


def _product(src, dst, w, x):
    out = np.zeros_like(x)
    np.add.at(out, dst, w[:, None] * x[src])
    return out


def _exchanges(found):
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 8 out of 8" in text
    return re.findall(r"\bExchange ([^\n]*)", text)


def _matrix(found):
    rows = sorted(found.collect())
    assert [r.id for r in rows] == list(range(N))
    return np.array([r.x for r in rows])


@pytest.mark.parametrize("buckets", [None, 3])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_products_over_stored_tables(plain, buckets, adaptive, tmp_path):
    plain.conf.set("spark.sql.adaptive.enabled", adaptive)
    edges, nodes, (src, dst, w, x) = _graph(plain)
    StoredGraph.save(nodes, edges, "stored_a", buckets, f"file://{tmp_path}")
    stored = StoredGraph.open(plain, "stored_a")
    assert stored.buckets == (buckets or 8) and 7 in [r.src for r in stored.hubs.collect()]
    assert stored.edges.count() + stored.hub_edges.count() == M and stored.edges.where("src = 7").count() == 0
    assert np.array_equal(_matrix(spmm.gather_weight_scatter(stored, stored.nodes)), _product(src, dst, w, x))
    assert np.array_equal(_matrix(spmm.gather_scatter(stored, stored.nodes)), _product(src, dst, np.ones(M), x))
    twice = spmm.gather_scatter(stored, stored.cut(spmm.gather_weight_scatter(stored, stored.nodes)))
    assert np.array_equal(_matrix(twice), _product(src, dst, np.ones(M), _product(src, dst, w, x)))
    stored.drop()
    assert not plain.catalog.tableExists("stored_a_nodes")


@pytest.mark.parametrize("hub", [True, False])
def test_one_exchange_a_layer_and_none_between(plain, hub):
    edges, nodes, (src, dst, w, x) = _graph(plain, hub)
    stored = StoredGraph.save(nodes, edges, "stored_b")
    if not hub:  # a sample so small may take any id for a hub
        stored = StoredGraph("stored_b", 8, stored.nodes, stored.edges.where("src >= 0"), stored.hub_edges.where("false"), stored.hubs.where("false"))
        kept = ~np.isin(src, [r.src for r in plain.table("stored_b_hubs").collect()])
        src, dst, w = src[kept], dst[kept], w[kept]
    rng = np.random.default_rng(1)
    first, second = rng.integers(-3, 4, (6, 5)).astype(float), rng.integers(-3, 4, (2, 6)).astype(float)
    spread = lambda n, e: spmm.gather_weight_scatter(e, n, dim=5)
    found = layers.Stack([spread, spread])(stored.nodes, stored)
    assert np.array_equal(_matrix(found), _product(src, dst, w, np.maximum(_product(src, dst, w, x), 0)))
    shuffles = _exchanges(found)
    assert len(shuffles) == (1 if hub else 2) and all(s.startswith("hashpartitioning(id#") for s in shuffles)  # with hubs, the first layer is written
    stack = layers.Stack([layers.GCN(first, normalize=False), layers.GCN(second, normalize=False)])
    found = stack(stored.nodes, stored)
    assert np.allclose(_matrix(found), _product(src, dst, w, np.maximum(_product(src, dst, w, x) @ first.T, 0) @ second.T))
    assert len(_exchanges(found)) == (1 if hub else 3)  # one of vectors that Python has mapped
    again = layers.GIN(lambda v: v, 0.5, 5)(stored.nodes, stored)
    assert np.array_equal(_matrix(again), 1.5 * x + _product(src, dst, np.ones(len(src)), x))
    stored.drop()


def test_stored_graphs_of_odd_rows(plain):
    """Null ends go, null weights are 1, sources without a node send nothing, nodes without edges are zero, and tables may be empty."""
    nodes = plain.createDataFrame([(i, [float(i), 1.0], "a") for i in range(4)], "id long, x array<double>, _part string")
    edges = plain.createDataFrame([(1, 0, None, 1), (1, 0, 2.0, 2), (None, 0, 1.0, 3), (2, None, 1.0, 4), (9, 3, 1.0, 5), (3, 3, 1.0, 6)], "src long, dst long, w double, _n long")
    stored = StoredGraph.save(nodes, edges, "stored_c", 2)
    assert sorted(spmm.gather_weight_scatter(stored, stored.nodes).collect()) == [(0, [3.0, 3.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 1.0])]
    unweighted = StoredGraph.save(nodes, edges.drop("w"), "stored_c", 2)
    assert sorted(spmm.gather_weight_scatter(unweighted, unweighted.nodes).collect())[0] == (0, [2.0, 2.0])
    empty = StoredGraph.save(nodes, edges.where("false"), "stored_c", 2)
    assert [r.x for r in spmm.gather_weight_scatter(empty, empty.nodes).collect()] == [[0.0, 0.0]] * 4
    nothing = StoredGraph.save(nodes.where("false"), edges, "stored_c", 2)
    assert spmm.gather_weight_scatter(nothing, nothing.nodes, dim=2).count() == 0
    nothing.drop()


@pytest.mark.parametrize("dim", [5, 70])
def test_several_reductions_at_once(plain, dim):
    """One aggregate for all, narrow and in chunks; components that a shorter vector lacks count for nothing."""
    edges, _, (src, dst, _, _) = _graph(plain)
    x = np.random.default_rng(9).integers(-9, 9, (N, dim)).astype(float)
    nodes = plain.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    names = ["sum", "mean", "max", "min"]
    found = spmm.gather_scatter_several(edges, nodes, names, num_nodes=N)
    singly = [_matrix(spmm.gather_scatter(edges, nodes, n, num_nodes=N)) for n in names]
    assert np.allclose(_matrix(found), np.concatenate(singly, axis=1))
    joins = lambda f: f._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(found) == joins(spmm.gather_scatter(edges, nodes, num_nodes=N))
    short = plain.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "id long, x array<double>")
    pairs = plain.createDataFrame([(0, 0), (1, 0)], "src long, dst long")
    assert spmm.gather_scatter_several(pairs, short, ["sum", "max"], num_nodes=1).first().x == [4.0, 2.0, 3.0, 2.0]


def test_hubs_are_few_and_vectors_stay(plain):
    edges, nodes, _ = _graph(plain)
    stored = StoredGraph.save(nodes, edges, "stored_d")
    assert stored.hubs.count() < segment.SHARE * 8
    sent = stored.messages(stored.nodes)
    assert sorted(map(tuple, sent.select("src", "dst", "w").collect())) == sorted(map(tuple, edges.collect()))
    assert vectors.to_long(sent.select("src", "x").distinct().withColumnRenamed("src", "id"), ["id"]).count() == nodes.count() * 5
    stored.drop()


@pytest.mark.parametrize("hub", [True, False])
def test_normalised_layers_move_edges_once(plain, hub, tmp_path):
    """Merged as they are stored and never joined with degrees, edges give what gcn_norm() gives of merged edges, with one exchange to their buckets."""
    edges, nodes, _ = _graph(plain, hub)
    edges = edges.withColumn("w", F.when(F.col("src") % 7 != 0, F.abs("w") + 1)).union(plain.createDataFrame([(3, 3, 2.0), (3, 3, 4.0), (None, 3, 1.0), (3, None, 1.0)], edges.schema))
    weight = np.random.default_rng(2).integers(-3, 4, (4, 5)).astype(float)
    want = layers.GCN(weight)(nodes, sparse.coalesce_edges(edges))
    looped, roots = graph.norm_parts(graph.merge_loops(edges), nodes)
    stored = StoredGraph.save(nodes, looped, "stored_e", path=f"file://{tmp_path}", merge=True)
    kept = plain.table("stored_e_edges").union(plain.table("stored_e_hub_edges").select("src", "dst", "w"))
    assert kept.select("src", "dst").distinct().count() == kept.count() == N + edges.where("src <> dst").select("src", "dst").distinct().count()
    found = layers.normalized(layers.GCN(weight, normalize=False), stored.keep(roots))(stored.nodes, stored)
    assert np.allclose(_matrix(found), _matrix(want))
    stored.drop()
    plan = sparse.coalesce_edges(edges.repartition(8, "src"))._jdf.queryExecution().executedPlan().toString()  # what save() writes
    assert len(re.findall(r"\bExchange ", plan)) == 1


def test_stored_square_writes_no_edges_but_those_of_the_graph(plain, monkeypatch):
    """Neither merged nor normalised edges are written or dealt on their own."""
    names = []
    monkeypatch.setattr(queries, "stash", lambda df, name="table": names.append(name) or stash(df, name))
    stored, roots, dim = queries._stored_square(plain, "/root/testdata/sf0.001")
    assert names == [] and dim == 64 and roots.columns == ["id", "d"] and roots.count() == stored.nodes.count()
    stored.drop()
