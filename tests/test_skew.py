"""Hubs: one key on a third of all rows, in joins, compressed rows, sampled products and attention. No task reads much more than its share, no plan moves vectors by destination, and results are those of plain loops."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.functions import scalars
from segspark.operators import augment, layers, sddmm, segment, sparse, spmm

N, M = 60, 3000


@pytest.fixture
def plain(spark):
    """No broadcast, no adaptive plans, 8 tasks: what a large table meets."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(kept, ("-1", "false", "8"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def graph():
    rng = np.random.default_rng(2)
    src, dst = rng.integers(0, N, M), rng.integers(0, N - 5, M)
    src[::3], dst[1::3] = 7, 4
    return src, dst, rng.integers(-5, 9, M).astype(float), rng.integers(-9, 9, (N, 5)).astype(float)


def _tables(spark, graph):
    src, dst, w, x = graph
    edges = spark.createDataFrame([(i, int(s), int(t), float(v)) for i, (s, t, v) in enumerate(zip(src, dst, w, strict=True))], "eid long, src long, dst long, w double")
    return edges, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def _sizes(found):
    return [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_no_task_gathers_over_twice_the_mean(plain, graph):
    edges, nodes = _tables(plain, graph)
    found = segment.gather(edges, nodes, "src")
    sizes = _sizes(found)
    assert sum(sizes) == M and len(sizes) == 8 and max(sizes) <= 2 * M / 8
    assert max(_sizes(edges.join(nodes.withColumnRenamed("id", "src"), "src"))) > M / 3
    assert sorted((r.eid, r.x) for r in found.collect()) == [(i, graph[3][s].tolist()) for i, s in enumerate(graph[0])]
    assert segment.hubs(edges, "src").count() < segment.SHARE * 8


def test_products_over_hubs(plain, graph):
    edges, nodes = _tables(plain, graph)
    src, dst, w, x = graph
    want = np.zeros((N, 5))
    np.add.at(want, dst, w[:, None] * x[src])
    got = {r.id: r.x for r in spmm.gather_weight_scatter(edges, nodes, num_nodes=N).collect()}
    assert all(got[i] == want[i].tolist() for i in range(N))
    assert segment.gather(edges.where("false"), nodes, "src").count() == 0


@pytest.mark.parametrize("wide", [16, 1 << 16])
def test_lookup_and_expansion_of_compressed_rows(spark, graph, wide):
    """A row that holds a third of all entries, empty rows, positions that repeat or lie outside; no array of positions."""
    edges, _ = _tables(spark, graph)
    rows = sparse.coo_to_csr(edges, num_rows=N + 3)
    asked = [0, 5, 5, 999, M - 1, M, -1]
    positions = spark.createDataFrame([(p, i) for i, p in enumerate(asked)], "pos long, tag long")
    owner = np.sort(graph[1])
    got = sparse.lookup_rows(rows, positions, wide).collect()
    assert sorted((r.tag, r.pos, r.row) for r in got) == [(i, p, int(owner[p])) for i, p in enumerate(asked) if 0 <= p < M]
    entries = sparse.csr_entries(edges)
    order = np.lexsort((graph[2], graph[0], graph[1]))
    found = sorted((r.pos, r.row, r.col, r.w) for r in sparse.csr_to_coo(rows, entries).collect())
    assert found == [(p, int(graph[1][i]), int(graph[0][i]), float(graph[2][i])) for p, i in enumerate(order)]
    plan = sparse.csr_to_coo(rows, entries)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_cut" in g or "div" in g for g in re.findall(r"Generate explode\(([^\n]*)", plan))


def test_long_rows_are_cut_twice(spark):
    """A row of 2 ** 40 entries: the arrays of cuts stay short, and its positions are found."""
    rows = spark.createDataFrame([(1, 0, 10), (2, 10, 1 << 34), (3, 1 << 34, (1 << 34) + 1)], "row long, ptr_begin long, ptr_end long")
    positions = spark.createDataFrame([(9,), (10,), (1 << 33,), ((1 << 34) - 1,), (1 << 34,), ((1 << 34) + 1,)], "pos long")
    assert sorted((r.pos, r.row) for r in sparse.lookup_rows(rows, positions).collect()) == [(9, 1), (10, 2), (1 << 33, 2), ((1 << 34) - 1, 2), (1 << 34, 3)]


def test_partitions_of_numbering_are_the_clusters(spark):
    """However small a block is, rows are dealt to no more partitions than are set for shuffles."""
    items = spark.range(5000).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("idx"))
    dealt = segment.deal(items, ["idx", "pos"], 10)
    assert dealt.select(F.shiftright("_at", 33)).distinct().count() <= 4 and dealt.groupBy("_block").count().agg(F.max("count")).first()[0] <= 10
    got = sparse.running_sum(items, F.col("pos"), "total", ["idx", "pos"], block=10).orderBy("idx", "pos").collect()
    assert [r.total for r in got] == np.cumsum([r.pos for r in got]).tolist()


@pytest.mark.parametrize("size", [40, 1 << 26])
def test_grid_products(plain, graph, size, monkeypatch):
    monkeypatch.setattr(sddmm, "BYTES", size * 40)
    edges, nodes = _tables(plain, graph)
    src, dst, _, x = graph
    extra = edges.union(plain.createDataFrame([(M, 999, 1, 1.0), (M + 1, None, 1, 1.0), (M + 2, 3, 3, None)], edges.schema))
    found = sddmm.grid_sddmm(extra, nodes, nodes)
    assert found.columns == ["eid", "src", "dst", "w", "value"]
    want = [(i, float(x[s] @ x[t])) for i, (s, t) in enumerate(zip(src, dst, strict=True))] + [(M + 2, float(x[3] @ x[3]))]
    assert sorted((r.eid, r.value) for r in found.collect()) == want
    assert sorted((r.eid, r.value) for r in sddmm.sddmm(extra, nodes, nodes).collect()) == want
    sizes = _sizes(found)
    assert max(sizes) <= 3 * sum(sizes) / 8
    odd = plain.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, None), (3, [None, 1.0]), (4, [5.0, 6.0])], "id long, x array<double>")
    pairs = plain.createDataFrame([(a, b) for a in range(5) for b in range(5)], "src long, dst long")
    got = {(r.src, r.dst): r.value for r in sddmm.grid_sddmm(pairs, odd, odd).collect()}
    assert got == {(a, b): {(0, 0): 5.0, (0, 4): 17.0, (4, 0): 17.0, (4, 4): 61.0, (1, 1): 9.0}.get((a, b)) for a in range(5) for b in range(5)}
    assert sddmm.grid_sddmm(edges.where("false"), nodes, nodes).count() == 0


def test_grid_sends_vectors_by_side():
    assert sddmm.grid(1000, 1000, 64) == (8, 8)
    rows, columns = sddmm.grid(1 << 40, 1 << 20, 800)
    assert rows >= (1 << 40) // sddmm.BYTES and columns == 1
    assert sddmm.grid(0, 0, 1) == (1, 1)


def test_attention_moves_no_vectors_by_destination(plain, graph):
    edges, _ = _tables(plain, graph)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 2, 3))
    nodes = plain.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<array<double>>")
    att = rng.normal(size=(2, 2, 3))
    found = layers.gat(nodes, edges.select("src", "dst"), *att)
    pairs = {(s, t) for s, t in zip(*graph[:2], strict=True) if s != t} | {(i, i) for i in range(N)}
    out = np.zeros((N, 2, 3))
    for t in range(N):
        near = [s for s, d in pairs if d == t]
        score = np.array([(att[0] * x[s]).sum(1) + (att[1] * x[t]).sum(1) for s in near])
        e = np.exp(np.where(score > 0, score, 0.2 * score))
        out[t] = (e[:, :, None] * x[near]).sum(0) / e.sum(0)[:, None]
    got = {r.id: r.x for r in found.collect()}
    assert all(np.allclose(got[t], out[t]) for t in range(N))
    text = plain.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    exchanges = re.findall(r"Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]\s*\nArguments: hashpartitioning\(([^)]*)", text)
    by_dst = [columns for columns, keys in exchanges if keys.startswith("dst#")]
    assert by_dst and len(exchanges) > len(by_dst) and not any(re.search(r"\bx#", columns) for columns in by_dst)


def test_many_wide_heads(spark, graph):
    edges, _ = _tables(spark, graph)
    x = np.random.default_rng(1).integers(-4, 5, (N, 3, 70)).astype(float)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<array<double>>")
    src, dst, w, _ = graph
    heads = edges.withColumn("w", F.array(F.col("w"), F.col("w") * 2, F.col("w") - 1))
    want = np.zeros((N, 3, 70))
    np.add.at(want, dst, np.stack([w, w * 2, w - 1], axis=1)[:, :, None] * x[src])
    got = {r.id: r.x for r in spmm.mh_spmm(heads, nodes, 3, 70, num_nodes=N).collect()}
    assert all(got[i] == want[i].tolist() for i in range(N))


def test_drawn_numbers_depend_on_nothing_but_seed_and_key(spark):
    rows = spark.range(4000)
    draw = lambda n: {r.id: (r.u, r.z) for r in rows.repartition(n).select("id", scalars.uniform(3, F.col("id")).alias("u"), scalars.normal(3, F.col("id")).alias("z")).collect()}
    one = draw(3)
    assert one == draw(7)
    u, z = np.array(list(one.values())).T
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05
    nodes, edges = augment.random_graph(rows, 2, 3, seed=4)
    assert edges.count() == 8000 and edges.where("dst < 0 OR dst >= 4000").count() == 0
    assert sorted(edges.collect()) == sorted(augment.random_graph(rows.repartition(5), 2, 3, seed=4)[1].collect())
