"""Sums on the grid of node blocks: results of plain loops with hubs, gaps, repeated edges and unknown ends, and fewer bytes than sums by task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.operators import cells, grad, layers, sparse, spmm

N, M, P = 400, 40_000, 64


@pytest.fixture(scope="module")
def many(spark):
    """No broadcast and more tasks than a destination has sources in a cell: what a large table meets."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(P), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def ends():
    """A third of all edges out of one node, a third into another."""
    rng = np.random.default_rng(7)
    src, dst = rng.integers(0, N, M), rng.integers(0, N, M)
    src[::3], dst[1::3] = 7, 4
    return src, dst, rng.integers(-5, 9, M).astype(float)


def written(spark, tmp_path, ends):
    """The edges as a table, with unknown ends and ends that aren't nodes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    src, dst, w = ends
    extra = ([999, None, 3, 5], [1, 1, None, 2], [1.0, 1.0, 1.0, None])
    pq.write_table(pa.table({n: pa.array([*a.tolist(), *b]) for n, a, b in zip(("src", "dst", "w"), (src, dst, w), extra, strict=True)}), tmp_path / "edges.parquet")
    return spark.read.parquet(str(tmp_path / "edges.parquet"))


def moved(spark, f):
    """f() and the bytes that its stages wrote to shuffles, spills and tables."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before = set(stages())
    got = f()
    return got, sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for i, s in stages().items() if i not in before)


def test_attention_moves_edges_once(many, ends, tmp_path):
    edges = written(many, tmp_path, ends)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 4, 16))
    nodes = many.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<array<double>>")
    att = rng.normal(size=(2, 4, 16)) * 20  # scores some hundreds apart
    got, size = moved(many, lambda: {r.id: r.x for r in layers.gat(nodes, edges, *att).collect()})
    pairs = {(s, t) for s, t in zip(*ends[:2], strict=True) if s != t} | {(i, i) for i in range(N)} | {(5, 2)}
    a, b = (x * att[0]).sum(2), (x * att[1]).sum(2)
    assert got.keys() == set(range(N))
    for t in range(N):
        near = [s for s, d in pairs if d == t]
        s = a[near] + b[t]
        s = np.where(s > 0, s, 0.2 * s)
        e = np.exp(s - s.max(0))
        assert np.allclose(got[t], (e[:, :, None] * x[near]).sum(0) / e.sum(0)[:, None])
    assert size < 150 * M


def test_attention_of_odd_vectors(many):
    """A null score counts for nothing; a destination without any is null; infinite scores are as in one softmax."""
    rows = [(0, [[1.0, 2.0]]), (1, [[None, 1.0]]), (2, [[float("nan"), 1.0]]), (3, [[4.0, 0.0]]), (4, [[float("-inf"), 1.0]]), (None, [[1.0, 1.0]])]
    nodes = many.createDataFrame(rows, "id long, x array<array<double>>")
    edges = many.createDataFrame([(0, 3), (0, 3), (1, 3), (2, 0), (4, 5), (3, 1)], "src long, dst long")
    plain = {r.id: r.x for r in layers.gat(nodes, edges, np.ones((1, 2)), np.ones((1, 2))).collect()}
    grid, kept = cells.Grid(2, 3, many.createDataFrame([(0, 2), (3, 2), (5, 3)], "_cell long, _parts int")), cells.plan
    try:
        cells.plan = lambda edges, nodes, *sizes: (grid, nodes)
        found = {r.id: r.x for r in layers.gat(nodes, edges, np.ones((1, 2)), np.ones((1, 2))).collect()}
    finally:
        cells.plan = kept
    near = lambda xs: {k: str(np.round(np.array(v, dtype=float), 9)) for k, v in xs.items()}
    assert near(found) == near(plain)


def _summed(ends, x, w):
    out = np.zeros((N, *x.shape[1:]))
    np.add.at(out, ends[1], w * x[ends[0]])
    return out


def test_shared_heads_move_one_vector(many, ends, tmp_path, monkeypatch):
    edges = written(many, tmp_path, ends).withColumn("w", F.array(F.col("w"), F.col("w") * 2, F.col("w") - 1))
    x = np.random.default_rng(1).integers(-4, 5, (N, 70)).astype(float)
    nodes = many.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    shifts = [0.0, 5.0, -2.0]
    got, size = moved(many, lambda: {r.id: r.x for r in spmm.mh_spmm(edges, nodes, 3, 70, num_nodes=N, shifts=shifts).collect()})
    w = np.stack([ends[2], ends[2] * 2, ends[2] - 1], axis=1)[:, :, None]
    want = _summed(ends, x[:, None, :] + np.array(shifts)[:, None], w)
    assert all(got[i] == want[i].tolist() for i in range(N))
    shifted = lambda s: F.transform("x", lambda v: v + s)
    heads = nodes.select("id", F.array(*[shifted(s) for s in shifts]).alias("x"))
    assert {r.id: r.x for r in spmm.mh_spmm(edges, heads, 3, 70, num_nodes=N).collect()} == got
    monkeypatch.setattr(cells, "applies", lambda *a: False)
    by_task, more = moved(many, lambda: {r.id: r.x for r in spmm.mh_spmm(edges, nodes, 3, 70, num_nodes=N, shifts=shifts).collect()})
    assert by_task == got and size < more / 2


def test_propagation_joins_no_edge_with_degrees(many, ends, tmp_path):
    edges = sparse.coalesce_edges(written(many, tmp_path, ends).where("src < 400 AND dst < 400").withColumn("w", F.abs("w") + 1))
    edges.write.parquet(str(tmp_path / "merged"))
    edges = many.read.parquet(str(tmp_path / "merged"))
    x = np.random.default_rng(3).integers(-9, 9, (N, 16)).astype(float)
    nodes = many.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    a = np.zeros((N, N))
    rows = edges.collect()
    for r in rows:
        a[r.dst, r.src] = r.w
    a[np.arange(N), np.arange(N)] = np.where(a.diagonal() > 0, a.diagonal(), 1.0)
    root = a.sum(1) ** -0.5
    a = root[:, None] * a * root
    weight = np.random.default_rng(4).normal(size=(3, 16))
    got, size = moved(many, lambda: {r.id: r.x for r in layers.sgc(nodes, edges, 2, weight, 16).collect()})
    assert np.allclose([got[i] for i in range(N)], a @ a @ x @ weight.T)
    assert size < 180 * len(rows)


def test_gradient_of_compressed_rows(many, ends, tmp_path):
    edges = written(many, tmp_path, ends).where("src < 400 AND w IS NOT NULL")
    x = np.random.default_rng(3).integers(-9, 9, (N, 16)).astype(float)
    nodes = many.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    (of_nodes, _), _ = moved(many, lambda: grad.csr_product_grad(sparse.coo_to_csr(edges.where("dst IS NOT NULL")), sparse.csr_entries(edges.where("dst IS NOT NULL")), nodes, nodes, 16))
    got = {r.id: r.x for r in of_nodes.collect()}
    want = _summed((ends[1], ends[0]), x, ends[2][:, None])
    assert all(got[i] == want[i].tolist() for i in range(N))


@pytest.mark.parametrize("reduces", [["sum"], ["mean"], ["max", "sum"], ["min", "mean", "prod"]])
@pytest.mark.parametrize("dim", [3, 70])
def test_reductions_on_the_grid_equal_those_by_task(many, reduces, dim, monkeypatch):
    """Short vectors, gaps, nulls, unknown weights and ends, in cells that are split."""
    rng = np.random.default_rng(dim)
    rows = [(i, [None if rng.random() < 0.1 else float(v) for v in rng.integers(-3, 4, dim - i % 3)]) for i in range(20)]
    nodes = many.createDataFrame([*rows, (20, None), (21, []), (None, [1.0] * dim)], "id long, x array<double>")
    end = lambda: [None if v == 25 else int(v) for v in rng.integers(0, 26, 120)]
    edges = many.createDataFrame(list(zip(end(), end(), [None if v > 6 else float(v) for v in rng.integers(-5, 9, 120)], strict=True)), "src long, dst long, w double")
    grid = cells.Grid(2, 3, many.createDataFrame([(0, 2), (3, 2), (5, 3)], "_cell long, _parts int"))
    several = lambda: {r.id: r.x for r in spmm._reduced(edges, nodes, reduces, dim, True).where("id IS NOT NULL").collect()}
    monkeypatch.setattr(cells, "applies", lambda *a: False)
    want = several()
    monkeypatch.setattr(cells, "applies", lambda *a: True)
    monkeypatch.setattr(cells, "plan", lambda edges, nodes, *sizes: (grid, nodes))
    got = several()
    assert got.keys() == want.keys()
    near = lambda x: [None if v is None else round(v, 9) for v in x]
    assert all(near(got[i]) == near(want[i]) for i in want)


def test_both_gradients_take_one_exchange_of_entries(many, ends, tmp_path):
    """Entries are numbered and looked up without being dealt for a join with a row a partition, and both gradients read the same cells."""
    edges = written(many, tmp_path, ends).where("dst IS NOT NULL")
    x = np.random.default_rng(3).integers(-9, 9, (N, 16)).astype(float)
    nodes = many.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")

    def both():
        of_nodes, of_entries = grad.csr_product_grad(sparse.coo_to_csr(edges), sparse.csr_entries(edges), nodes, nodes, 16)
        return of_nodes.select("id", F.lit(None).cast("double").alias("value"), "x").union(of_entries.select("pos", "value", F.lit(None))).collect()

    rows, size = moved(many, both)
    want = _summed((ends[1], ends[0]), x, ends[2][:, None])
    want[5] += x[2]  # the edge of unknown weight
    got = {r.id: r.x for r in rows if r.x is not None}
    assert got == {i: want[i].tolist() for i in range(N)}
    order = sorted([(t, s) for s, t in zip(*ends[:2], strict=True)] + [(1, 999), (1, -1), (2, 5)])
    products = {r.id: r.value for r in rows if r.x is None}
    assert products == {p: float(x[t] @ x[s]) for p, (t, s) in enumerate(order) if 0 <= s < N}
    assert size < 80 * M


def test_gradients_on_the_grid_equal_those_of_broadcast_nodes(many, monkeypatch):
    """Null, short and unknown vectors, unknown weights and repeated entries, in cells that are split."""
    rng = np.random.default_rng(11)
    table = lambda: many.createDataFrame([*((i, [None if rng.random() < 0.05 else float(v) for v in rng.integers(-3, 4, 6 - (i % 5 == 0))]) for i in range(20)), (20, None), (21, [])], "id long, x array<double>")
    upstream, nodes = table(), table().where("id <> 3")
    end = lambda: [int(v) for v in rng.integers(0, 25, 150)]
    edges = many.createDataFrame(list(zip(end(), end(), [None if v > 6 else float(v) for v in rng.integers(-5, 9, 150)], strict=True)), "src long, dst long, w double")
    grid = cells.Grid(2, 3, many.createDataFrame([(0, 2), (3, 2), (5, 3)], "_cell long, _parts int"))
    entries = sparse.csr_entries(edges)

    def found():
        of_nodes, of_entries = grad.csr_product_grad(sparse.coo_to_csr(edges), entries, upstream, nodes, 6)
        return sorted((r.id, str(r.x)) for r in of_nodes.collect()), sorted((r.pos, r.value is None, r.value or 0) for r in of_entries.collect())

    monkeypatch.setattr(cells, "plan_both", lambda *a: grid)
    got = found()
    many.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        want = found()
    finally:
        many.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert got == want and any(v[1] for v in got[1])


def test_both_sides_bound_the_blocks():
    rows, columns = cells.shape(10 * cells.BYTES, cells.BYTES, 4, 30 * cells.BYTES)
    assert columns >= 10 and rows >= 30
