"""Operators against plain NumPy loops on seeded graphs, algebraic properties, and hand-written edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.functions import scalars, vectors
from segspark.operators import analytics, augment, compare, grad, graph, layers, sddmm, segment, sparse, spmm, tree
from segspark.plans.layout import reduce_vectors

N, M, D = 30, 200, 5


def vec_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def edge_table(spark, src, dst, w):
    return spark.createDataFrame([(i, int(s), int(t), float(v)) for i, (s, t, v) in enumerate(zip(src, dst, w, strict=True))], "eid long, src long, dst long, w double")


def dense(found, n, d=D):
    out = np.full((n, d), np.nan)
    for r in found.collect():
        out[r["id"]] = r["x"]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    src, dst = rng.integers(0, N, M), rng.integers(0, N - 4, M)
    dst[:60] = 2  # a hub
    src[5], dst[5] = 7, 7  # a self loop
    src[6], dst[6], src[7], dst[7] = 1, 3, 1, 3  # a duplicate
    return src, dst, rng.integers(-5, 9, M).astype(float), rng.integers(-9, 9, (N, D)).astype(float)


@pytest.fixture(scope="module")
def nodes(spark, data):
    return vec_table(spark, data[3]).cache()


@pytest.fixture(scope="module")
def edges(spark, data):
    return edge_table(spark, *data[:3]).cache()


def spmm_loop(src, dst, w, x, n):
    out = np.zeros((n, x.shape[1]))
    for s, t, v in zip(src, dst, w, strict=True):
        out[t] += v * x[s]
    return out


@pytest.mark.parametrize(("how", "f"), [("sum", np.sum), ("mean", np.mean), ("max", np.max), ("amax", np.max), ("min", np.min), ("amin", np.min), ("prod", np.prod)])
def test_segment_reductions(spark, how, f):
    rng = np.random.default_rng(1)
    idx, x = rng.choice([0, 1, 3, 6], 40), rng.integers(-3, 4, (40, 3)).astype(float)
    items = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(idx, x, strict=True))], "pos long, idx long, x array<double>")
    want = np.zeros((7, 3))
    for k in set(idx):
        want[k] = f(x[idx == k], axis=0)
    assert np.allclose(dense(segment.index_scatter(items, how), 7, 3), want)
    assert segment.index_scatter(items, how, fill=False).count() == 4
    assert segment.index_scatter(items, how, num_segments=9).count() == 9


def test_unknown_reduction_is_refused():
    with pytest.raises(ValueError, match="unknown reduction"):
        scalars.reduction("median")


def test_empty_items(spark):
    items = spark.createDataFrame([], "pos long, idx long, x array<double>")
    assert segment.index_scatter(items).count() == 0
    assert segment.index_scatter(items, dim=2, num_segments=3).collect()[0]["x"] == [0.0, 0.0]


@pytest.mark.parametrize("dim", [1, 64, 65, 150])
def test_wide_vectors_go_by_chunks(spark, dim):
    rng = np.random.default_rng(dim)
    x, key = rng.integers(-9, 9, (50, dim)).astype(float), rng.integers(0, 4, 50)
    rows = spark.createDataFrame([(int(k), v.tolist(), 2.0) for k, v in zip(key, x, strict=True)], "id long, x array<double>, w double")
    got = dense(reduce_vectors(rows, ["id"], "x", "sum", dim, F.col("w")), 4, dim)
    assert np.allclose(got, [2 * x[key == k].sum(0) for k in range(4)])


def test_products(edges, nodes, data):
    src, dst, w, x = data
    n = dst.max() + 1
    assert np.allclose(dense(spmm.gather_scatter(edges, nodes), n), spmm_loop(src, dst, np.ones(M), x, n))
    assert np.allclose(dense(spmm.gather_weight_scatter(edges, nodes), n), spmm_loop(src, dst, w, x, n))
    ones = graph.drop_weights(edges)
    assert np.allclose(dense(spmm.gather_weight_scatter(ones, nodes), n), dense(spmm.gather_scatter(edges, nodes), n))
    assert np.allclose(dense(spmm.gather_weight_scatter(edges.repartition(7), nodes, num_nodes=N), N), spmm_loop(src, dst, w, x, N))
    assert spmm.gather_scatter(edges.where("false"), nodes, num_nodes=3).count() == 3
    got = dense(spmm.gather_scatter(edges, nodes, "max"), n)
    for t in range(n):
        assert np.allclose(got[t], x[src[dst == t]].max(0) if (dst == t).any() else 0)


def test_missing_weight_is_one(edges, nodes):
    blank = edges.withColumn("w", F.lit(None).cast("double"))
    assert np.allclose(dense(spmm.gather_weight_scatter(blank, nodes, num_nodes=N), N), dense(spmm.gather_scatter(edges, nodes, num_nodes=N), N))


def test_compressed_rows(spark, edges, nodes, data):
    src, dst, w, x = data
    rows, entries = sparse.coo_to_csr(edges, num_rows=N), sparse.csr_entries(edges)
    counts = np.bincount(dst, minlength=N)
    ends = counts.cumsum()
    got = rows.orderBy("row").collect()
    assert [(r.ptr_begin, r.ptr_end) for r in got] == list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
    assert np.allclose(dense(spmm.csr_product(rows, entries, nodes), N), spmm_loop(src, dst, w, x, N))
    coo = sparse.csr_to_coo(rows, entries)
    assert sorted((r.col, r.row, r.w) for r in coo.collect()) == sorted(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True))
    twice = sparse.transpose(sparse.transpose(edges))
    assert sorted(map(tuple, twice.select("src", "dst", "w").collect())) == sorted(map(tuple, edges.select("src", "dst", "w").collect()))


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_running_sums_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(block)
    keys, v = rng.integers(-20, 60, 300), rng.integers(-5, 5, 300)
    rows = spark.createDataFrame([(int(k), i, int(x)) for i, (k, x) in enumerate(zip(keys, v, strict=True))], "k long, i long, v long").repartition(5)
    got = {r.i: (r.s, r.p) for r in sparse.number_rows(sparse.running_sum(rows, F.col("v"), "s", ["k", "i"], block=block), "p", ["k", "i"], block=block).collect()}
    order = np.lexsort((np.arange(300), keys))
    assert got == {int(i): (int(s), p) for p, (i, s) in enumerate(zip(order, v[order].cumsum(), strict=True))}


def test_multi_head(spark, edges, data):
    src, dst, w, x = data
    rng = np.random.default_rng(5)
    x, weights = rng.integers(-9, 9, (N, 2, 3)).astype(float), np.stack([w, w + 1], 1)
    heads = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<array<double>>")
    table = spark.createDataFrame([(i, int(s), int(t), v.tolist()) for i, (s, t, v) in enumerate(zip(src, dst, weights, strict=True))], "eid long, src long, dst long, w array<double>")
    want = np.zeros((N, 2, 3))
    for s, t, v in zip(src, dst, weights, strict=True):
        want[t] += v[:, None] * x[s]
    long = table.select("eid", F.posexplode("w").alias("h", "w"))
    for found in (spmm.mh_spmm(table, heads, 2, 3, num_nodes=N), spmm.mh_spmm_transposed(table, long, heads, 2, 3, num_nodes=N)):
        assert np.allclose([r.x for r in found.orderBy("id").collect()], want)


def test_sampled_products_and_gradients(edges, nodes, data):
    src, dst, w, x = data
    upstream = nodes.withColumn("x", F.transform("x", lambda v: v * 2 + 1))
    y = x * 2 + 1
    want = {i: float(y[t] @ x[s]) for i, (s, t) in enumerate(zip(src, dst, strict=True))}
    assert {r.eid: r.value for r in grad.weight_grad(edges, upstream, nodes).collect()} == want
    assert {r.eid: r.value for r in sddmm.weighted_sddmm(edges, upstream, nodes).collect()} == {i: v * w[i] for i, v in want.items()}
    assert np.allclose(dense(grad.gather_weight_scatter_grad(edges, upstream, nodes), N), spmm_loop(dst, src, w, y, N))
    assert np.allclose(dense(grad.gather_scatter_grad(edges, upstream, nodes), N), spmm_loop(dst, src, np.ones(M), y, N))
    forward = dense(spmm.gather_weight_scatter(edges, nodes, num_nodes=N), N)
    assert (forward * y).sum() == pytest.approx((x * dense(grad.gather_weight_scatter_grad(edges, upstream, nodes), N)).sum())
    rows, entries = sparse.coo_to_csr(edges), sparse.csr_entries(edges)
    by_node, by_entry = grad.csr_product_grad(rows, entries, upstream, nodes)
    assert np.allclose(dense(by_node, N), spmm_loop(dst, src, w, y, N))
    assert sorted(r.value for r in by_entry.collect()) == sorted(want.values())
    assert sddmm.sddmm_csr(rows, entries, upstream, nodes).count() == M


def test_block_format(spark, data):
    src, dst, w, x = data
    pairs = {}
    for s, t, v in zip(src, dst, w, strict=True):
        pairs[int(t), int(s)] = pairs.get((int(t), int(s)), 0) + float(v)
    coo = spark.createDataFrame([(int(t), int(s), float(v)) for s, t, v in zip(src, dst, w, strict=True)], "row long, col long, w double")
    tiles = sparse.block_format(coo, 8, 4)
    for t in tiles.collect():
        cols = sorted({c for r, c in pairs if r // 8 == t.win})[t.blk * 4 : t.blk * 4 + 4]
        assert t.cols == cols and t.width == len(cols)
        assert t.vals == [pairs.get((t.win * 8 + r, c), 0.0) for r in range(8) for c in cols]
    assert np.allclose(dense(spmm.blocked_product(tiles, vec_table(spark, x), 8, num_rows=N), N), spmm_loop(src, dst, w, x, N))
    ptr = sparse.block_pointers(coo, 8, 4, num_rows=N, pad_rows_to=16).orderBy("win").collect()
    assert len(ptr) == 4 and ptr[-1].ptr_end == sum(len({c for r, c in pairs if r // 8 == k}) for k in range(4))


def test_axis_reduction(spark):
    x = np.random.default_rng(2).integers(-9, 9, (3, 4, 2)).astype(float)
    index = [1, 0, 1, 2]
    cells = spark.createDataFrame([(i, j, k, float(x[i, j, k])) for i in range(3) for j in range(4) for k in range(2)], "i long, j long, k long, v double")
    table = spark.createDataFrame(list(enumerate(index)), "j long, idx long")
    want = np.zeros((3, 3, 2))
    for j, t in enumerate(index):
        want[:, t] += x[:, j]
    got = segment.index_scatter_axis(cells, table, "j").collect()
    assert all(r.v == want[r.i, r.idx, r.k] for r in got) and len(got) == 18


@pytest.mark.parametrize("block", [3, 1000])
def test_boundaries_runs_and_scans(spark, block):
    idx = [0, 0, 2, 2, 2, 3, 7, 7, 9]
    items = spark.createDataFrame([(i, k, i + 1) for i, k in enumerate(idx)], "pos long, idx long, v long")
    got = segment.segment_boundaries(items, block).orderBy("pos").collect()
    assert [r.is_start for r in got] == [i == 0 or idx[i] != idx[i - 1] for i in range(9)]
    assert sorted(map(tuple, segment.run_lengths(items).collect())) == [(0, 0, 2), (2, 2, 3), (3, 5, 1), (7, 6, 2), (9, 8, 1)]
    assert [r.running for r in segment.segmented_scan(items).orderBy("pos").collect()] == [1, 3, 3, 7, 12, 6, 7, 15, 9]


def test_normalised_graph(spark, data):
    src, dst, w, x = data
    a = np.zeros((N, N))
    for s, t, v in zip(src, dst, np.abs(w) + 1, strict=True):
        a[t, s] += v
    pairs = np.argwhere(a)
    edges = edge_table(spark, pairs[:, 1], pairs[:, 0], a[a > 0])
    looped = a + np.diag(np.where(np.diag(a) == 0, 1, 0))
    scale = looped.sum(1) ** -0.5
    nodes = vec_table(spark, x)
    want = scale[:, None] * looped * scale[None]
    got = np.zeros((N, N))
    for r in graph.gcn_norm(edges, nodes).collect():
        got[r.dst, r.src] = r.w
    assert np.allclose(got, want)
    weight, bias = np.random.default_rng(1).normal(size=(3, D)), np.ones(3)
    assert np.allclose(dense(layers.GCN(weight, bias)(nodes, edges), N, 3), want @ x @ weight.T + bias)
    wide = np.random.default_rng(2).normal(size=(8, D))
    assert np.allclose(dense(layers.GCN(wide, cached=True)(nodes, edges), N, 8), want @ x @ wide.T)
    assert np.allclose(dense(layers.sgc(nodes, edges, 2, weight, D), N, 3), want @ want @ x @ weight.T)
    assert np.allclose(dense(layers.appnp(nodes, edges, 1, 0.5, D), N), 0.5 * want @ x + 0.5 * x)
    with pytest.raises(ValueError, match="self loops"):
        layers.GCN(weight, normalize=False, self_loops=True)
    with pytest.raises(ValueError, match="flow"):
        graph.gcn_norm(edges, nodes, flow="up")


def test_other_layers(spark, edges, nodes, data):
    src, dst, w, x = data
    a = np.zeros((N, N))
    np.add.at(a, (dst, src), 1)
    w1, w2 = np.random.default_rng(4).normal(size=(4, D)), np.random.default_rng(5).normal(size=(4, 4))
    nn = layers.mlp([(w1, None), (w2, np.ones(4))])
    assert np.allclose(dense(layers.GIN(nn, 0.1)(nodes, edges), N, 4), np.maximum((1.1 * x + a @ x) @ w1.T, 0) @ w2.T + 1)
    mean = a @ x / np.maximum(a.sum(1, keepdims=True), 1)
    out = mean @ w1.T + x @ w1.T
    assert np.allclose(dense(layers.SAGE(w1, w1, aggr="mean", normalize=True)(nodes, edges), N, 4), out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))
    both = np.random.default_rng(6).normal(size=(2, 2 * D))
    got = dense(layers.SAGE(both, aggr=["sum", "mean"])(nodes, edges), N, 2)
    assert np.allclose(got, np.concatenate([a @ x, mean], 1) @ both.T)
    jk = layers.jumping_knowledge([nodes, spmm.gather_scatter(edges, nodes, num_nodes=N)], "cat")
    assert np.allclose(dense(jk, N, 2 * D), np.concatenate([x, a @ x], 1))
    norm = (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5)
    assert np.allclose(dense(layers.feature_norm(nodes, "batch", D), N), norm)
    norm = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    assert np.allclose(dense(layers.feature_norm(nodes, "layer", D), N), norm)
    stack = layers.Stack([layers.GIN(layers.linear(np.eye(D))), layers.GIN(layers.linear(w1))], jk="last", out=layers.linear(w2))
    hidden = np.maximum(x + a @ x, 0)
    assert np.allclose(dense(stack(nodes, edges), N, 4), np.maximum((hidden + a @ hidden) @ w1.T, 0) @ w2.T)
    with pytest.raises(ValueError, match="activation"):
        layers.activation("nope")


def test_graph_tables(spark, edges, nodes):
    bare = graph.Graph.from_tables(spark.range(3), spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert tuple(bare.summary().first()) == (3, 32, 0, 1) and bare.edges.first().w == 1.0
    assert graph.add_self_loops(edges, nodes).count() == M + N
    assert graph.missing_nodes(spark.createDataFrame([(99,), (1,)], "src long"), nodes).collect()[0][0] == 99
    bad = spark.createDataFrame([(-1, 0), (1, 0)], "src long, dst long")
    assert [r.valid for r in graph.validate_index(bad, 3).collect()] == [False, True]
    assert [r.src for r in graph.wrap_negative(bad, 3).collect()] == [2, 1]
    with pytest.raises(Exception, match="outside"):
        graph.validate_index(bad, 3, strict=True).collect()
    with pytest.raises(TypeError):
        graph.validate_index(bad.withColumn("src", F.lit("x")), 3)
    assert sparse.symmetrize(sparse.symmetrize(edges)).count() == sparse.symmetrize(edges).count()


def test_vectors_and_scalars(spark):
    row = spark.createDataFrame([([3.0, -4.0], [1.0, 2.0], "./a/b_idx.npy")], "a array<double>, b array<double>, p string")
    a, b = F.col("a"), F.col("b")
    got = row.select(vectors.dot(a, b), vectors.dot(b, b), vectors.axpy(2, a, b), vectors.relu(a), vectors.l2_normalize(a), scalars.dataset_name(F.col("p")), scalars.capitalized(F.lit("abc")), scalars.nearest_power_of_two(F.lit(6.0)), scalars.inverse_sqrt(F.lit(0.0))).first()
    assert tuple(got) == (-5.0, 5.0, [7.0, -6.0], [3.0, 0.0], [0.6, -0.8], "b", "Abc", 8.0, 0.0)
    long = vectors.to_long(row.select(F.lit(1).alias("id"), "a"), ["id"], "a")
    assert vectors.to_vectors(long, ["id"]).first()["x"] == [3.0, -4.0]


def test_inner_products_of_any_lengths(spark):
    pairs = [([1.0, 2.0], [3.0, 4.0]), ([], []), (None, [1.0]), ([2.0], [5.0]), ([1.0, 2.0], [1.0]), ([1.0, None], [1.0, 1.0]), ([1.0] * 128, [2.0] * 128)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<double>, b array<double>").coalesce(1)
    want = [11.0, 0.0, None, 10.0, None, None, 256.0]
    assert [r[0] for r in rows.orderBy("i").select(vectors.dot(F.col("a"), F.col("b"))).collect()] == want
    assert rows.where("i in (0, 6)").select(vectors.dot(F.col("a"), F.col("b"))).count() == 2
    assert [r[0] for r in rows.where("size(a) = 2 and i = 0").select(vectors.dot(F.col("a"), F.col("b"))).collect()] == [11.0]
    assert rows.where("false").select(vectors.dot(F.col("a"), F.col("b"))).count() == 0


def test_vectors_of_different_lengths_are_reduced_whole(spark):
    items = spark.createDataFrame([(0, [1.0]), (0, [2.0, 3.0, 4.0]), (1, [5.0, 6.0])], "idx long, x array<double>").coalesce(1)
    got = {r.id: r.x for r in segment.index_scatter(items).collect()}
    assert got[0] == [3.0, 3.0, 4.0] and got[1][:2] == [5.0, 6.0]


def test_comparison(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id long, value double")
    b = spark.createDataFrame([(1, 1.00001), (2, 2.5)], "id long, value double")
    got = compare.compare(a, b, ["id"]).first()
    assert (got.cells, got.missing, got.all_close, got.bad_relative) == (3, 1, False, 1) and got.max_abs_diff == 0.5
    assert [r.id for r in compare.worst_cells(a, b, ["id"], most=1).collect()] == [2]


def test_index_vectors(spark):
    idx = sorted(np.random.default_rng(1).integers(0, 40, 64).tolist())
    items = spark.createDataFrame(list(enumerate(idx)), "pos long, idx long")
    assert [r.idx for r in augment.down_sample(items, 4).orderBy("pos").collect()] == [idx[i * 4] // 4 for i in range(16)]
    spots = [max((i + 0.5) / 2 - 0.5, 0) for i in range(128)]
    want = [int(np.floor(np.interp(s, range(64), idx) * 2)) for s in spots]
    assert [r.idx for r in augment.up_sample(items, 2).orderBy("pos").collect()] == want
    noisy = [r.idx for r in augment.noise_augment(items, 1).orderBy("pos").collect()]
    assert noisy == sorted(noisy) and len(noisy) == 64
    made = augment.synthetic_index(spark, 50, 1, 40, 500, 0.5, seed=3).orderBy("pos").collect()
    assert [r.pos for r in made] == list(range(500)) and [r.idx for r in made] == sorted(r.idx for r in made)
    assert len(augment.scale_exponents(64_000)) == 12 and augment.scale_exponents(64_000)[0] == 6


@pytest.mark.parametrize("exponents", [[2, 1, 0, -1, -2], [0]])
def test_scale_ladder(spark, exponents, monkeypatch):
    """Every step against NumPy: evenly spaced rows while the exponent is positive, half-pixel interpolation beyond."""
    monkeypatch.setattr(augment, "scale_exponents", lambda rows: exponents)
    idx = np.sort(np.random.default_rng(4).integers(0, 90, 50))
    want = []
    for step, e in enumerate(exponents):
        if e > 0:
            new = round(50 / 2**e)
            values = [idx[int(i * 50 // new)] // 2**e for i in range(new)]
        else:
            scale = 2**-e
            spots = np.maximum((np.arange(50 * scale) + 0.5) / scale - 0.5, 0)
            values = np.floor(np.interp(spots, range(50), idx) * scale).astype(int)
        want += [(step, pos, int(v)) for pos, v in enumerate(values)]
    items = spark.createDataFrame(list(enumerate(idx.tolist())), "pos long, idx long")
    assert sorted(tuple(r) for r in augment.scale_ladder(items).collect()) == want


def test_noise_stays_in_its_span(spark):
    """Noise is whole, at least 0 and below (rows - largest) / largest, a variant's own, and the same again in a rerun."""
    idx = np.repeat(np.arange(1, 11), 30)
    items = spark.createDataFrame(list(enumerate(idx.tolist())), "pos long, idx long").coalesce(1).cache()
    span = (300 - 10) // 10
    found = [[r.idx for r in augment.noise_augment(items, v).orderBy("pos").collect()] for v in (0, 1, 1)]
    for noisy in found:
        extra = np.array(noisy) - idx  # both sorted, so order statistics bound each other
        assert noisy == sorted(noisy) and extra.min() >= 0 and extra.max() < span and abs(np.sum(noisy) - idx.sum() - 300 * (span - 1) / 2) < 5 * span * (300 / 12) ** 0.5
    assert found[0] != found[1] and found[1] == found[2]


def test_synthetic_index_has_the_asked_spread(spark):
    made = augment.synthetic_index(spark, 2000, 2, 60, 40_000, 0.25, seed=5)
    lengths = np.array([r.length for r in segment.run_lengths(made).orderBy("idx").collect()])[:-1]  # the last takes what remains
    assert lengths.min() >= 2 and lengths.max() <= 60
    assert lengths.mean() == pytest.approx(20, rel=0.05) and lengths.std() / lengths.mean() == pytest.approx(0.25, rel=0.1)
    assert made.count() == 40_000


def _tree(x, y, depth):
    """A regression tree over all columns of y by exhaustive search over all thresholds, in plain NumPy: a function of one row."""
    best = None
    for k in range(x.shape[1]):
        for t in np.unique(x[:, k])[:-1]:
            left = x[:, k] <= t
            loss = sum(((part - part.mean(axis=0)) ** 2).sum() for part in (y[left], y[~left]))
            if best is None or loss < best[0] - 1e-9:
                best = (loss, k, t, left)
    if depth == 0 or best is None or ((y - y.mean(axis=0)) ** 2).sum() - best[0] <= 1e-9:
        return lambda row: y.mean(axis=0)
    _, k, t, left = best
    low, high = _tree(x[left], y[left], depth - 1), _tree(x[~left], y[~left], depth - 1)
    return lambda row: (low if row[k] <= t else high)(row)


def test_configurations_by_tree(spark):
    """Predictions equal those of a tree by exhaustive search, snapped to powers of two; then the measured time and its error."""
    rng = np.random.default_rng(6)
    rows = [(i, float(2 ** rng.integers(0, 4)), float(rng.choice([100, 2000, 30_000])), float(rng.choice([3, 9, 27]))) for i in range(300)]
    target = lambda f, n, a: (2.0 ** (1 + (n > 500) + 2 * (a > 5)), 4.0 if f > 2 else 1.0)
    frame = spark.createDataFrame([(*r, *target(*r[1:])) for r in rows], "i long, feature_size double, size double, avg double, c1 double, c2 double").cache()
    model = analytics.ConfigModel(["c1", "c2"], depth=3)
    train, test = model.split(frame)
    known = np.array([list(r) for r in train.collect()])
    assert 0.7 < len(known) / 300 < 0.9 and train.count() + test.count() == 300 and train.join(test, "i").count() == 0
    tree = _tree(known[:, 1:4], known[:, 4:6], 3)
    got = model.fit(train).predict(test).collect()
    for r in got:
        want = [2.0 ** np.round(np.log2(max(np.rint(m), 1))) for m in tree([r.feature_size, r.size, r.avg])]
        assert [r.pred_c1, r.pred_c2] == want
    measured = spark.createDataFrame([(2.0, 1.5), (4.0, 2.5), (8.0, 0.5)], "c1 double, t double")
    found = analytics.lookup(frame.select("i", "c1"), measured, ["c1"], "t")
    times = {2.0: 1.5, 4.0: 2.5, 8.0: 0.5}
    assert {r.i: r.t for r in found.collect()} == {r[0]: times.get(target(*r[1:])[0], 0.0) for r in rows}
    error = np.sqrt(np.mean([(times.get(target(*r[1:])[0], 0.0) - 1) ** 2 for r in rows]))
    assert found.agg(analytics.root_mean_squared_error(F.col("t"), F.lit(1.0))).first()[0] == pytest.approx(error)


@pytest.mark.parametrize("bins", [256, 6])
def test_joint_tree_equals_exhaustive_search(spark, bins):
    """Means of the leaves for three noisy outputs; with few bins a tree of at most so many thresholds, that still explains most of the variance."""
    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(0, 9, 400), rng.integers(0, 5, 400), rng.normal(size=400).round(1)], axis=1).astype(float)
    y = np.stack([3.0 * (x[:, 0] > 4) + x[:, 1], x[:, 2] * (x[:, 0] > 2), 0 * x[:, 0]], axis=1) + rng.normal(size=(400, 3)).round(3) * 0.1
    rows = spark.createDataFrame([(*a, *b) for a, b in zip(x.tolist(), y.tolist(), strict=True)], "a double, b double, c double, u double, v double, w double").repartition(3)
    got = tree.JointTree(["a", "b", "c"], ["u", "v", "w"], 4, bins).fit(rows).predict(rows).collect()
    if bins == 256:
        plain = _tree(x, y, 4)
        assert all(np.allclose([r.pred_u, r.pred_v, r.pred_w], plain([r.a, r.b, r.c])) for r in got)
    left = sum((r.u - r.pred_u) ** 2 + (r.v - r.pred_v) ** 2 for r in got)
    assert left < 0.2 * ((y[:, :2] - y[:, :2].mean(axis=0)) ** 2).sum()


def test_joint_tree_of_nulls_and_nothing(spark):
    schema = "a double, u double"
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (None, 5.0), (float("nan"), 5.0), (2.0, None)], schema)
    model = tree.JointTree(["a"], ["u"], 2).fit(rows)
    assert [r.pred_u for r in model.predict(rows).collect()] == [1.0, 1.0, 5.0, 5.0, 1.0]  # one known value: only what is unknown is apart
    more = rows.union(spark.createDataFrame([(3.0, 5.0)], schema))
    found = {repr(r.a): r.pred_u for r in tree.JointTree(["a"], ["u"], 2).fit(more).predict(more).collect()}
    assert found["1.0"] == 1.0 and found["3.0"] == found["None"] == found["nan"] == 5.0
    assert tree.JointTree(["a"], ["u"], 2).fit(rows.where("false")).predict(rows).where("pred_u IS NOT NULL").count() == 0


def test_tables_of_measurements(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 4.0), ("b", "x", 9.0), ("b", "y", 3.0)], "ds string, m string, t double")
    assert {(r.ds, r.m) for r in analytics.best_rows(rows, ["ds"], "t", ["m"]).collect()} == {("a", "y"), ("b", "x")}
    assert {r.ds: r.y for r in analytics.ratio_of(rows, ["ds"], "m", "t", "x", ["y"]).collect()} == pytest.approx({"a": 0.25, "b": 3.0})
    wide = analytics.pivot(rows, ["ds"], "m", ["x", "y"], "t")
    assert analytics.melt(wide, ["ds"], ["x", "y"]).count() == 4
    shares = {(r.ds, r.m): r.share for r in analytics.share_of_total(rows, ["ds"], "m", "t", ["x"]).collect()}
    assert shares == pytest.approx({("a", "x"): 20, ("a", "Others"): 80, ("b", "x"): 75, ("b", "Others"): 25})
    first = {(r.ds, r.m): r.ratio for r in analytics.ratio_to_first(rows, ["ds"], "t", [F.col("m")]).collect()}
    assert first == pytest.approx({("a", "x"): 1, ("a", "y"): 0.25, ("b", "x"): 1, ("b", "y"): 3})
    assert [r.m for r in analytics.sort_by_labels(rows, "m", ["y", "x"], "ds").collect()] == ["y", "y", "x", "x"]
    big = spark.createDataFrame([("g", 1e200), ("g", 1e220)], "ds string, t double")
    assert big.agg(analytics.geometric_mean(F.col("t"))).first()[0] == pytest.approx(1e210, rel=1e-9)
