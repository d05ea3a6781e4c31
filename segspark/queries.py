"""The registered queries of the segment, graph and table operators, each with its SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import scalars, vectors
from .operators import analytics, augment, compare, grad, graph, layers, ranks, sddmm, segment, sparse, spmm
from .operators.stored import StoredGraph
from .plans.layout import dim_of
from .session import scratch, stash, table
from .sources import matrix_market, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _long(found: DataFrame, keys: tuple[str, ...] = ("id",), kind: str = "long", digits: int | None = None) -> DataFrame:
    """(keys, k, value) with whole or rounded values; + 0 makes one zero of both."""
    value = F.col("value") if digits is None else F.round("value", digits) + F.lit(0.0)
    return vectors.to_long(found, list(keys)).select(*keys, F.col("k").cast("long").alias("k"), value.cast(kind).alias("value"))


# -- the fixtures in SQL ------------------------------------------------------------------------------

_N = "(SELECT count(*) FROM embeddings)"
_X = "X AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS k, round(unnest(embedding)::DOUBLE * 1000) AS v FROM embeddings)"


def _e(dst: str = "l_suppkey", name: str = "E") -> str:
    return f"{name} AS (SELECT l_partkey % {_N} AS src, ({dst.format(n=_N)})::BIGINT AS dst, l_quantity::DOUBLE AS w FROM lineitem)"


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice"


def _en(dst: str = "l_suppkey", name: str = "E") -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY {_ORDER}) - 1 AS eid, l_partkey % {_N} AS src, ({dst.format(n=_N)})::BIGINT AS dst, l_quantity::DOUBLE AS w FROM lineitem)"


_LINKS = f"{_e(fx.SQUARE, 'E2')}, S AS (SELECT DISTINCT src, dst FROM E2)"
_NODES = "V AS (SELECT vec_id AS id FROM embeddings)"
_ITEMS = "I AS (SELECT vec_id AS pos, label::BIGINT AS idx FROM embeddings)"
_RANKED = "R AS (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS pos, label::BIGINT AS idx FROM embeddings)"
_RESULTS = "T AS (SELECT event_id, event_type AS dataname, user_id % 8 AS feature_size, ['base','csr','ours'][(event_id % 3 + 1)::INT] AS method, value AS time FROM events)"


def _filled(reduced: str, dim: str, key: str = "id", ids: str = "(SELECT max(dst) + 1 FROM E)", kind: str = "BIGINT") -> str:
    """All cells of ids x components of the CTE reduced(key, k, v), zeros where it has none."""
    return f"""SELECT g.id, c.k, coalesce(r.v, 0)::{kind} AS value FROM (SELECT unnest(range({ids})) AS id) g
        CROSS JOIN (SELECT unnest(range({dim})) AS k) c LEFT JOIN {reduced} r ON r.{key} = g.id AND r.k = c.k"""


_DIM = "(SELECT max(len(embedding)) FROM embeddings)"


def _product(edges: str, weighted: bool, agg: str = "sum") -> str:
    return f"WITH {_X}, {edges}, P AS (SELECT E.dst AS id, X.k, {agg}({'E.w * ' if weighted else ''}X.v) AS v FROM E JOIN X ON X.id = E.src GROUP BY 1, 2) "


# -- segment reduction --------------------------------------------------------------------------------


def _segments(agg: str, kind: str = "BIGINT", value: str = "v") -> str:
    reduced = f"P AS (SELECT I.idx AS id, X.k, {agg} AS v FROM I JOIN X ON X.id = I.pos GROUP BY 1, 2)"
    return f"WITH {_X}, {_ITEMS}, {reduced} " + _filled("P", _DIM, ids="(SELECT max(idx) + 1 FROM I)", kind=kind)


@query(_segments("sum(v)"))
def segment_sum(spark: SparkSession, d: str) -> DataFrame:
    return _long(segment.index_scatter(fx.items(spark, d)))


@query(_segments("round(avg(v), 6)", "DOUBLE"))
def segment_mean(spark: SparkSession, d: str) -> DataFrame:
    return _long(segment.index_scatter(fx.items(spark, d), "mean"), kind="double", digits=6)


@query(_segments("max(v)"))
def segment_max(spark: SparkSession, d: str) -> DataFrame:
    return _long(segment.index_scatter(fx.items(spark, d), "amax"))


@query(_segments("min(v)"))
def segment_min(spark: SparkSession, d: str) -> DataFrame:
    return _long(segment.index_scatter(fx.items(spark, d), "min"))


@query(_segments("product(CASE abs(v)::BIGINT % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE -1.0 END::DOUBLE)", "DOUBLE"))
def segment_prod(spark: SparkSession, d: str) -> DataFrame:
    small = F.transform("x", lambda v: F.when(F.abs(v) % 3 == 0, 1.0).when(F.abs(v) % 3 == 1, 2.0).otherwise(-1.0))
    return _long(segment.index_scatter(fx.items(spark, d).withColumn("x", small), "prod"), kind="double")


@query(_product(_e(fx.GAP), False) + _filled("P", _DIM))
def segment_sum_gap(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d, fx.GAP)
    gathered = segment.gather(edges, fx.nodes(spark, d), "src").select(F.col("dst").alias("idx"), "x")
    return _long(segment.index_scatter(gathered))


@query(f"WITH {_X} SELECT id, k // 8 AS k, sum(v)::BIGINT AS value FROM X GROUP BY 1, 2")
def segment_dim1(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    index = nodes.select(F.explode(F.sequence(F.lit(0), F.size("x") - 1)).alias("k")).distinct().withColumn("idx", F.floor(F.col("k") / 8))
    return _long(segment.scatter_columns(nodes, index))


@query(f"WITH {_X}, {_en()} SELECT E.eid, E.dst, count(*) AS components, sum(E.w * v)::BIGINT AS total, sum(E.w * v * (k + 1))::BIGINT AS moment FROM E JOIN X ON X.id = E.src GROUP BY 1, 2")
def gather(spark: SparkSession, d: str) -> DataFrame:
    """Every edge's whole weighted message, told by its length, sum and the sum of its components times their places."""
    found = segment.gather(fx.numbered_edges(spark, d), fx.nodes(spark, d), "src").withColumn("x", vectors.scale(F.col("x"), F.col("w")))
    total = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v)
    moment = F.aggregate(F.transform("x", lambda v, k: v * (k + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return found.select("eid", "dst", F.size("x").cast("long").alias("components"), total.cast("long").alias("total"), moment.cast("long").alias("moment"))


@query(f"WITH {_RANKED} SELECT idx, min(pos) AS \"begin\", count(*) AS length FROM R GROUP BY 1")
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return segment.run_lengths(augment.renumber(fx.items(spark, d)))


@query(f"WITH {_RANKED} SELECT pos, idx, idx IS DISTINCT FROM lag(idx) OVER (ORDER BY pos) AS is_start FROM R")
def segment_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment_boundaries(augment.renumber(fx.items(spark, d)), block=128)


@query(f"WITH {_RANKED} SELECT pos, idx, (sum(pos) OVER (PARTITION BY idx ORDER BY pos))::BIGINT AS running FROM R")
def segmented_scan(spark: SparkSession, d: str) -> DataFrame:
    return segment.segmented_scan(augment.renumber(fx.items(spark, d)), "pos")


# -- products -----------------------------------------------------------------------------------------


@query(_product(_e(), False) + _filled("P", _DIM))
def gather_scatter(spark: SparkSession, d: str) -> DataFrame:
    return _long(spmm.gather_scatter(graph.drop_weights(fx.edges(spark, d)), fx.nodes(spark, d)))


@query(_product(_e(), False, agg="max") + _filled("P", _DIM))
def gather_scatter_max(spark: SparkSession, d: str) -> DataFrame:
    return _long(spmm.gather_scatter(fx.edges(spark, d), fx.nodes(spark, d), "max"))


@query(_product(_e(), True) + _filled("P", _DIM))
def gather_weight_scatter(spark: SparkSession, d: str) -> DataFrame:
    return _long(spmm.gather_weight_scatter(fx.edges(spark, d), fx.nodes(spark, d)))


flagship = gather_weight_scatter


@query(_product(_e(fx.GAP), True) + _filled("P", _DIM))
def csr_gws(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d, fx.GAP)
    return _long(spmm.csr_product(sparse.coo_to_csr(edges), sparse.csr_entries(edges), fx.nodes(spark, d)))


_PER = f"({_DIM} // {fx.HEADS})"
_HEADS = f"WITH {_X}, {_e()}, P AS (SELECT E.dst AS id, X.k, sum((X.k // {_PER} + 1) * E.w * X.v) AS v FROM E JOIN X ON X.id = E.src GROUP BY 1, 2) SELECT id, k // {_PER} AS h, k % {_PER} AS k, value FROM ({_filled('P', _DIM)})"


def _heads(found: DataFrame, kind: str = "long", digits: int | None = None) -> DataFrame:
    return _long(found.select("id", F.posexplode("x").alias("h", "x")).withColumn("h", F.col("h").cast("long")), ("id", "h"), kind, digits)


@query(_HEADS)
def mh_spmm(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.head_nodes(spark, d)
    return _heads(spmm.mh_spmm(fx.head_edges(spark, d), nodes, fx.HEADS, dim_of(nodes, F.col("x")[0])))


@query(f"WITH {_X}, {_e()}, W AS (SELECT h, E.src, E.dst, (h + 1) * E.w AS w FROM E CROSS JOIN (SELECT unnest(range({fx.HEADS})) AS h)), P AS (SELECT W.dst AS id, h, X.k, sum(w * (v + h)) AS v FROM W JOIN X ON X.id = W.src GROUP BY 1, 2, 3) SELECT g.id, h, k, coalesce(v, 0)::BIGINT AS value FROM (SELECT unnest(range((SELECT max(dst) + 1 FROM E))) AS id) g CROSS JOIN (SELECT unnest(range({fx.HEADS})) AS h) CROSS JOIN (SELECT unnest(range({_DIM})) AS k) LEFT JOIN P USING (id, h, k)")
def mh_spmm_wide(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors as every head, plus the head's number."""
    nodes = fx.nodes(spark, d)
    return _heads(spmm.mh_spmm(fx.head_edges(spark, d), nodes, fx.HEADS, dim_of(nodes), shifts=[float(h) for h in range(fx.HEADS)]))


@query(_HEADS)
def mh_spmm_transposed(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = stash(fx.head_edges(spark, d, numbered=True), "edges"), fx.head_nodes(spark, d)
    weights = edges.select("eid", F.posexplode("w").alias("h", "w"))
    return _heads(spmm.mh_spmm_transposed(edges, weights, nodes, fx.HEADS, dim_of(nodes, F.col("x")[0])))


_SDDMM = f"WITH {_X}, {_LINKS} SELECT S.{{}}, S.{{}}, sum(a.v * b.v)::BIGINT AS value FROM S JOIN X a ON a.id = S.dst JOIN X b ON b.id = S.src AND b.k = a.k GROUP BY 1, 2"


@query(_SDDMM.format("src", "dst"))
def sddmm_coo(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    return sddmm.sddmm(fx.links(spark, d), nodes, nodes).withColumn("value", F.col("value").cast("long"))


@query(_SDDMM.format("src", "dst"))
def sddmm_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same over the grid of node blocks, whatever the size of the tables."""
    nodes = fx.nodes(spark, d)
    return sddmm.grid_sddmm(fx.links(spark, d), nodes, nodes).withColumn("value", F.col("value").cast("long"))


@query(_SDDMM.format("dst AS row", "src AS col"))
def sddmm_csr(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = stash(fx.links(spark, d), "links"), fx.nodes(spark, d)
    found = sddmm.sddmm_csr(sparse.coo_to_csr(edges), sparse.csr_entries(edges), nodes, nodes)
    return found.select("row", "col", F.col("value").cast("long").alias("value"))


@query(f"WITH {_X}, {_en(fx.SQUARE)} SELECT E.eid, sum(a.v * b.v * E.w)::BIGINT AS value FROM E JOIN X a ON a.id = E.dst JOIN X b ON b.id = E.src AND b.k = a.k GROUP BY 1")
def weighted_sddmm(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    return sddmm.weighted_sddmm(fx.numbered_edges(spark, d, fx.SQUARE), nodes, nodes).select("eid", F.col("value").cast("long").alias("value"))


@query(f"WITH {_X}, {_LINKS}, L AS (SELECT id, k, v FROM X UNION ALL SELECT id, k + {_DIM}, v FROM X), R AS (SELECT id, k, v FROM X UNION ALL SELECT id, 2 * {_DIM} - 1 - k, v FROM X) SELECT S.src, S.dst, sum(a.v * b.v)::BIGINT AS value FROM S JOIN L a ON a.id = S.dst JOIN R b ON b.id = S.src AND b.k = a.k GROUP BY 1, 2")
def sddmm_double(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of twice the length, joined end to end: with themselves on the left, with themselves backwards on the right."""
    nodes = fx.nodes(spark, d)
    left, right = nodes.withColumn("x", F.concat("x", "x")), nodes.withColumn("x", F.concat("x", F.reverse("x")))
    return sddmm.sddmm(fx.links(spark, d), left, right).withColumn("value", F.col("value").cast("long"))


# -- gradients ----------------------------------------------------------------------------------------

_GRAD = f"Y AS (SELECT id, k, v + 1 AS v FROM X), {_NODES}"


def _grad_sql(weighted: bool) -> str:
    reduced = f"P AS (SELECT E.src AS id, Y.k, sum({'E.w * ' if weighted else ''}Y.v) AS v FROM E JOIN Y ON Y.id = E.dst GROUP BY 1, 2)"
    return f"WITH {_X}, {_e(fx.SQUARE)}, {_GRAD}, {reduced} " + _filled("P", _DIM, ids=_N)


def _grad_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = fx.nodes(spark, d)
    return nodes, nodes.withColumn("x", F.transform("x", lambda v: v + 1))


@query(_grad_sql(False))
def gs_grad(spark: SparkSession, d: str) -> DataFrame:
    nodes, upstream = _grad_tables(spark, d)
    return _long(grad.gather_scatter_grad(fx.edges(spark, d, fx.SQUARE), upstream, nodes))


@query(_grad_sql(True))
def gws_grad_src(spark: SparkSession, d: str) -> DataFrame:
    nodes, upstream = _grad_tables(spark, d)
    return _long(grad.gather_weight_scatter_grad(fx.edges(spark, d, fx.SQUARE), upstream, nodes))


@query(f"WITH {_X}, {_en(fx.SQUARE)} SELECT E.eid, sum((a.v + 1) * b.v)::BIGINT AS value FROM E JOIN X a ON a.id = E.dst JOIN X b ON b.id = E.src AND b.k = a.k GROUP BY 1")
def gws_grad_weight(spark: SparkSession, d: str) -> DataFrame:
    nodes, upstream = _grad_tables(spark, d)
    return grad.weight_grad(fx.numbered_edges(spark, d, fx.SQUARE), upstream, nodes).select("eid", F.col("value").cast("long").alias("value"))


@query(f"WITH {_X}, {_ITEMS} SELECT I.pos, I.idx, X.k, v::BIGINT AS value FROM I JOIN X ON X.id = I.idx")
def segment_grad(spark: SparkSession, d: str) -> DataFrame:
    return _long(grad.segment_sum_grad(fx.items(spark, d), fx.nodes(spark, d)), ("pos", "idx"))


@query(f"{_grad_sql(True).replace(' SELECT g.id', ', M AS (SELECT row_number() OVER (ORDER BY dst, src, w) - 1 AS pos, src, dst FROM E) SELECT g.id', 1)} UNION ALL SELECT -1 - M.pos, 0, sum(a.v * b.v)::BIGINT FROM M JOIN Y a ON a.id = M.dst JOIN X b ON b.id = M.src AND b.k = a.k GROUP BY M.pos")
def csr_gws_grad(spark: SparkSession, d: str) -> DataFrame:
    """Both gradients: nodes as (id, k, value), entries as (-1 - position, 0, value)."""
    nodes, upstream = _grad_tables(spark, d)
    edges = fx.edges(spark, d, fx.SQUARE)
    of_nodes, of_entries = grad.csr_product_grad(sparse.coo_to_csr(edges), sparse.csr_entries(edges), upstream, nodes)
    return _long(of_nodes).union(of_entries.select(-1 - F.col("pos"), F.lit(0).cast("long"), F.col("value").cast("long")))


# -- structure ----------------------------------------------------------------------------------------

_DEGREES = f"WITH {_e(fx.GAP)}, D AS (SELECT g.id, count(E.dst) AS n, coalesce(sum(E.w), 0)::DOUBLE AS w FROM (SELECT unnest(range((SELECT max(dst) + 1 FROM E))) AS id) g LEFT JOIN E ON E.dst = g.id GROUP BY 1) "


@query(_DEGREES + "SELECT id, n AS degree FROM D")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return sparse.degree(fx.edges(spark, d, fx.GAP))


@query(_DEGREES + "SELECT id, w AS degree FROM D")
def weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return sparse.weighted_degree(fx.edges(spark, d, fx.GAP))


@query(_DEGREES + "SELECT round(var_pop(n), 6) AS variance FROM D")
def degree_variance(spark: SparkSession, d: str) -> DataFrame:
    return sparse.degree_variance(fx.edges(spark, d, fx.GAP)).select(F.round("variance", 6).alias("variance"))


@query(f"WITH {_e(fx.SQUARE)} SELECT src, dst, sum(w) AS w FROM E GROUP BY 1, 2")
def coalesce_edges(spark: SparkSession, d: str) -> DataFrame:
    return sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE))


@query(_DEGREES + 'SELECT id AS "row", (sum(n) OVER (ORDER BY id) - n)::BIGINT AS ptr_begin, (sum(n) OVER (ORDER BY id))::BIGINT AS ptr_end FROM D')
def coo_to_csr(spark: SparkSession, d: str) -> DataFrame:
    return sparse.coo_to_csr(fx.edges(spark, d, fx.GAP))


@query(f'WITH {_e(fx.GAP)} SELECT dst AS "row", src AS col, w, row_number() OVER (ORDER BY dst, src, w) - 1 AS pos FROM E')
def csr_to_coo(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d, fx.GAP)
    return sparse.csr_to_coo(sparse.coo_to_csr(edges), sparse.csr_entries(edges))


@query(f'WITH {_e(fx.GAP)}, M AS (SELECT row_number() OVER (ORDER BY dst, src, w) - 1 AS pos, dst FROM E) SELECT event_id, M.pos, M.dst AS "row" FROM events JOIN M ON M.pos = (event_id * 31 + user_id) % (SELECT count(*) FROM E)')
def row_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The rows of positions that every event names."""
    edges = stash(fx.edges(spark, d, fx.GAP), "edges")
    positions = table(spark, d, "events").select("event_id", ((F.col("event_id") * 31 + F.col("user_id")) % edges.count()).alias("pos"))
    return sparse.lookup_rows(sparse.coo_to_csr(edges), positions).select("event_id", "pos", "row")


@query(f'WITH {_e()} SELECT row_number() OVER (ORDER BY src, dst, w) - 1 AS pos, src AS "row", dst AS col, w FROM E')
def transpose_csr(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.edges(spark, d)
    rows, entries = sparse.csr_to_csc(sparse.coo_to_csr(edges), sparse.csr_entries(edges))
    return sparse.csr_to_coo(rows, entries).select("pos", "row", "col", "w")


@query(f'WITH {_e(fx.SQUARE)}, D AS (SELECT g.id, count(E.src) AS n FROM (SELECT unnest(range({_N} + 16)) AS id) g LEFT JOIN E ON E.src = g.id GROUP BY 1) SELECT id AS "row", (sum(n) OVER (ORDER BY id) - n)::BIGINT AS ptr_begin, (sum(n) OVER (ORDER BY id))::BIGINT AS ptr_end FROM D')
def compressed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pointers of unsorted edges by source, with rows beyond the last that has entries."""
    return sparse.coo_to_csr(fx.edges(spark, d, fx.SQUARE), "src", fx.node_count(spark, d) + 16)


@query(f"WITH {_LINKS} SELECT src, dst FROM S UNION SELECT dst, src FROM S")
def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return sparse.symmetrize(fx.links(spark, d))


@query(f"WITH {_e()} SELECT row_number() OVER (ORDER BY dst, src, w) - 1 AS pos, src, dst, w FROM E")
def sorted_edges(spark: SparkSession, d: str) -> DataFrame:
    return sparse.number_rows(sparse.sort_edges(fx.edges(spark, d)), "pos", ["dst", "src", "w"])


_LOOPED = f"{_e(fx.SQUARE)}, C AS (SELECT src, dst, sum(w) AS w FROM E GROUP BY 1, 2), {_NODES}"


@query(f"WITH {_LOOPED} SELECT * FROM C UNION ALL SELECT id, id, 1.0 FROM V")
def self_loops(spark: SparkSession, d: str) -> DataFrame:
    return graph.add_self_loops(sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)), fx.nodes(spark, d))


_REMAINING = "L AS (SELECT src, dst, w FROM C WHERE src <> dst UNION ALL SELECT id, id, coalesce(w, {fill}) FROM V LEFT JOIN C ON src = id AND dst = id)"


@query(f"WITH {_LOOPED}, {_REMAINING.format(fill='2.0')} SELECT * FROM L")
def remaining_self_loops(spark: SparkSession, d: str) -> DataFrame:
    return graph.add_remaining_self_loops(sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)), fx.nodes(spark, d), 2.0)


@query(f"WITH {_LOOPED} SELECT src, dst, w FROM C WHERE src <> dst UNION ALL SELECT id, id, 0.5 FROM V")
def fill_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return graph.fill_diagonal(sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)), fx.nodes(spark, d), 0.5)


def _norm(fill: float) -> str:
    return f"{_LOOPED}, {_REMAINING.format(fill=fill)}, G AS (SELECT dst AS id, 1 / sqrt(sum(w)) AS d FROM L GROUP BY 1), A AS (SELECT L.src, L.dst, a.d * L.w * b.d AS w FROM L JOIN G a ON a.id = L.src JOIN G b ON b.id = L.dst)"


_NORM = _norm(1.0)


@query(f"WITH {_NORM} SELECT src, dst, round(w, 9) + 0 AS w FROM A")
def gcn_norm(spark: SparkSession, d: str) -> DataFrame:
    found = graph.gcn_norm(sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)), fx.nodes(spark, d))
    return found.withColumn("w", F.round("w", 9) + F.lit(0.0))


_BLOCKS = f"""WITH {_LINKS}, B AS (SELECT src AS "row", dst AS col, src // 8 AS win, dense_rank() OVER (PARTITION BY src // 8 ORDER BY dst) - 1 AS place FROM S),
    W AS (SELECT win, place // 8 AS blk, max(place % 8) + 1 AS width FROM B GROUP BY 1, 2)"""


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    return fx.edges(spark, d, fx.SQUARE).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.expr("src div 8").alias("win"))


@query(f'WITH {_e(fx.SQUARE)} SELECT src AS "row", dst AS col, dense_rank() OVER (PARTITION BY src // 8 ORDER BY dst) - 1 AS place FROM E')
def column_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The place of every entry's column among the distinct columns of its window of 8 rows."""
    return ranks.dense_ranks(_windowed(spark, d), ["win"], "col", "place").select("row", "col", "place")


@query(f"WITH {_e(fx.SQUARE)}, N AS (SELECT src // 8 AS win, count(DISTINCT dst) AS n FROM E GROUP BY 1) SELECT win, (sum(n) OVER (ORDER BY win) - n)::BIGINT AS ptr_begin, (sum(n) OVER (ORDER BY win))::BIGINT AS ptr_end FROM N")
def column_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers of distinct columns over the windows of 8 rows."""
    return ranks.distinct_offsets(_windowed(spark, d), ["win"], "col")


@query(_BLOCKS + """, C AS (SELECT win, place // 8 AS blk, "row" % 8 AS r, place % 8 AS slot FROM B)
    SELECT W.win, W.blk, W.width, i.i AS k, (CASE WHEN C.r IS NULL THEN 0 ELSE 1 END)::BIGINT AS value
    FROM W JOIN (SELECT unnest(range(64)) AS i) i ON i.i < 8 * W.width LEFT JOIN C ON C.win = W.win AND C.blk = W.blk AND C.r = i.i // W.width AND C.slot = i.i % W.width""")  # fmt: skip
def block_format(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.links(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("w"))
    return _long(sparse.block_format(edges, 8, 8, unique=True).withColumnRenamed("vals", "x"), ("win", "blk", "width"))


@query(_BLOCKS + f", N AS (SELECT win, count(DISTINCT col) AS n FROM B GROUP BY 1) SELECT g.win, (sum(coalesce(n, 0)) OVER (ORDER BY g.win) - coalesce(n, 0))::BIGINT AS ptr_begin, (sum(coalesce(n, 0)) OVER (ORDER BY g.win))::BIGINT AS ptr_end FROM (SELECT unnest(range(({_N} + 16 - {_N} % 16 + 7) // 8)) AS win) g LEFT JOIN N ON N.win = g.win")
def block_pointers(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.links(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"))
    return sparse.block_pointers(edges, 8, 8, num_rows=fx.node_count(spark, d), pad_rows_to=16)


@query(f"WITH {_X}, {_LINKS}, P AS (SELECT S.src AS id, X.k, sum(X.v) AS v FROM S JOIN X ON X.id = S.dst GROUP BY 1, 2) " + _filled("P", _DIM, ids=_N))
def blocked_spmm(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.links(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("w"))
    return _long(spmm.blocked_product(sparse.block_format(edges, 8, 8, unique=True), fx.nodes(spark, d), 8, num_rows=fx.node_count(spark, d)))


@query(f"SELECT {_N} AS num_nodes, (SELECT count(*) FROM lineitem) AS num_edges, max(len(embedding))::BIGINT AS in_channels, (max(label) + 1)::BIGINT AS num_classes FROM embeddings")
def load_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.items(spark, d).select(F.col("pos").alias("id"), "x", F.col("idx").alias("y"))
    return graph.Graph.from_tables(nodes, fx.edges(spark, d)).summary()


@query(f"WITH {_e()} SELECT src < {_N} // 2 AS valid, count(*) AS n FROM E GROUP BY 1")
def validate_index(spark: SparkSession, d: str) -> DataFrame:
    half = fx.node_count(spark, d) // 2
    return graph.validate_index(fx.edges(spark, d), half, ("src",)).groupBy("valid").agg(F.count("*").alias("n"))


@query(f"WITH {_en()} SELECT eid, src, dst, w, true AS valid FROM E")
def wrapped_index(spark: SparkSession, d: str) -> DataFrame:
    """Sources of every other quantity count from the end; all are wrapped, and none may lie outside then."""
    n = fx.node_count(spark, d)
    edges = fx.numbered_edges(spark, d).withColumn("src", F.when(F.col("w") % 2 == 1, F.col("src") - n).otherwise(F.col("src")))
    return graph.validate_index(graph.wrap_negative(edges, n, ("src",)), n, ("src",), strict=True)


@query(f"WITH {_X}, Y AS (SELECT id, k, round(v / 10) * 10 AS v FROM X) SELECT count(*) AS cells, 0::BIGINT AS missing, max(abs(X.v - Y.v)) AS max_abs_diff, bool_and(abs(X.v - Y.v) <= 0.0001) AS all_close, count(*) FILTER (abs(X.v - Y.v) > 0.01 * abs(Y.v)) AS bad_relative FROM X JOIN Y ON X.id = Y.id AND X.k = Y.k")
def compare_results(spark: SparkSession, d: str) -> DataFrame:
    cells = vectors.to_long(fx.nodes(spark, d), ["id"])
    return compare.compare(cells, cells.withColumn("value", F.round(F.col("value") / 10) * 10), ["id", "k"])


# -- layers -------------------------------------------------------------------------------------------


#: Channels behind the first layer and the second.
_HIDDEN, _OUT = 16, 8


def _weight(out: int, dim: int, shift: int = 0) -> np.ndarray:
    o, k = np.indices((out, dim))
    return (3 * o + 5 * k + shift) % 7 - 3.0


def _linear(source: str, out: int, shift: int = 0) -> str:
    """(id, k, v) of the CTE source(id, k, v) times the weights of _weight()."""
    return f"(SELECT s.id, o.o AS k, sum(s.v * ((3 * o.o + 5 * s.k + {shift}) % 7 - 3)) AS v FROM {source} s CROSS JOIN (SELECT unnest(range({out})) AS o) o GROUP BY 1, 2)"


def _spread(edges: str, source: str, agg: str = "sum(A.w * s.v)") -> str:
    """(id, k, v): source(id, k, v) aggregated over edges(src, dst, w) at dst."""
    return f"(SELECT A.dst AS id, s.k, {agg} AS v FROM {edges} A JOIN {source} s ON s.id = A.src GROUP BY 1, 2)"


def _rounded(source: str, digits: int) -> str:
    return f" SELECT id, k, round(v, {digits}) + 0 AS value FROM {source}"


def _square(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """Nodes, merged edges of the square graph, and the length of the nodes' vectors."""
    nodes = fx.nodes(spark, d)
    return nodes, stash(sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)), "edges"), dim_of(nodes)


def _beside(source: str, agg: str, name: str) -> str:
    """CTE name(id, k, v): what the neighbours' CTE source comes to at every node, 0 without any."""
    return f"{name}0 AS {_spread('C', source, agg)}, {name} AS (SELECT X.id, X.k, coalesce({name}0.v, 0) AS v FROM X LEFT JOIN {name}0 ON {name}0.id = X.id AND {name}0.k = X.k)"


@query(f"WITH {_X}, {_NORM}, H AS {_linear('X', _OUT)}, O AS {_spread('A', 'H')}, B AS (SELECT id, k, v + k + 1 AS v FROM O)" + _rounded("B", 3))
def gcn_layer(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, dim = _square(spark, d)
    return _long(layers.GCN(_weight(_OUT, dim), np.arange(1.0, _OUT + 1))(nodes, edges), kind="double", digits=3)


@query(f"WITH {_X}, {_norm(2.0)}, H AS {_linear('X', _OUT)}, O AS {_spread('A', 'H')}" + _rounded("O", 3))
def gcn_improved(spark: SparkSession, d: str) -> DataFrame:
    """Self loops of weight 2; the normalised edges are kept for a second call."""
    nodes, edges, dim = _square(spark, d)
    return _long(layers.GCN(_weight(_OUT, dim), improved=True, cached=True)(nodes, edges), kind="double", digits=3)


@query(f"WITH {_X}, {_LOOPED}, {_beside('X', 'sum(s.v)', 'S')}, Y AS (SELECT X.id, X.k, 1.5 * X.v + S.v AS v FROM X JOIN S ON S.id = X.id AND S.k = X.k), H AS (SELECT id, k, greatest(v, 0) AS v FROM {_linear('Y', _HIDDEN)}), O AS {_linear('H', _OUT, 1)}" + _rounded("O", 3))
def gin_layer(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, dim = _square(spark, d)
    nn = layers.mlp([(_weight(_HIDDEN, dim), None), (_weight(_OUT, _HIDDEN, 1), None)])
    return _long(layers.GIN(nn, 0.5, dim)(nodes, edges), kind="double", digits=3)


@query(f"WITH {_X}, {_LOOPED}, {_beside('X', 'avg(s.v)', 'Z')}, P AS {_linear('Z', _OUT)}, Q AS {_linear('X', _OUT, 1)}, O AS (SELECT P.id, P.k, P.v + Q.v AS v FROM P JOIN Q ON P.id = Q.id AND P.k = Q.k), M AS (SELECT id, sqrt(sum(v * v)) AS n FROM O GROUP BY 1), R AS (SELECT O.id, O.k, O.v / greatest(n, 1e-12) AS v FROM O JOIN M ON M.id = O.id)" + _rounded("R", 6))
def sage_layer(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, dim = _square(spark, d)
    return _long(layers.SAGE(_weight(_OUT, dim), _weight(_OUT, dim, 1), aggr="mean", normalize=True, dim=dim)(nodes, edges), kind="double", digits=6)


@query(f"WITH {_X}, {_LOOPED}, {_beside('X', 'max(s.v)', 'T')}, {_beside('X', 'sum(s.v)', 'S')}, Z AS (SELECT * FROM T UNION ALL SELECT id, k + {_DIM}, v FROM S), O AS {_linear('Z', _OUT)}" + _rounded("O", 3))
def sage_several(spark: SparkSession, d: str) -> DataFrame:
    """Two aggregations joined end to end, without the node itself."""
    nodes, edges, dim = _square(spark, d)
    return _long(layers.SAGE(_weight(_OUT, 2 * dim), aggr=["max", "sum"], dim=dim)(nodes, edges), kind="double", digits=3)


@query(f"WITH {_X}, {_LOOPED}, {_beside('X', 'avg(A.w * s.v)', 'S')}" + _rounded("S", 6))
def message_and_aggregate(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, dim = _square(spark, d)
    return _long(spmm.message_and_aggregate(edges, nodes, "mean", weighted=True, dim=dim, num_nodes=nodes), kind="double", digits=6)


@query(f"WITH {_X}, {_NORM}, H AS {_linear('X', _HIDDEN)}, O AS (SELECT id, k, greatest(v, 0) AS v FROM {_spread('A', 'H')}), H2 AS {_linear('O', _OUT, 1)}, P AS {_spread('A', 'H2')}" + _rounded("P", 3))
def gnn_stack(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, dim = _square(spark, d)
    stack = layers.Stack([layers.GCN(_weight(_HIDDEN, dim)), layers.GCN(_weight(_OUT, _HIDDEN, 1))], cut=lambda n: stash(n, "layer"))
    return _long(stack(nodes, edges), kind="double", digits=3)


def _stored(spark: SparkSession, nodes: DataFrame, edges: DataFrame, merge: bool = False) -> StoredGraph:
    """The graph in tables of the shared folder, which go when the driver ends."""
    return StoredGraph.save(nodes, edges, f"graph_{uuid.uuid4().hex}", path=scratch(spark, "graph"), merge=merge)


def _stored_square(spark: SparkSession, d: str) -> tuple[StoredGraph, DataFrame, int]:
    """The square graph with a loop at every node, merged as it is stored, what scales its vectors, and their length. Edges move once, to their buckets."""
    nodes = fx.nodes(spark, d)
    looped, roots = graph.norm_parts(graph.merge_loops(fx.edges(spark, d, fx.SQUARE)), nodes)
    stored = _stored(spark, nodes, looped, merge=True)
    return stored, stored.keep(roots), dim_of(nodes)


@query(_product(_e(fx.SQUARE), True) + _filled("P", _DIM, ids=_N))
def stored_product(spark: SparkSession, d: str) -> DataFrame:
    """The weighted product over stored tables, duplicate edges included."""
    stored = _stored(spark, fx.nodes(spark, d), fx.edges(spark, d, fx.SQUARE))
    return _long(spmm.gather_weight_scatter(stored, stored.nodes))


@query(ORACLES["gnn_stack"])
def stored_stack(spark: SparkSession, d: str) -> DataFrame:
    """The stack of gnn_stack over edges that are merged as they are stored in the buckets of the nodes."""
    stored, roots, dim = _stored_square(spark, d)
    stack = layers.Stack([layers.normalized(layers.GCN(w, normalize=False), roots) for w in (_weight(_HIDDEN, dim), _weight(_OUT, _HIDDEN, 1))], cut=stored.cut)
    return _long(stack(stored.nodes, stored), kind="double", digits=3)


def _normal_of(source: str, name: str) -> str:
    """CTE name(id, k, v): every component of the CTE source over all nodes, shifted and scaled, then relu."""
    return f"{name}M AS (SELECT k, avg(v) AS m, var_pop(v) AS s FROM {source} GROUP BY 1), {name} AS (SELECT {source}.id, {source}.k, greatest((v - m) / sqrt(s + 1e-5), 0) AS v FROM {source} JOIN {name}M USING (k))"


@query(f"""WITH {_X}, {_NORM}, H1 AS {_linear('X', _HIDDEN)}, O1 AS {_spread('A', 'H1')}, {_normal_of('O1', 'Y1')}, H2 AS {_linear('Y1', _HIDDEN, 1)}, O2 AS {_spread('A', 'H2')}, {_normal_of('O2', 'Y2')},
    H3 AS {_linear('Y2', _HIDDEN, 2)}, O3 AS {_spread('A', 'H3')}, {_normal_of('O3', 'Y3')},
    J AS (SELECT * FROM Y1 UNION ALL SELECT id, k + {_HIDDEN}, v FROM Y2 UNION ALL SELECT id, k + 2 * {_HIDDEN}, v FROM Y3), R AS (SELECT id, k, v + k - 3 AS v FROM {_linear('J', _OUT, 3)})""" + _rounded("R", 3))
def knowledge_stack(spark: SparkSession, d: str) -> DataFrame:
    """Three layers, each normalised over all nodes and activated, all outputs joined end to end and mapped to the classes."""
    stored, roots, dim = _stored_square(spark, d)
    convolutions = [layers.normalized(layers.GCN(_weight(_HIDDEN, width, i), normalize=False), roots) for i, width in enumerate((dim, _HIDDEN, _HIDDEN))]
    out = layers.linear(_weight(_OUT, 3 * _HIDDEN, 3), np.arange(_OUT) - 3.0)
    stack = layers.Stack([lambda n, e, c=c: stored.cut(c(n, e)) for c in convolutions], norm="batch", dims=[_HIDDEN] * 3, jk="cat", out=out)
    return _long(stack(stored.nodes, stored), kind="double", digits=3)


def _two_layers(spark: SparkSession, d: str) -> list[DataFrame]:
    nodes, edges, dim = _square(spark, d)
    return [nodes, spmm.gather_weight_scatter(edges, nodes, dim=dim, num_nodes=nodes)]


@query(f"WITH {_X}, {_LOOPED}, {_beside('X', 'sum(A.w * s.v)', 'S')}, Y AS (SELECT X.id, X.k, greatest(X.v, S.v) AS v FROM X JOIN S ON S.id = X.id AND S.k = X.k)" + _rounded("Y", 3))
def jumping_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return _long(layers.jumping_knowledge(_two_layers(spark, d), "max"), kind="double", digits=3)


@query(f"WITH {_X}, {_LOOPED}, {_beside('X', 'sum(A.w * s.v)', 'S')}, Y AS (SELECT * FROM X UNION ALL SELECT id, k + {_DIM}, v FROM S)" + _rounded("Y", 3))
def jumping_concat(spark: SparkSession, d: str) -> DataFrame:
    return _long(layers.jumping_knowledge(_two_layers(spark, d), "cat"), kind="double", digits=3)


@query(f"WITH {_X}, {_LOOPED}, {_beside('X', 'sum(A.w * s.v)', 'S')}" + _rounded("S", 3))
def jumping_last(spark: SparkSession, d: str) -> DataFrame:
    return _long(layers.jumping_knowledge(_two_layers(spark, d), "last"), kind="double", digits=3)


@query(f"WITH {_X}, M AS (SELECT k, avg(v) AS m, var_pop(v) AS s FROM X GROUP BY 1), R AS (SELECT id, X.k, (v - m) / sqrt(s + 1e-5) AS v FROM X JOIN M ON M.k = X.k)" + _rounded("R", 6))
def feature_norm(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    return _long(layers.feature_norm(nodes, "batch", dim_of(nodes)), kind="double", digits=6)


@query(f"WITH {_X}, M AS (SELECT id, avg(v) AS m, var_pop(v) AS s FROM X GROUP BY 1), R AS (SELECT X.id, X.k, (v - m) / sqrt(s + 1e-5) AS v FROM X JOIN M ON M.id = X.id)" + _rounded("R", 6))
def layer_norm(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d)
    return _long(layers.feature_norm(nodes, "layer", dim_of(nodes)), kind="double", digits=6)


_ACTS = {
    "relu": "greatest(v, 0)", "leaky_relu": "CASE WHEN v > 0 THEN v ELSE v * 0.01 END", "sigmoid": "1 / (1 + exp(-v))",
    "tanh": "1 - 2 / (exp(2 * v) + 1)", "elu": "CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END",
}


@query(f"WITH {_X} " + " UNION ALL ".join(f"SELECT '{name}' AS name, id, k, round({sql}, 9) + 0 AS value FROM (SELECT id, k, v / 1000 AS v FROM X)" for name, sql in _ACTS.items()))
def activations(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.nodes(spark, d).withColumn("x", F.transform("x", lambda v: v / 1000))
    each = [layers.apply(nodes, layers.activation(name)).withColumn("name", F.lit(name)) for name in _ACTS]
    return _long(analytics.stack_rows(each), ("name", "id"), "double", 9)


@query(f"WITH {_X}, {_NORM}, S AS {_spread('A', 'X')}, Y AS (SELECT X.id, X.k, 0.5 * coalesce(S.v, 0) + 0.5 * X.v AS v FROM X LEFT JOIN S ON S.id = X.id AND S.k = X.k), S2 AS {_spread('A', 'Y')}, Z AS (SELECT X.id, X.k, 0.5 * coalesce(S2.v, 0) + 0.5 * X.v AS v FROM X LEFT JOIN S2 ON S2.id = X.id AND S2.k = X.k)" + _rounded("Z", 3))
def appnp(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, dim = _square(spark, d)
    return _long(layers.appnp(nodes, edges, steps=2, alpha=0.5, dim=dim), kind="double", digits=3)


@query(f"WITH {_X}, {_NORM}, S AS {_spread('A', 'X')}, S2 AS {_spread('A', 'S')}, S3 AS {_spread('A', 'S2')}, O AS {_linear('S3', _OUT)}" + _rounded("O", 3))
def sgc(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, dim = _square(spark, d)
    return _long(layers.sgc(nodes, edges, steps=3, weight=_weight(_OUT, dim), dim=dim), kind="double", digits=3)


def _attention(shift: int) -> str:
    return f"sum(v * ((3 * (k // {_PER}) + 5 * (k % {_PER}) + {shift}) % 7 - 3) / 1000)"


@query(f"""WITH {_X}, {_e(fx.SQUARE)}, {_NODES}, L AS (SELECT DISTINCT src, dst FROM E WHERE src <> dst UNION ALL SELECT id, id FROM V),
    P AS (SELECT id, k // {_PER} AS h, {_attention(0)} AS a, {_attention(1)} AS b FROM X GROUP BY 1, 2),
    Q AS (SELECT L.src, L.dst, s.h, CASE WHEN s.a + t.b > 0 THEN s.a + t.b ELSE 0.2 * (s.a + t.b) END AS s FROM L JOIN P s ON s.id = L.src JOIN P t ON t.id = L.dst AND t.h = s.h),
    M AS (SELECT dst, h, max(s) AS m FROM Q GROUP BY 1, 2), R AS (SELECT Q.*, exp(s - m) AS e FROM Q JOIN M ON M.dst = Q.dst AND M.h = Q.h)
    SELECT R.dst AS id, R.h, X.k % {_PER} AS k, round(sum(e * v) / sum(e), 3) + 0 AS value FROM R JOIN X ON X.id = R.src AND X.k // {_PER} = R.h GROUP BY 1, 2, 3""")
def gat(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.head_nodes(spark, d)
    dim = dim_of(nodes, F.col("x")[0])
    found = layers.gat(nodes, fx.edges(spark, d, fx.SQUARE), _weight(fx.HEADS, dim) / 1000, _weight(fx.HEADS, dim, 1) / 1000)
    return _heads(found, "double", 3)


# -- tables of measurements ---------------------------------------------------------------------------


def _round(*names: str, digits: int = 6) -> dict[str, Column]:
    return {n: F.round(n, digits) for n in names}


@query("SELECT event_type AS dataname, count(*) AS size, max(user_id) AS max, round(stddev_pop(user_id), 6) AS std, round(avg(user_id), 6) AS mean, round(count(*) / max(user_id), 6) AS avg FROM events GROUP BY 1")
def index_features(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "events").select(F.col("event_type").alias("dataname"), F.col("user_id").alias("idx"))
    return analytics.index_features(items).withColumns(_round("std", "mean", "avg"))


@query(f"WITH {_RESULTS} SELECT event_id, dataname, feature_size, method, time FROM (SELECT *, row_number() OVER (PARTITION BY dataname, feature_size ORDER BY time DESC, event_id) AS r FROM T) WHERE r = 1")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    return analytics.best_rows(fx.results(spark, d), ["dataname", "feature_size"], "time", ["event_id"])


@query(f"WITH {_RESULTS} SELECT dataname, method, min(time) AS min_time, round(avg(time), 6) AS mean_time, max(time) AS max_time FROM T GROUP BY 1, 2")
def group_min_mean(spark: SparkSession, d: str) -> DataFrame:
    return analytics.summarize(fx.results(spark, d), ["dataname", "method"], "time").withColumns(_round("mean_time"))


@query(f"WITH {_RESULTS} SELECT dataname, method, round(exp(avg(ln(time))), 6) AS geomean FROM T WHERE time > 0 GROUP BY 1, 2")
def geomean(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.results(spark, d).where("time > 0")
    return rows.groupBy("dataname", "method").agg(F.round(analytics.geometric_mean(F.col("time")), 6).alias("geomean"))


@query(f"WITH {_RESULTS} SELECT dataname, round(exp(avg(ln(time)) FILTER (method = 'base') - avg(ln(time)) FILTER (method = 'csr')), 6) AS csr, round(exp(avg(ln(time)) FILTER (method = 'base') - avg(ln(time)) FILTER (method = 'ours')), 6) AS ours FROM T WHERE time > 0 GROUP BY 1")
def speedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.results(spark, d).where("time > 0")
    return analytics.ratio_of(rows, ["dataname"], "method", "time", "base", ["csr", "ours"]).withColumns(_round("csr", "ours"))


@query(f"WITH {_RESULTS} SELECT event_id, dataname, feature_size, method, round(first_value(time) OVER (PARTITION BY dataname, feature_size ORDER BY list_position(['ours','csr','base'], method), event_id) / time, 6) AS ratio FROM T WHERE time > 0")
def ratio_to_first(spark: SparkSession, d: str) -> DataFrame:
    order = [F.array_position(F.lit(["ours", "csr", "base"]), F.col("method")), F.col("event_id")]
    found = analytics.ratio_to_first(fx.results(spark, d).where("time > 0"), ["dataname", "feature_size"], "time", order)
    return found.select("event_id", "dataname", "feature_size", "method", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {_RESULTS}, S AS (SELECT dataname, CASE WHEN method IN ('ours', 'csr') THEN method ELSE 'Others' END AS method, sum(time) AS s FROM T GROUP BY 1, 2) SELECT dataname, method, round(100 * s / sum(s) OVER (PARTITION BY dataname), 6) AS share FROM S")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return analytics.share_of_total(fx.results(spark, d), ["dataname"], "method", "time", ["ours", "csr"]).withColumns(_round("share"))


_WIDE = f"{_RESULTS}, P AS (SELECT dataname, min(time) FILTER (method = 'base') AS base, min(time) FILTER (method = 'csr') AS csr, min(time) FILTER (method = 'ours') AS ours FROM T GROUP BY 1)"


@query(f"WITH {_WIDE} SELECT * FROM P")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pivot(fx.results(spark, d), ["dataname"], "method", ["base", "csr", "ours"], "time")


@query(f"WITH {_WIDE} SELECT dataname, unnest(['base', 'csr', 'ours']) AS variable, unnest([base, csr, ours]) AS value FROM P")
def melt(spark: SparkSession, d: str) -> DataFrame:
    return analytics.melt(pivot(spark, d), ["dataname"], ["base", "csr", "ours"])


_LEFT, _RIGHT = "(SELECT user_id, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)", "(SELECT user_id, min(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    return tuple(events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("value").alias("v")) for kind in ("view", "click"))


@query(f"SELECT user_id, a.v AS v_x, b.v AS v_y, least(a.v, b.v) AS v FROM {_LEFT} a FULL JOIN {_RIGHT} b USING (user_id)")
def outer_merge_min(spark: SparkSession, d: str) -> DataFrame:
    return analytics.outer_merge_least(*_sides(spark, d), ["user_id"], "v")


@query(f"SELECT user_id, a.v AS view_v, b.v AS click_v FROM {_LEFT} a JOIN {_RIGHT} b USING (user_id)")
def inner_merge(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return analytics.merge(left.withColumnRenamed("v", "view_v"), right.withColumnRenamed("v", "click_v"), ["user_id"])


@query(f"WITH {_RESULTS}, M AS (SELECT dataname, feature_size, method, min(time) AS time FROM T WHERE feature_size > 1 GROUP BY 1, 2, 3), D AS (SELECT DISTINCT dataname FROM T), F AS (SELECT DISTINCT feature_size, method FROM T) SELECT D.dataname, F.feature_size, F.method, coalesce(M.time, 0) AS time FROM D CROSS JOIN F LEFT JOIN M ON M.dataname = D.dataname AND M.feature_size = F.feature_size AND M.method = F.method")
def cross_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows, keys = fx.results(spark, d), ["dataname", "feature_size", "method"]
    measured = rows.where("feature_size > 1").groupBy(*keys).agg(F.min("time").alias("time"))
    grid = analytics.cross(rows.select("dataname").distinct(), rows.select("feature_size", "method").distinct())
    return analytics.lookup(grid, measured, keys, "time").select(*keys, "time")


@query(f"WITH {_RESULTS} SELECT event_id, time FROM T ORDER BY time DESC, event_id LIMIT 10")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top(fx.results(spark, d).select("event_id", "time"), "time", 10, "event_id")


@query(f"WITH {_X} SELECT id, k, abs(v - round(v / 10) * 10) AS diff FROM X ORDER BY diff DESC, id, k LIMIT 10")
def worst_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = vectors.to_long(fx.nodes(spark, d), ["id"]).withColumn("k", F.col("k").cast("long"))
    return compare.worst_cells(cells, cells.withColumn("value", F.round(F.col("value") / 10) * 10), ["id", "k"])


@query("SELECT DISTINCT event_type AS dataname FROM events ORDER BY 1")
def sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    return analytics.distinct_sorted(fx.results(spark, d), "dataname")


@query(f"WITH {_RESULTS}, G AS (SELECT method, dataname, min(time) AS least FROM T GROUP BY 1, 2) SELECT method, dataname, least FROM G ORDER BY list_position(['ours', 'base'], method), dataname")
def custom_order(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.results(spark, d).groupBy("method", "dataname").agg(F.min("time").alias("least"))
    return analytics.sort_by_labels(rows, "method", ["ours", "base"], "dataname")


@query(f"WITH {_RESULTS} SELECT dataname, time, CASE WHEN method = 'base' THEN -1 ELSE feature_size END AS feature_size FROM T WHERE method IN ('base', 'ours')")
def union_results(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.results(spark, d)
    found = analytics.stack_rows([rows.where("method = 'base'").select("dataname", "time"), rows.where("method = 'ours'").select("feature_size", "dataname", "time")])
    return found.withColumn("feature_size", F.coalesce("feature_size", F.lit(-1).cast("long")))


@query("SELECT vec_id, label, label * 2 AS twice, len(embedding) AS dim FROM embeddings")
def concat_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    parts = [rows.select("vec_id", "label"), rows.select("vec_id", (F.col("label") * 2).alias("twice")), rows.select("vec_id", F.size("embedding").cast("long").alias("dim"))]
    return analytics.side_by_side(parts, "vec_id")


@query("SELECT concat(upper(left(dataname, 1)), substr(dataname, 2)) AS dataset, label, n FROM (SELECT event_type AS dataname, CASE event_id % 3 WHEN 1 THEN 'CSR' ELSE 'Segment' END AS label, count(*) AS n FROM events WHERE event_id % 3 > 0 AND user_id % 8 <= 4 GROUP BY 1, 2)")
def clean_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.results(spark, d).withColumn("path", F.concat(F.lit("./idx_data/"), "dataname", F.lit("_idx.npy"))).drop("dataname")
    rows = rows.where(F.col("method").isin("csr", "ours") & (F.col("feature_size") <= 4)).withColumn("dataname", scalars.dataset_name(F.col("path")))
    label = scalars.relabel(F.col("method"), {"csr": "CSR", "ours": "Segment"})
    return rows.groupBy(scalars.capitalized(F.col("dataname")).alias("dataset"), label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_id, pow(2.0, round_even(log2(value), 0)) AS power FROM events WHERE value > 0")
def round_pow2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value > 0").select("event_id", scalars.nearest_power_of_two(F.col("value")).alias("power"))


@query("SELECT event_id, round(user_id * (user_id % 8 + 1) / value / 1e6 * 1e6, 6) AS mflops, round(2.0 * user_id * (user_id % 8 + 1) / value / 1e9 * 1e9, 6) AS flops, ceil(user_id / 8)::BIGINT AS tiles, least(greatest(user_id, 10), 100) AS clamped FROM events WHERE value > 0")
def gflops(spark: SparkSession, d: str) -> DataFrame:
    user, width, value = F.col("user_id"), F.col("user_id") % 8 + 1, F.col("value")
    return table(spark, d, "events").where("value > 0").select(
        "event_id", F.round(scalars.gflops(user, width, value) * 1e6, 6).alias("mflops"), F.round(scalars.sddmm_gflops(user, width, value) * 1e9, 6).alias("flops"),
        scalars.ceil_div(user, 8).alias("tiles"), scalars.clamp(user, 10, 100).cast("long").alias("clamped"),
    )


# -- index vectors ------------------------------------------------------------------------------------


@query(f"WITH {_RANKED}, C AS (SELECT count(*) AS n FROM R) SELECT g.p AS pos, idx // 4 AS idx FROM (SELECT unnest(range((SELECT round_even(n / 4, 0)::BIGINT FROM C))) AS p) g CROSS JOIN C JOIN R ON R.pos = floor(g.p * n / round_even(n / 4, 0))")
def downsample(spark: SparkSession, d: str) -> DataFrame:
    return augment.down_sample(augment.renumber(fx.items(spark, d)), 4)


_UP = "SELECT p AS pos, floor((a.idx + (t - q) * (coalesce(b.idx, a.idx) - a.idx)) * {s})::BIGINT AS idx FROM (SELECT p, t, least(floor(t), n - 1)::BIGINT AS q FROM (SELECT p, n, greatest((p + 0.5) / {s} - 0.5, 0)::DOUBLE AS t FROM (SELECT unnest(range((SELECT count(*) FROM R) * {s})) AS p, (SELECT count(*) FROM R) AS n))) JOIN R a ON a.pos = q LEFT JOIN R b ON b.pos = q + 1"


@query(f"WITH {_RANKED} " + _UP.format(s=2))
def upsample(spark: SparkSession, d: str) -> DataFrame:
    return augment.up_sample(augment.renumber(fx.items(spark, d)), 2)


_LADDER = f"""WITH {_RANKED}, C AS (SELECT count(*) AS n, floor(log2(greatest(count(*) // 1000, 1)))::BIGINT AS base FROM R),
    S AS (SELECT step, n, pow(2.0, base - step) AS f, CASE WHEN base > step THEN round_even(n / pow(2.0, base - step), 0) ELSE n * pow(2.0, step - base) END::BIGINT AS m FROM C CROSS JOIN (SELECT unnest(range({augment.LADDER})) AS step)),
    P AS (SELECT step, n, m, f, unnest(range(m)) AS p FROM S),
    Q AS (SELECT *, CASE WHEN f > 1 THEN floor(p * n / m) ELSE least(greatest(floor((p + 0.5) * f - 0.5), 0), n - 1) END::BIGINT AS q, greatest((p + 0.5) * f - 0.5, 0)::DOUBLE AS t FROM P),
    L AS (SELECT step, CASE WHEN f >= 1 THEN floor(a.idx / f) ELSE floor((a.idx + (t - q) * (coalesce(b.idx, a.idx) - a.idx)) / f) END::BIGINT AS idx FROM Q JOIN R a ON a.pos = q LEFT JOIN R b ON b.pos = q + 1)
    SELECT step::INT AS step, count(*) AS "rows", max(idx) AS largest, sum(idx)::BIGINT AS "sum" FROM L GROUP BY 1"""


@query(_LADDER)
def scale_ladder(spark: SparkSession, d: str) -> DataFrame:
    found = augment.scale_ladder(stash(augment.renumber(fx.items(spark, d)), "index"))
    return found.groupBy("step").agg(F.count("*").alias("rows"), F.max("idx").alias("largest"), F.sum("idx").alias("sum"))


@query(f"WITH {_ITEMS} SELECT row_number() OVER (ORDER BY idx, pos) - 1 AS rank, pos FROM I")
def arg_sort(spark: SparkSession, d: str) -> DataFrame:
    return augment.arg_sort(fx.items(spark, d))


def _uniform(seed: int, *keys: str) -> str:
    return f"(('0x' || left(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 13))::BIGINT / {1 << 52}.0::DOUBLE)"


def _normal(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_uniform(seed, chr(39) + 'r' + chr(39), *keys)})) * cos({_uniform(seed, chr(39) + 't' + chr(39), *keys)} * {2 * np.pi!r}))"


@query(f"WITH {_RANKED}, C AS (SELECT greatest(floor((count(*) - greatest(max(idx), 1)) / greatest(max(idx), 1)), 1)::BIGINT AS span FROM R), Z AS (SELECT pos, (idx + floor({_uniform(1, 'pos')} * span))::BIGINT AS idx FROM R CROSS JOIN C) SELECT row_number() OVER (ORDER BY idx, pos) - 1 AS pos, idx FROM Z")
def noise_augment(spark: SparkSession, d: str) -> DataFrame:
    return augment.noise_augment(augment.renumber(fx.items(spark, d)), variant=1)


@query(f"""WITH {_e()}, D AS (SELECT g.id, count(E.dst) AS n FROM (SELECT unnest(range((SELECT max(dst) + 1 FROM E))) AS id) g LEFT JOIN E ON E.dst = g.id GROUP BY 1),
    C AS (SELECT count(*) AS keys, min(n) AS least, max(n) AS most, sum(n)::BIGINT AS total, stddev_pop(n) / avg(n) AS cv, sum(n)::DOUBLE / count(*) AS mean FROM D),
    L AS (SELECT id AS idx, least(greatest(round({_normal(1, 'id')} * (cv * mean) + mean)::BIGINT, least), most) AS n, keys, total FROM D CROSS JOIN C),
    Z AS (SELECT idx, sum(n) OVER (ORDER BY idx) - n AS s, CASE WHEN idx = keys - 1 THEN total ELSE least(sum(n) OVER (ORDER BY idx), total) END AS t FROM L)
    SELECT idx, s::BIGINT AS "begin", (t - s)::BIGINT AS length FROM Z WHERE t > s""")
def synthetic_index(spark: SparkSession, d: str) -> DataFrame:
    """A generated vector with the size, key count and spread of lineitem's suppliers."""
    stats = sparse.degree(fx.edges(spark, d)).agg(F.count("*"), F.min("degree"), F.max("degree"), F.sum("degree"), F.stddev_pop("degree") / F.avg("degree")).first()
    keys, least, most, total, cv = stats
    return segment.run_lengths(augment.synthetic_index(spark, keys, least, most, total, cv, seed=1))


@query(f"""WITH {_NODES}, X AS (SELECT id, k, {_uniform(1, "'x'", 'id', 'k')} AS v FROM V CROSS JOIN (SELECT unnest(range(4)) AS k)),
    G AS (SELECT id AS src, k FROM V CROSS JOIN (SELECT unnest(range(8)) AS k)), E AS (SELECT src, floor({_uniform(1, "'dst'", 'src', 'k')} * {_N})::BIGINT AS dst, {_uniform(1, "'w'", 'src', 'k')} AS w FROM G),
    P AS (SELECT E.dst AS id, X.k, sum(E.w * X.v) AS v FROM E JOIN X ON X.id = E.src GROUP BY 1, 2) SELECT V.id, c.k, round(coalesce(P.v, 0), 6) + 0 AS value FROM V CROSS JOIN (SELECT unnest(range(4)) AS k) c LEFT JOIN P ON P.id = V.id AND P.k = c.k""")
def random_graph(spark: SparkSession, d: str) -> DataFrame:
    """The weighted product on a random graph over the given nodes, with 8 edges out of each."""
    nodes, edges = augment.random_graph(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), 8, 4, seed=1)
    return _long(spmm.gather_weight_scatter(edges, nodes, dim=4, num_nodes=nodes.select("id")), kind="double", digits=6)


@query(f"SELECT event_id, {_uniform(42, 'event_id')} < 0.8 AS in_train FROM events")
def config_split(spark: SparkSession, d: str) -> DataFrame:
    """Which measurements a model is fitted on."""
    return fx.results(spark, d).select("event_id", analytics.ConfigModel([]).in_train(["event_id"]).alias("in_train"))


@query()
def tree_fit(spark: SparkSession, d: str) -> DataFrame:
    """Configurations by tree: fit, predict powers of two, look the measured time up, error against the best."""
    rows = fx.results(spark, d).where("time > 0")
    features = rows.groupBy("dataname").agg(F.count("*").cast("double").alias("size"), F.avg("time").alias("avg"))
    rows = rows.join(features, "dataname").withColumn("config1", scalars.nearest_power_of_two(F.least("time", F.lit(32.0)))).withColumn("config2", F.pow(F.lit(2.0), F.col("feature_size") % 3))
    rows = stash(rows.withColumn("feature_size", F.col("feature_size").cast("double")), "features")
    model = analytics.ConfigModel(["config1", "config2"])
    train, test = model.split(rows, ["event_id"])
    found = model.fit(train).predict(test)
    keys = ["dataname", "config1", "config2"]
    measured = rows.groupBy(*keys).agg(F.max("time").alias("measured"))
    chosen = analytics.lookup(found.select("event_id", "dataname", "time", F.col("pred_config1").alias("config1"), F.col("pred_config2").alias("config2")), measured, keys, "measured")
    return chosen.groupBy("dataname").agg(F.count("*").alias("n"), analytics.root_mean_squared_error(F.col("measured"), F.col("time")).alias("rmse"))


# -- files --------------------------------------------------------------------------------------------


@query(f'WITH {_e(fx.SQUARE)} SELECT dst AS "row", src AS col, sum(w) AS w FROM E GROUP BY 1, 2')
def matrix_market_round_trip(spark: SparkSession, d: str) -> DataFrame:
    n, path = fx.node_count(spark, d), scratch(spark, "mtx")
    coo = sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)).select(F.col("dst").alias("row"), F.col("src").alias("col"), "w")
    matrix_market.write_matrix_market(stash(coo, "coo"), path, n, n)
    return matrix_market.read_matrix_market(spark, path)


@query(f"WITH {_RESULTS} SELECT dataname, feature_size::INT AS feature_size, method, time FROM T")
def result_csv(spark: SparkSession, d: str) -> DataFrame:
    rows, path = fx.results(spark, d), scratch(spark, "csv")
    named = rows.select("dataname", "feature_size", "method", "time")
    tables.write_csv(named.where("method = 'base'"), path)
    tables.write_csv(named.where("method <> 'base'"), path, append=True)
    return tables.read_csv(spark, path, "dataname string, feature_size int, method string, time double")


@query("SELECT event_type AS dataname, event_id % 2 AS noise, count(*) AS size, max(user_id) AS largest FROM events GROUP BY 1, 2")
def index_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "index")
    rows = table(spark, d, "events").select(F.col("event_type").alias("dataname"), (F.col("event_id") % 2).alias("noise"), F.lit(0).alias("scale"), F.col("event_id").alias("pos"), F.col("user_id").alias("idx"))
    tables.store_index(rows, path)
    return spark.read.parquet(path).groupBy("dataname", F.col("noise").cast("long").alias("noise")).agg(F.count("*").alias("size"), F.max("idx").alias("largest"))


@query(f"WITH {_RESULTS} SELECT dataname, feature_size::INT AS feature_size, method, time FROM T")
def result_csv_header(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    tables.write_csv(fx.results(spark, d).select("dataname", "feature_size", "method", "time"), path, header=True)
    return tables.read_csv(spark, path, "dataname string, feature_size int, method string, time double", header=True)


@query(f'WITH {_LOOPED} SELECT dst AS "row", src AS col, w, row_number() OVER (ORDER BY dst, src) - 1 AS pos FROM C')
def matrix_market_csr(spark: SparkSession, d: str) -> DataFrame:
    """A file read as compressed rows, and these as entries again."""
    n, path = fx.node_count(spark, d), scratch(spark, "mtx")
    coo = sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)).select(F.col("dst").alias("row"), F.col("src").alias("col"), "w")
    matrix_market.write_matrix_market(stash(coo, "coo"), path, n, n)
    return sparse.csr_to_coo(*matrix_market.read_matrix_market_csr(spark, path))


@query(f"""WITH {_LOOPED} SELECT 'pattern' AS field, dst AS "row", src AS col, 1.0::DOUBLE AS re, 0.0::DOUBLE AS im FROM C UNION ALL SELECT 'complex', dst, src, w, -w FROM C""")
def matrix_market_fields(spark: SparkSession, d: str) -> DataFrame:
    """A pattern file, whose entries count 1, and a complex one."""
    n, out = fx.node_count(spark, d), []
    coo = stash(sparse.coalesce_edges(fx.edges(spark, d, fx.SQUARE)).select(F.col("dst").alias("row"), F.col("src").alias("col"), "w"), "coo")
    for field, w in (("pattern", F.col("w")), ("complex", F.struct(F.col("w").alias("re"), (-F.col("w")).alias("im")))):
        path = scratch(spark, "mtx")
        matrix_market.write_matrix_market(coo.withColumn("w", w), path, n, n, field)
        found = matrix_market.read_matrix_market(spark, path)
        parts = (F.col("w.re"), F.col("w.im")) if field == "complex" else (F.col("w"), F.lit(0.0))
        out.append(found.select(F.lit(field).alias("field"), "row", "col", parts[0].alias("re"), parts[1].alias("im")))
    return out[0].union(out[1])


_LOWER = f"{_e(fx.SQUARE)}, T AS (SELECT greatest(src, dst) AS a, least(src, dst) AS b, sum(w)::DOUBLE AS w FROM E GROUP BY 1, 2)"


@query(f"""WITH {_LOWER}, U AS (SELECT 'symmetric' AS kind, a, b, w AS re, 0.0::DOUBLE AS im, 1 AS s, 0 AS t FROM T UNION ALL SELECT 'skew-symmetric', a, b, w, 0.0, -1, 0 FROM T WHERE a <> b
    UNION ALL SELECT 'hermitian', a, b, w, CASE WHEN a = b THEN 0 ELSE a - b END, 1, -1 FROM T)
    SELECT kind, a AS "row", b AS col, re, im + 0 AS im FROM U UNION ALL SELECT kind, b, a, s * re, t * im + 0 FROM U WHERE a <> b""")
def matrix_market_symmetries(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of which a half is written, read whole: entries below the diagonal come with their mirror image."""
    n, out = fx.node_count(spark, d), []
    edges = fx.edges(spark, d, fx.SQUARE).select(F.greatest("src", "dst").alias("dst"), F.least("src", "dst").alias("src"), "w")
    lower = stash(sparse.coalesce_edges(edges).select(F.col("dst").alias("row"), F.col("src").alias("col"), "w"), "lower")
    complex_w = F.struct(F.col("w").alias("re"), (F.col("row") - F.col("col")).cast("double").alias("im"))
    for symmetry, field, w in (("symmetric", "real", F.col("w")), ("skew-symmetric", "real", F.col("w")), ("hermitian", "complex", complex_w)):
        path = scratch(spark, "mtx")
        matrix_market.write_matrix_market(lower.withColumn("w", w), path, n, n, field, symmetry)
        found = matrix_market.read_matrix_market(spark, path)
        re, im = (F.col("w.re"), F.col("w.im") + 0.0) if field == "complex" else (F.col("w"), F.lit(0.0))
        out.append(found.select(F.lit(symmetry).alias("kind"), "row", "col", re.alias("re"), im.alias("im")))
    return analytics.stack_rows(out)


@query("SELECT (p // 1024)::VARCHAR AS dataname, p % 1024 AS pos, idx FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS p, user_id AS idx FROM events)")
def npy_files(spark: SparkSession, d: str) -> DataFrame:
    """Index vectors as .npy files of 1,024 entries, read back in bulk."""
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("idx"))
    path = scratch(spark, "npy")
    stash(tables.write_index_files(sparse.number_rows(events, "pos", ["event_id"]).select("pos", "idx"), path, 1024), "files")
    return tables.read_index_files(spark, path)
