"""Sources, sinks and the streaming operators."""

import numpy as np
import pytest

from segspark.sources import matrix_market, tables
from segspark.streaming import segments

HEAD = "%%MatrixMarket matrix coordinate "


def _file(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder}/{name}"


@pytest.mark.parametrize(
    ("kind", "body", "want"),
    [
        ("real general", "3 3 2\n1 2 5\n3 1 -1.5\n", [(0, 1, 5.0), (2, 0, -1.5)]),
        ("integer general", "2 2 1\n2 2 7\n", [(1, 1, 7.0)]),
        ("pattern symmetric", "3 3 3\n2 1\n3 3\n3 2\n", [(1, 0, 1.0), (2, 2, 1.0), (2, 1, 1.0), (0, 1, 1.0), (1, 2, 1.0)]),
        ("real skew-symmetric", "2 2 1\n2 1 3\n", [(1, 0, 3.0), (0, 1, -3.0)]),
    ],
)
def test_matrix_market_fields(spark, tmp_path, kind, body, want):
    path = _file(tmp_path, "m.mtx", f"{HEAD}{kind}\n% a comment\n%\n{body}")
    assert sorted(map(tuple, matrix_market.read_matrix_market(spark, path).collect())) == sorted(want)


def test_matrix_market_complex_and_csr(spark, tmp_path):
    path = _file(tmp_path, "c.mtx", f"{HEAD}complex hermitian\n2 2 1\n2 1 1.0 2.0\n")
    got = {(r.row, r.col): (r.w.re, r.w.im) for r in matrix_market.read_matrix_market(spark, path).collect()}
    assert got == {(1, 0): (1.0, 2.0), (0, 1): (1.0, -2.0)}
    path = _file(tmp_path, "r.mtx", f"{HEAD}real general\n4 4 3\n1 2 5\n3 1 2\n3 4 1\n")
    rows, entries = matrix_market.read_matrix_market_csr(spark, path)
    assert [(r.ptr_begin, r.ptr_end) for r in rows.orderBy("row").collect()] == [(0, 1), (1, 1), (1, 3), (3, 3)]
    assert [tuple(r) for r in entries.orderBy("pos").collect()] == [(0, 1, 5.0), (1, 0, 2.0), (2, 3, 1.0)]
    with pytest.raises(ValueError, match="not a Matrix Market"):
        matrix_market.header(spark, _file(tmp_path, "x.mtx", "1 2 3\n"))


@pytest.mark.parametrize(("symmetry", "sign"), [("symmetric", 1.0), ("skew-symmetric", -1.0)])
def test_half_of_a_symmetric_matrix_is_written(spark, tmp_path, symmetry, sign):
    cells = [(0, 0, 0.0), (2, 1, 5.0), (1, 2, 5.0 * sign), (3, 0, -1.5), (0, 3, -1.5 * sign)]
    cells = cells if sign > 0 else cells[1:]
    path = f"file://{tmp_path}/half"
    matrix_market.write_matrix_market(spark.createDataFrame(cells, "row long, col long, w double"), path, 4, 4, symmetry=symmetry)
    assert matrix_market.header(spark, path) == ("real", symmetry, 4, 4, len(cells) - 2)
    assert sorted(map(tuple, matrix_market.read_matrix_market(spark, path).collect())) == sorted(cells)
    with pytest.raises(ValueError, match="cannot write"):
        matrix_market.write_matrix_market(spark.createDataFrame(cells, "row long, col long, w double"), path, 4, 4, symmetry="hermitian")


def test_matrix_market_in_small_splits(spark, tmp_path):
    cells = [(i, (7 * i) % 50, float(i)) for i in range(400)]
    frame = spark.createDataFrame(cells, "row long, col long, w double")
    matrix_market.write_matrix_market(frame, f"file://{tmp_path}/out", 400, 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        found = matrix_market.read_matrix_market(spark, f"file://{tmp_path}/out")
        assert sorted(map(tuple, found.collect())) == cells
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_and_index_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5)], "dataname string, feature_size int, time double")
    path = f"file://{tmp_path}/r"
    tables.write_csv(rows, path)
    tables.write_csv(rows, path, append=True)
    assert tables.read_csv(spark, path, rows.schema.simpleString()[7:-1].replace(":", " ")).count() == 4
    (tmp_path / "idx").mkdir()
    np.save(tmp_path / "idx" / "one_idx.npy", np.array([0, 0, 3]))
    np.save(tmp_path / "idx" / "two_idx.npy", np.array([5]))
    got = tables.read_index_files(spark, f"file://{tmp_path}/idx").collect()
    assert sorted(map(tuple, got)) == [("one", 0, 0), ("one", 1, 0), ("one", 2, 3), ("two", 0, 5)]


def test_streamed_sums_equal_batch_sums(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0), (1, 0, 1.0), (0, 1, None)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(0, [1.0, 2.0]), (1, [10.0, 20.0])], "id long, x array<double>")
    edges.repartition(4).write.parquet(f"{tmp_path}/edges")
    stream = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/edges")
    run = segments.streaming_gather_sum(stream, nodes, 2).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    run.processAllAvailable()
    run.stop()
    assert {r.id: r.x for r in spark.sql("SELECT * FROM sums").collect()} == {1: [33.0, 66.0], 0: [10.0, 20.0]}


def test_windowed_degree(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(t) AS t, 0L AS src, d AS dst FROM VALUES (0, 1L), (30, 1L), (70, 1L), (75, 2L) AS v(t, d)")
    rows.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    run = segments.windowed_degree(stream, "t", "1 minute", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.start.minute, r.id, r.degree) for r in spark.sql("SELECT * FROM degrees").collect()) == [(0, 1, 2), (1, 1, 1), (1, 2, 1)]


def test_mirror_images_cost_no_second_reading(spark, tmp_path):
    coo = spark.createDataFrame([(2, 0, 1.5), (2, 2, 4.0), (3, 1, -2.0)], "row long, col long, w double")
    for symmetry, sign in (("symmetric", 1), ("skew-symmetric", -1)):
        path = f"file://{tmp_path}/{symmetry}"
        matrix_market.write_matrix_market(coo, path, 4, 4, "real", symmetry)
        found = matrix_market.read_matrix_market(spark, path)
        halves = matrix_market.read_matrix_market(spark, path, expand=False)
        scans = [d._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for d in (found, halves)]
        assert scans[0] == scans[1] > 0
        want = {(2, 0, 1.5), (3, 1, -2.0), (0, 2, sign * 1.5), (1, 3, sign * -2.0)} | ({(2, 2, 4.0)} if sign > 0 else set())
        assert {tuple(r) for r in found.collect()} == want


def test_compressed_rows_read_the_text_once(spark, tmp_path):
    coo = spark.createDataFrame([(1, 0, 1.5), (2, 2, 4.0)], "row long, col long, w double")
    matrix_market.write_matrix_market(coo, f"file://{tmp_path}/m", 3, 3)
    rows, entries = matrix_market.read_matrix_market_csr(spark, f"file://{tmp_path}/m")
    assert "text" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]
    assert sorted(tuple(r) for r in entries.collect()) == [(0, 0, 1.5), (1, 2, 4.0)]
