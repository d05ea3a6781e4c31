"""Matrix Market coordinate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sparse import coo_to_csr, csr_entries
from ..session import stash

FIELDS = ("real", "double", "complex", "integer", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, at): all lines but empty ones; at orders the lines of a file, split or not."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at")).where(F.trim("value") != "")


def header(spark: SparkSession, path: str) -> tuple[str, str, int, int, int]:
    """(field, symmetry, rows, cols, entries) of the banner and size line."""
    lines = _lines(spark, path)
    found = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    banner = found["value"].split() if found else []
    if len(banner) < 5 or [x.lower() for x in banner[1:3]] != ["matrix", "coordinate"]:
        raise ValueError("not a Matrix Market coordinate file")
    field, symmetry = banner[3].lower(), banner[4].lower()
    if field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"unknown field or symmetry: {field} {symmetry}")
    size = lines.where((F.col("file") == found["file"]) & ~F.col("value").startswith("%")).orderBy("at").first()["value"].split()
    return field, symmetry, int(size[0]), int(size[1]), int(size[2])


def read_matrix_market(spark: SparkSession, path: str, expand: bool = True) -> DataFrame:
    """(row, col, w) with ids from 0; complex values are a struct (re, im), pattern files have weight 1.

    With expand the mirrored entries of symmetric files are all added. path is one file, or a folder of parts of which one has the banner.
    Files may be split among tasks: the size line is the first line of the banner's file that is no comment, told by its place in
    the file.
    """
    field, symmetry, *_ = header(spark, path)
    lines = _lines(spark, path)
    titled = lines.where(F.col("value").startswith("%%MatrixMarket")).select(F.col("file").alias("_file"))
    plain = lines.where(~F.col("value").startswith("%"))
    first = plain.join(F.broadcast(titled), F.col("file") == F.col("_file")).agg(F.first("_file").alias("_file"), F.min("at").alias("_first"))
    body = plain.join(F.broadcast(first), (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_first")), "left_anti")
    at = body.select(F.split(F.trim("value"), "\\s+").alias("a")).select((F.col("a")[0].cast("long") - 1).alias("row"), (F.col("a")[1].cast("long") - 1).alias("col"), "a")
    real, imaginary = F.get("a", F.lit(2)).cast("double"), F.get("a", F.lit(3)).cast("double")
    value = F.lit(1.0) if field == "pattern" else F.struct(real.alias("re"), imaginary.alias("im")) if field == "complex" else real
    coo = at.select("row", "col", value.alias("w"))
    if symmetry == "general" or not expand:
        return coo
    mirror = F.col("w")
    if symmetry == "skew-symmetric":
        mirror = F.struct((-F.col("w.re")).alias("re"), (-F.col("w.im")).alias("im")) if field == "complex" else -mirror
    if symmetry == "hermitian" and field == "complex":
        mirror = F.struct(F.col("w.re").alias("re"), (-F.col("w.im")).alias("im"))
    entry = F.struct("row", "col", "w")
    image = F.struct(F.col("col").alias("row"), F.col("row").alias("col"), mirror.alias("w"))
    return coo.select(F.inline(F.when(F.col("row") != F.col("col"), F.array(entry, image)).otherwise(F.array(entry))))


def read_matrix_market_csr(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Row pointers and entries of a file; the size line gives the number of rows."""
    rows = header(spark, path)[2]
    coo = stash(read_matrix_market(spark, path), "coo")
    return coo_to_csr(coo, "row", rows), csr_entries(coo, "row", "col")


def write_matrix_market(coo: DataFrame, path: str, rows: int, cols: int, field: str = "real", symmetry: str = "general") -> None:
    """Write (row, col, w) in order of row and column to a folder of text parts that read as one file, header first.

    Of a symmetric matrix the entries on and below the diagonal are written, of a skew-symmetric one those below; the rest is their mirror image and isn't looked at.
    """
    if field not in FIELDS or symmetry not in SYMMETRIES or (symmetry == "hermitian" and field != "complex"):
        raise ValueError(f"cannot write field and symmetry: {field} {symmetry}")
    if symmetry != "general":
        coo = coo.where("row > col" if symmetry == "skew-symmetric" else "row >= col")
    ordered = coo.orderBy("row", "col")
    value = F.lit("") if field == "pattern" else F.concat(F.lit(" "), F.concat_ws(" ", F.col("w.re").cast("string"), F.col("w.im").cast("string")) if field == "complex" else F.col("w").cast("string"))
    body = ordered.select(F.concat((F.col("row") + 1).cast("string"), F.lit(" "), (F.col("col") + 1).cast("string"), value).alias("value"))
    head = coo.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate {field} {symmetry}\n{rows} {cols} {coo.count()}",)], "value string").coalesce(1)
    head.union(body).write.mode("overwrite").text(path)
