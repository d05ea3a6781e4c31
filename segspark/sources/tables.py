"""Result tables and index vectors on disk."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dataset_name


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """Columns as declared; nothing is inferred."""
    return spark.read.schema(schema).csv(path, header=header)


def write_csv(rows: DataFrame, path: str, append: bool = False, header: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=header)


def read_index_files(spark: SparkSession, path: str) -> DataFrame:
    """(dataname, pos, idx) of all .npy files under path, one task per file at most."""

    def load(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                idx = np.load(io.BytesIO(content), allow_pickle=False).ravel()
                for start in range(0, len(idx), 100_000):
                    part = idx[start : start + 100_000]
                    yield pd.DataFrame({"path": name, "pos": np.arange(start, start + len(part)), "idx": part.astype("int64")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content").mapInPandas(load, "path string, pos long, idx long")
    return rows.select(dataset_name(F.col("path")).alias("dataname"), "pos", "idx")


def store_index(rows: DataFrame, path: str) -> None:
    """Store (dataname, noise, scale, pos, idx), one folder per variant."""
    rows.write.mode("overwrite").partitionBy("dataname", "noise", "scale").parquet(path)


def write_index_files(rows: DataFrame, folder: str, block: int = 1 << 16) -> DataFrame:
    """Write rows(pos, idx), positions from 0 without gaps, as one .npy file of int64 for each block positions; (path, rows) of the files.

    folder has a scheme and is shared by the executors. A block is one task, and its file is moved into place when whole.
    """

    def save(part: pa.Table) -> pa.Table:
        number = part["block"][0].as_py()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        draft, path = f"{base}/.{number}.{uuid.uuid4().hex}", f"{base}/{number}_idx.npy"
        data = io.BytesIO()
        np.save(data, part.sort_by("pos")["idx"].to_numpy().astype("<i8"))
        with fs.open_output_stream(draft) as out:
            out.write(data.getbuffer())
        fs.move(draft, path)
        return pa.table({"path": [path], "rows": pa.array([part.num_rows], pa.int64())})

    blocks = rows.select(F.floor(F.col("pos") / block).alias("block"), "pos", F.col("idx").cast("long"))
    return blocks.groupBy("block").applyInArrow(save, "path string, rows long")
