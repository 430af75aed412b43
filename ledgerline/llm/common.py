"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder is taken if the driver runs all tasks
    itself (tests); on a cluster that is an error, as executors would not see its files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        root = context.getCheckpointDir()
        if root is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="spark-ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here,
    and a lost executor costs one read, not the whole computation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Delete the files of a table that write_table made, through the file system that holds them."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df, never broadcast where it is joined. For what grows with the input: Spark takes an
    exploded table for as large as it was before, and a written one for its compressed size,
    and would collect it in the driver. Large partitions are split all the same."""
    return df.hint("merge")


def small_batches(parts: Iterator[pa.RecordBatch], rows: int = 256, column: str = "text", size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most so many rows, and of about so many bytes of column
    at most (a longer text is a slice of its own): what a task holds as Python objects is
    bounded by one text."""
    for part in parts:
        lengths = np.asarray(pc.binary_length(part.column(column)).fill_null(0), np.int64) if column in part.schema.names else np.zeros(part.num_rows, np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < part.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            stop = min(stop, at + rows, part.num_rows)
            yield part.slice(at, stop - at)
            at = stop


def whole_rows(df: DataFrame, **more: Column) -> DataFrame:
    """df's rows as one struct, row, beside columns of our own: so no name of df can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(k) for k, c in more.items()))


def row_schema(rows: DataFrame, more: str) -> StructType:
    """The schema of row as it is, and more."""
    return StructType([rows.schema["row"], *StructType.fromDDL(more).fields])


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
