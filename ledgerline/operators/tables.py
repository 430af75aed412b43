"""Cutting the lineage of results that later steps use several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without that setting
    a temporary folder serves, if the driver runs all tasks itself."""
    spark = df.sparkSession
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: plans on top of it stay
    small, and its size and columns are known, so later reads prune and joins can broadcast
    what is small."""
    path = f"{shared_folder(df)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
