"""Documents as they arrive in a folder: an extension, the batch engine needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.readers import decode_documents

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arriving_documents(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """A stream of decoded documents; each micro-batch takes up to files_each new files."""
    found = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", "*.docx").load(folder)
    return decode_documents(found.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content"))
