"""Decoded packages kept by what they contain, so that no bytes are decoded twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.tables import settled


def decoded(packages: DataFrame, decode: Callable[[DataFrame], DataFrame], store: str) -> DataFrame:
    """What decode makes of packages (doc_id, content): a row for each row of packages, from store.

    decode takes doc_id, content and gives a row a package, with doc_id: readers.decode_documents,
    readers.decode_tables or any other. store is a folder of Parquet, by SHA-256 of content;
    it is made where it is missing, and holds the work of one decode only: take another folder
    when the decoder changes. Only content that store lacks is decoded, each once, whatever
    its names; null content counts as empty, and a package that cannot be decoded is kept
    with its error like any other.

    Packages are read once for their digests and once for the content that is new; the
    latter alone travels, to drop copies. A run that is lost half way leaves whole rows or
    none; two runs at once may decode the same content, of which the first by run id counts."""
    spark = packages.sparkSession
    whole = packages.select("doc_id", F.coalesce("content", F.lit(b"")).alias("content")).withColumn("digest", F.sha2("content", 256))
    one = lambda df: decode(df.select(F.col("digest").alias("doc_id"), "content")).withColumnRenamed("doc_id", "digest").withColumn("run", F.lit(uuid.uuid4().hex))
    schema = one(whole).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(store)
    kept = lambda: spark.read.schema(schema).parquet(store)
    named = settled(whole.select("doc_id", "digest"))
    new = settled(named.select("digest").distinct().join(kept().select("digest"), "digest", "left_anti"))
    if not new.isEmpty():
        one(whole.join(new, "digest", "left_semi").dropDuplicates(["digest"])).write.mode("append").parquet(store)
    runs = kept().groupBy("digest").agg(F.min("run").alias("run"))
    return named.join(runs.join(kept(), ["digest", "run"]), "digest").drop("digest", "run")
