"""Counts of clients and nominations per document, unknown rather than zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_answers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From a column answer (new, not, blank, unrecognised): active, new_clients, blanks,
    unrecognised. One unreadable answer makes the number of new clients unknown."""
    counted = rows.groupBy(*keys).agg(
        F.count("*").alias("active"),
        F.count_if(F.col("answer") == "new").alias("new_known"),
        F.count_if(F.col("answer") == "blank").alias("blanks"),
        F.count_if(F.col("answer") == "unrecognised").alias("unrecognised"),
    )
    return counted.select(*keys, "active", F.when(F.col("unrecognised") == 0, F.col("new_known")).alias("new_clients"), "blanks", "unrecognised")


def suspicious_blanks(rows: DataFrame, table: list[str], doc: list[str]) -> DataFrame:
    """Per document, blank answers in tables that have an answered row, or are one lone
    blank row."""
    blank = F.count_if(F.col("answer") == "blank")
    tables = rows.groupBy(*table).agg(F.count("*").alias("n"), blank.alias("blank"))
    odd = F.when((F.col("blank") < F.col("n")) | (F.col("n") == 1), F.col("blank")).otherwise(0)
    return tables.groupBy(*doc).agg(F.sum(odd).cast("long").alias("suspicious"), F.count("*").alias("tables"))
