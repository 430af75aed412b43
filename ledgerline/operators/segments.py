"""Order-dependent operators over rows of tables: windows, no loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segment(rows: DataFrame, keys: list[str], order: list[str], is_label: Column, name: str = "seg") -> DataFrame:
    """Each label row owns the rows up to the next label of the same table; rows before any
    label have segment 0."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(is_label, 1).otherwise(0)).over(running).cast("int"))


def adopt_next(tables: DataFrame, doc: str, order: str, ends_with_label: Column, is_plain: Column) -> DataFrame:
    """Tables with adopts: the number of the next table, where this one ends with a label
    and the next is unlabelled and not empty."""
    ahead = Window.partitionBy(doc).orderBy(order)
    takes = ends_with_label & F.coalesce(F.lead(is_plain).over(ahead), F.lit(False))
    return tables.withColumn("adopts", F.when(takes, F.lead(order).over(ahead)))


def value_below(rows: DataFrame, keys: list[str], order: str, is_heading: Column, value: str, default_row: int, name: str) -> DataFrame:
    """Per group the value in the row after the first heading, else in row default_row
    (from 0) of the group."""
    inside = Window.partitionBy(*keys).orderBy(order)
    at = rows.withColumns({"_next": F.lead(value).over(inside), "_row": F.row_number().over(inside) - 1, "_heading": is_heading})
    below = F.min(F.when(F.col("_heading"), F.struct("_row", "_next")))
    return at.groupBy(*keys).agg(F.coalesce(below["_next"], F.max(F.when(F.col("_row") == default_row, F.col(value)))).alias(name))


def data_after_heading(rows: DataFrame, keys: list[str], order: str, is_heading: Column) -> DataFrame:
    """Rows after the first heading of each group; groups without one have none."""
    whole = Window.partitionBy(*keys)
    first = F.min(F.when(is_heading, F.col(order))).over(whole)
    return rows.withColumn("_first", first).filter(F.col(order) > F.col("_first")).drop("_first")


def nearest_before(rows: DataFrame, doc: str, order: str, heading: Column, name: str) -> DataFrame:
    """The last heading before each row."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(before))
