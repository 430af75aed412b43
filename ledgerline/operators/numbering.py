"""Checks of numbered items: they must be 1..N for each kind, or else all together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check_numbering(items: DataFrame, keys: list[str], kind: str, number: str) -> DataFrame:
    """keys, items, by_kind, combined, clean, absent (numbers that the reading with fewer
    gaps misses; per kind on a tie). One pass: grouping sets over (keys, kind) and (keys)."""
    sets = items.groupingSets([[*map(F.col, keys), F.col(kind)], [*map(F.col, keys)]], *keys, kind)
    each = sets.agg(
        F.grouping(kind).alias("whole"),
        F.count(number).cast("int").alias("n"),
        F.min(number).cast("int").alias("low"),
        F.max(number).cast("int").alias("high"),
        F.count_distinct(number).cast("int").alias("different"),
    )
    each = each.withColumns({"clean": (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("different") == F.col("n")), "gaps": F.col("high") - F.col("different")})
    whole = F.col("whole") == 1
    out = each.groupBy(*keys).agg(
        F.max(F.when(whole, F.col("n"))).alias("items"),
        F.bool_and(F.when(~whole, F.col("clean"))).alias("by_kind"),
        F.max(F.when(whole, F.col("clean"))).alias("combined"),
        F.sum(F.when(~whole, F.col("gaps"))).cast("int").alias("kind_gaps"),
        F.max(F.when(whole, F.col("gaps"))).cast("int").alias("all_gaps"),
    )
    return out.select(*keys, "items", "by_kind", "combined", (F.col("by_kind") | F.col("combined")).alias("clean"), F.least("kind_gaps", "all_gaps").alias("absent"))


def islands(items: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: keys, first, last."""
    distinct = items.select(*keys, F.col(number).cast("int").alias("number")).distinct()
    run = F.col("number") - F.row_number().over(Window.partitionBy(*keys).orderBy("number"))
    return distinct.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("number").alias("first"), F.max("number").alias("last")).drop("_run")


def absent_numbers(items: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys and absent: the numbers from 1 to the largest that do not occur, as an array."""
    held = items.groupBy(*keys).agg(F.collect_set(F.col(number).cast("int")).alias("held"))
    return held.select(*keys, F.array_sort(F.array_except(F.sequence(F.lit(1), F.array_max("held")), "held")).alias("absent"))
