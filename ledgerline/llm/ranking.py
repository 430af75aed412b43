"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import write_table

#: Rows of a partition are numbered below this bit, partitions above it.
BITS = 33


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df as a written table in ranges of order, with part (the range, ascending) and at (the
    row's place in its range). Equal keys share a range: end order with a column that differs."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return write_table(dealt.withColumn("number", number).select("*", F.shiftright("number", BITS).cast("int").alias("part"), F.col("number").bitwiseAND((1 << BITS) - 1).alias("at")).drop("number"), "ordered")


def places(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, from 0 on, in order. Sizes of ranges are summed, one row a range: there
    are no more of them than shuffle partitions, so they are broadcast."""
    table = in_order(df, *order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return table.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("at")).drop("part", "at", "start")
