"""Connected components of an edge list, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import remove_table, shuffled, write_table


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _mins(both).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = down.join(shuffled(_mins(down)), "u")
    rest = tied.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(tied.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the component's least node) for every node of edges (u, v: long) but
    the least ones themselves. Large and small stars in turn, until nothing changes; the
    edges stay distributed, each round is a table, and a hub's edges can be split."""
    now = write_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = state(now)
    while before[0]:
        after = write_table(_small_star(_large_star(now)), "edges")
        remove_table(now)
        now, found = after, state(after)
        if found == before:
            break
        before = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
