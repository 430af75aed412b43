"""Joins by several spellings, fallbacks, and status of each result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.text import area_variants


def with_variants(rows: DataFrame, area: str, out: str) -> DataFrame:
    """rows with the spellings of area, computed once for each distinct area."""
    each = rows.select(F.col(area).alias("_area")).distinct().select("_area", area_variants(F.col("_area")).alias(out))
    return rows.join(each, F.col(area).eqNullSafe(F.col("_area")), "left").drop("_area")


def first_key_join(left: DataFrame, right: DataFrame, left_id: str, keys: Column, key: str, extra: list[str] | None = None) -> DataFrame:
    """left with the rows of right that its first matching key finds (left outer).

    keys: an array, most specific first; right has one column key; extra: further columns
    of the same name that must agree. Only keys are exploded and joined: the hits of the
    first key that has any are picked by a minimum, then joined back on left_id."""
    extra = extra or []
    tried = left.select(left_id, *extra, F.posexplode(keys).alias("priority", key))
    hits = tried.join(right, [*extra, key]).drop(*extra)
    best = hits.withColumn("_best", F.min("priority").over(Window.partitionBy(left_id))).filter(F.col("priority") == F.col("_best")).drop("_best")
    return left.join(best, left_id, "left")


def unique_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no other row has."""
    single = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(single, keys, "left_semi")


def prefer_exact(hits: DataFrame, left_id: str, exact: Column) -> DataFrame:
    """Of several hits of a row, those that are exact, if there are any."""
    own = Window.partitionBy(left_id)
    many = hits.withColumns({"_n": F.count("*").over(own), "_exact": exact, "_any": F.max(exact).over(own)})
    return many.filter((F.col("_n") == 1) | ~F.col("_any") | F.col("_exact")).drop("_n", "_exact", "_any")


def latest(rows: DataFrame, keys: list[str], at: Column, tie: list[str | Column]) -> DataFrame:
    """The newest row of each key; of equally new ones the first by tie."""
    order = Window.partitionBy(*keys).orderBy(at.desc_nulls_last(), *tie)
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def mark_superseded(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """superseded: not the newest of its slot, where the newest is unique; undecided: one
    of several newest."""
    slot = Window.partitionBy(*keys)
    top = rows.withColumn("_top", F.max(at).over(slot))
    newest = F.count_if(F.col(at) == F.col("_top")).over(slot)
    marked = top.withColumn("_newest", newest)
    return marked.withColumns({"superseded": F.coalesce((F.col(at) < F.col("_top")) & (F.col("_newest") == 1), F.lit(False)), "undecided": F.coalesce((F.col(at) == F.col("_top")) & (F.col("_newest") > 1), F.lit(False))}).drop("_top", "_newest")


def mark_copies(rows: DataFrame, name: str, has_suffix: Column, order: str) -> DataFrame:
    """copy_no within a name, from 1: the holder is the first row without a copy suffix,
    else the first row; all others are duplicates."""
    own = Window.partitionBy(name).orderBy(has_suffix, order)
    return rows.withColumn("copy_no", F.row_number().over(own))


def result_status(duplicate: Column, elite: Column, error: Column, known: Column, candidates: Column, superseded: Column) -> Column:
    """elite, parse_error, unmatched, ambiguous; a single candidate leaves a duplicate a
    duplicate; a matched row may be superseded."""
    return (
        F.when(elite, "elite")
        .when(error, "parse_error")
        .when(~known | (candidates == 0), "unmatched")
        .when(candidates > 1, "ambiguous")
        .when(duplicate, "duplicate")
        .when(superseded, "superseded")
        .otherwise("matched")
    )


def page_status(known: Column, elite: Column, has_document: Column, placed: Column, error: Column, superseded: Column, repeat: Column, reached: Column) -> Column:
    """Status of a line of an ordered page, the first that applies."""
    return (
        F.when(~known, "unrecognised")
        .when(elite, "elite")
        .when(~has_document, "no document")
        .when(placed & error, "could not read")
        .when(superseded, "older version")
        .when(placed, "uploaded")
        .when(repeat & reached, "check page")
        .when(reached, "missing")
        .otherwise("not reached")
    )
