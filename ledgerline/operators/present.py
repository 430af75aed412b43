"""What is shown: final figures, differences, notes, sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.labels import differs
from ledgerline.functions.text import clean, normalise


def final_value(present: Column, override: Column, recount: Column) -> Column:
    """An override wins even when it is null: that says the figure is unknown."""
    return F.when(F.coalesce(present, F.lit(False)), override).otherwise(recount)


def display_value(final: Column, exported: Column, checked: Column) -> tuple[Column, Column]:
    """The figure to show and whether it is unverified: the export's own, unless ticked."""
    return F.coalesce(final, exported), final.isNull() & ~F.coalesce(checked, F.lit(False))


def unpivot_metrics(rows: DataFrame, ids: list[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """ids, metric, reported, recounted: one row a metric."""
    parts = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(a).alias("reported"), F.col(b).alias("recounted")) for k, (a, b) in metrics.items()))
    return rows.select(*ids, F.inline(parts))


def changes(metrics: DataFrame) -> DataFrame:
    return metrics.filter(differs(F.col("reported"), F.col("recounted")))


def ordered_texts(order: Column, text: Column, separator: str = "; ", most: int | None = None) -> Column:
    """Aggregate: the texts that are not null, in order, joined; the first most of them."""
    parts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))))
    parts = F.transform(parts, lambda p: p["t"])
    return F.array_join(F.slice(parts, 1, most) if most else parts, separator)


def issues(*cases: tuple[Column, str]) -> Column:
    """The messages whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, m) for c, m in cases)))


def fill(unverified: Column, attention: Column, changed: Column) -> Column:
    return F.when(unverified | attention, "amber").when(changed, "green").otherwise("")


def keyed_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, old, new where two versions differ; rows of only one have column null
    and old or new "present"."""
    pair = old.select(key, F.struct(*columns).alias("_old")).join(new.select(key, F.struct(*columns).alias("_new")), key, "full_outer")
    one_side = F.col("_old").isNull() | F.col("_new").isNull()
    missing = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.when(F.col("_old").isNotNull(), "present").alias("old"), F.when(F.col("_new").isNotNull(), "present").alias("new")))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_old.{c}").cast("string").alias("old"), F.col(f"_new.{c}").cast("string").alias("new")) for c in columns))
    unlike = F.filter(each, lambda s: ~s["old"].eqNullSafe(s["new"]))
    return pair.select(key, F.inline(F.when(one_side, missing).otherwise(unlike)))


def few(texts: Column, most: int) -> Column:
    """The first most of an array of texts, and how many more there are."""
    more = F.size(texts) - most
    return F.array_join(F.concat(F.slice(texts, 1, most), F.when(more > 0, F.array(F.concat(F.lit("and "), more.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))), ", ")


def sorted_notes(notes: Column) -> Column:
    """Each note once, in order of its text."""
    return F.array_sort(F.array_distinct(notes))


def was(value: Column, original: Column) -> Column:
    """n, or n (was m) where the original is another."""
    shown = value.cast("string")
    return F.when(differs(value, original), F.concat(shown, F.lit(" (was "), original.cast("string"), F.lit(")"))).otherwise(shown)


def review_note(parts: Column, alternate: Column, checked: Column) -> Column:
    """What of a row wants a look: nothing once it is ticked, one memo for the alternate form
    (there every figure does), else its parts."""
    memo = "the alternate form was used: check every figure"
    return F.when(F.coalesce(checked, F.lit(False)), "").when(F.coalesce(alternate, F.lit(False)), memo).otherwise(F.array_join(parts, "; "))


#: Columns that each order of the result table goes by, before the order of upload.
ORDERS = {
    "pasted": ("page_position",),
    "export": ("export_order",),
    "listing": ("listing_order",),
    "hierarchy": ("group_id", "area_id"),
    "alphabet": ("region", "area"),
    "upload": (),
}


def in_order(order: str, upload: str = "doc_no") -> list[Column]:
    """Sort columns of an order; rows without its key come last, as they were uploaded. Ids
    are compared as texts."""
    columns = ORDERS[order]
    if order == "hierarchy":
        keys = [F.when(F.col("group_id").isNotNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
        missing = F.col("group_id").isNull()
    elif order == "alphabet":
        keys = [normalise(F.col(c)) for c in columns]
        missing = (clean(F.col("region")) == "") & (clean(F.col("area")) == "")
    else:
        keys = [F.col(c) for c in columns]
        missing = F.col(columns[0]).isNull() if columns else F.lit(False)
    return [missing, *(F.when(~missing, k).asc_nulls_first() for k in keys), F.col(upload)]
