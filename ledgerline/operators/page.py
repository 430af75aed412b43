"""A pasted page: its lines, the column that identifies them, order and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import clean, normalise, order_forms, order_keys, own_order_keys, portal_area, shared_order_keys
from ledgerline.operators.matching import with_variants
from ledgerline.operators.tables import settled

#: Headings of a page's columns.
HINTS = {
    "filename": ("file name", "filename", "file", "document name", "document", "file uri", "uri"),
    "firm": ("firm name", "firm"),
    "region": ("region", "country name", "country"),
    "practice_group": ("practice group name", "practice group", "group"),
    "practice_area": ("practice area name", "practice area", "table name", "area", "table"),
}


def read_page(pastes: DataFrame) -> DataFrame:
    """From page_id, pasted: page_id, line_no (from 0), cols. Lines end in any style, empty
    ones do not count, cells are split at tabs and short lines padded."""
    lines = F.filter(F.split("pasted", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    split = F.transform(lines, lambda x: F.transform(F.split(x, "\t"), lambda c: F.trim(c)))
    width = F.array_max(F.transform(F.col("split"), lambda r: F.size(r)))
    padded = F.transform("split", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("width") - F.size(r))))
    return pastes.select("page_id", split.alias("split")).withColumn("width", width).filter("width IS NOT NULL").select("page_id", F.posexplode(padded).alias("line_no", "cols"))


def named_columns(lines: DataFrame) -> DataFrame:
    """page_id and the number (from 0) of each column that the first line names; only a
    practice area or a file name makes it a header."""
    keys = F.transform("cols", lambda c: F.lower(clean(c)))
    place = lambda hint: F.nullif(F.array_position(keys, hint), F.lit(0)).cast("int") - 1
    at = {k: F.least(*map(place, v)) for k, v in HINTS.items()}  # the first column that has any of the hints
    heads = lines.filter("line_no = 0").select("page_id", *(c.alias(k) for k, c in at.items()))
    return heads.filter("practice_area IS NOT NULL OR filename IS NOT NULL")


def vocabulary(export_areas: DataFrame, listing: DataFrame) -> DataFrame:
    """known: every area and file name that the exports know, normalised. export_areas: area;
    listing: grp, area, tbl, filename, rows without a document included."""
    full = export_areas.select(normalise(F.col("area")).alias("known"))
    bare = full.filter(F.contains("known", F.lit(" > "))).select(F.element_at(F.split("known", " > ", 2), 2).alias("known"))
    named = listing.select(portal_area(F.col("grp"), F.col("area"), F.col("tbl")).alias("whole"))
    spelled = with_variants(named, "whole", "forms").select(F.explode("forms").alias("known"))
    files = listing.select(normalise(F.col("filename")).alias("known"))
    whole = full.unionByName(bare).unionByName(spelled).unionByName(files)
    return whole.filter("known <> ''").distinct()


def recognised(values: DataFrame, vocabulary: DataFrame, value: str) -> DataFrame:
    """values with recognised: the vocabulary has the value, or what follows its first level."""
    text = normalise(F.col(value))
    forms = F.when(text == "", F.array().cast("array<string>")).when(F.contains(text, F.lit(" > ")), F.array(text, F.element_at(F.split(text, " > ", 2), 2))).otherwise(F.array(text))
    each = values.select(value).distinct().select(value, F.explode(forms).alias("known")).join(vocabulary, "known", "left_semi").select(F.col(value).alias("_value")).distinct()
    both = values.join(each, F.col(value) == F.col("_value"), "left")
    return both.withColumn("recognised", F.col("_value").isNotNull()).drop("_value")


def column_scores(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """page_id, col_no, n (values), score (values that vocabulary, column known, has)."""
    cells = recognised(lines.select("page_id", F.posexplode("cols").alias("col_no", "value")), vocabulary, "value")
    return cells.groupBy("page_id", "col_no").agg(F.count_if(F.col("value") != "").alias("n"), F.count_if("recognised").alias("score"))


def suggested_column(scores: DataFrame, named: DataFrame) -> DataFrame:
    """page_id, col_no: the named column if any of its values is known, else the column
    with most known values, the first on a tie."""
    best = scores.groupBy("page_id").agg(F.max(F.struct("score", (-F.col("col_no")).alias("before"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("col_no", "score"))).alias("by"))
    wanted = best.join(named, "page_id", "left").withColumn("wanted", F.coalesce("practice_area", "filename"))
    heard = F.coalesce(F.try_element_at("by", F.col("wanted")), F.lit(0))
    choice = F.when(F.col("wanted").isNotNull() & ((heard > 0) | (F.col("b.score") == 0)), F.col("wanted")).when(F.col("b.score") > 0, -F.col("b.before")).otherwise(0)
    return wanted.select("page_id", choice.cast("int").alias("col_no"))


def order_map(lines: DataFrame, filename: Column, firm: Column, region: Column, group: Column, area: Column) -> DataFrame:
    """page_id, key, position: the first line on which each key stands."""
    keys = lines.select("page_id", "line_no", F.explode(order_keys(filename, firm, region, group, area)).alias("key"))
    return keys.groupBy("page_id", "key").agg(F.min("line_no").alias("position"))


def positions(rows: DataFrame, index: DataFrame, row_id: str, filename: Column, firm: Column, region: Column, group: Column, area: Column) -> DataFrame:
    """page_id, row_id, position: where on the page a row stands, by the first of its keys that
    the page has at all; not the line that comes first. Rows (with a page_id) that the page
    does not mention are left out. index: as order_map gives it.

    The keys that all rows of a region or area share are looked up once for each page, region,
    group and area (written: few as a rule, so joined back by a broadcast); only keys of a
    row's own file or firm are dealt to tasks."""
    named = {"_file": filename, "_firm": firm, "_region": region, "_group": group, "_area": area}
    parts = rows.select("page_id", row_id, *(F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in named.items()))
    place = ["page_id", "_region", "_group", "_area"]
    first = lambda df, keys, by: df.select(*by, F.posexplode(keys).alias("turn", "key")).join(index, ["page_id", "key"]).groupBy(*by).agg(F.min_by("position", "turn").alias("position"))
    each = parts.select(*place).distinct().withColumn("forms", order_forms(F.col("_group"), F.col("_area")))
    shared = first(each, shared_order_keys(F.col("_region"), F.col("forms")), place)
    known = settled(each.join(shared, place, "left").withColumnRenamed("position", "shared"))
    whole = parts.join(known, place)
    own = whole.select("page_id", row_id, F.posexplode(own_order_keys(F.col("_file"), F.col("_firm"), F.col("_region"), F.col("forms"))).alias("turn", "key"))
    found = own.join(index, ["page_id", "key"]).select("page_id", row_id, "turn", "position")
    # a shared key comes after all of a row's own
    last = whole.filter("shared IS NOT NULL").select("page_id", row_id, F.lit(2**31 - 1).alias("turn"), F.col("shared").alias("position"))
    return found.unionByName(last).groupBy("page_id", row_id).agg(F.min_by("position", "turn").alias("position"))


def rollup(lines: DataFrame) -> DataFrame:
    """One row a page from page_id, status, has_document, is_elite, superseded, repeat_of,
    placed, first_candidate: the counts that must add up."""
    expected = F.col("has_document") & ~F.col("is_elite") & ~F.col("superseded")
    repeat = F.col("repeat_of").isNotNull()
    count = lambda c: F.count_if(c)
    status = lambda *s: count(F.col("status").isin(*s))
    pages = lines.groupBy("page_id").agg(
        F.count("*").alias("page_size"),
        count(expected).alias("expected"),
        status("elite").alias("elite"),
        status("no document").alias("without_document"),
        status("missing").alias("missing"),
        status("not reached").alias("not_reached"),
        count(F.col("placed") & F.col("status").isin("uploaded", "older version")).alias("accounted"),
        F.count_distinct(F.when(expected & ~repeat & (F.col("first_candidate") != ""), F.lower("first_candidate"))).alias("named"),
        count(expected & repeat).alias("repeats"),
        status("check page").alias("unclear"),
        status("could not read").alias("unreadable"),
        status("unrecognised").alias("unrecognised"),
        F.count_distinct(F.when(F.col("status").isin("missing", "not reached"), F.col("first_candidate"))).alias("not_downloaded"),
    )
    whole = pages.withColumn("distinct_documents", F.col("named") + F.col("repeats")).drop("named")
    return whole.withColumns({"shared_rows": F.col("expected") - F.col("distinct_documents"), "accounted_for": (F.col("missing") + F.col("not_reached") + F.col("unreadable") + F.col("unclear")) == 0})


def folder_check(listed: DataFrame, on_disk: DataFrame, name: str = "name") -> DataFrame:
    """name, side: listed but not on disk ("missing"), on disk but not listed ("extra");
    names are compared without case."""
    key = lambda df: df.select(name, F.lower(name).alias("_key"))
    a, b = key(listed), key(on_disk)
    missing = a.join(b, "_key", "left_anti").select(name, F.lit("missing").alias("side"))
    return missing.unionByName(b.join(a, "_key", "left_anti").select(name, F.lit("extra").alias("side"))).distinct()
