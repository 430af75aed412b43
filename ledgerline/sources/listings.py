"""Portal listings and earlier results from spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import clean, created_at, uri_to_filename
from ledgerline.operators.matching import latest

#: Headers of a portal listing, and the link column's name.
FIELDS = {
    "portal_id": "ID", "firm": "Firm", "firm_ref": "Firm Ref", "region": "Region", "grp": "Practice Group Name", "area": "Practice Area Name",
    "tbl": "Table Name", "grp_id": "Practice Group ID", "area_id": "Practice Area ID", "created": "Created At", "person": "Person Name", "submission_type": "Submission Type",
}
LINK = "File URI"
#: How far the link column is looked for where no header names it.
SNIFF_ROWS, SNIFF_COLUMNS = 60, 64


def _target() -> Column:
    """A cell's hyperlink says more than its text."""
    return F.coalesce(F.nullif("link", F.lit("")), F.col("value"))


def link_column(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, col_no: the column headed as the link, else the one with most .docx
    among the first rows, the first on a tie."""
    named = F.min(F.when((F.col("row_no") == 1) & (F.lower(clean(F.col("value"))) == LINK.lower()), F.col("col_no")))
    heads = cells.groupBy("doc_id", "sheet").agg(named.alias("named"))
    near = cells.filter((F.col("row_no") <= SNIFF_ROWS) & (F.col("col_no") <= SNIFF_COLUMNS))
    scores = near.groupBy("doc_id", "sheet", "col_no").agg(F.count_if(F.contains(F.lower(_target()), F.lit(".docx"))).alias("score")).filter("score > 0")
    best = scores.groupBy("doc_id", "sheet").agg(F.max(F.struct("score", (-F.col("col_no")).alias("before"))).alias("b"))
    return heads.join(best, ["doc_id", "sheet"], "left").select("doc_id", "sheet", F.coalesce("named", -F.col("b.before")).alias("col_no"), F.col("named").isNotNull().alias("has_header")).filter("col_no IS NOT NULL")


def portal_rows(cells: DataFrame) -> DataFrame:
    """One row a listed submission: FIELDS, uri, filename, created_at, has_document. The
    first row is a header; rows whose link is no Word document are dropped, rows without a
    link are kept."""
    names = {v.lower(): k for k, v in FIELDS.items()}
    heads = cells.filter("row_no = 1").select("doc_id", "sheet", "col_no", F.lower(clean(F.col("value"))).alias("head"))
    fields = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    heads = heads.withColumn("field", F.try_element_at(fields, F.col("head"))).filter("field IS NOT NULL").drop("head")
    links = link_column(cells).select("doc_id", "sheet", "col_no", F.lit("uri").alias("field"))
    named = cells.filter("row_no > 1").withColumn("said", _target()).join(heads.unionByName(links), ["doc_id", "sheet", "col_no"])
    wide = named.groupBy("doc_id", "sheet", "row_no").agg(*(F.max(F.when(F.col("field") == f, F.col("said") if f == "uri" else F.col("value"))).alias(f) for f in [*FIELDS, "uri"]))
    whole = wide.withColumns({"filename": uri_to_filename(F.col("uri")), "created_at": created_at(F.col("created")), "has_document": F.coalesce(clean(F.col("uri")) != "", F.lit(False))})
    return whole.filter(~F.col("has_document") | F.endswith(F.lower("filename"), F.lit(".docx")))


def newest_per_file(listing: DataFrame) -> DataFrame:
    """The latest row of each file name; of equally new ones the first."""
    named = listing.filter("has_document").withColumn("_key", F.lower("filename"))
    return latest(named, ["_key"], F.col("created_at"), ["sheet", "row_no"]).drop("_key")


def earlier_results(cells: DataFrame) -> DataFrame:
    """name, column, value, shade of an earlier result workbook; the last row of a name wins."""
    heads = cells.filter("row_no = 1").select("doc_id", "sheet", "col_no", F.col("value").alias("column"))
    keys = heads.filter(F.upper("column") == "FILE NAME").select("doc_id", "sheet", F.col("col_no").alias("key_no"))
    rows = cells.filter("row_no > 1").join(keys, ["doc_id", "sheet"])
    names = rows.filter("col_no = key_no").select("doc_id", "sheet", "row_no", F.col("value").alias("name"))
    last = names.groupBy("doc_id", "name").agg(F.max_by(F.struct("sheet", "row_no"), "row_no").alias("r")).select("doc_id", "name", "r.*")
    shade = F.when(F.upper("fill") == "C6EFCE", "green").when(F.upper("fill") == "FFE699", "amber").otherwise("")
    return cells.join(last, ["doc_id", "sheet", "row_no"]).join(heads, ["doc_id", "sheet", "col_no"]).select("doc_id", "name", "column", "value", shade.alias("shade"))
