"""Spark sources: Word documents and spreadsheets as DataFrames of blocks, rows and cells.

Files are read by Spark's binaryFile source, so any store that Spark reads will do, and
each task decodes its own files. A file that cannot be decoded becomes a row with error."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.labels import is_elite_area
from ledgerline.functions.text import area_variants, clean, normalise, to_int
from ledgerline.sources.ooxml import PARTS, read_csv, read_document, read_workbook

DOCUMENT = (
    "blocks array<struct<block_no: int, kind: string, text: string, tbl_no: int>>, "
    "rows array<struct<tbl_no: int, row_no: int, cells: array<string>, fill: string>>, "
    "controls array<struct<sdt_no: int, alias: string, text: string>>, notes array<string>, error string"
)
CELLS = "array<struct<sheet_no: int, sheet: string, row_no: int, col_no: int, value: string, link: string, fill: string>>"


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """doc_id (file name), content; lock files of open documents are left out, and
    so are files without a byte, which Spark's source skips."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)  # path is the file's own, not encoded
    return found.select(name.alias("doc_id"), "content").filter(~F.startswith("doc_id", F.lit("~$")))


_BLOCK = pa.struct([("block_no", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("tbl_no", pa.int32())])
_ROW = pa.struct([("tbl_no", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("fill", pa.string())])
_CONTROL = pa.struct([("sdt_no", pa.int32()), ("alias", pa.string()), ("text", pa.string())])
_CELL = pa.struct([("sheet_no", pa.int32()), ("sheet", pa.string()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("value", pa.string()), ("link", pa.string()), ("fill", pa.string())])
#: Arrow types of the columns of DOCUMENT, and of decoded spreadsheets.
DOCUMENT_TYPES = {"blocks": pa.list_(_BLOCK), "rows": pa.list_(_ROW), "controls": pa.list_(_CONTROL), "notes": pa.list_(pa.string()), "error": pa.string()}
TABLE_TYPES = {"cells": pa.list_(_CELL), "error": pa.string()}


def document_columns(contents: list[bytes], wanted: list[str]) -> dict[str, pa.Array]:
    """The wanted columns of DOCUMENT for each package; parts not wanted are not decoded."""
    found = [read_document(c, frozenset(wanted) & PARTS) for c in contents]
    return {k: pa.array([f[k] for f in found], t) for k, t in DOCUMENT_TYPES.items() if k in wanted}


def table_columns(contents: list[bytes], sheets: frozenset[str] | None = None) -> dict[str, pa.Array]:
    """cells and error of each spreadsheet; with sheets, of sheets of these names in workbooks."""

    def one(content: bytes) -> tuple[list[dict], str | None]:
        try:
            return (read_workbook(content, sheets) if content.startswith(b"PK") else read_csv(content)), None
        except Exception as problem:  # a file that cannot be read is a result, not a failure
            return [], f"{type(problem).__name__}: {problem}"

    found = [one(c) for c in contents]
    return {k: pa.array([f[n] for f in found], t) for n, (k, t) in enumerate(TABLE_TYPES.items())}


def decode_documents(packages: DataFrame) -> DataFrame:
    """doc_id and what read_document finds in content."""

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = document_columns([c.as_py() or b"" for c in part.column("content")], list(DOCUMENT_TYPES))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found.values()], ["doc_id", *found])

    return packages.select("doc_id", "content").mapInArrow(decode, f"doc_id string, {DOCUMENT}")


def blocks(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.inline("blocks"))


def rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.inline("rows"))


def controls(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.inline("controls"))


def decode_tables(packages: DataFrame) -> DataFrame:
    """doc_id, cells, error of spreadsheets: workbooks by their first bytes, anything else is
    read as comma-separated text. A file that cannot be decoded has no cells and an error."""

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = table_columns([c.as_py() or b"" for c in part.column("content")])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found.values()], ["doc_id", *found])

    return packages.select("doc_id", "content").mapInArrow(decode, f"doc_id string, cells {CELLS}, error string")


def decode_workbooks(packages: DataFrame) -> DataFrame:
    """doc_id, sheet_no, sheet, row_no, col_no, value, link, fill: one row a cell."""
    return decode_tables(packages).select("doc_id", F.inline("cells"))


#: Headers under which the automated counts export names its fields, those
#: tried first standing first.
COUNT_FIELDS = {
    "match_status": ("match_status", "matched?", "matched", "match status"),
    "firm": ("firm_name", "firm name", "firm"),
    "firm_ref": ("firm_ref", "firm ref", "firm reference"),
    "region": ("country_name", "country", "region"),
    "area": ("concatenated_practice_area_name", "practice area", "practice area name", "submission_practice_area_name"),
    "num_matters": ("num_matters", "# matters", "matters"),
    "num_active_clients": ("num_active_clients", "# active clients", "active clients"),
    "num_new_clients": ("num_new_clients", "# new clients", "new clients"),
    "num_lead_partners": ("num_lead_partners", "# l.partners", "# lead partners", "lead partners"),
    "num_next_gen": ("num_next_gen", "# next gens", "# next gen", "next gens", "next gen"),
    "num_associates": ("num_associates", "# associates", "associates"),
}
COUNTS = [f for f in COUNT_FIELDS if f.startswith("num_")]
NEEDED = ("firm", "firm_ref", "region", "area")


def count_columns(cells: DataFrame) -> DataFrame:
    """doc_id, sheet_no, at (a struct of column numbers, from 1, null where a field is
    missing), last_row, notes: the first sheet of each workbook that names firm, reference,
    region and area. Only if none of the counts is named and there are six columns or more,
    the last six are taken for them. A workbook without such a sheet has a null sheet_no."""
    heads = cells.groupBy("doc_id", "sheet_no").agg(
        F.max("col_no").alias("width"),
        F.max("row_no").alias("last_row"),
        F.map_from_entries(F.collect_list(F.when(F.col("row_no") == 1, F.struct("col_no", F.lower(clean(F.col("value"))).alias("head"))))).alias("named"),
    )
    keys = heads.withColumn("keys", F.transform(F.sequence(F.lit(1), "width"), lambda k: F.coalesce(F.try_element_at("named", k), F.lit(""))))
    place = {f: F.coalesce(*(F.nullif(F.array_position("keys", a), F.lit(0)) for a in names)).cast("int") for f, names in COUNT_FIELDS.items()}
    placed = keys.select("doc_id", "sheet_no", "last_row", "width", "keys", F.struct(*(c.alias(f) for f, c in place.items())).alias("by_name"))
    known = sum((F.col(f"by_name.{f}").isNotNull().cast("int") for f in COUNTS), F.lit(0))
    by_place = (known == 0) & (F.col("width") >= len(COUNTS))
    at = F.struct(*((F.when(by_place, F.col("width") - len(COUNTS) + 1 + COUNTS.index(f)).otherwise(F.col(f"by_name.{f}")) if f in COUNTS else F.col(f"by_name.{f}")).cast("int").alias(f) for f in COUNT_FIELDS))
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"by_name.{f}").isNull(), f) for f in COUNTS))), ", ")
    used = F.array_join(F.slice("keys", F.greatest(F.col("width") - len(COUNTS) + 1, F.lit(1)), len(COUNTS)), ", ")
    notes = F.array_compact(F.array(
        F.when(by_place, F.concat(F.lit("no count was recognised by name, so the last six columns were used: "), used)),
        F.when(~by_place & (known < len(COUNTS)), F.concat(F.lit("some counts were not recognised and nothing was assumed about their place: "), missing)),
    ))
    usable = reduce(Column.__and__, (F.col(f"by_name.{f}").isNotNull() for f in NEEDED))
    first = F.min(F.when(usable, F.struct("sheet_no", at.alias("at"), "last_row", notes.alias("notes")))).alias("s")
    found = placed.groupBy("doc_id").agg(first)
    none = F.array(F.lit("no sheet has the columns that an export of counts needs"))
    return found.select("doc_id", "s.sheet_no", "s.at", "s.last_row", F.coalesce("s.notes", none).alias("notes"))


def count_rows(cells: DataFrame) -> DataFrame:
    """The exports' rows: doc_id, row_order, firm, firm_ref, region, area and the counts.
    Rows without firm or area are dropped."""
    wanted = cells.filter("row_no > 1").join(count_columns(cells).select("doc_id", "sheet_no", "at"), ["doc_id", "sheet_no"])
    pick = lambda f: F.max(F.when(F.col("col_no") == F.col(f"at.{f}"), F.col("value"))).alias(f)
    wide = wanted.groupBy("doc_id", "row_no").agg(*(pick(f) for f in COUNT_FIELDS if f != "match_status"))
    kept = wide.filter((clean(F.col("firm")) != "") & (clean(F.col("area")) != ""))
    return kept.select("doc_id", F.col("row_no").alias("row_order"), *NEEDED, *(to_int(F.col(f)).alias(f) for f in COUNTS))


def count_notes(cells: DataFrame) -> DataFrame:
    """doc_id, note: what was assumed about columns, rows dropped (blank ones too), and keys
    of firm, region and area that several rows share."""
    columns, rows = count_columns(cells), count_rows(cells)
    said = columns.select("doc_id", F.explode("notes").alias("note"))
    kept = rows.groupBy("doc_id").agg(F.count("*").alias("kept"))
    dropped = columns.filter("sheet_no IS NOT NULL").join(kept, "doc_id", "left").select("doc_id", (F.col("last_row") - 1 - F.coalesce("kept", F.lit(0))).alias("n"))
    lost = dropped.filter("n > 0").select("doc_id", F.concat(F.col("n").cast("string"), F.lit(" rows without a firm or practice area were left out")).alias("note"))
    keys = rows.filter(~is_elite_area(F.col("area"))).select("doc_id", "row_order", normalise(F.col("firm")).alias("firm"), normalise(F.col("region")).alias("region"), F.explode(area_variants(F.col("area"))).alias("form"))
    shared = keys.groupBy("doc_id", "firm", "region", "form").agg(F.count("*").alias("n")).filter("n > 1").groupBy("doc_id").agg(F.count("*").alias("n"))
    several = shared.select("doc_id", F.concat(F.col("n").cast("string"), F.lit(" keys of firm, region and practice area stand more than once")).alias("note"))
    return said.unionByName(lost).unionByName(several)


def is_package(content: Column) -> Column:
    """Zip packages begin with PK; anything else is read as text."""
    return F.substring(content, 1, 2) == F.lit(b"PK")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """A portal listing in CSV with a header; a byte order mark before it is dropped."""
    table = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return table.toDF(*(c.lstrip("\ufeff").strip() for c in table.columns))


def folders_of(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    """folder, documents: the folders, up to depth levels down, that hold Word documents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path")
    inside = F.regexp_replace("path", "/[^/]*$", "")
    root = F.lit(path.rstrip("/"))
    below = F.size(F.split(F.substring(inside, F.length(root) + F.instr(inside, path.rstrip("/")), F.length(inside)), "/")) - 1
    named = found.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select(inside.alias("folder"), below.alias("below"))
    return named.filter(F.col("below") <= depth).groupBy("folder").agg(F.count("*").alias("documents"))


def pick_folder(folders: DataFrame, firm: str) -> DataFrame:
    """The folders that name the firm, spaces and case aside: by the folder's own name, or
    else by its path."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    wanted = plain(F.lit(firm))
    marked = folders.withColumns({"own": F.contains(plain(F.element_at(F.split("folder", "/"), -1)), wanted), "any": F.contains(plain(F.col("folder")), wanted)})
    own = marked.filter("own")
    return (marked.filter("any") if own.isEmpty() else own).select("folder", "documents")


def exports_naming(tables: DataFrame, firm: str) -> DataFrame:
    """doc_id of decoded spreadsheets (doc_id, cells) that mention the firm: the candidates
    among files that lie near the documents."""
    return tables.filter(F.exists("cells", lambda c: F.contains(F.lower(clean(c["value"])), F.lower(clean(F.lit(firm)))))).select("doc_id")
