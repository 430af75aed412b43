"""The result workbook: recount, changes and issues, one workbook a batch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerline.functions.labels import differs
from ledgerline.operators.present import display_value, fill
from ledgerline.sources.ooxml import write_workbook

UNKNOWN = "double-check manually"
#: What a sheet says where it has no rows.
SHEETS = {"Recount": "No documents.", "Changes": "No differences found.", "Issues": "No issues reported."}
CELLS = "array<struct<value: string, number: boolean, fill: string, comment: string>>"


def recount_cells(metrics: DataFrame) -> DataFrame:
    """metrics (…, metric, final, exported, needs_check, checked, and possibly counted and
    notes) with shown, unverified, fill and comment."""
    shown, unverified = display_value(F.col("final"), F.col("exported"), F.col("checked"))
    attention = F.col("needs_check") & ~F.coalesce("checked", F.lit(False))
    changed = differs(F.col("final"), F.col("exported"))
    notes = F.col("notes") if "notes" in metrics.columns else F.array().cast("array<string>")
    counted = F.col("counted") if "counted" in metrics.columns else F.col("final")
    decided = F.when(F.col("final").eqNullSafe(counted), "the recount").otherwise("hand")
    heading = (
        F.when(unverified, "Not counted from the document; this is the export's own figure, unverified.")
        .when(attention, "Counted, but worth checking.")
        .when(changed, F.concat(F.lit("The export says "), F.col("exported").cast("string"), F.lit(", decided by "), decided, F.lit(".")))
    )
    comment = F.when(unverified | attention, F.array_join(F.concat(F.array(heading), F.coalesce(notes, F.array().cast("array<string>"))), "\n")).otherwise(heading)
    return metrics.withColumns({"shown": F.coalesce(shown.cast("string"), F.lit(UNKNOWN)), "unverified": unverified, "fill": fill(unverified, attention, changed), "comment": comment})


def issue_rows(rows: DataFrame, issues: Column, notes: Column, *columns: str) -> DataFrame:
    """columns, issue: one row an issue, then one a note (label, text) as "label: text"."""
    said = F.concat(issues, F.transform(notes, lambda n: F.concat_ws(": ", n["label"], n["text"])))
    return rows.select(*columns, F.posexplode(said).alias("place", "issue"))


def result_workbooks(recount: DataFrame, changes: DataFrame, issues: DataFrame, key: str, order: str, marks: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """key, content: a workbook of three sheets for each value of key, a column of all three
    tables, with rows by order (a numeric column of all three). marks: column of recount ->
    the columns of its fill and comment. Built in tasks; a task holds one workbook."""
    sheets = [(recount, marks or {}), (changes, {}), (issues, {})]
    tables, headers = [], []
    for number, (df, own) in enumerate(sheets):
        hidden = {key, order, *(c for pair in own.values() for c in pair if c)}
        columns = [c for c in df.columns if c not in hidden]
        none = F.lit(None).cast("string")
        cells = []
        for name in columns:
            shade, comment = own.get(name, (None, None))
            is_number = isinstance(df.schema[name].dataType, NumericType)
            cells.append(F.struct(F.col(name).cast("string").alias("value"), F.lit(is_number).alias("number"), (F.col(shade) if shade else none).alias("fill"), (F.col(comment) if comment else none).alias("comment")))
        body = F.array(*cells).cast(CELLS) if cells else F.array().cast(CELLS)
        tables.append(df.select(F.col(key).cast("string").alias("key"), F.lit(number).alias("sheet"), F.col(order).cast("double").alias("place"), body.alias("cells")))
        headers.append(columns)

    def value_of(cell: dict) -> object:
        if not cell["number"] or cell["value"] is None:
            return cell["value"]
        number = float(cell["value"])
        return int(number) if number.is_integer() else number

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in parts for row in zip(*(part.column(c).to_pylist() for c in ("key", "sheet", "cells")), strict=True))
        for name, group in groupby(rows, lambda r: r[0]):
            book: list[list] = [[], [], []]
            for _, number, cells in group:
                book[number].append([(value_of(c), c["fill"] or "", c["comment"]) for c in cells])
            whole = {title: [[(c, "") for c in headers[n]], *(book[n] or [[(empty, "")]])] for n, (title, empty) in enumerate(SHEETS.items())}
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_workbook(whole)], pa.binary())], ["key", "content"])

    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    dealt = every.repartition("key").sortWithinPartitions("key", "sheet", "place")
    return dealt.select("key", "sheet", "cells").mapInArrow(build, "key string, content binary")


def result_workbook(recount: DataFrame, changes: DataFrame, issues: DataFrame, fills: dict[str, str] | None = None) -> bytes:
    """One workbook of all rows, for a batch by itself. fills: value column -> column that holds its fill."""
    keyed = [df.withColumns({"_key": F.lit("all"), "_order": F.monotonically_increasing_id()}) for df in (recount, changes, issues)]
    found = result_workbooks(*keyed, "_key", "_order", {c: (f, None) for c, f in (fills or {}).items()}).first()
    if found is not None:
        return bytes(found["content"])
    columns = [[c for c in df.columns if c not in (fills or {}).values()] for df in (recount, changes, issues)]
    return write_workbook({t: [[(c, "") for c in own], [(empty, "")]] for (t, empty), own in zip(SHEETS.items(), columns, strict=True)})
