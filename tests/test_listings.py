"""Listings, earlier results and edits."""

from ledgerline.operators import edits
from ledgerline.sources import listings, readers
from ledgerline.sources.ooxml import write_workbook


def cells_of(spark, **sheets):
    book = write_workbook({k: [[(v, "") if not isinstance(v, tuple) else v for v in r] for r in rows] for k, rows in sheets.items()})
    return readers.decode_workbooks(spark.createDataFrame([("f.xlsx", bytearray(book))], "doc_id string, content binary"))


def test_portal_listing(spark):
    head = ["ID", "Firm", "Region", "Practice Area Name", "Created At", "File URI"]
    rows = [["1", "A", "UK", "Tax", "2026-01-15 00:00:00", "h/a%20b.docx?x"], ["2", "A", "UK", "Tax", "20/04/2026", "h/A B.docx"], ["3", "A", "UK", "VAT", "", ""], ["4", "A", "UK", "X", "", "h/c.pdf"]]
    found = listings.portal_rows(cells_of(spark, L=[head, *rows]))
    assert sorted((r["portal_id"], r["filename"], r["has_document"]) for r in found.collect()) == [("1", "a b.docx", True), ("2", "A B.docx", True), ("3", "", False)]
    assert [r["portal_id"] for r in listings.newest_per_file(found).collect()] == ["2"]


def test_link_column_by_content(spark):
    cells = cells_of(spark, L=[["x", "y", "z"], ["1.docx", "h/2.docx", ""], ["", "h/3.docx", ""]])
    assert [(r["col_no"], r["has_header"]) for r in listings.link_column(cells).collect()] == [(2, False)]


def test_earlier_results(spark):
    cells = cells_of(spark, Recount=[["FILE NAME", "MATTERS"], ["a.docx", (3, "green")], ["a.docx", (4, "amber")]])
    got = {(r["name"], r["column"]): (r["value"], r["shade"]) for r in listings.earlier_results(cells).collect()}
    assert got["a.docx", "MATTERS"] == ("4", "amber")


def test_edits(spark):
    old = spark.createDataFrame([("a", "m", 9), ("b", "m", 8), ("c", "m", 7)], "name string, metric string, value int")
    shown = spark.createDataFrame([("a", "m", 9, 5), ("b", "m", 8, 6), ("d", "m", 4, 4), ("e", "m", 3, 3)], "name string, metric string, value int, recount int")
    typed = spark.createDataFrame([("a", "m", 5), ("b", "m", 8), ("d", "m", None), ("e", "m", 2)], "name string, metric string, value int")
    got = {r["name"]: r["value"] for r in edits.apply_edits(old, shown, typed).collect()}
    assert got == {"b": 8, "c": 7, "d": None, "e": 2}


def test_ticks_and_ledger(spark):
    ticks = spark.createDataFrame([("A.docx", True), ("b.docx", False)], "name string, ticked boolean")
    assert [r["name"] for r in edits.replace_ticks(ticks).collect()] == ["a.docx"]
    assert {tuple(r) for r in edits.ledger(files=ticks, none=ticks.limit(0)).collect()} == {("files", 2), ("none", 0)}
    assert edits.duplicate_keys(ticks.unionByName(ticks), ["name"]).count() == 2


def test_review_rows(spark):
    """Unknown figures, flagged ones and those that differ; what was entered holds, also null."""
    rows = [("A", "m", 1, None, False), ("A", "n", 2, 2, True), ("b", "m", 5, 7, False), ("b", "n", 2, 2, False), ("c", "m", 5, 7, False), ("c", "n", 5, 7, False), ("d", "m", None, 4, False)]
    df = spark.createDataFrame(rows, "name string, metric string, exported int, counted int, needs_check boolean")
    log = spark.createDataFrame([("C", "m", 9, 1, False), ("c", "m", 5, 2, False), ("c", "n", None, 1, False), ("b", "m", 5, 1, False), ("B", "m", None, 2, True), ("b", "n", 3, 1, False)], "name string, metric string, value int, at int, removed boolean")
    now = edits.latest_overrides(log)
    assert sorted(tuple(r) for r in now.collect()) == [("b", "n", 3), ("c", "m", 5), ("c", "n", None)]
    got = sorted(tuple(r) for r in edits.review_rows(df, now).collect())
    assert got == [("A", "m", 1, None, None, "count by hand"), ("A", "n", 2, 2, 2, "check the count"), ("b", "m", 5, 7, 7, "differs from the export"), ("b", "n", 2, 2, 3, "differs from the export")]
    assert edits.review_rows(df, now, everything=True).count() == len(rows)


def test_chains(spark):
    counts = spark.createDataFrame([("a", 10, 2, 0, 8, 3, 5), ("b", 4, 1, 1, 3, 0, 3), ("c", 0, None, 0, 0, 0, 0)], "k string, start int, x int, y int, mid int, z int, last int")
    lines = [("all", "start", "start"), ("x", "x", "minus"), ("y", "y", "minus"), ("middle", "mid", "total"), ("z", "z", "minus"), ("end", "last", "total")]
    got = sorted(tuple(r) for r in edits.chain(counts, ["k"], "test", lines).collect())
    assert got == [
        ("a", "test", 1, "all", 10, None), ("a", "test", 2, "x", -2, None), ("a", "test", 4, "middle", 8, True), ("a", "test", 5, "z", -3, None), ("a", "test", 6, "end", 5, True),
        ("b", "test", 1, "all", 4, None), ("b", "test", 2, "x", -1, None), ("b", "test", 3, "y", -1, None), ("b", "test", 4, "middle", 3, False), ("b", "test", 6, "end", 3, True),
        ("c", "test", 1, "all", 0, None), ("c", "test", 4, "middle", 0, True), ("c", "test", 6, "end", 0, True),
    ]
