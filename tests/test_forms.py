"""Headers, the alternate form, pasted pages, sinks and the drop folder."""

import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from ledgerline.operators import alternate, headers, page
from ledgerline.sources import readers, sinks
from ledgerline.sources.ooxml import read_workbook
from ledgerline.streaming.drop_folder import arriving_documents
from tests.docx_files import control, p, package, tbl

LAWYERS = tbl(("B9 Information regarding ranked and unranked lawyers",), ("Name", "Comments", "Partner Y/N"), ("A", "", "Y"), ("B", "", "n"), ("C", "", "(y)"), ("", "", "Y"), ("D", "", "?"))
CLIENTS = tbl(("D0 List of publishable clients",), ("", "Name of client", "New client Y/N"), ("1", "X", "Y"), ("2", "Y", "No"), ("3", "N/A", ""), ("4", "Z", "")) + tbl(("E0 Confidential clients",), ("", "Name of client", "New client"), ("1", "Q", "new"))
FIRM = p("Firm Name") + tbl(("Smith  LLP",))


def decoded(spark, **bodies):
    packages = spark.createDataFrame([(k, bytearray(package(v))) for k, v in bodies.items()], "doc_id string, content binary")
    return readers.decode_documents(packages).cache()


def test_headers(spark):
    docs = decoded(
        spark,
        three=FIRM + control(p("UK - Tax - VAT"), "Select Practice "),
        two=FIRM + control(p("Brazil - Tax"), "Select Practice"),
        free=control(p("a - b - c"), "other") + p("Firm name") + p("x"),
        typed=FIRM + p("OR If you have an earlier version of Word, type in this box: ► Employment"),
        below=p("type in this box: ►") + p("Practice area") + p("Pensions"),
        none=p("nothing"),
    )
    found = headers.headers(docs, readers.blocks(docs), readers.rows(docs), readers.controls(docs))
    got = {r["doc_id"]: (r["firm"], r["region"], r["grp"], r["area"], len(r["warnings"]), r["check_area"]) for r in found.collect()}
    assert got == {
        "three": ("Smith LLP", "UK", "Tax", "VAT", 0, False),
        "two": ("Smith LLP", "Brazil", None, "Tax", 0, False),
        "free": (None, "a", "b", "c", 0, True),
        "typed": ("Smith LLP", None, None, "Employment", 1, False),
        "below": (None, None, None, "Pensions", 1, False),
        "none": (None, None, None, None, 1, False),
    }


def test_alternate_form(spark):
    docs = decoded(spark, a=LAWYERS + CLIENTS, b=p("upload at myaccount.chambers.com"), c=p("ours"), d=tbl(("D0 clients",), ("", "Name of client", "New client"), ("1", "X", "maybe")))
    rows = readers.rows(docs)
    assert {r[0] for r in alternate.is_alternate(rows, readers.blocks(docs)).collect()} == {"a", "b", "d"}
    assert [tuple(r) for r in alternate.count_lawyers(rows).collect()] == [("a", 2, 1, 1)]
    assert sorted(tuple(r) for r in alternate.count_clients(rows).collect()) == [("a", 4, 2), ("d", 1, None)]


def test_pasted_page(spark):
    pastes = spark.createDataFrame([(1, "No\tPractice area\tFirm\r\n1\tTax > VAT\tA\r\n\r\n2\tPensions\r\n"), (2, "Tax > VAT\nfirm"), (3, " \n")], "page_id int, pasted string")
    lines = page.read_page(pastes).cache()
    assert [(r["page_id"], r["line_no"], r["cols"]) for r in lines.orderBy("page_id", "line_no").collect()] == [
        (1, 0, ["No", "Practice area", "Firm"]), (1, 1, ["1", "Tax > VAT", "A"]), (1, 2, ["2", "Pensions", ""]), (2, 0, ["Tax > VAT"]), (2, 1, ["firm"]),
    ]
    named = page.named_columns(lines)
    assert [(r["page_id"], r["practice_area"], r["firm"]) for r in named.collect()] == [(1, 1, 2)]
    vocabulary = spark.createDataFrame([("tax > vat",), ("pensions",)], "known string")
    scores = page.column_scores(lines, vocabulary)
    assert {(r["page_id"], r["col_no"]): r["score"] for r in scores.collect()} == {(1, 0): 0, (1, 1): 2, (1, 2): 0, (2, 0): 1}
    assert {r["page_id"]: r["col_no"] for r in page.suggested_column(scores, named).collect()} == {1: 1, 2: 0}
    none = F.lit(None).cast("string")
    keys = page.order_map(lines.filter("page_id = 1 AND line_no > 0"), none, F.get("cols", F.lit(2)), none, none, F.get("cols", F.lit(1)))
    assert {r["key"]: r["position"] for r in keys.collect()} == {"a|tax > vat": 1, "a|vat": 1, "a|pensions": 2}


def test_rollup_adds_up(spark):
    rows = [
        ("uploaded", True, False, False, None, True, "a"), ("missing", True, False, False, None, False, "b"), ("check page", True, False, False, 1, False, "a"),
        ("elite", True, True, False, None, False, "c"), ("no document", False, False, False, None, False, ""), ("older version", True, False, True, None, True, "d"), ("not reached", True, False, False, None, False, "B"),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "page_id int, status string, has_document boolean, is_elite boolean, superseded boolean, repeat_of int, placed boolean, first_candidate string")
    got = page.rollup(df).first().asDict()
    assert (got["page_size"], got["expected"], got["distinct_documents"], got["shared_rows"], got["accounted"], got["accounted_for"]) == (7, 4, 3, 1, 2, False)
    assert got["not_downloaded"] == 2


def test_folder_check(spark):
    listed, disk = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["A.docx", "b.docx"], ["a.DOCX", "c.docx"]))
    assert {tuple(r) for r in page.folder_check(listed, disk).collect()} == {("b.docx", "missing"), ("c.docx", "extra")}


def test_result_workbook(spark):
    rows = [("a.docx", "matters", 5, 4, False, False), ("a.docx", "next_gen", None, 2, False, False), ("a.docx", "associates", 1, 1, True, False), ("a.docx", "clients", 3, 3, True, True), ("a.docx", "new", None, None, False, False)]
    cells = sinks.recount_cells(spark.createDataFrame(rows, "name string, metric string, final int, exported int, needs_check boolean, checked boolean"))
    assert {r["metric"]: (r["shown"], r["fill"]) for r in cells.collect()} == {"matters": ("5", "green"), "next_gen": ("2", "amber"), "associates": ("1", "amber"), "clients": ("3", ""), "new": (sinks.UNKNOWN, "amber")}
    none = spark.createDataFrame([], "a string")
    book = sinks.result_workbook(cells.select("name", "metric", "shown", "fill"), none, none, {"shown": "fill"})
    found = {(c["sheet"], c["row_no"], c["col_no"]): c["value"] for c in read_workbook(book)}
    assert found["Changes", 2, 1] == "No differences found."
    assert found["Recount", 2, 3] == "5"


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(package(p("hello")))
    run = arriving_documents(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert [(r["doc_id"], r["error"]) for r in spark.table("arrived").collect()] == [("a.docx", None)]


def test_workbooks_of_batches(spark):
    rows = [("x", 1, "a.docx", 5, "green", "The export says 4"), ("x", 2, "b.docx", None, "amber", None), ("y", 1, "c.docx", 7, "", None)]
    cells = spark.createDataFrame(rows, "firm string, n int, name string, matters int, shade string, why string")
    changed = spark.createDataFrame([("x", 1, "a.docx", 4)], "firm string, n int, name string, exported int")
    said = spark.createDataFrame([("y", 9, "z"), ("z", 1, "only an issue")], "firm string, n int, issue string")
    books = {r["key"]: bytes(r["content"]) for r in sinks.result_workbooks(cells, changed, said, "firm", "n", {"matters": ("shade", "why")}).collect()}
    assert set(books) == {"x", "y", "z"}
    at = {k: {(c["sheet"], c["row_no"], c["col_no"]): (c["value"], c["fill"]) for c in read_workbook(b)} for k, b in books.items()}
    assert [at["x"]["Recount", r, c] for r, c in ((1, 2), (2, 2), (3, 1), (3, 2))] == [("matters", ""), ("5", "C6EFCE"), ("b.docx", ""), ("", "FFE699")]
    assert at["y"]["Changes", 2, 1] == ("No differences found.", "")
    assert at["z"]["Recount", 2, 1] == ("No documents.", "")
    assert at["z"]["Issues", 2, 1] == ("only an issue", "")
    with zipfile.ZipFile(BytesIO(books["x"])) as z:
        assert "The export says 4" in z.read("xl/comments1.xml").decode()
        assert "xl/drawings/vmlDrawing1.vml" in z.namelist()
        assert 'width="' in z.read("xl/worksheets/sheet1.xml").decode()


def test_comments_and_issue_rows(spark):
    rows = [("m", 5, 4, 5, False, ["n"]), ("u", None, 2, None, False, ["why"]), ("c", 3, 3, 3, True, ["odd"]), ("h", 6, 4, 5, False, []), ("s", 4, 4, 4, False, [])]
    df = spark.createDataFrame(rows, "metric string, final int, exported int, counted int, needs_check boolean, notes array<string>").withColumn("checked", F.lit(False))
    got = {r["metric"]: r["comment"] for r in sinks.recount_cells(df).collect()}
    assert got["m"] == "The export says 4, decided by the recount."
    assert got["h"] == "The export says 4, decided by hand."
    assert got["u"].endswith("unverified.\nwhy")
    assert got["c"] == "Counted, but worth checking.\nodd"
    assert got["s"] is None
    one = spark.createDataFrame([("a", ["i1", "i2"], [("Matters", "n")])], "name string, issues array<string>, notes array<struct<label: string, text: string>>")
    assert [r["issue"] for r in sinks.issue_rows(one, F.col("issues"), F.col("notes"), "name").orderBy("place").collect()] == ["i1", "i2", "Matters: n"]


def test_positions_deal_rows_by_their_own_keys_only(spark):
    """As a walk over all keys says; a key that a whole region or area shares is no row's own."""
    import random

    from ledgerline.functions import text

    rng = random.Random(3)
    one = lambda *c: rng.choice([None, "", *c])
    rows = [(rng.randint(1, 2), n, one(f"F{n % 40}.docx"), one("Firm A", "firm b"), one("UK", "fr"), one("G", "H > I"), one("Tax > VAT", "VAT", "x > y > z")) for n in range(300)]
    lines = [(rng.randint(1, 2), n, *(one("F1.docx", "f7.docx"), one("FIRM a"), one("uk", "FR"), one("g"), one("tax", "VAT", "y > z"))) for n in range(12)]
    df = spark.createDataFrame(rows, "page_id int, id int, file string, firm string, region string, grp string, area string")
    page_lines = spark.createDataFrame(lines, "page_id int, line_no int, file string, firm string, region string, grp string, area string")
    parts = tuple(F.col(c) for c in ("file", "firm", "region", "grp", "area"))
    index = page.order_map(page_lines, *parts)
    got = {r["id"]: (r["page_id"], r["position"]) for r in page.positions(df, index, "id", *parts).collect()}
    known = {(r["page_id"], r["key"]): r["position"] for r in index.collect()}
    keys = df.select("page_id", "id", text.order_keys(*parts).alias("keys"), text.own_order_keys(*parts[:3], text.order_forms(*parts[3:])).alias("own")).collect()
    hits = {r["id"]: (r["page_id"], [known[r["page_id"], k] for k in r["keys"] if (r["page_id"], k) in known]) for r in keys}
    assert got == {n: (p_, found[0]) for n, (p_, found) in hits.items() if found} and len(got) > 100
    assert all(k.startswith(("file|", "fra|")) for r in keys for k in r["own"]) and all(r["keys"][: len(r["own"])] == r["own"] for r in keys)
