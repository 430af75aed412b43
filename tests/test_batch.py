"""A batch from documents to changes, and pages of lines."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import batch, headers, page, present, reconcile
from ledgerline.operators.metrics import recount
from ledgerline.sources import listings, readers
from ledgerline.sources.ooxml import write_workbook
from tests.docx_files import clients, control, matter, nominee, p, package, tbl

DOCS = "doc_no long, file_name string, firm string, region string, grp string, area string, typed string, dropdown string, error string, warnings array<string>"
LIST = "portal_id string, firm string, firm_ref string, region string, grp string, area string, tbl string, submission_type string, person string, created_at timestamp_ntz, filename string, has_document boolean, sheet string, row_no int"
EXPORT = "export_id long, firm string, firm_ref string, region string, area string, num_matters int"


def day(n):
    return datetime.datetime(2026, 1, n)


def doc(n, name, area=None, region="UK", firm="Smith LLP", grp=None, **more):
    return (n, name, firm, region, grp, area, more.get("typed"), more.get("dropdown", "x"), more.get("error"), more.get("warnings", []))


def entry(n, name, area, at=1, region="UK", firm="Smith LLP", grp=None, kind=None, person=None):
    return (str(n), firm, "77", region, grp, area, None, kind, person, day(at), name, bool(name), "L", n)


@pytest.fixture(scope="module")
def results(spark):
    docs = [
        doc(1, "a.docx", "Tax"), doc(2, "a (1).docx", "Tax"), doc(3, "old.docx"), doc(4, "new.docx"), doc(5, "unlisted.docx", "Pensions", warnings=["w"]), doc(6, "elite.docx"),
        doc(7, "broken.docx", error="ValueError: x"), doc(8, "none.docx", None), doc(9, "City.docx"), doc(10, "x_77_submission_Ann_EC12.docx", "Tax"), doc(11, "far.docx", "Energy"),
        doc(12, "spelt.docx", "Tax", firm="Smith Ltd"), doc(13, "retry.docx", "Dispute resolution: Litigation"), doc(14, "twice.docx", "VAT"), doc(15, "law1.docx"), doc(16, "law2.docx"), doc(17, "tie1.docx"), doc(18, "tie2.docx"),
        doc(19, "typed.docx", typed="Elsewhere", dropdown=None),
    ]
    listed = [
        entry(1, "A.docx", "Tax"), entry(2, "old.docx", "Banking", 2), entry(3, "new.docx", "Banking", 5), entry(4, "elite.docx", "Tax", grp="Rio Elite"), entry(5, "broken.docx", "Tax"), entry(6, "City.docx", "Tax", grp="City focus"),
        entry(7, "y_77_submission_Bob_EC12.docx", "Lawyers"), entry(8, "retry.docx", "Dispute resolution"), entry(9, "law1.docx", "Lawyers", kind="Lawyer", person="Ann"), entry(10, "law2.docx", "Lawyers", kind="lawyer", person="Bo"),
        entry(11, "tie1.docx", "Shipping", 3), entry(12, "tie2.docx", "Shipping", 3), entry(13, "typed.docx", "Mining"), entry(14, None, "Empty"),
    ]
    export = [
        (1, "SMITH LLP", "r1", "uk", "Tax", 5), (2, "Smith LLP", "r1", "UK", "City focus > Tax", 4), (3, "Smith LLP", "r1", "UK", "Banking", 3), (4, "Smith LLP", "r5", "UK", "Employment > Pensions", 2), (5, "Smith LLP", "r1", "FR", "Energy", 1),
        (6, "Smith LLP", "r1", "UK", "Dispute resolution: Litigation", 1), (7, "Smith LLP", "r1", "UK", "VAT", 1), (8, "Smith LLP", "r1", "UK", "VAT", 2), (9, "Smith LLP", "r1", "UK", "Lawyers", 2), (10, "Smith LLP", "r1", "UK", "Shipping", 2), (11, "Smith LLP", "r1", "UK", "Mining", 2),
        (12, "Smith LLP", "r1", "UK", "Rio Elite > Tax", 9),
    ]
    found = batch.batch(spark.createDataFrame(docs, DOCS), spark.createDataFrame(listed, LIST), spark.createDataFrame(export, EXPORT)).cache()
    return spark, found, {r["doc_no"]: r for r in found.collect()}, spark.createDataFrame(export, EXPORT)


def test_statuses(results):
    rows = results[2]
    assert len(rows) == 19
    assert {n: r["status"] for n, r in rows.items()} == {
        1: "matched", 2: "duplicate", 3: "superseded", 4: "matched", 5: "matched", 6: "elite", 7: "parse_error", 8: "unmatched", 9: "matched", 10: "matched", 11: "unmatched",
        12: "unmatched", 13: "matched", 14: "ambiguous", 15: "matched", 16: "matched", 17: "matched", 18: "superseded", 19: "matched",
    }
    assert {n: r["export_id"] for n, r in rows.items() if r["export_id"]} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 4, 9: 2, 10: 9, 13: 6, 15: 9, 16: 9, 17: 10, 18: 10, 19: 11}
    assert {n for n, r in rows.items() if r["undecided"]} == {17}
    assert {n for n, r in rows.items() if r["by_code"]} == {10}


def test_names_and_references(results):
    rows = results[2]
    assert (rows[1]["filename"], rows[2]["filename"], rows[10]["filename"]) == ("A.docx", "A.docx", "x_77_submission_Ann_EC12.docx")
    assert (rows[1]["firm_ref"], rows[5]["firm_ref"]) == ("77", "r5")
    assert rows[9]["area"] == "City focus > Tax"


def test_issues_say_why(results):
    said = {n: "; ".join(r["issues"]) for n, r in results[2].items()}
    assert "copy 1 of a.docx" in said[2]
    assert "this one is dated 2026-01-02" in said[3]
    assert said[5].endswith("w")
    assert "elite" in said[6]
    assert "ValueError: x" in said[7]
    assert "no practice area" in said[8]
    assert "firm reference and table code" in said[10]
    assert "exist under FR" in said[11]
    assert "spells the firm SMITH LLP / Smith LLP" in said[12]
    assert "matched by the practice area in the document" in said[13]
    assert "2 export rows" in said[14]
    assert "check by hand" in said[17]
    assert "typed practice area (Elsewhere)" in said[19]


def test_differences(results):
    spark, found, _, export = results
    figures = spark.createDataFrame([(1, "matters", 6), (4, "matters", 3), (5, "matters", None), (3, "matters", 99), (9, "matters", 5)], "doc_no long, metric string, value int")
    got = batch.differences(found, figures, export, {"matters": "num_matters"})
    assert sorted((r["doc_no"], r["exported"], r["counted"], r["decided_by"]) for r in got.collect()) == [(1, 5, 6, "the count"), (9, 4, 5, "the count")]
    names = {r["doc_no"]: r["filename"] for r in found.collect()}
    entered = spark.createDataFrame([(names[1].upper(), "matters", 5), (names[9], "matters", 7), (names[5], "matters", None), ("other", "matters", 1)], "name string, metric string, value int")
    got = batch.differences(found, figures, export, {"matters": "num_matters"}, entered)
    assert sorted((r["doc_no"], r["exported"], r["counted"], r["decided_by"]) for r in got.collect()) == [(9, 4, 7, "a person")]


def test_copies_say_what_is_counted(results):
    said = [(r["doc_no"], i) for r in results[1].filter("status = 'duplicate'").collect() for i in r["issues"] if "second copy" in i]
    assert said
    assert all(i.startswith("a second copy of the same submission, counted from ") for _, i in said)


def test_from_files_to_changes(spark):
    """Word files, a listing and an export of counts, as they are uploaded."""
    body = p("Firm name") + tbl(("Smith LLP",)) + control(p("UK - Tax - VAT"), "Practice") + tbl(*matter("Publishable matter 1", "A"), *matter("Publishable matter 2", "B")) + tbl(*clients(("A", "Yes"), ("B", "No"))) + tbl(*nominee("Partner: leading individual 1", "Ann"))
    packages = spark.createDataFrame([("one.docx", bytearray(package(body))), ("two.docx", bytearray(b"broken"))], "doc_id string, content binary")
    decoded = readers.decode_documents(packages).cache()
    said = headers.headers(decoded, readers.blocks(decoded), readers.rows(decoded), readers.controls(decoded))
    numbers = decoded.select("doc_id", "error").join(said, "doc_id").withColumn("doc_no", F.when(F.col("doc_id") == "one.docx", 1).otherwise(2).cast("long"))
    none = F.lit(None).cast("string")
    docs = numbers.select("doc_no", F.col("doc_id").alias("file_name"), "firm", "region", "grp", "area", none.alias("typed"), F.lit("x").alias("dropdown"), "error", "warnings")
    sheet = lambda rows: bytearray(write_workbook({"s": [[(v, "") for v in r] for r in rows]}))
    books = spark.createDataFrame([("l", sheet([["ID", "Firm", "Region", "Practice Group Name", "Practice Area Name", "Created At", "File URI"], ["1", "Smith LLP", "UK", "Tax", "VAT", "2026-02-01", "h/one.docx"]]))], "doc_id string, content binary")
    listing = listings.portal_rows(readers.decode_workbooks(books))
    counts = spark.createDataFrame([("e", sheet([["Firm", "Firm Ref", "Country", "Practice Area", "# Matters", "# Active Clients", "# New Clients", "# L.Partners", "# Next Gens", "# Associates"], ["Smith LLP", "r1", "UK", "Tax > VAT", 3, 2, 1, 0, 0, 0]]))], "doc_id string, content binary")
    export = readers.count_rows(readers.decode_workbooks(counts)).withColumn("export_id", F.col("row_order").cast("long"))
    found = batch.batch(docs, listing, export).cache()
    assert {r["doc_no"]: r["status"] for r in found.collect()} == {1: "matched", 2: "parse_error"}
    figures = recount(decoded, readers.rows(decoded), readers.blocks(decoded)).join(numbers.select("doc_id", "doc_no"), "doc_id")
    names = {"matters": "num_matters", "active_clients": "num_active_clients", "new_clients": "num_new_clients", "lead_partners": "num_lead_partners", "next_gen": "num_next_gen", "associates": "num_associates"}
    assert sorted((r["metric"], r["exported"], r["counted"]) for r in batch.differences(found, figures, export, names).collect()) == [("lead_partners", 0, 1), ("matters", 3, 2)]


def test_line_candidates(spark):
    listing = [(1, ["name:a"], "UK", "G", "Tax", True), (2, ["name:b"], "UK", "G", "Tax", True), (3, ["name:a"], "FR", "G", "Tax", False), (4, ["name:a"], "FR", "Big Elite", "VAT", True), (5, ["name:a"], "UK", None, "Tax", True)]
    listed = spark.createDataFrame([(*x[:5], None, x[5]) for x in listing], "candidate long, firm_keys array<string>, region string, grp string, area string, tbl string, has_document boolean")
    lines = spark.createDataFrame([(7, 1, "G > Tax"), (7, 2, "tax"), (7, 3, "VAT"), (7, 4, "?"), (8, 1, "G > Tax")], "page_id long, line_no int, value string")
    firms = spark.createDataFrame([(7, "name:a")], "page_id long, firm_key string")
    regions = spark.createDataFrame([(7, "uk")], "page_id long, region_key string")
    got = sorted((r["page_id"], r["line_no"], r["candidate"], r["is_elite"]) for r in reconcile.line_candidates(lines, listed, firms, regions).collect())
    assert got == [(7, 1, 1, False), (7, 2, 1, False), (7, 2, 5, False), (7, 3, 4, True), (8, 1, 1, False), (8, 1, 2, False), (8, 1, 3, False)]


def test_page_superseded(spark):
    rows = [(1, 1, "f", "UK", "Tax", False, True, 1), (1, 2, "F", "uk", "tax", False, True, 2), (1, 3, "f", "UK", "VAT", False, True, 1), (1, 4, "f", "UK", "VAT", False, True, 1), (1, 5, "f", "UK", "Tax", True, True, 9), (1, 6, "f", "UK", "Tax", False, False, 9), (2, 1, "f", "UK", "Tax", False, True, 1)]
    df = spark.createDataFrame(rows, "page_id long, line_no int, firm string, region string, area string, is_elite boolean, has_document boolean, at int")
    got = reconcile.page_superseded(df, F.col("firm"), F.col("region"), F.col("area"), "at")
    assert [(r["page_id"], r["line_no"]) for r in got.filter("superseded").collect()] == [(1, 1)]


def test_vocabulary(spark):
    areas = spark.createDataFrame([("Tax > VAT",), (None,)], "area string")
    listing = spark.createDataFrame([("G", "A", "T", "f.docx"), (None, "B", None, None)], "grp string, area string, tbl string, filename string")
    known = page.vocabulary(areas, listing)
    assert {r[0] for r in known.collect()} == {"tax > vat", "vat", "g > a > t", "a > t", "g > a", "a", "t", "b", "f.docx"}
    values = spark.createDataFrame([(x,) for x in ("vat", "Any > VAT", "F.DOCX", "tax", "", "any > any > vat")], "v string")
    assert {r["v"] for r in page.recognised(values, known, "v").filter("recognised").collect()} == {"vat", "Any > VAT", "F.DOCX"}


def test_shown_texts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"], 3, 2, True, False), ([], None, 2, False, False), (["x"], 2, 2, False, True)], "t array<string>, v int, o int, alt boolean, ticked boolean")
    got = df.select(present.few(F.col("t"), 2), present.sorted_notes(F.col("t")), present.was(F.col("v"), F.col("o")), present.review_note(F.col("t"), F.col("alt"), F.col("ticked"))).collect()
    assert [r[0] for r in got] == ["b, a, and 2 more", "", "x"]
    assert [r[1] for r in got] == [["a", "b", "c"], [], ["x"]]
    assert [r[2] for r in got] == ["3 (was 2)", None, "2"]
    assert [r[3] for r in got] == ["the alternate form was used: check every figure", "", ""]


def test_firm_keys_and_codes(spark):
    df = spark.createDataFrame([("R 1", "Smith & Co. LLP"), (None, "A"), (" ", None)], "ref string, name string")
    assert [r[0] for r in df.select(batch.firm_keys(F.col("ref"), F.col("name"))).collect()] == [["ref:r 1", "name:smith co"], ["name:a"], []]


def test_documents_without_a_row_are_not_dealt_by_it(spark):
    """No join of all documents by export_id: those without one would be one task's."""
    documents = spark.createDataFrame([doc(n, f"d{n}.docx", "Tax" if n == 1 else f"Other{n}") for n in range(1, 6)], DOCS)
    export = spark.createDataFrame([(1, "Smith LLP", "77", "UK", "Tax", 1)], EXPORT)
    done = batch.batch(documents, spark.createDataFrame([], LIST), export)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join LeftOuter" in line and "export_id" in line]
    got = {r["doc_no"]: (r["export_id"], r["firm_ref"]) for r in done.collect()}
    assert got == {1: (1, "77")} | {n: (None, None) for n in range(2, 6)}
