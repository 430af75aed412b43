"""Documents end to end: decoding, recount, spreadsheets."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import edits, metrics
from ledgerline.operators.metrics import looks_like_submission, recount, trace
from ledgerline.sources import readers
from ledgerline.sources.listings import portal_rows
from ledgerline.sources.ooxml import read_document, read_workbook, write_workbook
from tests.docx_files import GOLDEN, NS, clients, control, matter, nominee, p, package, tbl

METRICS = ("matters", "active_clients", "new_clients", "lead_partners", "next_gen", "associates")


@pytest.fixture(scope="module")
def figures(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    for name, (body, _) in GOLDEN.items():
        (folder / name).write_bytes(package(body))
    (folder / "broken.docx").write_bytes(b"not a package")
    (folder / "~$lock.docx").write_bytes(b"x")
    documents = readers.decode_documents(readers.files(spark, str(folder), "*.docx")).cache()
    found = recount(documents, readers.rows(documents), readers.blocks(documents))
    return {(r["doc_id"], r["metric"]): (r["value"], r["needs_check"]) for r in found.collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_figures(figures, name):
    assert tuple(figures[name, m][0] for m in METRICS) == GOLDEN[name][1]


def test_flags(figures):
    assert figures["gamma.docx", "matters"][1]  # numbered 1, 2, 4
    assert not figures["beta.docx", "matters"][1]
    assert figures["alpha.docx", "active_clients"][1]  # a blank among answers


def test_broken_documents_are_unknown(figures):
    assert {figures["broken.docx", m][0] for m in METRICS} == {None}
    assert not any("lock" in d for d, _ in figures)


def test_blocks_and_controls():
    found = read_document(package(p("a") + control(p("inside") + tbl(("x", "y")), "Select Practice") + p("z")))
    assert [(b["kind"], b["text"]) for b in found["blocks"]] == [("p", "a"), ("p", "inside"), ("tbl", None), ("p", "x"), ("p", "y"), ("p", "z")]
    assert [(c["alias"], c["text"]) for c in found["controls"]] == [("Select Practice", "insidexy")]


def test_miscased_package():
    found = read_document(package(p("a"), part="Word/Document.xml"))
    assert found["error"] is None
    assert found["blocks"][0]["text"] == "a"
    assert found["notes"]


def test_workbook_round_trip():
    sheets = {"Recount": [[("FIRM", ""), ("MATTERS", "")], [("A & B <x>", "amber"), (5, "green")]], "Issues": [[(None, "")]]}
    cells = {(c["sheet"], c["row_no"], c["col_no"]): (c["value"], c["fill"]) for c in read_workbook(write_workbook(sheets))}
    assert cells == {("Recount", 1, 1): ("FIRM", ""), ("Recount", 1, 2): ("MATTERS", ""), ("Recount", 2, 1): ("A & B <x>", "FFE699"), ("Recount", 2, 2): ("5", "C6EFCE")}


def test_counts_export(spark):
    header = ["Firm Name", "Firm Ref", "Country", "Practice Area", "a", "b", "c", "d", "e", "f"]
    body = [["Smith LLP", "F1", "London", "Tax", 5, 4, "x", 2, 1, 0], ["", "", "", "", 1, 1, 1, 1, 1, 1], ["Applied filters:"] + [""] * 9]
    content = write_workbook({"Export": [[(v, "") for v in r] for r in [header, *body]]})
    cells = readers.decode_workbooks(spark.createDataFrame([("e.xlsx", bytearray(content))], "doc_id string, content binary"))
    got = [tuple(r) for r in readers.count_rows(cells).collect()]
    assert got == [("e.xlsx", 2, "Smith LLP", "F1", "London", "Tax", 5, 4, None, 2, 1, 0)]
    notes = [r["note"] for r in readers.count_notes(cells).collect()]
    assert len(notes) == 2
    assert any("last six columns were used: a, b, c, d, e, f" in n for n in notes)
    assert any(n.startswith("2 rows without") for n in notes)


def exports(spark, **books):
    rows = [(k, bytearray(v if isinstance(v, bytes) else write_workbook({s: [[(x, "") for x in r] for r in t] for s, t in v.items()}))) for k, v in books.items()]
    return spark.createDataFrame(rows, "doc_id string, content binary")


def test_columns_by_name(spark):
    header = ["FIRM_NAME", "Firm  Ref", "Country", "SUBMISSION_PRACTICE_AREA_NAME", "Practice Area", "# Matters", "x", "y", "z"]
    found = readers.count_columns(readers.decode_workbooks(exports(spark, a={"s": [header]}))).first()
    assert (found["at"]["area"], found["at"]["num_matters"], found["at"]["num_associates"]) == (5, 6, None)
    assert "num_associates" in found["notes"][0]
    header = ["Firm Name", "Firm Ref", "Country", "Practice Area", "Matters", "Active Clients"]
    found = readers.count_columns(readers.decode_workbooks(exports(spark, a={"s": [header]}))).first()
    assert (found["at"]["num_matters"], found["at"]["num_active_clients"], found["at"]["num_new_clients"], found["at"]["firm"]) == (5, 6, None, 1)


def test_two_exports_and_sheet_order(spark):
    header = ["Firm", "Firm Ref", "Region", "Practice Area", "# Matters"]
    books = exports(
        spark,
        a={"Zfirst": [header, ["Aa", "r1", "UK", "Tax", 3]], "Asecond": [header, ["Aa", "r1", "UK", "Tax", 99]]},
        b={"notes": [["nothing here"]], "s": [header, ["Bb", "r2", "FR", "VAT", 7], [], ["Bb", "r2", "FR", "VAT", 8]]},
        c={"s": [["no", "headers"]]},
        d=b"PKbroken",
    )
    tables = readers.decode_tables(books).cache()
    assert {r["doc_id"]: r["error"] is None for r in tables.collect()} == {"a": True, "b": True, "c": True, "d": False}
    cells = tables.select("doc_id", F.inline("cells"))
    got = sorted((r["doc_id"], r["firm"], r["firm_ref"], r["region"], r["area"], r["num_matters"]) for r in readers.count_rows(cells).collect())
    assert got == [("a", "Aa", "r1", "UK", "Tax", 3), ("b", "Bb", "r2", "FR", "VAT", 7), ("b", "Bb", "r2", "FR", "VAT", 8)]
    notes = {(r["doc_id"], r["note"].split(" ")[1]) for r in readers.count_notes(cells).collect()}
    assert {("b", "keys"), ("b", "rows"), ("c", "sheet")} <= notes


def test_folders(spark, tmp_path):
    for name in ("Smith LLP/a.docx", "Smith LLP/b.docx", "Jones/Smith/x.docx", "Jones/~$x.docx", "k/l/m/n/deep.docx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = readers.folders_of(spark, str(tmp_path))
    assert {r["folder"].split(tmp_path.name + "/")[1]: r["documents"] for r in found.collect()} == {"Smith LLP": 2, "Jones/Smith": 1}
    assert [r["documents"] for r in readers.pick_folder(found, "smithllp").collect()] == [2]
    assert {r["folder"].split("/")[-1] for r in readers.pick_folder(found, "jones").collect()} == {"Smith"}


def test_team_rows_are_no_nominations(spark):
    for head in ("Lead partners", "Lead partner(s)", "Other team members", "Other key team members"):
        body = tbl((head,), ("Partner: leading individual 1",), ("Name",), ("Ann",)) + tbl(*nominee("Partner: leading individual 2", "Bo"))
        docs = readers.decode_documents(spark.createDataFrame([("d", bytearray(package(body)))], "doc_id string, content binary"))
        got = {r["metric"]: r["value"] for r in recount(docs, readers.rows(docs), readers.blocks(docs)).collect()}
        assert got["lead_partners"] == 1, head


def test_looks_like_a_submission(spark):
    bodies = {"clients": tbl(("Active key clients", "New")), "matter": tbl(("Publishable matter 3", "")), "named": tbl(("Partner: leading partner 1",)), "other": tbl(("Partner: two",)) + tbl(("x",), ("Publishable matter 1",))}
    docs = readers.decode_documents(spark.createDataFrame([(k, bytearray(package(v))) for k, v in bodies.items()], "doc_id string, content binary"))
    assert {r["doc_id"] for r in looks_like_submission(readers.rows(docs)).collect()} == {"clients", "matter", "named"}


def test_miscased_relations():
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/word/main.xml"/></Types>')
        z.writestr("_rels/.rels", '<R><r Type="x/officeDocument" Target="word/main.xml"/></R>')
        z.writestr("Word/Main.xml", f"<w:document {NS}><w:body>{p('a')}</w:body></w:document>")
    found = read_document(out.getvalue())
    assert found["blocks"][0]["text"] == "a"
    assert [n.split(" ", 1)[0] for n in found["notes"][1:]] == ["1", "1"]


def test_package_sniffing(spark):
    df = spark.createDataFrame([(bytearray(b"PK\x03\x04"),), (bytearray(b"a,b"),)], "content binary")
    assert [r[0] for r in df.select(readers.is_package(F.col("content"))).collect()] == [True, False]


def test_listing_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("﻿Firm,File URI\n\"A, \"\"B\"\"\",x.docx\n".encode())
    got = readers.read_listing(spark, str(tmp_path / "l.csv"))
    assert got.columns == ["Firm", "File URI"]
    assert got.first()["Firm"] == 'A, "B"'


def test_csv_listing_is_read_like_a_workbook(spark):
    text = "\ufeffID,Firm,Region,Practice Area Name,Created At,File URI\n1,\"A, Co\",UK,Tax,2026-01-15,h/a%20b.docx\n\n2,A,UK,\"V\nAT\",,\n3,A,UK,X,,h/c.pdf\n"
    cells = readers.decode_workbooks(spark.createDataFrame([("l.csv", bytearray(text.encode()))], "doc_id string, content binary"))
    got = sorted((r["portal_id"], r["firm"], r["filename"], r["has_document"]) for r in portal_rows(cells).collect())
    assert got == [("1", "A, Co", "a b.docx", True), ("2", "A", "", False)]


def test_trace(spark):
    body = tbl(("Active key clients", "New"), ("Client name", ""), ("A", "Yes"), ("N/A", ""), ("B", "TBC"), ("", "")) + tbl(("Publishable matter 1", ""), ("x", "")) + tbl(("Rising star 1",))
    docs = readers.decode_documents(spark.createDataFrame([("d", bytearray(package(body)))], "doc_id string, content binary"))
    got = [(r["label"], r["what"], r["row_class"], r["answer"]) for r in trace(readers.rows(docs)).orderBy("tbl_no", "row_no").collect()]
    assert got == [
        ("Active key clients", "clients", None, None), ("Client name", None, "header", None), ("A", None, "client", "new"), ("N/A", None, "not_applicable", None), ("B", None, "client", "unrecognised"),
        ("Publishable matter 1", "matter", None, None), ("x", None, None, None), ("Rising star 1", "associates", None, None),
    ]


def test_ledger_adds_up(spark):
    lines = spark.createDataFrame([("page", 5), ("elite", 1), ("expected", 4)], "line string, n long")
    assert tuple(edits.adds_up(lines, "page", "elite", "expected").first()) == (5, 5, True)
    assert not edits.adds_up(lines, "page", "elite").first()["adds_up"]


ORDINARY = tbl(*clients(("Acme", "Yes")))


def of_kind(spark, tmp_path, **bodies):
    """(document, metric) -> row of the figures of documents with these bodies."""
    for name, body in bodies.items():
        (tmp_path / f"{name}.docx").write_bytes(package(body) if isinstance(body, str) else body)
    documents = readers.decode_documents(readers.files(spark, str(tmp_path), "*.docx")).cache()
    found = metrics.figures(documents, readers.rows(documents), readers.blocks(documents)).collect()
    return {(r["doc_id"].removesuffix(".docx"), r["metric"]): r for r in found}


def values(got, name):
    return tuple(got[name, m]["value"] for m in METRICS)


def test_routes(spark, tmp_path):
    """Unknown, never zero: a letter has no figures, the alternate form has its own."""
    lawyers = tbl(("B9: Ranked and unranked lawyers", "", ""), ("Name", "Comments", "Partner Y/N"), ("Ann", "", "Y"), ("Bo", "", "[N]"), ("", "", "Y"))
    listed = tbl(("D0 Publishable clients", "", ""), ("No", "Name of client", "New client (Y/N)"), ("1", "Acme", "Yes"), ("2", "N/A", ""), ("3", "Beta", "no"), ("4", "", ""))
    got = of_kind(
        spark, tmp_path, letter=tbl(("Dear", "Sir")), alternate=lawyers + listed, site=p("send it to https://myaccount.chambers.com/x") + ORDINARY,
        odd=lawyers.replace("[N]", "perhaps") + listed.replace(">no<", ">perhaps<"), headless=tbl(("E0 Confidential clients",), ("nothing",)), broken=b"PK no package", plain=ORDINARY,
    )
    assert {name: got[name, "matters"]["route"] for name, m in got if m == "matters"} == {"letter": "no submission", "alternate": "alternate", "site": "alternate", "odd": "alternate", "headless": "alternate", "broken": "unreadable", "plain": "ordinary"}
    assert values(got, "letter") == values(got, "broken") == (None,) * 6
    assert got["letter", "next_gen"]["notes"] == [got["letter", "next_gen"]["error"]]
    assert "does not look like a submission" in got["letter", "matters"]["error"]
    assert values(got, "alternate") == (None, 2, 1, 1, None, 1)
    assert got["alternate", "lead_partners"]["evidence"] == ["Ann - partner"]
    assert got["alternate", "associates"]["evidence"] == ["Bo - not a partner"]
    assert got["alternate", "new_clients"]["evidence"] == ["D0 Publishable clients: 2 client rows"]
    assert all(got["alternate", m]["needs_check"] for m in METRICS if m != "next_gen")
    assert values(got, "site") == values(got, "headless") == (None,) * 6  # neither list was found
    assert values(got, "odd") == (None, 2, None, 1, None, 0)
    assert got["odd", "associates"]["notes"] == ["1 lawyer(s) are said to be neither partner nor not: Bo: 'perhaps'; not counted"]
    assert got["odd", "new_clients"]["notes"] == ["1 answer(s) are neither yes nor no: 'perhaps'; count this column by hand"]
    assert values(got, "plain") == (None, 1, 1, 0, 0, 0)


def test_evidence_and_notes(spark, tmp_path):
    numbers = lambda kind, *ns: "".join(tbl(*matter(f"{kind} matter {n}", "X")) for n in ns)
    many = [(f"Client {n}", "") for n in range(7)]
    got = of_kind(
        spark, tmp_path,
        straight=numbers("Publishable", 1, 2) + numbers("Non-publishable", 3, 4),
        kinds=numbers("Publishable", 1, 2, 2, 5) + numbers("Non-publishable", 1, 2), far=numbers("Publishable", 2, 2, 900) + numbers("Non-publishable", 1, 2),
        both=numbers("Publishable", 1, 2, 3, 7) + numbers("Non-publishable", 4, 5, 9),
        blanks=tbl(*clients(*many, ("Answered", "Yes"))), lone=tbl(*clients(("All clients are confidential", ""))), habit=tbl(*clients(*many)),
        odd=tbl(*clients(("A", "maybe"), ("B", "Not sure"), ("C", "maybe"), ("D", "Yes, partly"), ("E", "((no))"))),
        vague=ORDINARY + tbl(*nominee("Partner: of note 1", "Ann")) + tbl(*nominee("Partner: of note 2", "")) + p("Your team: next gen partners"),
        team=ORDINARY + tbl(*matter("Publishable matter 1", "X"), ("Associate: of the matter", "")) + tbl(*nominee("Associates: leading associate 1", "Cy")),
        apart=tbl(("Non-publishable matter 1", "")) + tbl(("Name of client", "Industry sector"), ("Y", "")) + tbl(*matter("Publishable matter 1", "")) + tbl(*nominee("Leading partner 1", "")),
    )
    said = lambda name, m: got[name, m]["notes"]
    assert (said("straight", "matters"), got["straight", "matters"]["numbering_gap"]) == ([], False)
    assert said("kinds", "matters") == ["Publishable matters are numbered up to 5, and 4 were counted (no 3, 4; repeated 2): one may have been deleted or mistyped, or missed by the count"]
    assert said("far", "matters") == ["Matters are numbered up to 900 across publishable and non-publishable, and 5 were counted (no 3 to 899; repeated 2): one may have been deleted or mistyped, or missed by the count"]
    assert said("both", "matters") == ["Matters are numbered up to 9 across publishable and non-publishable, and 7 were counted (no 6, 8): one may have been deleted or mistyped, or missed by the count"]
    assert got["both", "matters"]["numbering_gap"] and not got["both", "matters"]["needs_check"]
    assert said("blanks", "active_clients") == ["7 row(s) answer nothing about new clients: 'Client 0', 'Client 1', 'Client 2', 'Client 3', and 3 more; counted, check that they are clients"]
    assert said("lone", "active_clients") == ["1 row(s) answer nothing about new clients: 'All clients are confidential'; counted, check that they are clients"]
    assert (said("habit", "active_clients"), said("habit", "new_clients")) == ([], ["7 blank answer(s) count as not new"])
    assert got["odd", "new_clients"]["value"] is None
    assert said("odd", "new_clients") == ["1 answer(s) say more than yes or no and were read by their first word: 'Yes, partly'", "3 answer(s) are neither yes nor no: 'Not sure', 'maybe'; count this column by hand"]
    unsure = "1 partner nomination(s) say neither leading nor next generation: 'Partner: of note 1'; counted as neither, decide by hand"
    assert said("vague", "lead_partners") == [unsure, "no nominations of this kind"]
    assert said("vague", "next_gen") == [unsure, "the heading of this category is there, but no nomination below it was recognised"]
    assert (got["vague", "lead_partners"]["value"], got["vague", "next_gen"]["value"], got["vague", "associates"]["value"]) == (0, None, 0)
    assert (got["team", "associates"]["evidence"], said("team", "associates")) == (["Associates: leading associate 1 - Cy"], ["1 role(s) inside matters are no nominations: 'Associate: of the matter'"])
    assert said("apart", "matters") == ["1 empty matter box(es) were left out", "1 matter(s) have their label in a table of its own and the details in the next one"]
    assert (got["apart", "lead_partners"]["value"], said("apart", "lead_partners")) == (0, ["1 empty nomination box(es) were left out"])
