"""Folders of many firms against what their exports list."""

import random

from ledgerline.operators import folders

LISTING = "export string, row_no int, firm string, region string, grp string, area string, filename string, has_document boolean, created_at timestamp_ntz"


def test_names_within_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    texts = [word(rng.randint(0, 30)) for _ in range(200)] + ["", None, "aaaa" * 500, "abc", "abc"]
    names = [word(rng.randint(1, 7)) for _ in range(60)] + ["", None, "a", "aaaaaaaa", "zz", "abc", "abc"]
    found = folders.names_within(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(t, n) for t in texts for n in names if t and n and n in t}


def test_numbered_names_meet_few_texts(spark):
    """What is searched grows with what is found, not with the square of the names."""
    numbers = spark.range(20000)
    texts, names = numbers.selectExpr("concat('firm ', id, ' llp') AS text"), numbers.selectExpr("concat('firm ', id) AS name")
    found = folders.names_within(texts, names).count()
    assert found == sum(len(str(n)) for n in range(20000))
    assert folders.names_to_search(texts, names).count() < 2 * found


def test_rows_of_one_name_and_older_ones_that_are_held(spark):
    """The first row of a name counts, whatever its firm; a held older version is extra too."""
    from datetime import datetime

    old, new = datetime(2026, 1, 1), datetime(2026, 2, 1)
    row = lambda n, firm, name, at, export="real/all.csv": (export, n, firm, "MX", "G", "Tax", name, True, at)
    listing = [
        row(2, "Acme One", "a.docx", new), row(1, "Acme Two", "a.docx", old), row(3, "Acme One", "A.docx", old), row(4, "Acme Two", "b.docx", new),
        row(9, "Acme One", "far.docx", new, "elsewhere/x.csv"),
    ]
    got, _ = check(spark, listing, [("Acme", "a.DOCX"), ("Acme", "A.docx")], ["Acme"])
    # a.docx is row 1, of Acme Two, where b.docx is newer; A.docx is alone in its slot
    assert got == [("Acme", "missing", "b.docx"), ("Acme", "older version", "a.docx"), ("Acme", "present", "A.docx")]


def test_documents_and_folders(spark):
    paths = ["file:/r/Acme/a.docx", "file:/r/mexico/Acme Abogados/b.DOCX", "file:/r/mexico/Acme Abogados/~$b.docx", "file:/r/1/2/3/deep.docx", "file:/r/1/2/3/4/no.docx", "file:/r/top.docx", "file:/r/chile/x.docx", "file:/r/Acme/n.txt"]
    docs = folders.documents_in(spark.createDataFrame([(p,) for p in paths], "path string"), "/r")
    assert {tuple(r) for r in docs.collect()} == {("Acme", "a.docx"), ("mexico/Acme Abogados", "b.DOCX"), ("1/2/3", "deep.docx"), ("chile", "x.docx")}
    firms = spark.createDataFrame([("acme",), ("ACME abogados",), ("Mexico",), ("chile",), ("nobody",), ("",), (None,)], "firm string")
    got = {tuple(r) for r in folders.pick_folders(docs, firms).collect()}
    assert got == {("acme", "Acme"), ("ACME abogados", "mexico/Acme Abogados"), ("Mexico", "mexico/Acme Abogados"), ("chile", "chile")}


def check(spark, listing, documents, firms, general=("real",)):
    firms = spark.createDataFrame([(f,) for f in firms], "firm string")
    checked = folders.check_folders(spark.createDataFrame(listing, LISTING), spark.createDataFrame(documents, "folder string, name string"), firms, list(general))
    counts = {r["firm"]: r.asDict() for r in folders.folder_counts(firms, checked).collect()}
    return sorted((r["firm"], r["side"], r["name"]) for r in checked.fillna("-", ["name"]).collect()), counts


def test_check_folders(spark):
    from datetime import datetime

    old, new = datetime(2026, 1, 1), datetime(2026, 2, 1)
    own, far = "mx/Acme/spreadsheets/p.csv", "real/all.csv"
    row = lambda n, area, name, at=new, grp="Group", export=own, firm="Acme LLP": (export, n, firm, "MX", grp, area, name, name != "", at)
    listing = [
        row(1, "Tax", "Tax.docx"), row(2, "Tax", "tax old.docx", old), row(3, "VAT", ""), row(4, "X", "gone.docx"),
        row(5, "Y", "y1.docx"), row(6, "Y", "y2.docx"), row(7, "Z", "_12_submission_a_EC7.docx", grp="Rio Elite"),
        row(8, "W", "Tax.docx", old), row(1, "Far", "far.docx", export=far), row(2, "Only far", "f.docx", export=far, firm="Beta"),
        row(1, "Elsewhere", "e.docx", export="other/x.csv", firm="Gamma"),
    ]
    documents = [("mx/Acme", n) for n in ("TAX.docx", "tax old.docx", "y1.docx", "p_12_submission_b_EC7.docx", "stray.docx")] + [("Beta", "f.docx"), ("Gamma", "e.docx")]
    got, counts = check(spark, listing, documents, ["Acme", "Beta", "Gamma", "nobody"])
    acme = [("present", "TAX.docx"), ("present", "y1.docx"), ("missing", "gone.docx"), ("missing", "y2.docx"), ("older version", "tax old.docx"), ("no document", "-"), ("elite", "p_12_submission_b_EC7.docx"), ("extra", "stray.docx"), ("extra", "tax old.docx")]
    assert got == sorted([("Acme", *x) for x in acme] + [("Beta", "present", "f.docx")])
    assert counts["Acme"] == {"firm": "Acme", "folder": "mx/Acme", "export": own, "present": 2, "missing": 2, "older": 1, "without_document": 1, "elite_files": 1, "extra": 2, "complete": False}
    assert counts["Beta"]["complete"] is True and counts["Beta"]["export"] == far
    assert counts["Gamma"]["complete"] is None and counts["nobody"]["complete"] is None


def test_nearest_export_comes_first(spark):
    """A firm for each place: its export is there and in every later place."""
    places = ["mx/Acme{}/spreadsheets/z.csv", "mx/Acme{}/b.csv", "mx/spreadsheets/c.csv", "first/d.csv", "real/a.csv", "real/b.csv"]
    listing = [(x.format(n), 1, f"Acme{n} LLP", "MX", "G", "Tax", "a.docx", True, None) for n in range(len(places)) for x in reversed(places[n:])]
    _, counts = check(spark, listing, [(f"mx/Acme{n}", "a.docx") for n in range(len(places))], [f"acme{n}" for n in range(len(places))], ("first", "real"))
    assert {f: r["export"] for f, r in counts.items()} == {f"acme{n}": x.format(n) for n, x in enumerate(places)}


def test_nothing_listed_and_nothing_held(spark):
    assert check(spark, [], [("a", "b.docx")], ["a"])[0] == []
    assert check(spark, [], [], [])[0] == []
