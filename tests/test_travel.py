"""What lies together stays together: rows that travel are shuffle files on disk."""

from datetime import datetime

from ledgerline.operators import folders, metrics

ROWS = "doc_id long, tbl_no int, row_no int, cells array<string>, fill string"


def exchanges(df) -> list[str]:
    """The shuffles that Spark adds by itself to those that were asked for."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line]


def test_rows_that_lie_by_document_travel_no_more(spark):
    """A box of the next table, a nomination, clients and an alternate form, without a shuffle."""
    tables = [
        (1, [["Publishable matter 1"]]), (1, [["Name of client"], ["Acme"]]), (1, [["Leading partner 1"], ["Name"], ["Ann"]]), (1, [["Active key clients", "New"], ["Beta", "Yes"]]),
        (2, [["D0 Clients"], ["No", "Name of client", "New client"], ["1", "Gamma", "Y"]]),
    ]
    rows = spark.createDataFrame([(d, t, r, cells, "") for t, (d, table) in enumerate(tables) for r, cells in enumerate(table)], ROWS)
    documents = spark.createDataFrame([(d, None) for d in (1, 2, 3)], "doc_id long, error string")
    blocks = spark.createDataFrame([(3, 0, "p", "a paragraph")], "doc_id long, block_no int, kind string, text string")
    found = metrics.figures(*(df.repartition(4, "doc_id") for df in (documents, rows, blocks)))
    assert exchanges(found) == []
    values = {(r["doc_id"], r["metric"]): r["value"] for r in found.collect() if r["value"] is not None}
    assert values == {(1, "matters"): 1, (1, "active_clients"): 1, (1, "new_clients"): 1, (1, "lead_partners"): 1, (1, "next_gen"): 0, (1, "associates"): 0, (2, "active_clients"): 1, (2, "new_clients"): 1}


def shuffled_rows(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_are_judged_before_they_meet_those_who_ask(spark):
    """A row that many firms ask for travels less than once for each of them."""
    firms, rows = 30, 40
    listing = [("real/all.csv", r, "a" * k, "MX", "G", "Tax", f"{k}-{r}.docx", True, datetime(2026, 1, 1 + r % 28, r)) for k in range(1, firms + 1) for r in range(1, 20)]
    listing += [("real/all.csv", r, "a" * k, "MX", "G", "Tax", f"{k}-{r}.docx", True, datetime(2025, 1, 1)) for k in range(1, firms + 1) for r in range(20, rows)]
    listed = spark.createDataFrame(listing, "export string, row_no int, firm string, region string, grp string, area string, filename string, has_document boolean, created_at timestamp_ntz")
    documents = spark.createDataFrame([("a" * k, f"{k}-19.docx") for k in range(1, firms + 1)], "folder string, name string")
    asked = spark.createDataFrame([("a" * k,) for k in range(1, firms + 1)], "firm string")
    before = shuffled_rows(spark)
    found = folders.check_folders(listed, documents, asked, ["real"]).groupBy("side").count().collect()
    asked_for = sum(range(1, firms + 1)) * (rows - 1)
    assert {r["side"]: r["count"] for r in found} == {"present": firms, "missing": sum(range(firms)), "older version": sum(range(1, firms + 1)) * (rows - 2)}
    assert shuffled_rows(spark) - before < asked_for


def test_firms_that_share_names_or_slots_are_judged_for_each_that_asks(spark):
    """Beta stands alone; Acme One and Acme Two share a name, " acme" has Acme's slot."""
    old, new = datetime(2026, 1, 1), datetime(2026, 2, 1)
    row = lambda n, firm, name, at: ("real/all.csv", n, firm, "MX", "G", "Tax", name, True, at)
    listing = [
        row(1, "Acme Two", "a.docx", old), row(2, "Acme One", "a.docx", new), row(3, "Acme One", "b.docx", old), row(4, "Acme", "c.docx", old), row(5, " acme", "d.docx", new),
        row(6, "Beta", "e.docx", old), row(7, "Beta", "f.docx", new), row(8, "Beta", "e.docx", new),
    ]
    listed = spark.createDataFrame(listing, "export string, row_no int, firm string, region string, grp string, area string, filename string, has_document boolean, created_at timestamp_ntz")
    documents = spark.createDataFrame([(f, "x.docx") for f in ("Acme", "Acme One", "x Acme", "Beta")], "folder string, name string")
    asked = spark.createDataFrame([("Acme",), ("Acme One",), ("Beta",)], "firm string")
    found = folders.check_folders(listed, documents, asked, ["real"]).filter("side <> 'extra'")
    assert sorted((r["firm"], r["side"], r["name"]) for r in found.collect()) == [
        ("Acme", "missing", "a.docx"), ("Acme", "missing", "b.docx"), ("Acme", "missing", "d.docx"), ("Acme", "older version", "c.docx"),
        ("Acme One", "missing", "a.docx"), ("Acme One", "older version", "b.docx"), ("Beta", "missing", "f.docx"), ("Beta", "older version", "e.docx"),
    ]


def test_few_and_many_names_fetch_the_same(spark, monkeypatch):
    """Whether names are sent to every task or travel by their pieces: the same pairs, each once."""
    texts, names = [f"firm {n} llp" for n in range(300)] + ["", None], ["firm 1", "firm 12", "firm 299 llp", "29", "p", "nobody", "", None]
    given = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string")
    for few in (0, 2, 100):
        monkeypatch.setattr(folders, "FEW", few)
        got = [tuple(r) for r in folders.names_within(*given).collect()]
        assert sorted(got) == sorted((t, n) for t in texts for n in names if t and n and n in t)
