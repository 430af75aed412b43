"""Matching, supersession and reconciliation on small tables."""

from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import matching, numbering, present


def test_longest_spelling_wins_and_exact_decides(spark):
    docs = spark.createDataFrame([(1, "Tax > VAT > VAT"), (2, "Nothing")], "doc long, area string")
    listed = [("vat", 10), ("tax > vat", 11), ("tax > vat", 12)]
    right = spark.createDataFrame(listed, "form string, id long")
    hits = matching.first_key_join(docs, right, "doc", text.area_variants(F.col("area")), "form")
    assert sorted((r["doc"], r["id"]) for r in hits.collect() if r["id"]) == [(1, 11), (1, 12)]
    assert hits.filter("doc = 2").first()["id"] is None
    only = matching.prefer_exact(hits.filter("id IS NOT NULL"), "doc", F.col("id") == 12)
    assert [r["id"] for r in only.collect()] == [12]
    both = matching.prefer_exact(hits.filter("id IS NOT NULL"), "doc", F.lit(False))
    assert both.count() == 2


def test_copies(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", False)], "n int, name string, suffix boolean")
    got = {r["n"]: r["copy_no"] for r in matching.mark_copies(rows, "name", F.col("suffix"), "n").collect()}
    assert got == {2: 1, 3: 2, 1: 3}


def test_superseded_only_if_newest_is_unique(spark):
    rows = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, "t", 1), (4, "t", 5), (5, "t", 5)], "n int, slot string, at int")
    got = {r["n"]: (r["superseded"], r["undecided"]) for r in matching.mark_superseded(rows, ["slot"], "at").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True), 5: (False, True)}


def test_numbering(spark):
    lists = {"straight": "a1 a2 b3 b4", "kinds": "a1 a2 b1", "gap": "a1 a2 a4", "twice": "a1 a2 a2", "far": "a1 a2 a3 a9"}
    rows = [(k, x[0], int(x[1:])) for k, v in lists.items() for x in v.split()]
    checked = numbering.check_numbering(spark.createDataFrame(rows, "d string, kind string, n int"), ["d"], "kind", "n")
    got = {r["d"]: (r["clean"], r["absent"]) for r in checked.collect()}
    assert got == {"straight": (True, 0), "kinds": (True, 0), "gap": (False, 1), "twice": (False, 0), "far": (False, 5)}


def test_override_of_null_is_not_no_override(spark):
    df = spark.createDataFrame([(True, None, 5), (None, None, 5), (True, 7, 5)], "present boolean, value int, recount int")
    assert [r[0] for r in df.select(present.final_value(F.col("present"), F.col("value"), F.col("recount"))).collect()] == [None, 5, 7]


def test_keyed_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", 3), (3, "c", 1)], "k int, x string, y int")
    got = sorted((tuple(r) for r in present.keyed_diff(old, new, "k", ["x", "y"]).collect()), key=str)
    assert got == [(1, "y", None, "3"), (2, None, "present", None), (3, None, None, "present")]
