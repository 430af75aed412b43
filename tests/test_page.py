"""A page from its lines to statuses, against a plain walk in order."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import reconcile

POOLS = "page_id long, pool string, candidate long, rank long, is_elite boolean, has_document boolean, name string, identity string"
FILES = "page_id long, file_no long, name string, by_code boolean"


def walked(lines, pools, files):
    """(page, line) -> candidate, file, repeat_of; every line looks at all its pool."""
    out, pages = {}, {line[0] for line in lines}
    for page in pages:
        queues = {}
        for p, no, name, _ in sorted(files, key=lambda f: (f[3], f[1])):
            if p == page and name:
                queues.setdefault(name, []).append(no)
        used, placed, first = set(), set(), {}
        for _, line, pool in sorted(x for x in lines if x[0] == page):
            own = sorted((r for r in pools if r[:2] == (page, pool)), key=lambda r: (r[4], r[3], r[2]))
            rows = [r for r in own if r[2] not in used] or own
            choice = None
            for r in rows:
                left = [f for f in queues.get(r[6], []) if f not in placed]
                if left:
                    choice, file = r, left[0]
                    break
            if choice is None:
                file = None
                choice = next((r for r in rows if r[5]), rows[0])
            identity = choice[7] or ("own", choice[2])
            used.add(choice[2])
            placed.add(file)
            out[page, line] = (choice[2], file, first.get(identity))
            first.setdefault(identity, line)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_take_rows_and_files_in_order(spark, seed):
    """Pools that overlap, rows that share a name or an identity, queues of several files."""
    r = random.Random(seed)
    lines, pools, files = [], [], []
    for page in range(12):
        rows = [(c, r.random() < 0.2, r.random() < 0.7, r.choice([None, "", "a", "b", f"own{c}"]), r.choice([None, None, "p", f"q{c % 3}"])) for c in range(r.randint(1, 9))]
        for pool in range(r.randint(1, 5)):
            own = [x for x in rows if r.random() < 0.4] or rows[:1]
            pools += [(page, f"f{pool}", c, c, *rest) for c, *rest in own]
            lines += [(page, 0, f"f{pool}")] * r.randint(0, 5)
        files += [(page, 100 + n, r.choice(["a", "b", None, "", "own1", "own2", "elsewhere"]), r.random() < 0.5) for n in range(r.randint(0, 8))]
    r.shuffle(lines)
    numbered, count = [], {}
    for page, _, pool in lines:
        count[page] = count.get(page, 0) + 1
        numbered.append((page, count[page], pool))
    found = reconcile.assign_lines(spark.createDataFrame(numbered, "page_id long, line_no int, pool string"), spark.createDataFrame(pools, POOLS), spark.createDataFrame(files, FILES))
    got = {(x["page_id"], x["line_no"]): (x["candidate"], x["file_no"], x["repeat_of"]) for x in found.collect()}
    assert got == walked(numbered, pools, files)


def test_used_up_rows_repeat_the_first_with_a_document(spark):
    lines = spark.createDataFrame([(1, n, "f") for n in (1, 2, 3)], "page_id long, line_no int, pool string")
    pools = spark.createDataFrame([(1, "f", 10, 10, False, True, None, None), (1, "f", 20, 20, False, True, "x", None)], POOLS)
    files = spark.createDataFrame([(1, 5, "x", False)], FILES)
    got = sorted(tuple(r)[1:] for r in reconcile.assign_lines(lines, pools, files).collect())
    assert got == [(1, 20, 5, None), (2, 10, None, None), (3, 10, None, 2)]


def test_parts(spark):
    rows = [(1, "a", 1, None, None), (1, "b", 1, "n", None), (1, "c", 2, "n", None), (1, "d", 3, None, "i"), (1, "e", 4, None, "i"), (1, "f", 5, None, None), (2, "c", 1, None, None)]
    got = reconcile.parts_of(spark.createDataFrame(rows, "page_id long, pool string, candidate long, name string, identity string"))
    assert {(r["page_id"], r["pool"]): r["part"] for r in got.collect()} == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "d"): "d", (1, "e"): "d", (1, "f"): "f", (2, "c"): "c"}


LISTING = "candidate long, firm string, firm_keys array<string>, region string, grp string, area string, tbl string, filename string, portal_id string, created_at string, has_document boolean"


@pytest.fixture(scope="module")
def small_page(spark):
    keys = ["name:smith"]
    listing = [
        (1, "Smith", keys, "UK", "G", "Tax", None, "tax.docx", "p1", "2024-01-01", True),
        (2, "Smith", keys, "UK", "G", "Tax", None, "", "", "2024-01-01", False),
        (3, "Smith", keys, "UK", "Elite G", "VAT", None, "vat.docx", "p3", "2024-01-01", True),
        (4, "Smith", keys, "UK", "G", "Old", None, "old.docx", "p4", "2023-01-01", True),
        (5, "Smith", keys, "UK", "G", "Old", None, "new.docx", "p5", "2024-06-01", True),
        (6, "Smith", keys, "UK", "G", "Twice", None, "twice.docx", "p6", "2024-01-01", True),
        (7, "Smith", keys, "UK", "G", "Broken", None, "broken.docx", "p7", "2024-01-01", True),
        (8, "Other", ["name:other"], "UK", "G", "Tax", None, "theirs.docx", "p8", "2025-01-01", True),
        (9, "Smith", keys, "FR", "G", "Late", None, "late.docx", "p9", "2024-01-01", True),
    ]
    values = ["Tax", "G > Tax", "VAT", "Old", "Old", "Twice", "Twice", "Broken", "unknown", "Twice", "Late"]
    results = [(1, 101, "tax.docx", False, "matched"), (1, 102, "new.docx", False, "matched"), (1, 103, "twice.docx", True, "matched"), (1, 104, "twice.docx", False, "matched"), (1, 105, "broken.docx", False, "parse_error"), (1, 106, None, False, "unmatched"), (1, 107, "tax.docx", False, "duplicate"), (1, 108, "vat.docx", False, "elite")]
    frames = (
        spark.createDataFrame([(1, n + 1, v) for n, v in enumerate(values)], "page_id long, line_no int, value string"),
        spark.createDataFrame(listing, LISTING),
        spark.createDataFrame(results, "page_id long, file_no long, name string, by_code boolean, status string"),
        spark.createDataFrame([(1, "name:smith")], "page_id long, firm_key string"),
        spark.createDataFrame([(1, "uk")], "page_id long, region_key string"),
    )
    return reconcile.page_lines(*frames).cache(), frames


def test_statuses(small_page):
    got = [(r["candidate"], r["file_no"], r["repeat_of"], r["status"]) for r in small_page[0].orderBy("line_no").collect()]
    assert got == [
        (1, 101, None, "uploaded"), (2, None, None, "no document"), (3, None, None, "elite"), (5, 102, None, "uploaded"), (4, None, None, "older version"),
        (6, 104, None, "uploaded"), (6, 103, 6, "uploaded"), (7, 105, None, "could not read"), (None, None, None, "unrecognised"), (6, None, 6, "check page"), (9, None, None, "missing"),
    ]


def test_rollup(small_page):
    lines, frames = small_page
    got = reconcile.page_rollup(lines, frames[2]).first().asDict()
    assert got | {"page_size": 11, "expected": 7, "in_batch": 7, "elite": 1, "without_document": 1, "missing": 1, "not_reached": 0, "accounted": 4, "repeats": 2, "distinct_documents": 7, "shared_rows": 0, "unclear": 1, "unreadable": 1, "unrecognised": 1, "not_downloaded": 1, "duplicates": 1, "not_on_page": 1, "accounted_for": False} == got


def test_copies_keep_a_page_open(spark, small_page):
    """Nothing missing and nothing unclear, but a second copy was given."""
    lines = small_page[0].filter("line_no IN (1, 4)")
    results = small_page[1][2].filter("file_no IN (101, 102)")
    assert reconcile.page_rollup(lines, results).first()["accounted_for"]
    more = results.unionByName(spark.createDataFrame([(1, 9, "tax.docx", False, "duplicate")], results.schema))
    assert not reconcile.page_rollup(lines, more).first()["accounted_for"]
    assert reconcile.page_rollup(lines, results.filter(F.lit(False))).first()["duplicates"] == 0
