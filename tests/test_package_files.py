"""Data sources of documents and workbooks, against reading by Spark's own file source."""

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import package_files, readers, workbook_files
from ledgerline.sources.ooxml import write_workbook
from tests.docx_files import control, p, package, tbl


def key(df, *columns):
    return sorted(map(str, df.select(*(columns or sorted(df.columns))).collect()))


@pytest.fixture
def folder(spark, tmp_path):
    package_files.register(spark)
    (tmp_path / "deep é+%20").mkdir()
    for n in range(12):
        body = p(f"Title {n}") + tbl(["a", str(n)], fill="AA00BB") + control(p("inside"), "Area")
        (tmp_path / ("deep é+%20" if n % 2 else ".") / f"doc {n} é+%20.docx").write_bytes(package(body))
    (tmp_path / "broken.docx").write_bytes(b"PK nothing")
    (tmp_path / "~$lock.docx").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    return tmp_path


def test_documents_equal_those_of_the_file_source(spark, folder):
    want = readers.decode_documents(readers.files(spark, str(folder), "*.docx"))
    for path in (str(folder), f"{folder}/", f"file:{folder}", folder.as_uri()):
        assert key(spark.read.format("submission_documents").load(path)) == key(want)
    assert want.filter("error IS NOT NULL").count() == 1
    (folder / "empty.docx").write_bytes(b"")  # the file source leaves such a file out
    found = spark.read.format("submission_documents").load(str(folder))
    assert found.count() == 14
    assert found.filter("doc_id = 'empty.docx' AND error LIKE 'BadZipFile%' AND size(rows) = 0").count() == 1


def test_only_the_columns_asked_for_are_decoded(spark, folder, monkeypatch):
    want = readers.decode_documents(readers.files(spark, str(folder), "*.docx"))
    types = {f.name: f.dataType.simpleString() for f in want.schema}
    for columns in (["controls", "doc_id"], ["rows"], ["blocks", "error"], ["doc_id"], ["notes"]):
        asked = spark.read.format("submission_documents").schema(", ".join(f"{c} {types[c]}" for c in columns)).load(str(folder))
        assert asked.columns == columns
        assert key(asked, *columns) == key(want, *columns)
    assert readers.read_document(package(p("a") + tbl(["x"]) + control(p("i"))), frozenset({"rows"})) == {
        "blocks": [], "rows": [{"tbl_no": 0, "row_no": 0, "cells": ["x"], "fill": ""}], "controls": [], "notes": [], "error": None,
    }
    with pytest.raises(Exception, match="must be among"):
        spark.read.format("submission_documents").schema("doc_id long").load(str(folder)).collect()


def test_only_the_sheets_asked_for_are_opened(spark, tmp_path):
    package_files.register(spark)
    for n in range(3):
        (tmp_path / f"{n}.xlsx").write_bytes(write_workbook({"One": [[("v", ""), (n, "")]], "Two, too": [[("w", "")]]}))
    (tmp_path / "_pending").mkdir()
    (tmp_path / "_pending" / "9.xlsx").write_bytes(b"half")
    load = lambda **more: spark.read.format("submission_tables").options(**more).load(str(tmp_path))
    assert key(load()) == key(readers.decode_tables(readers.files(spark, str(tmp_path), "[0-2].xlsx")))
    two = load(sheets="Two, too|absent").select(F.inline("cells"))
    assert {(r["sheet_no"], r["sheet"], r["value"]) for r in two.collect()} == {(1, "Two, too", "w")}
    assert two.count() == 3
    assert key(load(sheets="Two, too|One")) == key(load())
    assert load(pattern="1.*").select("doc_id").collect() == [("1.xlsx",)]


def test_no_files_and_no_folder(spark, tmp_path):
    package_files.register(spark)
    assert spark.read.format("submission_documents").load(str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="absent"):
        spark.read.format("submission_documents").load(f"{tmp_path}/absent").collect()


def test_partitions_are_packed_by_size():
    large, small = ("l", 50 << 20), [(f"s{n:04}", 20 << 10) for n in range(1000)]
    parts = package_files.packed([*small[:500], large, *small[500:]], package_files.PARTITION_BYTES, package_files.FILE_COST)
    assert parts[0] == [large]
    assert sorted(f for part in parts[1:] for f in part) == small
    per = package_files.PARTITION_BYTES // ((20 << 10) + package_files.FILE_COST)
    assert [len(part) for part in parts[1:]] == [per] * (1000 // per) + [1000 % per]
    assert package_files.packed([], 10, 1) == []
    assert [len(x) for x in package_files.batches([("a", 9 << 20), *(("b", 0) for _ in range(300))])] == [1, 256, 44]


def test_partitions_of_a_folder(spark, tmp_path):
    package_files.register(spark)
    (tmp_path / "large.docx").write_bytes(package(p("word " * 200_000)) + b"\0" * 2_000_000)
    for n in range(60):
        (tmp_path / f"{n}.docx").write_bytes(package(p(str(n))))
    read = spark.read.format("submission_documents").option("partitionBytes", 1_000_000).option("fileCost", 20_000).load(str(tmp_path))
    by_part = [[r["doc_id"] for r in part] for part in read.select("doc_id").rdd.glom().collect()]
    assert ["large.docx"] in by_part
    assert len(by_part) == 3
    assert sum(map(len, by_part)) == 61


def test_workbooks_written_are_read_again(spark, tmp_path):
    workbook_files.register(spark)
    package_files.register(spark)
    books = [(f"k{n}", bytearray(write_workbook({"S": [[(n, "")]]}))) for n in range(5)]
    spark.createDataFrame(books, "key string, content binary").write.format(workbook_files.NAME).mode("append").save(f"{tmp_path}/out")
    found = spark.read.format("submission_tables").load(f"{tmp_path}/out").select("doc_id", F.inline("cells"))
    assert sorted((r["doc_id"], r["value"]) for r in found.collect()) == [(f"k{n}.xlsx", str(n)) for n in range(5)]
