"""Kept decodes and workbooks written as files."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import tables
from ledgerline.sources import readers, sinks, store, workbook_files
from tests.docx_files import p, package, tbl


def test_new_bytes_only_are_decoded(spark, tmp_path):
    decoded = spark.sparkContext.accumulator(0)

    def decode(packages):
        def count(parts):
            for part in parts:
                decoded.add(part.num_rows)
                yield part

        return readers.decode_tables(packages.select("doc_id", "content").mapInArrow(count, "doc_id string, content binary"))

    def run(*rows):
        before = decoded.value
        packages = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "doc_id string, content binary")
        found = {(r["doc_id"], tuple(c["value"] for c in r["cells"]), r["error"] is None) for r in store.decoded(packages, decode, f"{tmp_path}/store").collect()}
        return found, decoded.value - before

    a = ("a.csv", b"x,y\n1,2\n")
    first = {("a.csv", ("x", "y", "1", "2"), True), ("copy.csv", ("x", "y", "1", "2"), True), ("bad.xlsx", (), False)}
    assert run(a, ("copy.csv", a[1]), ("bad.xlsx", b"PK no package")) == (first, 2)
    assert run(a, ("copy.csv", a[1]), ("bad.xlsx", b"PK no package")) == (first, 0)
    assert run(a, ("a.csv", b"z\n")) == ({("a.csv", ("x", "y", "1", "2"), True), ("a.csv", ("z",), True)}, 1)
    assert run((None, None), ("empty.csv", b""))[1] == 1
    assert run() == (set(), 0)


def test_kept_documents_are_those_decoded(spark, tmp_path):
    rows = [(f"{n}.docx", bytearray(package(p(f"Title {n}") + tbl(["a", str(n)])))) for n in range(5)]
    packages = spark.createDataFrame(rows, "doc_id string, content binary")
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(store.decoded(packages, readers.decode_documents, f"{tmp_path}/s")) == key(readers.decode_documents(packages))


def test_two_runs_of_the_same_content_count_once(spark, tmp_path):
    packages = spark.createDataFrame([("a", bytearray(b"1"))], "doc_id string, content binary")
    store.decoded(packages, readers.decode_tables, f"{tmp_path}/s").collect()
    twice = tables.settled(spark.read.parquet(f"{tmp_path}/s").withColumn("run", F.lit("later")))
    twice.write.mode("append").parquet(f"{tmp_path}/s")
    assert store.decoded(packages, readers.decode_tables, f"{tmp_path}/s").count() == 1


def books(spark, keys):
    recount = spark.createDataFrame([(k, n, 3) for n, k in enumerate(keys)], "key string, place int, matters int")
    return sinks.result_workbooks(recount, recount.limit(0), recount.limit(0), "key", "place")


def save(df, path, mode="append"):
    df.write.format(workbook_files.NAME).mode(mode).save(str(path))


def names(path):
    return sorted(x.name for x in path.iterdir()) if path.exists() else []


def test_workbooks_are_published_whole(spark, tmp_path):
    workbook_files.register(spark)
    out = tmp_path / "out"
    save(books(spark, ["Acme & Co", "a/b", "é"]), out)
    assert names(out) == ["%C3%A9.xlsx", "Acme & Co.xlsx", "a%2Fb.xlsx"]
    assert "xl/workbook.xml" in zipfile.ZipFile(BytesIO((out / "Acme & Co.xlsx").read_bytes())).namelist()
    found = readers.decode_workbooks(readers.files(spark, str(out), "*.xlsx"))
    assert found.filter("sheet = 'Recount' AND row_no = 2 AND value = '3'").count() == 3
    save(books(spark, ["new"]), f"file:{out}")
    with pytest.raises(Exception, match="names in use"):
        save(books(spark, ["newer", "new"]), out)
    assert names(out) == ["%C3%A9.xlsx", "Acme & Co.xlsx", "a%2Fb.xlsx", "new.xlsx"]
    save(books(spark, ["new", "only"]), out, "overwrite")
    assert names(out) == ["new.xlsx", "only.xlsx"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    workbook_files.register(spark)
    fails = F.when(F.col("key") == "k7", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))
    many = spark.range(20, numPartitions=4).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(b"x").alias("content")).withColumn("content", fails)
    with pytest.raises(Exception, match="lost"):
        save(many, tmp_path / "out")
    assert names(tmp_path / "out") == []
    with pytest.raises(Exception, match="several workbooks"):
        save(many.limit(3).select(F.lit("same").alias("key"), F.lit(b"x").alias("content")), tmp_path / "out")
    assert names(tmp_path / "out") == []
