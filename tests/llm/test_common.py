"""Shared helpers: folders, slices, rows as structs."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from ledgerline.llm import common


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default, set=lambda key, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="share"):
        common.shared_folder(fake("spark://host:7077"))
    assert common.shared_folder(fake("spark://host:7077", "file:///shared/")) == "file:///shared"
    assert common.shared_folder(fake("local[2]"))


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * 10] * 5 + ["y" * 100, None, ""] + ["z" * 10] * 5
    part = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(13))], ["text", "n"])
    got = list(common.small_batches([part], 4, "text", 50))
    assert [x for p in got for x in p.column("n").to_pylist()] == list(range(13))
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 50) for p in got)


def test_rows_keep_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, row string, `text.x` string")
    assert common.whole_rows(df).select("row.*").schema == df.schema
