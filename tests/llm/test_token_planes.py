"""Operator 1: ids on disk against encoding every text whole."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, normalizers

from ledgerline.llm import token_planes as tp
from ledgerline.llm import tokens
from ledgerline.llm.tokens import TextEncoder

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PLAIN = {}
for path in (WORDS, BYTES):
    PLAIN[path] = Tokenizer.from_file(path)
    PLAIN[path].encode_special_tokens = True
MEMO = {path: TextEncoder(path) for path in (WORDS, BYTES)}

texts = st.text(st.sampled_from("aB çéß'İΣœ9²½ .,!\n\t\x1c\x85\xa0　ﬁ日") | st.characters(exclude_categories=["Cs"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4))
def test_memo_equals_whole_texts(some):
    for path, plain in PLAIN.items():
        got = MEMO[path].encode([*some, None])
        assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in some] + [[]]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 60_000, n).astype(np.uint32)
    assert tp.from_planes(tp.to_planes(ids, 2, kind), n, 2).tolist() == ids.tolist()


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_crc32_join(a, b):
    assert tp.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(rows):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*PLAIN[WORDS].encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip(spark, tmp_path, kind):
    rows = [(5, "The cat sat"), (2, None), (3, ""), (9, "long words " * 400), (None, "no id"), (4, "twice"), (4, "twice"), (1, "a  b\n\nc")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, shard string, chunk int")
    tp.write_token_file(docs, f"{tmp_path}/f", WORDS, 2, block=64, kind=kind, shards=3)
    got = [tuple(r)[:4] for r in tp.read_token_file(spark, f"{tmp_path}/f").orderBy("start").collect()]
    assert got == expected(rows)


def test_empty_table(spark, tmp_path):
    tp.write_token_file(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", WORDS, 2)
    assert tp.read_token_file(spark, f"{tmp_path}/e").count() == 0


def test_width_follows_the_ids(spark, tmp_path):
    assert [tp.width_of(n) for n in (0, 255, 256, 65_535, 65_536, 2**32 - 1)] == [1, 1, 2, 2, 4, 4]
    with pytest.raises(ValueError, match="does not fit"):
        tp.to_planes(np.array([70_000, 5], np.uint32), 2, "byte")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tp.write_token_file(docs, f"{tmp_path}/wide", WORDS, 70_000, kind="bit")
    ids = np.array([*PLAIN[WORDS].encode("a b", add_special_tokens=False).ids, 70_000], "<u4")
    assert tp.read_token_file(spark, f"{tmp_path}/wide").first()["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_other_vocabularies_are_encoded_whole(tmp_path):
    other = Tokenizer.from_file(BYTES)
    other.normalizer = normalizers.Lowercase()
    other.save(f"{tmp_path}/other.json")
    assert tokens.kind_of(PLAIN[WORDS]) == "words"
    assert tokens.kind_of(PLAIN[BYTES]) == "bytes"
    assert tokens.kind_of(other) is None
    some = ["Ab C\n d", "", None]
    assert [x.tolist() for x in TextEncoder(f"{tmp_path}/other.json").encode(some)] == [other.encode(t or "", add_special_tokens=False).ids for t in some]


def test_one_id_for_many_rows(spark, tmp_path):
    rows = [(7, f"row {n % 40} x" * 5) for n in range(200)] + [(8, "last")]
    tp.write_token_file(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/f", WORDS, 2, shards=4)
    got = tp.read_token_file(spark, f"{tmp_path}/f").orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == expected(rows)
    assert len({r["shard"] for r in got}) > 2
