"""The corpus pipeline, stage by stage, against brute force on planted documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import leaks_by_force, prints_by_force, prose, removed_by_force


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    item = prose(500, 40)
    shared = prose(501, 60)
    say = lambda n: ". ".join(prose(n * 31 + k, 9, 3000).capitalize() for k in range(14)) + "."
    rows = [(n, say(n)) for n in range(40)]
    rows += [(100 + n, say(n)) for n in range(5)]  # copies
    rows += [(200 + n, say(60 + n) + " " + shared + ". " + say(80 + n)) for n in range(5)]  # a repeated passage
    rows += [(300 + n, say(120 + n) + " " + item + ". " + say(140 + n)) for n in range(3)]  # leaks
    rows += [(400 + n, " ".join(w + "$$$" for w in prose(n, 120).split())) for n in range(20)]  # junk
    rows += [(450 + n, (prose(900 + n, 1) + " ") * 150) for n in range(20)]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(d < 400), 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, [(1, item)]


def test_stages(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    (_, quality), (_, near), (_, repeats), (_, leaks), (_, packing) = corpus_pipeline.STAGES

    docs = quality(spark, docs, at).cache()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns
    assert set(kept) == {d for d, _ in rows if d < 400}

    docs = near(spark, docs, at).cache()
    prints = {d: prints_by_force(t) for d, t in kept.items()}
    first = {d for d in kept if not any(e < d and (prints[e] ^ prints[d]).bit_count() <= 4 for e in kept)}
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns
    assert set(kept) == first
    assert not set(range(100, 105)) & first

    docs = repeats(spark, docs, at).cache()
    want = removed_by_force(kept.items())
    after = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns
    for d, t in kept.items():
        assert after[d]["text"].encode() == want[d, t][2]
        assert after[d]["n_chars"] == len(after[d]["text"])
    assert len(after[204]["text"]) < len(kept[204])

    kept = {d: r["text"] for d, r in after.items()}
    docs = leaks(spark, docs, at).cache()
    gone = {d for d, _ in leaks_by_force(kept.items(), items)}
    assert docs.columns == columns
    assert {r["doc_id"] for r in docs.collect()} == set(kept) - gone
    assert 300 in gone

    packed = packing(spark, docs, at)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept) - gone
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_leaks_without_an_id(spark, folder):
    at, _, items = folder
    leak = prose(1, 30) + " " + items[0][1]
    rows = [(None, leak), (None, leak), (None, prose(2, 60)), (None, None), (1, leak), (1, prose(3, 60)), (2, prose(4, 60))]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.benchmark_decontamination(spark, docs, at).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted([("None", prose(2, 60)), ("None", ""), ("1", prose(3, 60)), ("2", prose(4, 60))])


def test_run_is_the_stages_in_order(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{folder[0]}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


FIELDS = "doc_id long, text string, lang string, spans string, kept string, kept_text string, score double, fp long, row string, rid long, label string, doc long, th long, text_key string, words string, _doc string, _th string, _spans string"


def odd_rows(*texts):
    """Rows with every column null in turn, repeated ids, repeated rows and names that stages use themselves."""
    rest = ("en", "s", "k", "t", 0.5, 3, "r", 4, "l", 5, 6, "x", "w", "a", "b", "c")
    rows = [(n, t, *rest) for n, t in enumerate(texts)]
    rows += [(None, texts[0], *rest), (None, None, *[None] * len(rest)), (0, texts[1], *rest), (1, texts[1], *rest), (77, "", *rest), (78, " \n", *rest)]
    rows += [(100 + k, texts[2], *[None if k == n else v for n, v in enumerate(rest)]) for k in range(len(rest))]
    return rows


@pytest.fixture(scope="module")
def odd(spark, folder):
    good = [". ".join(prose(7000 + 40 * n + k, 9, 3000).capitalize() for k in range(14)) + "." for n in range(4)]
    rows = odd_rows(*good, ". ".join(prose(9000 + n, 9, 3000).capitalize() for n in range(2500)) + ".")
    return rows, spark.createDataFrame(rows, FIELDS)


def as_rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_quality_of_odd_rows(spark, folder, odd):
    rows, docs = odd
    got = corpus_pipeline.quality_classifier(spark, docs, folder[0])
    assert got.schema == docs.schema
    kept = as_rows(got)
    assert set(kept) <= set(map(str, rows))
    full = [r for r in rows if (r[1] or "").strip()]
    assert [k for k in kept if k in set(map(str, full))] == sorted(map(str, full))  # each as often as it was given


def test_near_duplicates_of_odd_rows(spark, folder, odd):
    rows, docs = odd
    got = corpus_pipeline.simhash_near_dedup(spark, docs, folder[0])
    assert got.schema == docs.schema
    kept = [tuple(r) for r in got.collect()]
    assert set(kept) <= set(rows)
    # one row a text (null and blank ones are alike), under its least id
    least = {}
    for r in rows:
        text = (r[1] or "").strip()
        least[text] = min(least.get(text, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(((r[1] or "").strip(), r[0]) for r in kept) == sorted((t, None if none else d) for t, (none, d) in least.items())
    small = docs.select("doc_id", "text").limit(0).unionByName(spark.createDataFrame([(1, "a b c d e"), (5, "a b c d e"), (5, "f g h i j k"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in corpus_pipeline.simhash_near_dedup(spark, small, folder[0]).collect()) == [(1, "a b c d e"), (5, "f g h i j k")]


def test_repeats_in_odd_rows(spark, folder, odd):
    rows, docs = odd
    got = corpus_pipeline.suffix_array_dedup(spark, docs, folder[0])
    assert got.schema == docs.schema
    want = removed_by_force([r[:2] for r in rows])
    expected = [(r[0], None if r[1] is None else want[r[0], r[1]][2].decode(errors="ignore"), *r[2:]) for r in rows]
    assert as_rows(got) == sorted(map(str, expected))


def test_leaks_in_odd_rows(spark, folder, odd):
    at, _, items = folder
    rows, docs = odd
    leak = (0, rows[3][1] + " " + items[0][1], *rows[0][2:])
    got = corpus_pipeline.benchmark_decontamination(spark, docs.unionByName(spark.createDataFrame([leak, leak], FIELDS)), at)
    assert got.schema == docs.schema
    assert as_rows(got) == sorted(map(str, rows))


def test_packing_of_odd_rows(spark, folder, odd):
    rows, docs = odd
    got = corpus_pipeline.best_fit_packing(spark, docs, folder[0]).collect()
    whole = [r for r in got if r["piece"] == 0]
    assert sorted(str(r["doc_id"]) for r in whole) == sorted(str(r[0]) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_of_empty_tables(spark, folder, odd):
    _, docs = odd
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.limit(0), folder[0])
        assert got.count() == 0, name
        assert name == "best_fit_packing" or got.schema == docs.schema
