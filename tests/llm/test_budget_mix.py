"""Mixing to budgets: targets against plain arithmetic, sums against exhaustive search."""

import random
from itertools import product

import pytest

from ledgerline.llm import budget_mix, queries


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in fixed)
        units = sum(w for s, w in weight.items() if s not in fixed)
        out = {s: most * sizes[s] if s in fixed else weight[s] * left / units for s in order}
        above = {s for s in order if out[s] > most * sizes[s]}
        if not above:
            return out
        fixed |= above


def test_nearest_sum():
    rng = random.Random(4)
    for _ in range(500):
        lengths = rng.sample(range(40), rng.randint(1, 4))
        counts = [rng.randint(1, 4) for _ in lengths]
        words = lambda take: sum(a * b for a, b in zip(lengths, take, strict=True))
        budget = rng.random() * words(counts)
        best = min(abs(words(x) - round(budget)) for x in product(*(range(c + 1) for c in counts)))
        got = budget_mix.fit_counts(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
        assert abs(words(got) - round(budget)) == best
        small = budget_mix.fit_counts(lengths, counts, budget, fitted=30)
        assert all(0 <= g <= c for g, c in zip(small, counts, strict=True))


def test_large_budgets_keep_shares():
    rng = random.Random(5)
    lengths = list(range(1, 3000, 7))
    counts = [rng.randint(1, 50_000) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for part in (0.1, 0.37, 0.999):
        got = budget_mix.fit_counts(lengths, counts, total * part)
        assert abs(sum(a * b for a, b in zip(lengths, got, strict=True)) - total * part) <= 1
        assert all(abs(g - c * part) <= 0.01 * c + 2000 for g, c in zip(got, counts, strict=True))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("mix"))
    rng = random.Random(2)
    rows = []
    for k in range(600):
        source = rng.choice(["b", "a", None, "Z", "é", "hot", "hot", "hot", "", "zz"])
        text = rng.choice([None, "", " \t", "x y z", None]) if k % 20 == 0 else "w \n" * rng.randint(1, 30)
        rows.append((None if k % 50 == 7 else k // 2, text, source, "x"))
    rows += [(5, "same text here", "hot", "x")] * 200 + [(900, "long " * 20_000, "hot", "x"), (901, None, "silent", "x"), (902, " ", "silent", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, size string").write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_op12(spark, folder):
    at, rows = folder
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = targets_by_hand(sizes)
    assert any(targets[s] == 2 * sizes[s] > 0 for s in sizes) and any(targets[s] < 2 * sizes[s] for s in sizes)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    mixed = budget_mix.mix(docs).select("row.*", "source_size", "target", "taken", "copies", budget_mix.F.col("size").alias("words")).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"], r["source"], r["size"]) for r in mixed])) == sorted(map(str, rows))
    for s in sizes:
        own = [r for r in mixed if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(r["target"] == pytest.approx(targets[s]) for r in own)
        # as near as any choice comes; the one very long text is most of its source
        passes = int(targets[s] // sizes[s]) if sizes[s] else 0
        sums = 1
        for r in own:
            sums |= sums << r["words"]
        goal = targets[s] - passes * sizes[s]
        best = min(abs(k - goal) for k in range(sums.bit_length()) if sums >> k & 1)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= best + 1
    assert all(r["words"] == size(r["text"]) and r["taken"] == r["copies"] * r["words"] and 0 <= r["copies"] <= 2 for r in mixed)
    got = queries.QUERIES["op12_budget_mix"](spark, at)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "copies": "int"}
    # reruns agree, also over other partitions
    first = sorted(map(str, got.drop("copies").collect()))
    again = budget_mix.mix(docs.repartition(7), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")
    assert first == sorted(map(str, again.collect()))


def test_rows_of_the_mix(spark):
    docs = spark.createDataFrame([(k, "w " * (k + 1), "ab"[k % 2]) for k in range(20)], "doc_id long, text string, source string")
    mixed = budget_mix.mix(docs)
    want = {r["row"]["doc_id"]: r["copies"] for r in mixed.collect()}
    got = {}
    for r in budget_mix.mixed_rows(mixed).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: c for d, c in want.items() if c}
    assert budget_mix.mix(docs.limit(0)).collect() == []
