"""Runs of words against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import periodic_runs, queries


def runs_by_force(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > a and i + q - a >= max(least, 2 * q):
                found.setdefault((a, i + q - a), q)
            i += i == a
    return sorted((a, size, q) for (a, size), q in found.items())


def some_texts(rng, most=70):
    for _ in range(rng.randint(0, 4)):
        kinds = rng.choice([1, 2, 3, 30])
        words = [rng.randrange(kinds) for _ in range(rng.randint(0, most))]
        if words and rng.random() < 0.5:
            at = rng.randrange(len(words))
            words[at:at] = [rng.randrange(kinds) for _ in range(rng.randint(1, 9))] * rng.randint(2, 7)
        yield words


@pytest.mark.parametrize("shared, at_once", [(16_384, 1_000_000), (40, 50)])
def test_runs_against_brute_force(monkeypatch, shared, at_once):
    """With one table of grid points for all texts and with their own, asked in small parts."""
    monkeypatch.setattr(periodic_runs, "SHARED_GRID", shared)
    monkeypatch.setattr(periodic_runs, "QUERIES_AT_ONCE", at_once)
    periodic_runs._shared_grid.cache_clear()
    rng = random.Random(shared)
    for _ in range(400):
        texts = list(some_texts(rng))
        got = periodic_runs.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in x.tolist()] for x in got] == [runs_by_force(t) for t in texts]
    periodic_runs._shared_grid.cache_clear()


def test_extensions_to_both_sides():
    rng = random.Random(8)
    for _ in range(100):
        word = [rng.randrange(3) for _ in range(rng.randint(1, 5))]
        ids = np.array([9, *(word * rng.randint(2, 40))[: rng.randint(4, 120)], 10], np.int64)
        pairs = [sorted(rng.sample(range(1, len(ids) - 1), 2)) for _ in range(30)]
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        grammar = periodic_runs.Grammar(ids, 9)
        for step in (1, -1):
            want = []
            for i, j in pairs:
                size = 0
                while ids[i + step * size] == ids[j + step * size]:
                    size += 1
                want.append(size)
            assert grammar.extensions(a, b, step).tolist() == want


def rewritten(doc_id, words):
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = rewritten(doc_id, (text or "").encode().split())
    runs = sorted(runs_by_force(words), key=lambda r: (r[0], r[2]))
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    collapsed = b" ".join(w for k, w in enumerate(words) if k not in gone)
    said = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def test_op13(spark, tmp_path):
    """Nulls, blanks, ids that repeat or are null, ties, white space that is not ASCII, long texts."""
    rng = random.Random(1)
    pool = ["a", "b", "é", "日本", "x y", "c.", "d"]
    texts = [" ".join(rng.choice(pool[: rng.randint(1, 7)]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += [None, "", " \t\n\x0b\x0c\r", "one", "a " * 3000, ("a b c\t" * 9 + "z " + "b c a\n" * 9), " ".join(str(k % 901) for k in range(3000)), "x y " * 20]
    rows = [(k * 7, t) for k, t in enumerate(texts)] + [(7, texts[1]), (7, texts[1]), (7, texts[2]), (None, texts[3]), (None, "a " * 30)]
    spark.createDataFrame([(d, t, "row", 5) for d, t in rows], "doc_id long, text string, row string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    order = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted((expected(d, t) for d, t in rows), key=order)


def test_own_interface(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 8 + "y", 3)], "doc_id long, text string, n_words int")
    r = periodic_runs.find_runs(docs).first()
    assert (r["row"]["n_words"], r["n_words"], r["collapsed"]) == (3, 18, "x a b y")
    assert [tuple(x) for x in r["runs"]] == [(1, 16, 2)]
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
