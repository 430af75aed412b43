"""Whitening against dense decompositions."""

import math

import numpy as np
import pytest

from ledgerline.llm import queries, whitening


class Dense:
    """Products with a matrix that is at hand."""

    def __init__(self, x):
        x = np.asarray(x, float)
        self.x, self.size = x - x.mean(0), x.shape[1]

    def products(self, q, earlier):
        u = self.x @ q
        return (self.x @ earlier).T @ u, self.x.T @ u, float(u @ u)


def cases():
    r = np.random.default_rng(3)
    yield r.integers(-100, 100, (400, 24)) + 50 * r.integers(0, 5, (400, 1)) * r.normal(size=(1, 24))
    yield np.floor((r.normal(size=(8, 40)) * 60)[r.integers(0, 8, 500)] + r.normal(size=(500, 40)) * 20)
    yield np.floor(r.normal(size=(60, 90)) * 30)
    yield np.eye(6)
    yield np.hstack([np.vstack([np.eye(5), -np.eye(5)]) @ np.diag([5, 5, 3, 2, 1]), np.zeros((10, 2))])
    yield np.zeros((5, 4))
    yield np.outer(np.arange(5), [1, 2, 3])
    yield r.integers(0, 9, (3, 6))
    yield [[3]]
    yield [[3], [4]]


@pytest.mark.parametrize("x", list(cases()))
def test_leading_triplets(x):
    """Flat and steep spectra, equal values, fewer rows or dimensions than asked for, none."""
    dense = Dense(x)
    vectors, values = whitening.leading(dense, 4)
    want = np.linalg.svd(dense.x, compute_uv=False)[:4]
    want = want[want > 1e-10 * max(want.max(initial=0), 1e-300)]
    assert values == pytest.approx(want, rel=1e-10)
    if len(want):
        assert vectors.T @ vectors == pytest.approx(np.eye(len(want)), abs=1e-10)
        assert np.linalg.norm(dense.x.T @ (dense.x @ vectors) - vectors * values**2) < 1e-10 * values[0] ** 2


def exact(rows, k=4):
    """vec_id, component, n, deviation, |whitened|, explained by dense decomposition."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(x) for _, x in whole), default=0)
    whole = [(i, x + [0] * (size - len(x))) for i, x in whole]
    distinct = sorted({tuple(x) for _, x in whole})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    if not n or not size:
        return []
    centred = np.array(distinct, float) - np.array(sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in whole:
        for c in range(min(k, int((e > 1e-9 * max(e[0], 1e-300)).sum()))):
            y = (np.array(x) - np.array(sums) / n) @ v[:, c] / math.sqrt(e[c])
            out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), y, e[c] / e.sum()))
    return out


def test_op11(spark, tmp_path):
    """Null vectors and entries, not finite ones, copies, short vectors, null and repeated ids."""
    r = np.random.default_rng(9)
    basis = r.normal(size=(3, 6))
    rows = [(int(k), [float(c) for c in (r.normal(size=3) * [3, 2, 1] @ basis + 0.1 * r.normal(size=6)).astype(np.float32)]) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(200)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (900, rows[5][1][:4]), (901, [])]
    rows += [(902, None), (903, [None] * 6), (904, [float("nan")] + [0.0] * 5), (905, [float("inf")] * 6), (906, [-0.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_whitening"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    order = lambda x: (x[1], x[0] is None, x[0] or 0, x[3], abs(x[4]))
    got = sorted((tuple(x) for x in got.collect()), key=order)
    want = sorted(exact(rows), key=order)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert max(x[6] for x in got) < 1e-10
    for c in range(1, 5):
        mine, theirs = ([x for x in side if x[1] == c] for side in (got, want))
        assert [x[5] for x in mine] == pytest.approx([x[5] for x in theirs], rel=1e-9)
        sign = np.sign(sum(a[4] * b[4] for a, b in zip(mine, theirs, strict=True)))
        assert [sign * x[4] for x in mine] == pytest.approx([x[4] for x in theirs], rel=1e-7, abs=1e-9)


def test_few_or_no_vectors(spark):
    kind = "id int, embedding array<double>, n string"
    none = whitening.whiten(spark.createDataFrame([], kind))
    assert none.collect() == [] and none.columns == ["row", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], "x"), (2, [2.0, 3.0], "x"), (3, None, "x")], kind)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], "x"), (2, [4.0, 3.0], "y")], kind)).collect()
    assert sorted((r["row"]["n"], r["component"], r["n"], abs(r["whitened"]), r["explained"]) for r in two) == [("x", 1, 2, pytest.approx(1), pytest.approx(1)), ("y", 1, 2, pytest.approx(1), pytest.approx(1))]


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(1, [1e16, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1e300, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "id int, embedding array<double>"), k=1).collect()
    assert {r["row"]["id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: None}
