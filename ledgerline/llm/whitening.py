"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation (operator 11).

The principal components of vectors x are the right singular vectors of the matrix A whose
rows are the distinct vectors, centred. Bidiagonalisation finds the leading ones from products
with A alone. From a unit vector v it alternates

    u = A v - beta u',  alpha = |u|        and        v' = A^T u - alpha v,  beta = |v'|

each followed by full reorthogonalisation against all earlier u or v. A step is a pass over
the written vectors: a task multiplies its blocks by v, what comes out by the blocks again and
by the earlier u, and emits sums of about the length of a vector. No left vector is stored: as
u is always A p for a known short p, tasks make the earlier ones again from their block, and
A^T of what reorthogonalisation takes away from u is known from the passes before. So what the
driver holds and sends is a few arrays of the length of a vector a step, whatever the number
of rows. The singular values of the small bidiagonal matrix give deviations, its vectors the
components.

It ends when the residuals of the leading triplets vanish, and after a second start,
orthogonal to all before, that brings nothing larger (which an eigenvalue that occurs twice
would)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import row_schema, whole_rows, write_table

#: Vectors of a block; steps of a second start; a residual that counts as none.
BLOCK, AGAIN, TINY = 4096, 8, 1e-15
#: Entries from here on have no 64-bit floor and count as not finite.
LARGEST = 9.0e18


def floors(vector: Column, scale: int) -> tuple[Column, Column]:
    """Whether a vector is whole (not null, all entries finite), and floor(scale * entry)."""
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    whole = vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(scaled(c)) < LARGEST), F.lit(False)))
    return whole, F.transform(vector, lambda c: F.floor(scaled(c)).cast("long"))


class Fit:
    """The distinct vectors, in blocks, and products with them."""

    def __init__(self, vectors: DataFrame, size: int, most: int):
        """vectors: x array<long> of size entries, none beyond most in amount."""
        self.size = size
        kind, width = next((k, w) for k, w in (("smallint", 2), ("int", 4), ("bigint", 8)) if most < 1 << 8 * w - 1)
        self.kind = f"<i{width}"
        distinct = vectors.select(F.col("x").cast(f"array<{kind}>").alias("x")).distinct()
        stored = self.kind

        def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for at in range(0, part.num_rows, BLOCK):
                    x = part.column("x").slice(at, BLOCK)
                    block = np.asarray(x.flatten()).reshape(len(x), size)
                    sums = block.sum(axis=0, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([block.astype(stored).tobytes()], pa.binary()), pa.array([sums], pa.list_(pa.int64()))], ["n", "block", "sums"])

        self.blocks = write_table(distinct.mapInArrow(pack, "n long, block binary, sums array<bigint>"), "vectors")
        self.n = int(self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        entries = self.blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
        self.sums = [0] * size
        for r in entries:
            self.sums[r["i"]] = int(r["s"])
        self.mean = np.array(self.sums, float) / max(self.n, 1)

    def summed(self, of_block) -> np.ndarray:
        """The sum over all blocks of what of_block makes of the centred vectors of one: an
        array of some length that depends on the size of a vector only."""
        size, mean, stored = self.size, self.mean, self.kind

        def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for part in parts:
                for raw in part.column("block"):
                    total = total + of_block(np.frombuffer(raw.as_buffer(), stored).reshape(-1, size) - mean)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        rows = self.blocks.select("block").mapInArrow(task, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(rows))
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    def products(self, q: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of u = A q: its products with each earlier left vector A p, A^T u, and u u."""

        def both(x: np.ndarray) -> np.ndarray:
            u = x @ q
            return np.concatenate([(x @ earlier).T @ u, x.T @ u, [u @ u]])

        out, n = self.summed(both), earlier.shape[1]
        return out[:n], out[n:-1], float(out[-1])


def _apart(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v without its parts along basis, taken twice as rounding asks for."""
    for _ in range(2 if basis else 0):
        b = np.array(basis)
        v = v - b.T @ (b @ v)
    return v


def leading(fit: Fit, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k leading right singular vectors of the centred vectors, as columns, and their
    singular values; fewer where the rest are zero."""
    rng, size = np.random.default_rng(seed), fit.size
    right: list[np.ndarray] = []  # v, unit and orthogonal
    left: list[np.ndarray] = []  # p, so that u = A p are unit and orthogonal
    backs: list[np.ndarray] = []  # A^T u
    small = np.zeros((0, 0))  # U^T A V: bidiagonal within a start
    ends: list[tuple[int, float]] = []  # where a start was left, and its beta
    known: np.ndarray | None = None
    largest = 0.0

    while len(right) < size:
        # from A^T A of a random vector: what A takes to zero would make the p grow
        v = _apart(fit.products(_apart(rng.standard_normal(size), right), np.zeros((size, 0)))[1], right)
        if np.linalg.norm(v) <= 1e-12 * largest**2 or not v.any():
            break  # nothing is left beside what was found
        v /= np.linalg.norm(v)
        beta, steps, adds = 0.0, 0, True
        while len(right) < size:
            q = v - beta * left[-1] if beta else v
            overlap = np.zeros(len(left))
            p, back_of = np.array(left).reshape(-1, size).T, np.array(backs).reshape(-1, size).T
            for _ in range(2 if left and not beta else 1):  # a new start is taken apart twice
                c, back, square = fit.products(q, p)
                q, overlap = q - p @ c, overlap + c
            back, alpha = back - back_of @ c, float(np.sqrt(max(square - c @ c, 0.0)))
            largest = max(largest, alpha)
            if beta:
                overlap[-1] += beta
            if alpha <= 1e-13 * largest * max(1.0, np.linalg.norm(q)):  # A v lies among the left vectors
                adds = float(np.linalg.norm(overlap)) > 1e-13 * largest
                if adds:
                    small, beta = np.hstack([small, overlap[:, None]]), 0.0
                    right.append(v)
                break
            small = np.block([[small, overlap[:, None]], [np.zeros((1, len(right))), np.array([[alpha]])]])
            right.append(v)
            left.append(q / alpha)
            backs.append(back / alpha)
            z = _apart(back / alpha - alpha * v, right)
            beta = float(np.linalg.norm(z))
            steps += 1
            if beta <= 1e-13 * largest or len(right) == size:
                beta = 0.0
                break
            u, s, _ = np.linalg.svd(small)
            enough = len(s) >= k and (known is None or steps >= AGAIN)
            if enough:
                over = sum((b * np.abs(u[at, :k]) for at, b in [*ends, (len(left) - 1, beta)]), np.zeros(k))
                if (over <= TINY * s[0]).all():
                    break
            v = z / beta
        if not adds and not steps:
            break
        if beta:
            ends.append((len(left) - 1, beta))
        values = np.linalg.svd(small)[1][:k]
        if known is not None and len(known) == len(values) and len(values) == min(k, size) and np.allclose(values, known, rtol=1e-11, atol=0):
            break
        known = values
    if not left:
        return np.zeros((size, 0)), np.zeros(0)
    _, s, vt = np.linalg.svd(small)
    found = min(k, int((s > 1e-12 * s[0]).sum()))
    vectors = np.array(right).T @ vt[:found].T
    return vectors / np.linalg.norm(vectors, axis=0), s[:found]


def whiten(df: DataFrame, vector: str = "embedding", k: int = 4, scale: int = 256, seed: int = 42) -> DataFrame:
    """row (df's columns as a struct), component (1 to k), n (distinct vectors), deviation,
    whitened, explained, identity_error, for each row whose vector is whole.

    x = floor(scale * entry), as integers. Sums of x and deviation (the sum over dimensions of
    (n x - sum)^2) are exact; a deviation beyond 64 bits is null. Components belong to the
    distinct x, so copies of a row change nothing.

    Rows whose vector is null or holds null, not finite or (beyond 64 bits) too large entries
    go. A vector shorter than others counts as filled up with zeros. Components without
    deviation (fewer distinct vectors or dimensions than k) have no rows. Null and repeated
    ids are like any other; repeated rows each get their rows; equal deviations leave the
    directions free, as in any decomposition. An empty table gives no rows."""
    named = F.col(f"`{vector}`")
    whole, x = floors(named, scale)
    valid = df.filter(whole)
    facts = valid.select(x.alias("x")).agg(F.max(F.size("x")), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()
    size, most = int(facts[0] or 0), int(facts[1] or 0)
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(named)))
    rows = whole_rows(valid, x=filled)
    schema = row_schema(rows, "deviation long, whitened array<double>")
    basis, values, n, sums, mean = np.zeros((size, 0)), np.zeros(0), 0, [0] * size, np.zeros(size)
    explained, off = np.zeros(0), 0.0
    if size:
        fit = Fit(rows, size, most)
        n, sums, mean = fit.n, fit.sums, fit.mean
        basis, values = leading(fit, min(k, size), seed)
    found = len(values)
    deviations = values / np.sqrt(max(n, 1))
    if found:
        made = lambda v: np.concatenate([(y := v @ (basis / deviations)).sum(0), (y.T @ y).ravel(), [np.square(v).sum()]])
        checks = fit.summed(made)
        centre = checks[:found] / n
        off = float(np.abs(checks[found:-1].reshape(found, found) / n - np.outer(centre, centre) - np.eye(found)).max())
        explained = deviations**2 / (checks[-1] / n)
    fits = size * (n * most + max((abs(s) for s in sums), default=0)) ** 2 < 1 << 63

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "deviation", "whitened"]
        for part in parts:
            at = part.column("x")
            block = np.asarray(at.flatten()).astype(np.int64).reshape(part.num_rows, size)
            if fits:
                far = pa.array(np.square(n * block - np.array(sums, np.int64)).sum(axis=1), pa.int64())
            else:
                exact = [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in block.tolist()]
                far = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            y = (block - mean) @ basis / deviations
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, found, dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("row"), far, lists], names)

    if not found:
        done = rows.limit(0).select("row", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened"))
    else:
        done = rows.mapInArrow(project, schema)
    each = done.select("row", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(e)) for e in (explained if found else [0.0]))), F.col("place") + 1)
    return each.select("row", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(off).alias("identity_error"))
