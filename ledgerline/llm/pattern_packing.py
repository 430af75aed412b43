"""Pattern packing of documents into fixed-size sequences (operator 10).

Documents become pieces of at most capacity tokens; only longer ones are cut, and the
first piece takes the remainder. The histogram of piece lengths, at most capacity bins
whatever the corpus, goes to the driver. There, patterns of up to four lengths on a coarse
grid that fill a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded down, patterns are realised with actual lengths
(the last one is the longest that still fits), and what is left is packed best fit first.
Each (length, rank) then has its place: pieces are ranked within their length in salted
groups, so a length that a third of all rows share is split, and look their place up.

Nulls: a null text is an empty document (its end id alone); a null doc_id is kept. A very
long text is encoded whole and cut into as many pieces as it needs. Of pieces of one length
any may take any place of that length; which does changes no sequence's length. Repeated rows are packed each. Empty tables give no rows; other columns are ignored."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import write_table
from ledgerline.llm.tokens import batches, encoder

#: Bins of the coarse grid, and parts of a pattern.
GRID, PARTS = 128, 4
#: Groups that a length is split into for ranking, at least; more where a group would pass ROWS.
SALTS, ROWS = 64, 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """PIECES of each document, with ids (little-endian unsigned 32-bit) if asked for."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary), np.array([end_id], np.uint32)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for part in parts:
            docs_, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            for a, b in batches(texts):
                rows = []
                for doc, ids in zip(docs_[a:b], words.encode(texts[a:b]), strict=True):
                    raw = np.concatenate([ids, end]).astype("<u4")
                    cuts = [0, *range(len(raw) % capacity or capacity, len(raw) + 1, capacity)]
                    for n, (at, to) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = raw[at:to].tobytes()
                        rows.append((doc, n, at, to - at, zlib.crc32(own), own))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(names))], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, PIECES + (", ids binary" if keep_ids else ""))


def patterns(total: int, parts: int, most: int | None = None) -> Iterator[tuple[int, ...]]:
    """Ways to write total as a sum of up to so many positive numbers, largest first."""
    most = min(total, most or total)
    if parts == 1:
        if total <= most:
            yield (total,)
        return
    for first in range(most, 0, -1):
        if first == total:
            yield (first,)
        elif first * parts >= total:
            yield from ((first, *rest) for rest in patterns(total - first, parts - 1, first))


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |matrix x - target| small: the active-set method of Lawson and Hanson."""
    x = np.zeros(matrix.shape[1])
    active: list[int] = []
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = matrix.T @ (target - matrix @ x)
        gain[active] = -np.inf
        if len(active) == matrix.shape[1] or gain.max() <= slack:
            break
        active.append(int(gain.argmax()))
        while active:
            best = np.linalg.lstsq(matrix[:, active], target, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[active] = best
                break
            now = x[active]
            falling = best <= 0
            step = float(np.min(now[falling] / np.maximum(now[falling] - best[falling], 1e-300)))
            x[active] = now + step * (best - now)
            gone = {a for a, b in zip(active, best, strict=True) if x[a] <= slack and b <= 0}
            for a in gone or {active[-1]}:
                x[a] = 0
            active = [a for a in active if a not in (gone or {active[-1]})]
    return x


class _Stock:
    """Pieces left of each length; finds the longest that fits."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = {k: n for k, n in histogram.items() if n}
        self.lengths = sorted(self.left)

    def fitting(self, room: int, taken: dict[int, int]) -> int:
        """The longest length up to room of which more than taken are left, else 0."""
        at = bisect_right(self.lengths, room) - 1
        while at >= 0 and self.left[self.lengths[at]] <= taken.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def take(self, used: dict[int, int], times: int) -> None:
        for k, n in used.items():
            self.left[k] -= n * times
            if not self.left[k]:
                del self.left[k]
                self.lengths.pop(bisect_right(self.lengths, k) - 1)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), for all pieces of histogram."""
    out: list[tuple[tuple[int, ...], int]] = []
    stock = _Stock(histogram)
    grid = min(GRID, capacity)
    bin_of = lambda length: -(-length * grid // capacity)

    def fill(lengths: list[int], most: int) -> int:
        """Fill up one sequence that begins with lengths, and repeat it."""
        used: dict[int, int] = {}
        for k in lengths:
            used[k] = used.get(k, 0) + 1
        room = capacity - sum(lengths)
        while room and (k := stock.fitting(room, used)):
            lengths.append(k)
            used[k] = used.get(k, 0) + 1
            room -= k
        times = min(most, *(stock.left[k] // n for k, n in used.items()))
        stock.take(used, times)
        out.append((tuple(lengths), times))
        return times

    shapes = list(patterns(grid, PARTS))
    matrix = np.zeros((grid, len(shapes)))
    for n, shape in enumerate(shapes):
        np.add.at(matrix[:, n], np.asarray(shape) - 1, 1)
    target = np.zeros(grid)
    for k, n in histogram.items():
        target[bin_of(k) - 1] += n
    repeats = np.floor(nnls(matrix, target) + 1e-6).astype(np.int64)
    for n in sorted(np.flatnonzero(repeats), key=lambda n: shapes[n], reverse=True):
        left = int(repeats[n])
        while left > 0:
            lengths: list[int] = []
            taken: dict[int, int] = {}
            for part in shapes[n][:-1] or shapes[n]:  # the last one is whatever fits best
                k = stock.fitting(part * capacity // grid, taken)
                if not k or bin_of(k) != part:
                    break
                lengths.append(k)
                taken[k] = taken.get(k, 0) + 1
            else:
                left -= fill(lengths, left)
                continue
            break
    while stock.lengths:
        fill([stock.lengths[-1]], stock.left[stock.lengths[-1]])
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, sequence of the first, offset), sorted."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in planned:
        for k, offset in zip(lengths, accumulate((0, *lengths)), strict=False):
            at = rank.get(k, 0)
            rows.append((k, at, at + times, sequence, offset))
            rank[k] = at + times
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    salts = max(SALTS, -(-sum(histogram.values()) // ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside)).join(firsts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("first")).drop("salt", "first")

    kept = pieces.columns

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        step = int(table[:, 2].max(initial=0)) + 1
        firsts = table[:, 0] * step + table[:, 1]
        for part in parts:
            length, rank = (np.asarray(part.column(c)) for c in ("length", "rank"))
            row = table[np.searchsorted(firsts, length * step + rank, "right") - 1]
            columns = [part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*kept, "rank").mapInArrow(place, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """All of the above for doc_id, text of docs."""
    return pack(write_table(cut(docs, vocabulary, end_id, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids
    (binary), and starts, where each document's piece begins. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))
