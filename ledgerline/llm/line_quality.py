"""Quality by a linear-chain conditional random field over lines (operator 4).

Every line of a document is labelled good or bad; its features are its own and those of
the lines before and after it, and neighbouring labels interact. Forward-backward gives
each line's marginal; weighted by line length they add up to the document's score.

The weights are fitted on a bounded sample of labelled rows (SAMPLE documents, chosen by a
hash of doc_id), of which every line teaches its document's label. Tasks turn lines into
feature numbers, ten bytes a line, which are written as a table of chains; a document of
more than CHAIN lines teaches in chains of that many. A step of the fit sums losses and
slopes over that table in tasks, so the driver holds one vector a task, however long the
texts. Scoring reads whole texts: a line
longer than a segment is split at spaces into segments of about SEGMENT characters, so a
text without line ends is a chain too. Features use nothing but the text.

Nulls: a null or empty text is one empty line and gets a score; rows with null labels or
text teach nothing, and labels that disagree on a document count as good. Repeated rows
teach once, and are scored each. Ties: documents whose hashes are equal at the sample's edge
are taken by doc_id; equal texts have equal scores. An empty table gives no rows; without any labelled rows
every score is 0.5. Columns of any other names are ignored, or kept in row."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import remove_table, row_schema, small_batches, whole_rows, write_table

#: Labelled documents that are fitted on, and lines of a chain in fitting.
SAMPLE, CHAIN = 4_000, 128
#: Passes over the chains at most, directions that a step remembers, slope at which the fit
#: ends, weight of the penalty on features (ten times that on moves).
PASSES, MEMORY, FLAT, DECAY = 40, 8, 1e-5, 3e-5
#: Bytes of feature numbers that a task works on at once.
PORTION = 1_000_000
SEGMENT = 600
EDGES = {  # borders of the bins that each measure falls into
    "length": (0, 1, 20, 60, 200, 450),
    "word": (2.0, 3.5, 5.0, 6.5, 9.0),
    "letters": (0.3, 0.6, 0.7, 0.78, 0.85),
    "upper": (0.01, 0.05, 0.15, 0.5),
    "marks": (0.005, 0.03, 0.06, 0.12, 0.25),
    "digits": (0.01, 0.05, 0.2),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),
    "repeats": (0.01, 0.05, 0.2, 0.5),
    "ends": (0.02, 0.05, 0.12, 0.25),
    "bare": (0.02, 0.1, 0.3),
}
OWN = sum(len(v) + 1 for v in EDGES.values())
SIZE = 3 * OWN + 3  # own, before, after; first, last, constant


@dataclass
class LineModel:
    """weights: features by label; moves: score of a label after a label."""

    weights: np.ndarray
    moves: np.ndarray


def lines_of(text: str | None) -> list[str]:
    """Lines; long ones in segments that end at a space where there is one."""
    out = []
    for line in (text or "").split("\n"):
        at = 0
        while len(line) - at > SEGMENT:
            cut = line.rfind(" ", at + SEGMENT // 2, at + SEGMENT)
            cut = cut if cut > 0 else at + SEGMENT
            out.append(line[at:cut])
            at = cut
        out.append(line[at:])
    return out


_UPPER = re.compile("[A-ZÀ-Þ]+")
_DIGITS = re.compile("[0-9]+")
_MARKS = re.compile(r"[^\w\s]+")
_BARE = re.compile(r"(?:^|\s)[^\w\s]+(?=\s|$)")


def measures(line: str) -> tuple[float, ...]:
    """The measures that EDGES bins, in its order."""
    n = len(line)
    words = line.split()
    k = max(1, len(words))
    upper = sum(map(len, _UPPER.findall(line)))
    digits = sum(map(len, _DIGITS.findall(line)))
    runs = _MARKS.findall(line)
    marks = sum(map(len, runs))
    stops = sum(w[-1] in ".!?" for w in words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    size = max(1, n)
    return (n, n / k, 1 - (marks + digits + len(words)) / size, upper / size, marks / size, digits / size, len(set(words)) / k, repeats / k, stops / k, len(_BARE.findall(line)) / k)


def features(lines: list[str]) -> np.ndarray:
    """Active feature numbers of each line: one bin of each measure."""
    table = np.array([measures(x) for x in lines], float)
    out = np.empty(table.shape, np.int64)
    base = 0
    for n, edges in enumerate(EDGES.values()):
        out[:, n] = base + np.searchsorted(edges, table[:, n], "right")
        base += len(edges) + 1
    return out


def chain_scores(own: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores (line, label) of documents' lines one after another; starts: where documents
    begin, and the end."""
    here = weights[own].sum(1)
    before, after = weights[own + OWN].sum(1), weights[own + 2 * OWN].sum(1)
    out = here + weights[-1]
    inner = np.ones(len(own), bool)
    inner[starts[:-1]] = False
    out[inner] += before[np.flatnonzero(inner) - 1]
    inner[:] = True
    inner[starts[1:] - 1] = False
    out[inner] += after[np.flatnonzero(inner) + 1]
    out[starts[:-1]] += weights[-3]
    out[starts[1:] - 1] += weights[-2]
    return out


def forward_backward(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (line, label), pair marginals (line, label before, label), and log of the
    normaliser per document. Works on one position of all documents at a time."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, longest = starts[:-1][order], int(sizes.max(initial=0))
    open_at = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # documents with more than t lines
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    for t in range(longest):
        at = first[: open_at[t]] + t
        alpha[at] = scores[at] if t == 0 else scores[at] + np.logaddexp(alpha[at - 1, :1] + moves[0], alpha[at - 1, 1:] + moves[1])
    for t in range(longest - 2, -1, -1):
        at = first[: open_at[t + 1]] + t
        ahead = beta[at + 1] + scores[at + 1]
        beta[at] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
    total = np.logaddexp(*alpha[starts[1:] - 1].T)
    each = np.repeat(total, sizes)
    marginals = np.exp(alpha + beta - each[:, None])
    pairs = np.zeros((len(scores), 2, 2))
    inner = np.ones(len(scores), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    pairs[at] = np.exp(alpha[at - 1][:, :, None] + moves[None] + (scores + beta)[at][:, None, :] - each[at][:, None, None])
    return marginals, pairs, total


def gathered(rows: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Sum of errors (line, label) over the lines' active features."""
    each = rows.shape[1]
    return np.stack([np.bincount(rows.ravel(), np.repeat(errors[:, y], each), SIZE) for y in (0, 1)], axis=1)


def slopes(own: np.ndarray, starts: np.ndarray, labels: np.ndarray, share: np.ndarray, model: LineModel) -> np.ndarray:
    """Loss of chains one after another, and its slope: loss, then weights, then moves. labels
    and share (what a line of the chain counts) are by chain."""
    sizes = np.diff(starts)
    line_labels, line_share = np.repeat(labels, sizes), np.repeat(share, sizes)
    scores = chain_scores(own, starts, model.weights)
    marginals, pairs, total = forward_backward(scores, model.moves, starts)
    path = np.add.reduceat(scores[np.arange(len(own)), line_labels], starts[:-1]) + (sizes - 1) * model.moves[labels, labels]
    error = (marginals - np.eye(2)[line_labels]) * line_share[:, None]
    inner = np.ones(len(own), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    slope = gathered(own, error) + gathered(own[at - 1] + OWN, error[at]) + gathered(own[at] + 2 * OWN, error[at - 1])
    slope[-1], slope[-3], slope[-2] = error.sum(0), error[starts[:-1]].sum(0), error[starts[1:] - 1].sum(0)
    moves = (pairs[at] * line_share[at, None, None]).sum(0)
    moves[[0, 1], [0, 1]] -= np.bincount(labels, (sizes - 1) * share, 2)
    return np.concatenate([[(share * (total - path)).sum()], slope.ravel(), moves.ravel()])


def model_of(x: np.ndarray) -> LineModel:
    return LineModel(x[: 2 * SIZE].reshape(SIZE, 2), x[2 * SIZE :].reshape(2, 2))


def summed(chains: DataFrame, shares: np.ndarray, x: np.ndarray) -> np.ndarray:
    """slopes of all chains (quality, lines), summed in tasks, in one order of tasks."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 + len(x))
        for part in small_batches(parts, PORTION, "lines", PORTION):
            lines = [np.frombuffer(b, np.uint8).reshape(-1, len(EDGES)) for b in part.column("lines").to_pylist()]
            labels = np.asarray(part.column("quality"), np.int64)
            out += slopes(np.concatenate(lines).astype(np.int64), np.cumsum([0, *map(len, lines)]), labels, shares[labels], model_of(x))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    found = chains.select("quality", "lines").mapInArrow(add, "sums binary").select(F.spark_partition_id().alias("part"), "sums").collect()
    return np.sum([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["part"])], axis=0)


def fit(chains: DataFrame) -> LineModel:
    """Maximum likelihood with a quadratic penalty over written chains (quality, lines), either
    label counting one half, by quasi-Newton steps that remember the last directions."""
    x = np.zeros(2 * SIZE + 4)
    lines = dict.fromkeys((0, 1), 0)
    lines |= {r["quality"]: r["n"] for r in chains.groupBy("quality").agg((F.sum(F.length("lines")) / len(EDGES)).alias("n")).collect()}
    if not any(lines.values()):
        return model_of(x)
    shares = np.array([0.5 / max(1, lines[y]) for y in (0, 1)])
    decay = np.full(len(x), DECAY)
    decay[2 * SIZE :] *= 10

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        found = summed(chains, shares, x)
        return found[0] + (decay * x * x).sum() / 2, found[1:] + decay * x

    loss, slope = at(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []  # moves of x, and changes of the slope with them
    passes, reach = 1, 1.0
    while passes < PASSES and np.abs(slope).max() > FLAT:
        way, back = -slope, []
        for dx, dg in reversed(steps):
            back.append((dx @ way) / (dx @ dg))
            way = way - back[-1] * dg
        if steps:
            way = way * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (dx, dg), a in zip(steps, reversed(back), strict=True):
            way = way + (a - (dg @ way) / (dx @ dg)) * dx
        reach = 1.0 if steps else 1.0 / np.abs(way).max()
        while passes < PASSES:
            passes += 1
            new_loss, new_slope = at(x + reach * way)
            if new_loss <= loss + 1e-4 * reach * (slope @ way):
                break
            reach /= 2
        else:
            break
        dx, dg = reach * way, new_slope - slope
        if dx @ dg > 0:
            steps = [*steps, (dx, dg)][-MEMORY:]
        x, loss, slope = x + dx, new_loss, new_slope
    return model_of(x)


def score_texts(texts: list[str | None], model: LineModel) -> np.ndarray:
    """Length-weighted mean of the good marginals of each text's lines."""
    lines = [lines_of(t) for t in texts]
    starts = np.cumsum([0, *map(len, lines)])
    flat = [x for own in lines for x in own]
    if not flat:
        return np.zeros(0)
    marginals, _, _ = forward_backward(chain_scores(features(flat), starts, model.weights), model.moves, starts)
    weight = np.fromiter(map(len, flat), float, len(flat)) + 1e-6
    sums = np.add.reduceat(np.stack([weight, weight * marginals[:, 1]]), starts[:-1], axis=1)
    return np.clip(sums[1] / sums[0], 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame) -> LineModel:
    """A model from docs (doc_id, text) and labels (doc_id, quality)."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # as many of either label as there are, up to half the sample each
    picked = []
    for label in (0, 1):
        own = known.filter(F.col("quality") == label)
        picked.append(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 2))
    chosen = picked[0].unionByName(picked[1])

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "quality", "text_hash"]
        for part in small_batches(parts):
            found = [features(lines_of(t)).astype(np.uint8) for t in part.column("text").to_pylist()]
            chains = [(row, no, lines[at : at + CHAIN].tobytes()) for row, lines in enumerate(found) for no, at in enumerate(range(0, len(lines), CHAIN))]
            rows, numbers, lines = (list(c) for c in zip(*chains, strict=True)) if chains else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows, pa.int64())) for c in names), pa.array(numbers, pa.int64()), pa.array(lines, pa.binary())], [*names, "no", "lines"])

    taught = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    taught = taught.join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))), "doc_id").withColumn("text_hash", F.xxhash64("text"))
    numbered = taught.mapInArrow(number, "doc_id long, quality int, text_hash long, no long, lines binary")
    once = numbered.distinct().sortWithinPartitions("doc_id", "text_hash", "no")
    chains = write_table(once, "chains")
    model = fit(chains)
    remove_table(chains)
    return model


def scored_rows(docs: DataFrame, model: LineModel) -> DataFrame:
    """row (docs' columns) and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(parts, 200):
            found = score_texts(part.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found)], ["row", "score"])

    rows = whole_rows(docs, text=F.col("text").cast("string"))
    return rows.mapInArrow(compute, row_schema(rows, "score double"))


def score(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, score for each row."""
    return scored_rows(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
