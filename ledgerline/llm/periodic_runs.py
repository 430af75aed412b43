"""Periodic stretches of words, found by recompression (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
of at least max(12, 2 q) words that no neighbouring word extends keeping period q.

Candidates lie on harmonic grids: a run of period q and at least 2 q words covers exactly one
pair of grid points (i, i + q), i a multiple of q, with i less than q after its start. All
pairs of a text are n/1 + n/2 + ... = n log n; those whose two words are equal are extended
to either side by longest common extensions, and a run is what reaches 2 q words.

Extensions are answered by a grammar. Recompression alternates two steps on the word ids:
stretches of one symbol become one symbol (block compression), then every symbol with bit 0
merges with a right neighbour of bit 1 (pair compression); bits are fixed per symbol, so
equal stretches are compressed alike but at their ends. A query climbs: on each level it
matches at most one symbol or block, after which both sides stand at symbols of the next
level; where symbols differ it descends, matching at most one child or block a level. That is
exact, needs no suffix array and O(log n) steps; all queries of a batch of texts go through a
level together, as numpy arrays. Levels are built only as long as some query still climbs.

Every text is worked on in the task that reads it: no shuffle, nothing gathered. A task holds
the words of about BATCH_WORDS at a time, or of one longer text."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import row_schema, small_batches, whole_rows

#: Words of texts that are compressed together; the shortest run; queries answered together;
#: texts up to this length share one table of grid points, longer ones make theirs as they go.
BATCH_WORDS, LEAST, QUERIES_AT_ONCE, SHARED_GRID = 200_000, 12, 1_000_000, 16_384
RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string, collapsed_sha256 string"


class Grammar:
    """Levels of symbols over a sequence of ids, each derived from the one below: odd levels
    by blocks, even ones by pairs. Ids from `walls` on stand between texts; each occurs once
    and is never merged."""

    def __init__(self, ids: np.ndarray, walls: int):
        self.symbols = [ids]
        self.starts = [np.arange(len(ids) + 1)]  # first word of each symbol, and the end
        self.walls = [ids >= walls]
        self.parents: list[np.ndarray] = []  # of each symbol of a level, its place on the next
        self.firsts: list[np.ndarray] = []  # of each symbol of the next level, its first child, and the end
        self.rights: list[np.ndarray | None] = []  # pair levels: the bit of each symbol of the level below

    def grow(self) -> None:
        level = len(self.parents)
        symbols, walls = self.symbols[level], self.walls[level]
        n = len(symbols)
        new = np.ones(n, bool)  # where a symbol of the next level begins
        if level % 2 == 0:
            new[1:] = symbols[1:] != symbols[:-1]
            self.rights.append(None)
        else:
            right = ((symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> np.uint64(61) & np.uint64(1)).astype(bool)
            inside = ~(walls[1:] | walls[:-1])
            forward, backward = ~right[:-1] & right[1:] & inside, right[:-1] & ~right[1:] & inside
            if backward.sum() > forward.sum():
                right, forward = ~right, backward
            new[1:] = ~forward
            self.rights.append(right)
        first = np.flatnonzero(new)
        firsts = np.append(first, n)
        size = np.diff(firsts)
        last = symbols[firsts[1:] - 1]
        # a block is its symbol and length, a pair its two symbols; a lone symbol of a pair
        # level is the pair of itself and nothing
        key = np.stack([symbols[first], size if level % 2 == 0 else np.where(size == 2, last, -1)], axis=1)
        span = int(key[:, 1].max(initial=0)) + 2
        _, named = np.unique(key[:, 0].astype(np.int64) * span + key[:, 1] + 1, return_inverse=True)
        self.firsts.append(firsts)
        self.parents.append(np.cumsum(new) - 1)
        self.symbols.append(named.astype(np.int64))
        self.starts.append(self.starts[level][firsts])
        self.walls.append(walls[first])

    def extensions(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words from a and from b on are the same, to the right (step 1) or, a and b
        included, to the left (step -1). a and b differ and no text reaches beyond a wall."""
        began = a.copy()
        which = np.arange(len(a))
        fallen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # queries that stop climbing, a level
        level = 0
        while len(which):
            if level == len(self.parents):
                self.grow()
            symbols, firsts, parents = self.symbols[level], self.firsts[level], self.parents[level]
            same = symbols[a] == symbols[b]
            if level % 2 == 0:
                above, below = parents[a], parents[b]
                if step > 0:
                    left_a, left_b = firsts[above + 1] - a, firsts[below + 1] - b
                else:
                    left_a, left_b = a - firsts[above] + 1, b - firsts[below] + 1
                go = np.where(same, np.minimum(left_a, left_b), 0)
                climbs = same & (left_a == left_b)
            else:
                go = np.where(same & (self.rights[level][a] == (step > 0)), 1, 0)
                climbs = same
            a, b = a + step * go, b + step * go
            stay = ~climbs
            fallen.append((which[stay], a[stay], b[stay]))
            which, a, b = which[climbs], parents[a[climbs]], parents[b[climbs]]
            level += 1
        out = np.empty(len(began), np.int64)
        which = np.empty(0, np.int64)
        a = b = which
        for level in range(level - 1, -1, -1):
            if len(which):  # symbols above differ: what their children share is matched
                firsts, symbols = self.firsts[level], self.symbols[level]
                if step > 0:
                    above, below, a, b = a, b, firsts[a], firsts[b]
                else:
                    above, below, a, b = a, b, firsts[a + 1] - 1, firsts[b + 1] - 1
                same = symbols[a] == symbols[b]
                if level % 2 == 0:
                    go = np.where(same, np.minimum(np.diff(firsts)[above], np.diff(firsts)[below]), 0)
                else:
                    go = same.astype(np.int64)
                a, b = a + step * go, b + step * go
            more, more_a, more_b = fallen[level]
            which, a, b = np.concatenate([which, more]), np.concatenate([a, more_a]), np.concatenate([b, more_b])
        out[which] = step * (a - began[which])
        return out


@lru_cache(maxsize=1)
def _shared_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, i + q), i a multiple of q, of texts up to SHARED_GRID words, ordered by their
    second point; and how many have it below n, for every n."""
    j = np.concatenate([np.arange(q, SHARED_GRID, q, dtype=np.int32) for q in range(1, SHARED_GRID)])
    q = np.concatenate([np.full((SHARED_GRID - 1) // q, q, np.int32) for q in range(1, SHARED_GRID)])
    order = np.argsort(j, kind="stable")
    j, q = j[order], q[order]
    return j - q, j, np.searchsorted(j, np.arange(SHARED_GRID + 1))


def _candidates(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First grid points and periods of pairs of equal words, in parts."""
    n = len(ids)
    if n <= SHARED_GRID:
        i, j, below = _shared_grid()
        i, j = i[: below[n]], j[: below[n]]
        hit = np.flatnonzero(ids[i] == ids[j])
        q = j[hit] - i[hit]
        fits = 2 * q <= n
        yield i[hit][fits].astype(np.int64), q[fits].astype(np.int64)
        return
    held, parts = 0, []
    for q in range(1, n // 2 + 1):
        grid = ids[::q]
        hit = np.flatnonzero(grid[:-1] == grid[1:]) * q
        if len(hit):
            parts.append((hit, np.full(len(hit), q)))
            held += len(hit)
            if held >= QUERIES_AT_ONCE:
                yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                held, parts = 0, []
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, as word ids from 0, its runs: rows of start, length, period, in order of
    start, then period."""
    sizes = [len(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    walls = max((int(t.max(initial=-1)) for t in texts), default=-1) + 1
    whole = np.empty(offsets[-1] + 1, np.int64)
    whole[0] = walls
    for k, t in enumerate(texts):
        whole[offsets[k] + 1 : offsets[k] + 1 + len(t)] = t
        whole[offsets[k + 1]] = walls + k + 1
    grammar = Grammar(whole, walls)
    found: list[np.ndarray] = []

    def ask(first: np.ndarray, period: np.ndarray) -> None:
        ahead = grammar.extensions(first, first + period, 1)
        behind = grammar.extensions(first - 1, first + period - 1, -1)
        length = ahead + behind + period
        run = (length >= 2 * period) & (length >= least) & (behind < period)
        found.append(np.stack([first - behind, length, period], axis=1)[run])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for k, t in enumerate(texts):
        for i, q in _candidates(t):
            for at in range(0, len(i), QUERIES_AT_ONCE):
                waiting.append((i[at : at + QUERIES_AT_ONCE] + offsets[k] + 1, q[at : at + QUERIES_AT_ONCE]))
                held += len(waiting[-1][0])
                if held >= QUERIES_AT_ONCE:
                    ask(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                    held, waiting = 0, []
    if waiting:
        ask(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
    runs = np.concatenate([np.empty((0, 3), np.int64), *found])
    # a stretch found with several periods has the least as its own; the others are multiples
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], offsets + 1)
    return [runs[a:b] - [[int(o) + 1, 0, 0]] for a, b, o in zip(bounds[:-1], bounds[1:], offsets[:-1], strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the original words that a document's words become, or None if they stay: of
    one in ten documents the words from some place on repeat with a period. All choices come
    from the crc32 of doc_id in decimal; a document without an id stays."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def find_runs(docs: DataFrame, text: str = "text", rewrite: Callable[[int | None, int], np.ndarray | None] | None = None, doc_id: str = "doc_id", texts: bool = True) -> DataFrame:
    """row (docs' columns as a struct), n_words, runs (start, length, period; by start, then
    period), runs_sha256 (of a line `start,length,period` each), collapsed (the words that no
    run contains after its first period, joined by one space; null unless texts) and its
    sha256. Words are stretches without ASCII white space.

    rewrite(doc_id, n), if given, names the places of the words to take instead.

    A null or blank text has no words, no runs and an empty collapsed text. Ids may be null or
    repeat: every row is judged by itself, repeated rows alike. Columns of other names stay in
    row. A very long text is a batch of its own. An empty table gives no rows."""
    rows = whole_rows(docs, own_text=docs[text].cast("string"), own_id=docs[doc_id].cast("long"))
    schema = row_schema(rows, RUNS)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(group: list[pa.RecordBatch], words: list[list[bytes]], ids: list[np.ndarray]) -> pa.RecordBatch:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for own, runs in zip(words, runs_of(ids), strict=True):
                left = b" ".join(np.array(own, object)[kept_words(len(own), runs)]) if len(runs) else b" ".join(own)
                values = runs.tolist()
                said = "".join(f"{s},{size},{q}\n" for s, size, q in values)
                columns[0].append(len(own))
                columns[1].append([{"start": s, "length": size, "period": q} for s, size, q in values])
                columns[2].append(hashlib.sha256(said.encode()).hexdigest())
                columns[3].append(left.decode("utf-8", "replace") if texts else None)
                columns[4].append(hashlib.sha256(left).hexdigest())
            row = pa.concat_arrays([part.column("row") for part in group])
            kinds = (pa.int64(), run_type, pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([row, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", "n_words", "runs", "runs_sha256", "collapsed", "collapsed_sha256"])

        group: list[pa.RecordBatch] = []
        words: list[list[bytes]] = []
        ids: list[np.ndarray] = []
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        held = 0
        for part in small_batches(parts, column="own_text", size=2_000_000):
            group.append(part)
            for doc, whole in zip(part.column("own_id").to_pylist(), part.column("own_text").cast(pa.binary()).to_pylist(), strict=True):
                own = (whole or b"").split()  # bytes: splits at ASCII white space only
                named = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                place = rewrite(doc, len(own)) if rewrite else None
                if place is not None:
                    own, named = [own[k] for k in place.tolist()], named[place]
                words.append(own)
                ids.append(named)
                held += len(own)
            if held >= BATCH_WORDS:
                yield results(group, words, ids)
                group, words, ids, held = [], [], [], 0
                number = defaultdict(count().__next__)
        if group:
            yield results(group, words, ids)

    return rows.mapInArrow(judge, schema)
