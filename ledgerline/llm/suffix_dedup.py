"""Removal of repeated byte strings by suffix sorting (operator 9).

Every byte covered by a string of STRING bytes that also starts earlier (smaller doc_id,
or same document and earlier start) is removed; overlaps count, strings are judged on the
input, matches never cross documents.

A suffix array of the whole corpus would be one unbounded group, so it is cut into many
small ones that lose nothing. Among any STRING - GRAM + 1 neighbouring grams the one with
the least hash is an anchor; equal strings contain equal anchors at equal places, so they
meet when anchors are dealt by hash. An anchor's context is all that a string through it
can cover. A map task first folds occurrences whose whole contexts have the same bytes as
an earlier one, so of a passage that a third of all documents share about one occurrence a
task is dealt out.

Hashes only decide what is looked at; bytes decide what is removed. The different contexts
of one anchor are suffix-sorted together: two-stage sorting sorts directly only suffixes
smaller than their successors and induces the rest by one scan over the buckets; where
neighbours have a common prefix of STRING bytes, all but the earliest are covered. Contexts
that look like an earlier one's copy (equal hashes) are joined to long runs, and a run and
its source meet likewise: equal bytes cover the later one, anything else is sorted. An
anchor with more than GROUP contexts is sorted in salted blocks, and strings that several
of its blocks seem to hold meet once more, by their bytes.

Long texts are read in overlapping parts of BLOCK bytes. Memory is about 70 bytes for each
byte of a part, and about four times the longest text. Nulls: a null text is empty, a
null doc_id comes first. Rows with equal doc_id and equal text are one document, and each
such row gets its result; with equal doc_id and different texts, the order is that of the
texts' crc32. Empty tables give no rows; columns of any other names are kept in row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import row_schema, shuffled, small_batches, whole_rows, write_table

STRING, GRAM = 100, 40
SIDE = STRING - GRAM  # bytes of context before an anchor, and after its gram
#: Contexts of an anchor that are sorted in one block, and contexts sorted at a time.
GROUP, BATCH = 4_000, 1_000
#: Bytes of text that a task works on at a time.
BLOCK = 1_000_000
#: Contexts that a task remembers because they came again, and bytes of a run that are sent
#: as one piece.
HOT, PIECE = 50_000, 16_384
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_PLACE = np.uint64(2**31 - 1)

KEYS = "doc long, th long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Polynomial hashes of any range of a block, from prefix sums modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, raw: np.ndarray) -> None:
        n = len(raw) + 1
        if len(self.up) < n:
            grown = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
            grown[0][0] = grown[1][0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in grown)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return _mixed((self.sums[GRAM:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def anchors(rolling: RollingHash, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of the strings that start in [first, last) of
    each part of the block that rolling holds."""
    grams = rolling.grams()
    if len(grams) < SIDE + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # of equal hashes the last place counts
    ranked = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
    least = sliding_least(ranked, SIDE + 1)
    sizes = np.maximum(last - first, 0)
    inside = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    at = (_PLACE - (least[inside] & _PLACE)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at, grams[at]


def parts_of(raw: memoryview) -> Iterator[tuple[int, int, int, memoryview]]:
    """(offset, first, last, bytes): the strings that start in [first, last) of a part are
    its own; the rest is what their contexts need."""
    n = len(raw)
    if n <= BLOCK + STRING:
        yield 0, 0, n - STRING + 1, raw
        return
    for at in range(0, n - STRING + 1, BLOCK):
        low, stop = max(0, at - SIDE), min(at + BLOCK, n - STRING + 1)
        yield low, at - low, stop - low, raw[low : min(n, stop + SIDE + STRING)]


def merged(a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [a, b) of owners joined where they overlap or touch; owners ascend."""
    if not len(a):
        return a, b, owner
    order = np.lexsort((a, owner))
    a, b, owner = a[order], b[order], owner[order]
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + owner.astype(np.int64) * far) - owner.astype(np.int64) * far
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (a[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return a[first], np.maximum.reduceat(reach, first), owner[first]


def _alike(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + size] and raw[b : b + size] are the same bytes, row by row."""
    out = np.zeros(len(a), bool)
    steps = np.arange(SIDE + STRING)
    for at in range(0, len(a), 4_000):
        part = slice(at, at + 4_000)
        inside = steps < size[part, None]
        left, right = (raw[np.minimum(x[part, None] + steps, len(raw) - 1)] for x in (a, b))
        out[part] = ((left == right) | ~inside).all(1)
    return out


class _Again:
    """Contexts that came more than once in a task, with the bytes and the earliest place
    of each."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], tuple[tuple[int, int, int], bytes]] = {}
        self.grams = np.zeros(0, np.uint64)

    def covered(self, h: np.ndarray, c: np.ndarray, place: list[tuple[int, int, int]], raws) -> np.ndarray:
        """Which of these contexts (raws: bytes by row) stand earlier in the task."""
        out = np.zeros(len(h), bool)
        for k in np.flatnonzero(np.isin(h, self.grams)).tolist():
            key = int(h[k]), int(c[k])
            if (held := self.known.get(key)) and held[1] == raws(k):
                if held[0] < place[k]:
                    out[k] = True
                elif held[0] > place[k]:
                    self.known[key] = place[k], held[1]
        return out

    def remember(self, h: np.ndarray, c: np.ndarray, place: list[tuple[int, int, int]], raws, rows: np.ndarray) -> None:
        if len(self.known) > HOT:
            self.known.clear()
        for k in rows.tolist():
            self.known.setdefault((int(h[k]), int(c[k])), (place[k], raws(k)))
        self.grams = np.unique(np.fromiter((h for h, _ in self.known), np.uint64, len(self.known)))


def occurrences(rows: DataFrame) -> DataFrame:
    """From doc, th, text: kind 0, an anchor at a with hash h and context hash c, b holding
    the context's size; kind 1, bytes [a, b) that are covered. Contexts with the bytes of an
    earlier one of the task are folded."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, again = RollingHash(), _Again()
        names = ["kind", "doc", "th", "a", "b", "h", "c"]

        def block(held: list[tuple]) -> pa.RecordBatch:
            docs, ths, bases, first, last = (np.array([x[k] for x in held], np.int64) for k in range(5))
            raw = np.frombuffer(b"".join(x[5] for x in held), np.uint8)
            starts = np.cumsum([0, *(len(x[5]) for x in held)])
            rolling.load(raw)
            at, h = anchors(rolling, starts[:-1] + first, starts[:-1] + last)
            own = np.searchsorted(starts, at, "right") - 1
            # documents without bytes share a start: the last of them is the one with bytes
            low, high = np.maximum(at - SIDE, starts[own]), np.minimum(at + STRING, starts[own + 1])
            c = _mixed(rolling.of(low, high) ^ _mixed(((at - low) * 1000 + (high - at)).astype(np.uint64)))
            place = at - starts[own] + bases[own]
            order = np.lexsort((place, ths[own], docs[own], c, h))
            at, h, c, own, low, high, place = (x[order] for x in (at, h, c, own, low, high, place))
            n = len(at)
            new = np.ones(n, bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
            same = ~new & (high - low == (high - low)[lead]) & (at - low == (at - low)[lead])
            rest = np.flatnonzero(same)
            same[rest] = _alike(raw, low[rest], low[lead[rest]], (high - low)[rest])
            # the same document given twice in a block is no repeat
            twice = same & (docs[own] == docs[own[lead]]) & (ths[own] == ths[own[lead]]) & (place == place[lead])
            hit = same & ~twice
            kept = np.flatnonzero(~same)
            spots = list(zip(docs[own[kept]].tolist(), ths[own[kept]].tolist(), place[kept].tolist(), strict=True))
            raws = lambda k: raw[low[kept[k]] : high[kept[k]]].tobytes()
            gone = again.covered(h[kept], c[kept], spots, raws)
            again.remember(h[kept], c[kept], spots, raws, np.flatnonzero(np.isin(kept, lead[np.flatnonzero(hit)]) & ~gone))
            hit[kept[gone]] = True
            kept = kept[~gone]
            hit = np.flatnonzero(hit)
            hit = hit[np.argsort(own[hit], kind="stable")]
            begin = place[hit] - (at - low)[hit]
            a, b, who = merged(begin, begin + (high - low)[hit], own[hit])
            zero = np.zeros(len(a), np.uint64)
            columns = [
                np.concatenate([np.zeros(len(kept), np.int8), np.ones(len(a), np.int8)]),
                np.concatenate([docs[own[kept]], docs[who]]),
                np.concatenate([ths[own[kept]], ths[who]]),
                np.concatenate([place[kept], a]),
                np.concatenate([(high - low)[kept], b]),
                np.concatenate([h[kept], _mixed(docs[who].astype(np.uint64) + np.uint64(1))]).view(np.int64),
                np.concatenate([c[kept], zero]).view(np.int64),
            ]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

        held, total = [], 0
        for part in parts:
            docs, ths, texts = part.column("doc").to_pylist(), part.column("th").to_pylist(), part.column("text")
            for n in range(part.num_rows):
                if not texts[n].is_valid:
                    continue
                for base, first, last, piece in parts_of(memoryview(texts[n].as_buffer())):
                    held.append((docs[n], ths[n], base, first, last, piece))
                    total += len(piece)
                    if total >= BLOCK:
                        yield block(held)
                        held, total = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(find, f"kind byte, {KEYS}, a long, b long, h long, c long")


FOUND = f"kind byte, {KEYS}, a long, b long, h long, from_doc long, from_th long, from_a long"


def compare(found: DataFrame) -> DataFrame:
    """Occurrences dealt by hash: kind 1 as above; kind 2, an anchor at a whose context is
    the first of its kind where the anchor has several; kind 4, a context [a, b) that has the
    hashes of the one that begins at from_a of an earlier document. Streams over a sorted
    partition and remembers one row."""

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        head: np.ndarray | None = None  # the last context's first row
        asked = False  # whether it was asked for

        def table(kind: int, *columns: np.ndarray) -> np.ndarray:
            n = len(columns[0])
            return np.stack([np.full(n, kind), *columns, *[np.zeros(n, np.int64)] * (8 - len(columns))], axis=1)

        for part in parts:
            if not part.num_rows:
                continue
            rows = np.stack([np.asarray(part.column(c)).astype(np.int64) for c in ("doc", "th", "a", "b", "h", "c", "kind")], axis=1)
            out = [table(1, *rows[rows[:, 6] == 1].T[:5])]
            rows = rows[rows[:, 6] == 0]
            if len(rows):
                pool = rows if head is None else np.concatenate([head[None], rows])
                new = np.ones(len(pool), bool)
                new[1:] = (pool[1:, 4:6] != pool[:-1, 4:6]).any(1)
                lead = pool[np.maximum.accumulate(np.where(new, np.arange(len(pool)), 0))]
                copy = ~new & (pool[:, :3] != lead[:, :3]).any(1) & (pool[:, 3] == lead[:, 3])
                if copy.any():
                    own, source = pool[copy], lead[copy]
                    # a context begins SIDE before its anchor, or where the document does
                    low, begin = np.maximum(own[:, 2] - SIDE, 0), np.maximum(source[:, 2] - SIDE, 0)
                    out.append(table(4, own[:, 0], own[:, 1], low, low + own[:, 3], own[:, 4], source[:, 0], source[:, 1], begin))
                heads = pool[new]
                alike = heads[1:, 4] == heads[:-1, 4]
                wanted = np.zeros(len(heads), bool)
                wanted[1:] |= alike
                wanted[:-1] |= alike
                last_asked = bool(wanted[-1]) or (len(heads) == 1 and asked)
                if asked:
                    wanted[0] = False
                ask = heads[wanted]
                out.append(table(2, ask[:, 0], ask[:, 1], ask[:, 2], ask[:, 3], ask[:, 4]))
                head, asked = heads[-1], last_asked
            all_ = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(all_[:, k], pa.int8() if k == 0 else pa.int64()) for k in range(9)], names)

    dealt = found.repartition("h").sortWithinPartitions("h", "c", "doc", "th", "a")
    return dealt.mapInArrow(stream, FOUND)


REQUESTS = f"{KEYS}, key long, a long, b long"


def runs(found: DataFrame) -> DataFrame:
    """REQUESTS for the copies (kind 4 of compare) joined to runs, and for their sources: the
    bytes of a run and of its source have the same key. A run that is split between batches
    loses nothing, as every string lies in one context."""

    def form(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = np.stack([np.asarray(part.column(c)) for c in ("doc", "th", "from_doc", "from_th", "shift", "a", "b")], axis=1)
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :5] != rows[:-1, :5]).any(1)
            a, b, own = merged(rows[:, 5], rows[:, 6], np.cumsum(new) - 1)
            who = rows[new][own]
            step = PIECE - STRING + 1
            count = np.maximum(1, -(-(b - a - STRING + 1) // step))
            at = np.repeat(a, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
            stop, who = np.minimum(at + PIECE, np.repeat(b, count)), np.repeat(who, count, axis=0)
            key = np.full(len(at), 7, np.uint64)
            for x in (*who.T[:5], at):
                key = _mixed(key ^ x.astype(np.uint64)) + np.uint64(1)
            shift = who[:, 4]
            both = [np.stack([who[:, 0], who[:, 1], key.view(np.int64), at, stop], axis=1), np.stack([who[:, 2], who[:, 3], key.view(np.int64), at + shift, stop + shift], axis=1)]
            out = np.concatenate(both)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(5)], ["doc", "th", "key", "a", "b"])

    copies = found.filter("kind = 4").withColumn("shift", F.col("from_a") - F.col("a"))
    copies = copies.select("doc", "th", "from_doc", "from_th", "shift", "a", "b").repartition("doc", "th")
    return copies.sortWithinPartitions("doc", "th", "from_doc", "from_th", "shift", "a").mapInArrow(form, REQUESTS)


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of text (bytes), in the order of their first depth bytes.

    Directly sorted are the suffixes smaller than their successors. A scan over the buckets
    of first bytes then places the others: as the scan passes a suffix, the one that starts
    a byte before it, if it is the larger, comes next in its own bucket."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    wide = text.astype(np.int16)
    step = np.sign(np.diff(wide, append=-1))  # the end is smaller than any byte
    ahead = np.where(step != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]  # equal bytes go by the next different one
    small = np.flatnonzero(step[ahead] > 0)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[small]).view(f"S{depth}").ravel()
    small = small[np.argsort(keys, kind="stable")]
    edges = np.searchsorted(text[small], np.arange(257), "left")
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for first in range(256):
        if not waiting[first] and edges[first] == edges[first + 1]:
            continue
        large = [*waiting[first]] or [np.zeros(0, np.int64)]
        run = np.concatenate(large)
        large = [run]
        while len(run):  # in a run of one byte, each places the one before it
            run = run[run > 0] - 1
            run = run[text[run] == first]
            large.append(run)
        bucket = np.concatenate([*large, small[edges[first] : edges[first + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > first]
        letters = text[before]
        before = before[np.argsort(letters, kind="stable")]
        letters, at = np.unique(text[before], return_index=True)
        for letter, own in zip(letters.tolist(), np.split(before, at[1:]), strict=True) if len(letters) else ():
            waiting[letter].append(own)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the prefix, up to depth, that each suffix shares with the one before it."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 20_000):
        unlike = view[order[at : at + 20_000]] != view[order[at - 1 : min(at + 20_000, len(order)) - 1]]
        out[at : at + 20_000] = np.where(unlike.any(1), unlike.argmax(1), depth)
    return out


def sort_contexts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, offsets in them, and class of every string of STRING bytes in raws: equal
    strings have equal classes."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    text = np.frombuffer(b"\xff".join(raws) + b"\xff", np.uint8) + np.uint8(1)  # ends become 0: UTF-8 has no byte 255
    starts = np.cumsum(sizes) - sizes
    order = two_stage_order(text, STRING)
    own = np.searchsorted(starts, order, "right") - 1
    offset = order - starts[own]
    whole = np.flatnonzero(offset + STRING < sizes[own])
    order, own, offset = order[whole], own[whole], offset[whole]
    kind = np.cumsum(common_prefixes(text, order, STRING) < STRING) if len(order) else order
    return own, offset, kind


def sort_groups(contexts: DataFrame) -> DataFrame:
    """Contexts (key, split, salt, doc, th, low, raw) in partitions by key and salt: kind 1,
    covered bytes; kind 3, the earliest place of a string in a block of a split anchor, with
    two hashes of it."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc", "th", "a", "b", "h", "c"]
        rolling = RollingHash()

        def folded(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
            """Rows of which the same key has other bytes, the earliest of each kind of
            bytes; and covered (doc, th, a, b) of rows whose bytes an earlier row has."""
            least: dict[bytes, tuple] = {}
            kinds: dict[int, set[bytes]] = {}
            for r in rows:
                kinds.setdefault(r[0], set()).add(r[6])
                if (held := least.get(r[6])) is None or r[3:6] < held[3:6]:
                    least[r[6]] = r
            covered = [(r[3], r[4], r[5], r[5] + len(r[6])) for r in rows if len(r[6]) >= STRING and r[3:6] != least[r[6]][3:6]]
            split = {r[6] for r in rows if r[1]}
            mixed = {raw for own in kinds.values() if len(own) > 1 for raw in own} | split
            return [(r[0], int(raw in split), *r[2:]) for raw, r in least.items() if raw in mixed], covered

        def block(rows: list[tuple]) -> pa.RecordBatch:
            rows, covered = folded(rows)
            out = [np.array([(1, *c, 0, 0) for c in covered], np.int64).reshape(-1, 7)]
            own, offset, kind = sort_contexts([r[6] for r in rows]) if rows else (np.zeros(0, np.int64),) * 3
            if len(own):
                doc, th, low, split = (np.array([r[k] for r in rows], np.int64)[own] for k in (3, 4, 5, 1))
                at = low + offset
                order = np.lexsort((at, th, doc, kind))
                own, kind, doc, th, at, split, offset = (x[order] for x in (own, kind, doc, th, at, split, offset))
                first = np.concatenate([[True], kind[1:] != kind[:-1]])
                place = np.stack([doc, th, at], axis=1)
                lead = place[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
                hit = np.flatnonzero(~first & (place != lead).any(1))
                if len(hit):
                    keys, who = np.unique(place[hit][:, :2], axis=0, return_inverse=True)
                    a, b, who = merged(at[hit], at[hit] + STRING, who.ravel())
                    out.append(np.stack([np.ones(len(a), np.int64), keys[who, 0], keys[who, 1], a, b, np.zeros_like(a), np.zeros_like(a)], axis=1))
                # a class that holds any context of a split anchor must meet the other blocks
                far = np.flatnonzero(first & (np.maximum.reduceat(split, np.flatnonzero(first))[np.cumsum(first) - 1] > 0))
                if len(far):
                    raw = np.frombuffer(b"".join(rows[k][6][o : o + STRING] for k, o in zip(own[far].tolist(), offset[far].tolist(), strict=True)), np.uint8)
                    rolling.load(raw)
                    begin = np.arange(len(far)) * STRING
                    h = _mixed(rolling.of(begin, begin + STRING))
                    half = rolling.of(begin, begin + STRING // 2) ^ _mixed(rolling.of(begin + STRING // 3, begin + STRING))
                    out.append(np.stack([np.full(len(far), 3), doc[far], th[far], at[far], at[far] + STRING, h.view(np.int64), _mixed(half).view(np.int64)], axis=1))
            all_ = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(all_[:, k], pa.int8() if k == 0 else pa.int64()) for k in range(7)], names)

        held: list[tuple] = []
        size = 0
        for part in small_batches(parts, BATCH, "raw"):
            for row in zip(*(part.column(c).to_pylist() for c in ("key", "split", "salt", "doc", "th", "low", "raw")), strict=True):
                if held and (len(held) >= BATCH or size >= BATCH * 2 * STRING) and (row[0], row[2]) != (held[-1][0], held[-1][2]):
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield block(held)

    dealt = contexts.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.mapInArrow(work, f"kind byte, {KEYS}, a long, b long, h long, c long")


def keyed(docs: DataFrame) -> DataFrame:
    """row (docs' columns), text, and doc and th: what tells documents apart, without nulls.
    th begins with the text's crc32."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    th = F.shiftleft(F.crc32(text), 31).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)))
    return whole_rows(docs, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), th=th, text=F.col("text").cast("string"))


def cut(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Contexts for sort_groups, from rows (doc, th, text) and a written table of requests (REQUESTS, split, salt)."""

    def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "split", "salt", "doc", "th", "low", "raw"]
        for part in small_batches(parts):
            out, size = [], 0
            for n in range(part.num_rows):
                doc, th, raw = part.column("doc")[n].as_py(), part.column("th")[n].as_py(), memoryview(part.column("text")[n].as_buffer())
                wanted = part.column("asked")[n].values
                for key, a, b, split, salt in set(zip(*(wanted.field(k).to_pylist() for k in ("key", "a", "b", "split", "salt")), strict=True)):
                    out.append((key, split, salt, doc, th, a, bytes(raw[a:b])))
                    size += b - a
                    if size >= 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k == 6 else pa.int64()) for k in range(7)], names)
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k == 6 else pa.int64()) for k in range(7)], names)

    asked = requests.groupBy("doc", "th").agg(F.collect_list(F.struct("key", "a", "b", "split", "salt")).alias("asked"))
    both = rows.filter(F.col("text").isNotNull()).join(shuffled(asked), ["doc", "th"])
    return both.select("doc", "th", "text", "asked").mapInArrow(slices, f"key long, split long, salt long, {KEYS}, low long, raw binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, th, spans (array of a, b: bytes to remove, merged) where there are any."""
    rows = keyed(docs.select("doc_id", "text")).select("doc", "th", "text")
    found = write_table(compare(occurrences(rows)), "anchors")
    asked = found.filter("kind = 2")
    large = write_table(asked.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("h", F.ceil(F.col("n") / GROUP).alias("blocks")), "split-anchors")
    split = F.when(F.col("blocks").isNull(), 0).otherwise(1).cast("long")
    salt = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "th", "a"), F.col("blocks"))).cast("long")
    asked = asked.join(large, "h", "left").select("doc", "th", F.col("h").alias("key"), F.greatest(F.col("a") - SIDE, F.lit(0)).alias("a"), (F.col("a") + STRING).alias("b"), split.alias("split"), salt.alias("salt"))
    zero = F.lit(0).cast("long")
    requests = write_table(asked.unionByName(runs(found).withColumns({"split": zero, "salt": zero})), "requests")
    sorted_ = write_table(sort_groups(cut(rows, requests)), "sorted")
    covers = [t.filter("kind = 1").select("doc", "th", "a", "b") for t in (found, sorted_)]

    strings = sorted_.filter("kind = 3")
    several = strings.groupBy("h", "c").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = write_table(strings.join(shuffled(several), ["h", "c"]).select("doc", "th", F.col("h").alias("key"), "a", "b", zero.alias("split"), zero.alias("salt")), "requests")
    if not again.isEmpty():
        covers.append(sort_groups(cut(rows, again)).filter("kind = 1").select("doc", "th", "a", "b"))

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for part in parts:
            lists = part.column("spans")
            sizes = np.diff(np.asarray(lists.offsets))
            own = np.repeat(np.arange(len(sizes)), sizes)
            a, b, own = merged(np.asarray(lists.flatten().field("a")), np.asarray(lists.flatten().field("b")), own)
            offsets = np.searchsorted(own, np.arange(len(sizes) + 1), "left")
            values = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(kind)], ["doc", "th", "spans"])

    each = reduce(DataFrame.unionByName, covers).groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return write_table(each.mapInArrow(join, f"{KEYS}, spans array<struct<a: long, b: long>>"), "spans")


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """row (docs' columns), spans (possibly null), kept, the remaining bytes, and kept_text,
    those of them that are whole characters (a text without spans as it was), for each row."""
    both = keyed(docs).join(shuffled(spans), ["doc", "th"], "left").select("row", "text", "spans")

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(parts):
            kept, left = [], []
            for text, own in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                at, out = 0, []
                for s in own or ():
                    out.append(raw[at : s["a"]])
                    at = s["b"]
                kept.append(b"".join([*out, raw[at:]]))
                left.append(kept[-1].decode(errors="ignore") if own else text)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("spans"), pa.array(kept, pa.binary()), pa.array(left, pa.string())], ["row", "spans", "kept", "kept_text"])

    return both.mapInArrow(take, row_schema(both, "spans array<struct<a: long, b: long>>, kept binary, kept_text string"))
