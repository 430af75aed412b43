"""Mixing sources to target weights by fitting word budgets (operator 12).

Every source has a target number of words. Of a source with s words whose target is t, all
documents are taken floor(t / s) times; for the words that remain, documents are counted by
exact length, each length gives its share (rounded down), and what the rounding leaves is
filled by bounded-knapsack dynamic programming over the documents left of each length: the
reachable sum nearest to the budget is taken. So a source misses its target by no more than
its lengths force it to, and the mix keeps the source's distribution of lengths.

How many documents of a length are taken is then a number; which ones, a seeded hash says.
Rows are put in ranges of (source, length, hash), a range is a task's, and each range learns
how many of a length earlier ranges hold: no task sees a whole source or length, however
large. Only counts by length reach the dynamic programming, one source a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import whole_rows, write_table
from ledgerline.llm.ranking import in_order, places

#: Words that dynamic programming fits; larger remainders are first brought down to this by
#: whole documents. It bounds a task's work, no row depends on it.
FITTED = 1_000_000
#: ASCII white space, which is all that separates words here.
SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Stretches of characters that are no ASCII white space; a null text has none."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), SPACE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def fit_counts(lengths: list[int], counts: list[int], budget: float, fitted: int = FITTED) -> list[int]:
    """How many documents of each length to take, so that their words come nearest to budget.

    First every length gives its share and dynamic programming fits the rest; if that misses,
    the last `fitted` words of the budget are all fitted anew (for smaller budgets that is the
    whole problem, and exact)."""
    total = sum(length * n for length, n in zip(lengths, counts, strict=True))
    goal = min(max(round(budget), 0), total)
    best, gap = [0] * len(lengths), goal
    for spare in (0, fitted):
        if gap:
            taken = _filled(lengths, counts, goal, max(goal - spare, 0), total, fitted)
            missed = abs(goal - sum(length * n for length, n in zip(lengths, taken, strict=True)))
            if missed < gap:
                best, gap = taken, missed
    return best


def _filled(lengths: list[int], counts: list[int], goal: int, shared: int, total: int, fitted: int) -> list[int]:
    """Shares of `shared` words for all lengths, then the reachable sum nearest to goal."""
    take = [n * shared // total for n in counts]
    rest = goal - sum(length * n for length, n in zip(lengths, take, strict=True))
    # those that rounding cost most come first
    order = sorted((k for k in range(len(lengths)) if lengths[k]), key=lambda k: (-(counts[k] * goal % total), lengths[k]))
    for k in order:
        if rest <= fitted:
            break
        some = min(counts[k] - take[k], max(1, counts[k] * (goal - shared) // total), rest // lengths[k])
        take[k] += some
        rest -= some * lengths[k]
    left = [k for k in order if take[k] < counts[k]]
    if not rest or not left:
        return take
    top = rest + min(rest, max(lengths[k] for k in left))  # a little too many may come nearer
    reached, last = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int32)
    reached[0] = True
    items: list[tuple[int, int]] = []  # (length, how many of it), each used at most once
    for k in left:
        room, some = min(counts[k] - take[k], top // lengths[k]), 1
        while room and not reached[rest]:
            some = min(some, room)
            step = some * lengths[k]
            new = reached[: top + 1 - step] & ~reached[step:]
            last[step:][new] = len(items)
            reached[step:] |= new
            items.append((k, some))
            room, some = room - some, 2 * some
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        k, some = items[last[at]]
        take[k] += some
        at -= some * lengths[k]
    return take


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sources (source, source_size) with target. Sources in the order of their code points,
    null last, weigh weights in turn and share so much of all words; a target stops at most
    times its source's words, and what is over goes to the others by weight, until none is
    above. The level (words a unit of weight) rises round by round; a round is one sum."""
    ranked = places(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = write_table(ranked.select("source", F.col("place").alias("source_no"), "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")), "sources")
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("cap")
        sums = table.agg(F.sum("source_size"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if sums[0] is None or sums[3] == full or not sums[2]:
            break
        full, level = sums[3], (share * sums[0] - sums[1]) / sums[2]
    return table.withColumn("target", F.least(F.col("weight") * level, F.col("cap"))).drop("weight", "cap")


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """row (the columns keep of docs, all if none are named, as a struct), size (words),
    source_size, target, copies (how often the mix takes the row) and taken (words).

    Null and blank texts have size 0 and are taken as often as their source is taken whole;
    a null source is a source, the last one. Null or repeated ids: a row's turn depends on the
    seed, its id and its text; of rows alike in these it does not matter which are taken, and
    the mix is the same in every run. Very long texts are counted whole. Columns of other
    names stay in row. An empty table gives no rows."""
    kept = docs.select(*(F.col(f"`{c}`") for c in keep)) if keep else docs
    inside = whole_rows(docs, source=F.col(f"`{source}`").cast("string"), size=word_count(F.col(f"`{text}`").cast("string")), turn=F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")), tie=F.monotonically_increasing_id())
    row = F.struct(*(F.col(f"row.`{c}`") for c in kept.columns)).alias("row")
    table = in_order(inside.select(row, "source", "size", "turn", "tie"), *(F.col(c) for c in ("source", "size", "turn", "tie")))
    # one row for each length of a source in a range
    spans = write_table(table.groupBy("source", "size", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "spans")
    known = targets(spans.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    known = known.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    lengths = spans.groupBy("source", "size").agg(F.sum("n").alias("n")).withColumnRenamed("source", "named")
    counts = known.join(lengths, F.col("source").eqNullSafe(F.col("named"))).select("source_no", "size", "n", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        taken = fit_counts(part["size"].tolist(), part["n"].tolist(), float(part["budget"].iloc[0]))
        return pd.DataFrame({"source_no": part["source_no"], "length": part["size"], "wanted": taken})

    wanted = counts.groupBy("source_no").applyInPandas(fit, "source_no long, length long, wanted long")
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumnsRenamed({"source": "named", "size": "length", "part": "range"})
    both = known.join(before.drop("n"), F.col("source").eqNullSafe(F.col("named"))).drop("named").join(wanted, ["source_no", "length"])
    plan = write_table(both.select(F.col("source").alias("named"), "length", "range", "source_size", "target", "passes", (F.col("first") + F.col("wanted") - F.col("before")).alias("stop")), "mix")
    # a row is taken once more if it stands before its length's stop in its range
    placed = table.join(plan, (F.col("part") == F.col("range")) & (F.col("size") == F.col("length")) & F.col("source").eqNullSafe(F.col("named")))
    copies = (F.col("passes") + (F.col("at") < F.col("stop")).cast("int")).cast("int")
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*", "copy")
