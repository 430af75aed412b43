"""Benchmark decontamination by SimHash windows (operator 3), JVM-side only.

Texts are words (runs of letters and digits, in lower case). Windows of exactly an item's
number of words slide over a document, and an item of fewer than five words is one shingle of
all its words. A window's fingerprint has 64 bits, each the majority over its words' hashes.

A window is made only where it could pass: around a document's lead shingles, those of an
item that fewest items have, until what is left of the item weighs too little. (A window that
passes shares at least THRESHOLD of its item's weight, so this drops none; text is read in
one narrow pass.) Windows then meet the items of their size whose fingerprint lies within
RADIUS bits: fingerprints are cut into RADIUS + 1 blocks, so two within the radius share one
whole block, and a join on (size, block, value) finds them all. What meets is verified
exactly: the weight of the five-word shingles that both have, over that of all they have,
each weighing its characters, must reach THRESHOLD.

RADIUS is so wide that pairs at THRESHOLD are within it: of pairs whose last words differ it
loses 0.2 % (a test holds every length from 13 to 60 words against radius=None). With
radius=None fingerprints decide nothing and windows meet the items that their lead shingles
lead: whole, at any similarity. Leads are broadcast up to BROADCAST_SHINGLES and shuffled
beyond, likewise the keys of documents with such positions. Positions are made distinct
before the shuffle, so a passage that a third of all documents share is no hot group.

Nulls: a null text has no words; an item without words is none; ids may be null and are
reported as they are. A document shorter than an item is one window. Long texts are read
whole; the work for a hit grows with the square of its item's words. Repeated documents and items are compared
once; of several windows the most similar, then the first, is reported. Empty tables give
no rows; columns of any other names are ignored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import shuffled, write_table

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 16
BROADCAST_SHINGLES, BROADCAST_DOCUMENTS, BROADCAST_ITEMS = 1_000_000, 500_000, 50_000
#: Counters of several bits are summed in one long: LANES of LANE_BITS each; one a long for
#: items of more words than such a counter holds.
LANES, LANE_BITS = 3, 21


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, make, size: int = SHINGLE) -> Column:
    """make(size words) at each position that has so many. words should be a plain column: the
    lambda looks into it at every position."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return F.transform(firsts, lambda w, i: make(w, *(F.get(words, i + k) for k in range(1, size))))


def joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def own_shingles(words: Column) -> Column:
    """The shingles of an item or window: all words where there are fewer than five."""
    return F.when((F.size(words) > 0) & (F.size(words) < SHINGLE), F.array(F.array_join(words, " "))).otherwise(shingles(words, joined))


def _lanes(h: Column, lanes: int) -> list[Column]:
    """The 64 bits of h, so many to a long, each at the foot of its counter: copies of these
    bits, one bit less than a counter apart, of which each keeps one bit."""
    copies = F.lit(sum(1 << (LANE_BITS - 1) * n for n in range(lanes)))
    feet = F.lit(sum(1 << LANE_BITS * n for n in range(lanes)))
    threes = (F.shiftrightunsigned(h, k).bitwiseAND(F.lit((1 << lanes) - 1)) for k in range(0, 64, lanes))
    return [(t * copies).bitwiseAND(feet) for t in threes]


def simhash(rows: DataFrame, keys: list[str], h: str, lanes: int = LANES) -> DataFrame:
    """keys, fp: the majority bits over the hashes h of a group."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(_lanes(F.col(h), lanes))))
    mask = F.lit((1 << LANE_BITS) - 1 if lanes > 1 else -1)
    bits = []
    for k in range(64):
        count = F.shiftright(F.col(f"s{k // lanes}"), LANE_BITS * (k % lanes)).bitwiseAND(mask)
        bits.append(F.when(count * 2 > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def blocks(fp: Column, radius: int) -> Column:
    """(block, value) of each of radius + 1 blocks of bits."""
    count = radius + 1
    edges = [64 * k // count for k in range(count + 1)]
    parts = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        parts.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")))
    return F.array(*parts)


def _weight(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s))


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles."""
    return F.try_divide(_weight(F.array_intersect(a, b)), _weight(F.array_union(a, b)))


def windows(hits: DataFrame, found: DataFrame) -> DataFrame:
    """uid, size, start (from 1), hashes: item-sized windows around the hits."""
    n = F.size("hashes")
    last = F.greatest(F.lit(1), n - F.col("size") + 1)

    def starts(b: Column) -> Column:
        low, high = F.least(F.greatest(F.lit(1), (b - 1) * F.col("size") + F.least(F.col("size"), F.lit(SHINGLE)) + 1), last), F.least(last, (b + 1) * F.col("size"))
        return F.sequence(low, F.greatest(low, high))

    around = hits.groupBy("uid", "size").agg(F.collect_set("block").alias("around"))
    own = around.join(shuffled(found.select("uid", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))), "uid")
    each = own.select("uid", "size", "hashes", F.explode(F.array_distinct(F.flatten(F.transform("around", starts)))).alias("start"))
    return each.select("uid", "size", "start", F.explode(F.slice("hashes", F.col("start"), F.col("size"))).alias("h"))


def leads(items: DataFrame, threshold: float) -> DataFrame:
    """shingle, iid, size: of each item the shingles that fewest items have, until those
    left weigh less than threshold of it."""
    each = items.select("iid", "size", F.explode(F.array_distinct(own_shingles(F.col("item_words")))).alias("s"))
    # in the hash a null word counts for nothing, so fewer words hash as they do by themselves
    each = each.select("iid", "size", F.length("s").alias("weight"), F.xxhash64(*(F.get(F.split("s", " "), F.lit(k)) for k in range(SHINGLE))).alias("shingle"))
    each = each.join(each.groupBy("shingle").agg(F.count("*").alias("n")), "shingle")
    own = Window.partitionBy("iid")
    order = own.orderBy("n", "shingle", "weight").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("weight").over(order), F.lit(0)), F.sum("weight").over(own)
    # a little below threshold, so that rounding loses nothing
    return each.withColumn("left", total - before).withColumn("total", total).filter(F.col("left") >= F.col("total") * (threshold - 1e-9)).select("shingle", "iid", "size").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int | None = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start (word of the document, from 1), n_words, distance
    for each document that holds an item and each such item. radius: bits within which
    fingerprints meet; None for all windows with a lead shingle of the item."""
    items = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("item_words")).filter(F.size("item_words") > 0)
    items = items.distinct().select(F.xxhash64("item_id", F.array_join("item_words", " ")).alias("iid"), "item_id", "item_words", F.size("item_words").alias("size"))
    items = write_table(items, "items")
    parts = write_table(leads(items, threshold), "item-leads")
    few_parts = parts.count() <= BROADCAST_SHINGLES

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    kinds = items.agg(F.collect_set(F.least("size", F.lit(SHINGLE))), F.max("size")).first()
    lanes = LANES if (kinds[1] or 0) < 1 << (LANE_BITS - 1) else 1
    split = rows.select("uid", words_of(F.col("text")).alias("words"))
    held = [split.select("uid", F.posexplode(shingles(F.col("words"), F.xxhash64, k)).alias("at", "shingle"), F.lit(k).alias("kind")) for k in sorted({SHINGLE, *kinds[0]})]
    parts = parts.withColumn("kind", F.least("size", F.lit(SHINGLE)))
    parts = F.broadcast(parts) if few_parts else parts
    hits = reduce(DataFrame.unionByName, (h.join(parts, ["shingle", "kind"]) for h in held)).select("uid", "iid", "size", F.floor(F.col("at") / F.col("size")).cast("int").alias("block")).distinct()
    hits = write_table(hits, "hits")
    keys = hits.select("uid").distinct()
    few = keys.count() <= BROADCAST_DOCUMENTS
    found = rows.join(F.broadcast(keys) if few else keys, "uid", "left_semi").dropDuplicates(["uid"])
    found = write_table(found.select("uid", "doc_id", words_of(F.col("text")).alias("words")), "found")

    prints = write_table(simhash(windows(hits, found), ["uid", "size", "start"], "h", lanes), "window-prints")
    each = items.select("iid", "size", F.explode(F.transform("item_words", lambda w: F.xxhash64(w))).alias("h"))
    own = write_table(simhash(each, ["iid", "size"], "h", lanes), "item-prints")
    if radius is None:
        # the first words of a window's shingles lie in the block of its start or the next
        at = F.floor((F.col("start") - 1) / F.col("size")).cast("int")
        near = prints.select("uid", "size", "start", "fp", F.explode(F.array(at, at + 1)).alias("block"))
        met = near.join(hits, ["uid", "size", "block"]).join(own.select("iid", F.col("fp").alias("item_fp")), "iid")
    else:
        left = prints.select("*", F.inline(blocks(F.col("fp"), radius)))
        right = own.select("iid", "size", F.col("fp").alias("item_fp"), F.inline(blocks(F.col("fp"), radius)))
        # its rows are as many as items times blocks, however small Spark takes it to be
        met = left.join(F.broadcast(right) if own.count() <= BROADCAST_ITEMS else shuffled(right), ["size", "block", "value"])
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = met.filter(apart <= (64 if radius is None else radius)).select("uid", "start", "iid", apart.alias("distance")).distinct()

    both = met.join(items, "iid").join(shuffled(found), "uid")
    window = F.slice("words", F.col("start"), F.col("size"))
    shared = once(window, lambda w: once(F.struct(own_shingles(w).alias("a"), own_shingles(F.col("item_words")).alias("b")), lambda s: similarity(s["a"], s["b"])))
    passed = both.withColumn("similarity", shared).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), F.col("size").alias("n_words"), "distance")).alias("b")
    return passed.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", (-F.col("b.before")).alias("start"), "b.n_words", "b.distance")
