"""SimHash near-duplicates by covering locality-sensitive hashing (operator 6).

A fingerprint of 64 bits per document; two link at RADIUS or fewer differing bits. Each
bit position has a vector of RADIUS + 1 bits, and each of the 2^(RADIUS + 1) - 1 non-zero
vectors v gives a mask: the positions whose vector has odd product with v. Any RADIUS
positions leave some v orthogonal to them all, so a pair within the radius agrees under
that mask: every such pair meets in some table, none is lost.

Only distinct fingerprints are hashed, so exact copies cost one row. Within a bucket no
pairs are listed: in rounds, every member is compared with one hub and linked if within
the radius; buckets whose members are then all in one component are done. In the others,
members outside the bucket's most frequent component are compared with the members of
other components, and only links leave the join. Links, components and fingerprints stay
distributed: no join broadcasts, since a row stands for one a mask once it is exploded, and
what is planned from the size before that would not fit a driver.

Texts are whole, long ones too (about 60 bytes of memory a word). Nulls: a null or blank
text has fingerprint 0 and is linked like any other; rows with a
null doc_id take part, and a component of only such rows has a null id. Repeated rows stay
repeated. An id is a minimum; of rows that tie on it, the one whose text has the least
hash is kept where one of a group stays. An empty table gives no rows; columns of any other
names are ignored, or kept in row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType, StructField, StructType

from ledgerline.llm.common import remove_table, shuffled, small_batches, whole_rows, write_table
from ledgerline.llm.graph import components

BITS, SEED = 64, 42


def shingle_hashes(text: str | None, words_each: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) words, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate([[0], ends[:-words_each]]).tolist()
    stops = (ends[words_each - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, words_each: int = 4) -> DataFrame:
    """rows (text and other columns) with fp (the 64 bits as a long) in place of text."""
    kept = [c for c in rows.columns if c != "text"]

    def compute(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(parts):
            found = [majority(shingle_hashes(t.as_py(), words_each)) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.array(found, np.uint64).view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(compute, StructType([*(rows.schema[c] for c in kept), StructField("fp", LongType())]))


def covering_masks(radius: int) -> list[int]:
    """One mask for each non-zero vector; every position's vector is non-zero, in turn."""
    size = 2 ** (radius + 1) - 1
    vectors = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def links(nodes: DataFrame, radius: int, rounds: int = 2) -> DataFrame:
    """node, label for the nodes (fp: distinct longs) that link to a lesser one, directly
    or through others."""
    masks = F.array(*(F.lit(_signed(m)) for m in covering_masks(radius)))
    hashed = nodes.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = hashed.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = write_table(hashed.join(shuffled(shared), ["k", "key"]), "buckets")
    done = [rows]
    found = None
    for turn in range(rounds):
        hubs = rows.groupBy("k", "key").agg(F.min(F.struct(F.xxhash64("fp", F.lit(turn)), "fp"))["fp"].alias("hub"))
        spokes = rows.join(shuffled(hubs), ["k", "key"]).filter((F.col("fp") != F.col("hub")) & near("fp", "hub", radius))
        spokes = spokes.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
        found = components(spokes if found is None else spokes.unionByName(found.select(F.col("node").alias("u"), F.col("label").alias("v"))))
        labelled = rows.select("k", "key", "fp").join(shuffled(found.withColumnRenamed("node", "fp")), "fp", "left").select("k", "key", "fp", F.coalesce("label", "fp").alias("label"))
        mixed = labelled.groupBy("k", "key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("k", "key")
        rows = write_table(labelled.join(shuffled(mixed), ["k", "key"]), "buckets")
        done.append(rows)
    most = rows.groupBy("k", "key", "label").agg(F.count("*").alias("n")).groupBy("k", "key").agg(F.max_by("label", "n").alias("most"))
    few = rows.join(shuffled(most), ["k", "key"]).filter("label <> most").select("k", "key", F.col("fp").alias("u"), F.col("label").alias("own"))
    meets = (F.col("own") != F.col("label")) & near("u", "fp", radius)
    both = few.alias("a").join(shuffled(rows.alias("b")), (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & meets)
    rest = both.select("u", F.col("fp").alias("v")).distinct()
    whole = components(rest.unionByName(found.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    for table in done:  # what they gave is written
        remove_table(table)
    return whole


def groups(prints: DataFrame, radius: int) -> DataFrame:
    """fp, label for each distinct fingerprint: the least one reachable."""
    nodes = prints.select("fp").distinct()
    labels = links(nodes, radius)
    return nodes.join(shuffled(labels.withColumnRenamed("node", "fp")), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 4, words_each: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = write_table(fingerprints(rows, words_each), "fingerprints")
    labelled = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(shuffled(groups(prints, radius)), "fp"), "labels")
    # a table of its own, so that rows of one label can be split where they are joined
    least = write_table(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "component-ids")
    named = write_table(labelled.join(shuffled(least), "label").select("fp", "component_id"), "components")
    return prints.join(shuffled(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_keys(df: DataFrame) -> dict[str, Column]:
    """Two 64-bit hashes of a whole row; nulls count."""
    plain = [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.col(f"`{f.name}`").cast("string") for f in df.schema]
    gaps = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in plain))
    return {"row_a": F.xxhash64(gaps, *plain), "row_b": F.xxhash64(F.lit("b"), *plain, gaps)}


def one_of_each(docs: DataFrame, radius: int = 4, words_each: int = 4) -> DataFrame:
    """docs' rows without near duplicates: of each group the row with the least doc_id stays
    (a null one comes last), of several with that id the one whose text has the least hash.
    Rows are told apart by 128 bits of hashes over all columns, so repeated or null ids do no
    harm; of rows that are alike in every column one stays."""
    rows = whole_rows(docs, **row_keys(docs), doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    prints = write_table(fingerprints(rows.select("row_a", "row_b", "doc_id", F.xxhash64("text").alias("th"), "text"), words_each), "fingerprints")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "row_a", "row_b")).alias("first")
    labelled = write_table(prints.groupBy("fp").agg(order).join(shuffled(groups(prints, radius)), "fp"), "labels")
    stay = labelled.groupBy("label").agg(F.min("first").alias("first")).select("first.row_a", "first.row_b")
    # rows alike in every column meet in their own tasks first, so they are no hot group
    once = rows.select("row", "row_a", "row_b").dropDuplicates(["row_a", "row_b"])
    return once.join(shuffled(stay), ["row_a", "row_b"], "left_semi").select("row.*")
