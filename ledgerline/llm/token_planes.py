"""Token-id output in transposed planes (operator 1).

File format, version 1: a Parquet folder of chunk rows, so that any store Spark writes to
holds it and Spark's commit protocol makes it whole or absent. The ids of a shard (one
range of doc_id, documents in ascending order) are cut into blocks of a fixed number of
ids. A block is transposed into byte planes (plane k holds byte k of every id) or bit
planes (plane k holds bit k), and each plane is compressed by itself with zstandard. The
chunk index lies beside the planes: position of the chunk in its shard, and for each
document that overlaps it doc_id, start in the shard and length. Reading prunes to the
index columns where planes are not needed, and any chunk is decoded without the others.

A long text is encoded as one; its ids go through blocks like all others. Nulls: a null
text is an empty one (its end id alone); a null doc_id sorts first. Rows of equal doc_id
are dealt by text too, so a doc_id that very many rows repeat fills no single shard. Repeated
rows each get their own entry, ordered by doc_id, then text. Empty tables give no rows.
Other columns of the input are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.tokens import batches, encoder, vocabulary_size

CHUNKS = "shard int, chunk int, first long, n_ids int, width int, planes array<binary>, doc_ids array<bigint>, doc_starts array<bigint>, doc_lengths array<bigint>"


def width_of(most: int) -> int:
    """Bytes that ids up to most take: 1, 2 or 4."""
    if not 0 <= most < 2**32:
        raise ValueError(f"ids are unsigned 32-bit integers, not {most}")
    return 1 if most < 2**8 else 2 if most < 2**16 else 4


def to_planes(ids: np.ndarray, width: int, kind: str, level: int = 3) -> list[bytes]:
    """Planes of ids, each compressed. width: bytes an id takes; ids that do not fit are an error."""
    if len(ids) and int(ids.max()) >= 1 << 8 * width:
        raise ValueError(f"id {int(ids.max())} does not fit into {width} bytes")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    raw = np.ascontiguousarray(ids, f"<u{width}").view(np.uint8).reshape(-1, width)
    if kind == "bit":
        raw = np.packbits(np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little").T), axis=1, bitorder="little").T
    return [squeeze(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(raw.shape[1])]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """The ids again; byte and bit planes are told apart by their number."""
    open_ = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(open_(p), np.uint8) for p in planes]
    if len(planes) == 8 * width:
        bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in raw], axis=1)
        block = np.packbits(bits, axis=1, bitorder="little")
    else:
        block = np.stack(raw, axis=1)
    return np.ascontiguousarray(block).reshape(-1).view(f"<u{width}").astype(np.uint32)


def write_token_file(docs: DataFrame, path: str, vocabulary: str, end_id: int, block: int = 65_536, width: int | None = None, kind: str = "byte", shards: int | None = None) -> None:
    """Encode doc_id, text of docs and write the format above to path. width: bytes an id
    takes; as many as the vocabulary and end_id need if it is not given.

    Documents are dealt to shards by ranges of doc_id; a task holds one Arrow batch of
    texts and one block of ids, whatever the size of the shard."""

    width = width or width_of(max(vocabulary_size(vocabulary) - 1, end_id))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary), np.array([end_id], np.uint32)
        waiting: list[np.ndarray] = []  # ids not yet written
        index: list[tuple[int | None, int, int]] = []  # documents that end after the last chunk
        state = {"held": 0, "first": 0, "chunk": 0, "total": 0}
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def rows(shard: int, last: bool) -> Iterator[pa.RecordBatch]:
            while state["held"] >= block or last and state["held"]:
                ids = np.concatenate(waiting)
                now, rest = ids[:block], ids[block:]
                stop = state["first"] + len(now)
                own = [x for x in index if x[1] < stop]
                row = [shard, state["chunk"], state["first"], len(now), width, to_planes(now, width, kind), *([x[k] for x in own] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)
                waiting[:] = [rest]
                index[:] = [x for x in index if x[1] + x[2] > stop]
                state.update(held=len(rest), first=stop, chunk=state["chunk"] + 1)

        shard = 0
        for part in parts:
            if not part.num_rows:
                continue
            shard = part.column("shard")[0].as_py()
            ids_of, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            for a, b in batches(texts):
                for doc, ids in zip(ids_of[a:b], words.encode(texts[a:b]), strict=True):
                    waiting += [ids, end]
                    index.append((doc, state["total"], len(ids) + 1))
                    state["total"] += len(ids) + 1
                    state["held"] += len(ids) + 1
                    if state["held"] >= 4 * block:
                        yield from rows(shard, False)
                yield from rows(shard, False)
        yield from rows(shard, True)

    by = F.substring("text", 1, 40)  # in the order of text, and short
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = keyed.repartitionByRange(shards, "doc_id", by) if shards else keyed.repartitionByRange("doc_id", by)
    ordered = dealt.sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    ordered.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(path)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of a + b, from those of a and b and the bytes of b: appending zero bytes to a
    is a linear map over GF(2), raised to the power length by squaring."""
    power = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        power = [_times(power, x) for x in power]
    while length:
        if length & 1:
            first = _times(power, first)
        power = [_times(power, x) for x in power]
        length >>= 1
    return first ^ second


def read_pieces(chunks: DataFrame) -> DataFrame:
    """For each chunk and document in it: where the document's ids lie and their crc32."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                raw = from_planes(list(row.planes), row.n_ids, row.width).astype("<u4")
                for doc, start, n in zip(row.doc_ids, row.doc_starts, row.doc_lengths, strict=True):
                    a, b = max(start, row.first), min(start + n, row.first + row.n_ids)
                    out.append((row.shard, doc, start, n, a, b - a, zlib.crc32(raw[a - row.first : b - row.first].tobytes())))
            yield pd.DataFrame(out, columns=["shard", "doc_id", "at", "n_tokens", "piece", "n", "crc"]).astype({"doc_id": "Int64"})

    return chunks.mapInPandas(decode, "shard int, doc_id long, at long, n_tokens long, piece long, n long, crc long")


def _joined(pieces: pd.Series) -> pd.Series:
    def one(parts) -> int:
        parts = sorted(parts, key=lambda p: p["piece"])
        out = parts[0]["crc"]
        for p in parts[1:]:
            out = crc32_join(out, p["crc"], 4 * p["n"])
        return out

    return pieces.map(one)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Chunks are decoded independently; a document over several chunks has its pieces'
    checksums joined. Shard offsets are sums over the index, one row a shard."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    docs = read_pieces(chunks).groupBy("shard", "at", "doc_id", "n_tokens").agg(F.collect_list(F.struct("piece", "n", "crc")).alias("pieces"))
    return docs.join(F.broadcast(offsets), "shard").select(
        "doc_id",
        (F.col("offset") + F.col("at")).alias("start"),
        "n_tokens",
        F.pandas_udf(_joined, "long")("pieces").alias("ids_crc32"),
        "shard",
    )
