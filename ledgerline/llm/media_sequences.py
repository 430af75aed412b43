"""Interleaved sequences of text and media (operator 5).

HTML is parsed into ordered structs: text, and references to media with their captions.
Media lie in a content-addressed store, one row a payload, named by the SHA-256 digest of
the payload; an equi-join on the digest resolves references. Positions and captions stay
with the reference, so both stay aligned whatever order rows arrive in.

The store is written where the payload is made: a task stores a payload once, other tasks
may store it again, and the index keeps one entry a digest. So payloads never cross the
network, also where a third of all rows hold the same one.

Long pages and texts are read whole, a page or text at a time. Nulls: a null html has no
segments, a null text is an empty payload; a reference without a digest, or to a payload
that is not in the store, resolves to null. Every parsed row has a number of its own, so
rows with null or equal keys keep their own segments, and repeated rows stay repeated. Ties
cannot arise: a digest has one payload. Empty tables give no rows; columns of any other
names are kept in row."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import row_schema, small_batches, write_table

SEGMENTS = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"
_BLOCKS = frozenset("address article aside blockquote dd div dl dt figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul br".split())
_MEDIA = frozenset("img video audio source embed".split())
_HIDDEN = frozenset("script style template noscript title".split())
WIDTH = 576
#: How hard media are compressed.
LEVEL = 6


class _Segments(HTMLParser):
    """Ordered segments of a page. A caption is the figure's, else the alt text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join(" ".join(self.words).split()):
            self.out.append({"pos": len(self.out), "kind": "text", "text": text, "ref": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            self.out.append({"pos": len(self.out), "kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt")})
            if self.figure is not None:
                self.figure.append(self.out[-1])
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join(" ".join(self.caption).split())
            for media in self.figure or ():
                media["caption"] = text or media["caption"]
            self.caption = None
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def segments_of(html: str | None) -> list[dict]:
    parser = _Segments()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """row (pages' other columns), segments."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for part in small_batches(parts, 256, "html"):
            found = [segments_of(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, kind)], ["row", "segments"])

    named = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != html)).alias("row"), F.col(html).cast("string").alias("html"))
    return named.mapInArrow(parse, row_schema(named, f"segments {SEGMENTS}"))


def digest_of(ref):
    """The digest that a reference such as sha256:ab12 names, else null."""
    return F.nullif(F.regexp_extract(ref, "^sha256:([0-9a-f]{64})$", 1), F.lit(""))


def interleave(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """parsed with a struct media in each segment: the index's row for its digest, or null.

    index: digest and any other columns, one row a digest; a written table, so that rows of
    one digest can be split where they are joined."""
    columns = [c for c in index.columns if c != "digest"]
    rows = write_table(parsed.withColumn("rid", F.monotonically_increasing_id()), "sequences")
    refs = rows.select("rid", F.explode(F.array_distinct(F.transform("segments", lambda s: digest_of(s["ref"])))).alias("digest")).filter("digest IS NOT NULL")
    found = refs.join(index, "digest").select("rid", F.struct("digest", F.struct(*columns).alias("media")).alias("m"))
    found = found.groupBy("rid").agg(F.map_from_entries(F.collect_list("m")).alias("found"))
    resolved = F.transform(
        "segments",
        lambda s: F.struct(*(s[c].alias(c) for c in ("pos", "kind", "text", "ref", "caption")), F.try_element_at("found", F.coalesce(digest_of(s["ref"]), F.lit(""))).alias("media")),
    )
    return rows.join(found, "rid", "left").select("row", resolved.alias("segments"))


def encode_png(payload: bytes) -> bytes:
    """payload, a positive multiple of WIDTH bytes, as an 8-bit grey PNG."""
    height = len(payload) // WIDTH
    lines = np.zeros((height, WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without line filters, as lines."""
    at, data, shape = 8, b"", (0, 0)
    while at < len(media):
        (size,), name = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged chunk")
        if name == b"IHDR":
            shape = struct.unpack(">II", body[:8])[::-1]
        elif name == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that this reader does not know")
    return lines[:, 1:]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * ((-len(raw)) % WIDTH if raw else WIDTH)


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, spread and mean step between neighbouring samples."""
    flat = samples.reshape(-1)
    total, square = int(flat.sum(dtype=np.int64)), int(np.dot(flat.astype(np.int64), flat.astype(np.int64)))
    mean = total / flat.size
    step = int(np.abs(np.diff(flat.astype(np.int16))).sum(dtype=np.int64)) / max(1, flat.size - 1)
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.6f} var={max(0.0, square / flat.size - mean * mean):.6f} step={step:.6f}"


def store_texts(docs: DataFrame) -> DataFrame:
    """Write each text as media. Rows of the table: doc_id, n_bytes, digest, media; media
    is null where the task had stored the payload before."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in small_batches(parts):
            rows = []
            for text in part.column("text"):
                n, payload = payload_of(text.as_py())
                digest = hashlib.sha256(payload)
                new = digest.digest() not in seen
                seen.add(digest.digest())
                rows.append((n, digest.hexdigest(), encode_png(payload) if new else None))
            columns = [part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "digest", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return write_table(rows.mapInArrow(encode, "doc_id long, n_bytes long, digest string, media binary"), "media")


def media_index(store: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes: payload and media sizes, digests, feature."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for part in parts:
            rows = []
            for digest, media in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                media = media.as_py()
                samples = decode_png(media)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    stored = store.filter(F.col("media").isNotNull()).select("digest", "media")
    rows = stored.mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    # the copies of a digest are equal, so any aggregate keeps the row
    return write_table(rows.groupBy("digest").agg(*(F.max(c).alias(c) for c in rows.columns if c != "digest")), "media-index")
