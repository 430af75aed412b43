"""Token ids of whole texts from a public vocabulary file of the tokenizers library.

Rare words cost the library about ten microseconds each and frequent words come up again
and again, so pieces of text that the vocabulary treats independently of their neighbours
are looked up in a bounded memo; only new pieces reach the library, in batches. The
ids are those of encoding the whole text (tests compare the two)."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: How the two vocabularies split text before merging.
_WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: The normalisers and splitters for which pieces of text are known to be independent.
_WORD_KIND = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
_BYTE_KIND = ([], [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}])


def kind_of(tokenizer: Tokenizer) -> str | None:
    """"words" or "bytes" for vocabularies that split as above, else None: then only whole
    texts are encoded."""
    spec = json.loads(tokenizer.to_str())

    def steps(name: str, inner: str) -> list[dict]:
        found = spec[name]
        return [] if found is None else found[inner] if found["type"] == "Sequence" else [found]

    rules = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
    plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
    return {plain and rules == _WORD_KIND: "words", plain and rules == _BYTE_KIND: "bytes"}.get(True)


def _letters() -> dict[int, str]:
    """Byte-level models write each byte as a printable letter: itself, or one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_LETTERS = _letters()


class _Rows(dict):
    """Numbers keys as they come; fresh holds those that have no ids yet."""

    def __init__(self) -> None:
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def fill(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths) + len(self.flat)
        self.starts = np.concatenate([self.starts, ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.fresh = []

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows one after another, and how many each has."""
        lengths = self.lengths[rows]
        total = int(lengths.sum())
        shift = self.starts[rows] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(total)], lengths


class TextEncoder:
    """Encodes lists of texts; encoder() keeps one a worker process, with its memo.

    memo bounds the number of pieces kept; beyond it the memo starts anew. The strings of
    special tokens inside texts are ordinary text."""

    def __init__(self, path: str, memo: int = 600_000) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        kind = kind_of(self._tokenizer)
        self._words, self._whole = kind == "words", kind is None
        self._memo, self._pieces, self._parts = memo, _Rows(), _Rows()

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts: what is normalised and split already goes straight to the
        library's merging model, in the alphabet of bytes that byte-level models use."""
        ids: list = [None] * len(parts)
        other = []
        merge = self._tokenizer.model.tokenize
        for n, part in enumerate(parts):
            if part.isascii() or max(part) < "\u0100":
                ids[n] = [t.id for t in merge(part.encode().decode("latin-1").translate(_LETTERS))]
            else:
                other.append(n)
        for n, found in zip(other, self._direct([parts[n] for n in other]), strict=True):
            ids[n] = found
        return ids

    def _split(self, text: str) -> list[str] | None:
        """Pieces that are encoded independently, or None if the text must stay whole.

        White space never matters to the vocabulary with word ends. The byte-level one
        splits before every space and around every line end if each stands alone, which
        holds if there are as many words as separators and one; str.split() also knows all
        other white space."""
        if self._words:  # but Python takes four control characters for white space
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return None
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def _resolve(self) -> None:
        """Ids for the fresh pieces, by way of their parts."""
        fresh = self._pieces.fresh
        if not fresh:
            return
        parts: list[str] = []
        ends = np.empty(len(fresh), np.int64)
        for n, piece in enumerate(fresh):
            if not self._words and not piece.startswith("\n"):
                piece = " " + piece
            if piece.isascii() or max(piece) < "\u0100":
                parts += _WORD_PARTS.findall(piece.lower()) if self._words else _BYTE_PARTS.findall(piece)
            else:
                parts.append(piece)  # the library normalises and splits it
            ends[n] = len(parts)
        rows = np.fromiter(map(self._parts.__getitem__, parts), np.int64, len(parts))
        if self._parts.fresh:
            ids = self._merge(self._parts.fresh)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._parts.fill(np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths)
        flat, lengths = self._parts.expand(rows)
        cut = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])]
        self._pieces.fill(flat, np.diff(cut))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One uint32 array for each text; null counts as empty."""
        if len(self._pieces) > self._memo:
            self._pieces.reset()
        if len(self._parts) > self._memo:
            self._parts.reset()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        split, where, whole = [], [], []
        for n, text in enumerate(texts):
            if not text:
                continue
            pieces = None if self._whole else self._split(text)
            if pieces is None:
                whole.append(n)
            else:
                split.append(pieces)
                where.append(n)
        for n, ids in zip(whole, self._direct([texts[n] for n in whole]), strict=True):
            out[n] = np.asarray(ids, np.uint32)
        if split:
            rows = [np.fromiter(map(self._pieces.__getitem__, p), np.int64, len(p)) for p in split]
            self._resolve()
            for n, r in zip(where, rows, strict=True):
                ids, lengths = self._pieces.expand(r)
                # a text of the byte-level vocabulary was split with a line end before it
                out[n] = ids if self._words or not len(lengths) else ids[1:]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """The worker process's encoder: what a task looked up, the next one need not."""
    return TextEncoder(path)


def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def batches(texts: list[str | None], size: int = 2_000_000):
    """Ranges of texts of about so many characters."""
    start, total = 0, 0
    for n, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield start, n + 1
            start, total = n + 1, 0
    if start < len(texts):
        yield start, len(texts)
