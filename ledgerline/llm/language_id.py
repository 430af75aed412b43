"""Language identification, word first with back-off to character n-grams (operator 7).

Learning counts words and the n-grams inside them per language over all given rows, on
Spark, with partial aggregation before the shuffle. The model keeps every word, n-gram and
language, in written tables; log frequencies are over all counts. A word of the model
scores its log frequency in each language. Any other word is covered by the longest known
n-gram at each of its letters, from three letters down to one.

Scoring reads texts once, with the most frequent words (up to HOT counts) and all n-grams
broadcast. Any other word is covered by n-grams at once; if the model knows it after all, a
join by its hash corrects that, so unknown words leave the join and rows are small. n-grams
beyond BROADCAST_GRAMS are not broadcast; then words are covered in joins, distinct words
first. So what is broadcast is bounded and nothing is left out. Words are told apart by
64-bit hashes.

Nulls: rows with null text or lang teach nothing; a text that is null or has no letter is
"und" with score 0, as is any text if nothing was learned. Letters are those of \\p{L},
in learning and in scoring; a long text is scored whole. Ties go to the language that
sorts first. Each row has its own prediction; an empty table gives no rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import small_batches, write_table

LONGEST = 3
#: Counts of words (word, language) that are broadcast, and n-grams.
HOT, BROADCAST_GRAMS = 200_000, 500_000
#: Scores of pieces of text that a task remembers.
MEMO = 1_500_000
_LETTERS = regex.compile(r"\p{L}+")


@dataclass
class LanguageModel:
    """words and grams: key, size (0 for words), n, langs (places in languages) and gains
    (what a count adds to the log frequency of a key never seen in the language); base: that
    log frequency, by size and language."""

    languages: list[str]
    words: DataFrame | None
    grams: DataFrame | None
    base: np.ndarray


def letters_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def count_words(rows: DataFrame) -> DataFrame:
    """lang, word, n over rows with text and lang."""
    known = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return known.select("lang", F.explode(letters_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """lang, gram, n: letters of a word marked at both ends, in pieces of 1 to LONGEST."""
    marked = F.concat(F.lit("_"), F.col("word"), F.lit("_"))

    def cut(k: int) -> Column:  # a second argument of transform's lambda would be the index
        return F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.substring(marked, i, F.lit(k)))

    pieces = [cut(k) for k in range(1, LONGEST + 1)]
    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*pieces))).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def keyed(counts: DataFrame, languages: DataFrame) -> DataFrame:
    """key, size, n, langs, gains from lang, key, size, n."""
    own = counts.join(F.broadcast(languages), "lang").groupBy("key", "size").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", F.col("n").alias("c")))).alias("e"))
    return own.select("key", "size", "n", F.col("e.at").alias("langs"), F.transform("e", lambda x: F.log1p(x["c"] * 2)).alias("gains"))


def learn(rows: DataFrame) -> LanguageModel:
    """A model from all rows (text, lang)."""
    spark = rows.sparkSession
    words = write_table(count_words(rows), "language-counts")
    grams = write_table(count_grams(words).select("lang", F.col("gram").alias("key"), F.length("gram").alias("size"), "n"), "language-gram-counts")
    words = words.select("lang", F.col("word").alias("key"), F.lit(0).alias("size"), "n")
    both = words.unionByName(grams).groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in both})
    if not languages:
        return LanguageModel([], None, None, np.zeros((LONGEST + 1, 0)))
    places = {x: k for k, x in enumerate(languages)}
    listed = spark.createDataFrame(list(places.items()), "lang string, at int")
    words, grams = write_table(keyed(words, listed), "language-words"), write_table(keyed(grams, listed), "language-grams")
    kinds = np.zeros((LONGEST + 1, 1))
    for r in words.unionByName(grams).groupBy("size").count().collect():
        kinds[r["size"]] = r["count"]
    totals = np.zeros((LONGEST + 1, len(languages)))
    for r in both:
        totals[r["size"], places[r["lang"]]] = r["n"]
    # (n + 0.5) / (total + 0.5 kinds) = base x (2 n + 1); a size that no word reaches has no key
    base = np.log(0.5 / np.maximum(totals + 0.5 * kinds, 0.5))
    return LanguageModel(languages, words, grams, base)


def frequent(words: DataFrame, most: int) -> Column:
    """Whether a word is one of the most frequent ones, with up to most counts in all. Cut
    between eighths of powers of two, so no task ranks words."""
    level = F.floor(F.log2("n") * 8)
    sizes = words.groupBy(level.alias("level")).agg(F.sum(F.size("langs")).alias("n")).collect()
    least, sum_ = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if (sum_ := sum_ + r["n"]) > most:
            break
        least = r["level"]
    return level >= least if least is not None else F.lit(False)


class Gains:
    """Places and gains of the keys of a table, in arrays."""

    def __init__(self, table: pa.Table) -> None:
        langs, gains = (table.column(c).combine_chunks() for c in ("langs", "gains"))
        self.sizes = np.asarray(langs.value_lengths(), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.langs, self.gains = np.asarray(langs.flatten(), np.int64).astype(np.int16), np.asarray(gains.flatten(), np.float64)

    def add(self, found: np.ndarray, rows: np.ndarray, out: np.ndarray, weights: np.ndarray | float = 1.0) -> None:
        """Add the gains of each found key, times its weight, to its row of out."""
        sizes = self.sizes[found]
        flat = np.repeat(self.starts[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        np.add.at(out, (np.repeat(rows, sizes), self.langs[flat]), self.gains[flat] * np.repeat(np.broadcast_to(weights, len(sizes)), sizes))


class Words(Gains):
    """Words by their hash."""

    def __init__(self, table: pa.Table) -> None:
        super().__init__(table)
        hashes = np.asarray(table.column("hash").combine_chunks(), np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.sizes, self.starts = hashes[order], self.sizes[order], self.starts[order]

    def find(self, words: list[str]) -> np.ndarray:
        """Where each word is, or -1."""
        digest = xxhash.xxh64_intdigest
        wanted = np.fromiter((digest(w.encode(), 42) for w in words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, wanted), max(0, len(self.hashes) - 1))
        return np.where(self.hashes[at] == wanted, at, -1) if len(self.hashes) else np.full(len(words), -1)


class Grams(Gains):
    """All n-grams by their letters, 21 bits each in one number."""

    def __init__(self, table: pa.Table) -> None:
        super().__init__(table)
        codes = np.array([sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))) for g in table.column("key").to_pylist()], np.int64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    def cover_all(self, words: list[str], rows: np.ndarray, out: np.ndarray, languages: int, sign: float = 1.0) -> None:
        """Add the mean over each word's longest known n-grams, one at each letter and mark, to
        its row of out: gains, then the shares of each size."""
        if not words or not len(self.codes):
            return
        letters = np.frombuffer("".join(f"_{w}_" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        own = np.repeat(np.arange(len(words)), sizes)
        left = np.cumsum(sizes)[own] - np.arange(len(letters))  # letters to the word's end
        found, lengths = np.full(len(letters), -1), np.zeros(len(letters), np.int64)
        padded = np.concatenate([letters, np.zeros(LONGEST, np.int64)])
        for k in range(LONGEST, 0, -1):
            at = np.flatnonzero((found < 0) & (left >= k))
            code = sum(padded[at + i] << 21 * (k - 1 - i) for i in range(k))
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[place] == code
            found[at[hit]], lengths[at[hit]] = self.order[place[hit]], k
        known = np.flatnonzero(found >= 0)
        who = own[known]
        weight = sign / np.bincount(who, minlength=len(words))[who]
        self.add(found[known], rows[who], out, weight)
        np.add.at(out, (rows[who], languages + lengths[known]), weight)


class Scorer:
    """Sums over pieces of text between spaces, remembered within a task, and each piece's
    words that are not among words. A row holds the languages' gains, the shares of words and
    of each size of n-gram, and the number of words.

    grams: None if such words are not covered here."""

    def __init__(self, words: Words, grams: Grams | None, languages: int) -> None:
        self.words, self.grams, self.languages, self.memo = words, grams, languages, _Memo()
        self.width = languages + LONGEST + 2
        self._forget()

    def _forget(self) -> None:
        self.memo.clear()
        self.table = np.zeros((0, self.width))
        self.others: list[list[str] | None] = []
        self.has_others = np.zeros(0, bool)

    def _resolve(self) -> None:
        fresh = self.memo.fresh
        table = np.zeros((len(fresh), self.width))
        cut = [_LETTERS.findall(piece) for piece in fresh]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        words, rows = [w for own in cut for w in own], np.repeat(np.arange(len(cut)), sizes)
        table[:, -1] = sizes
        found = self.words.find(words)
        known = found >= 0
        self.words.add(found[known], rows[known], table)
        np.add.at(table, (rows[known], self.languages), 1.0)
        others: list[list[str] | None] = [None] * len(fresh)
        unknown = np.flatnonzero(~known)
        for n in unknown.tolist():
            row = int(rows[n])
            others[row] = [*(others[row] or ()), words[n]]
        if self.grams is not None:
            self.grams.cover_all([words[n] for n in unknown.tolist()], rows[unknown], table, self.languages)
        self.others += others
        self.table = np.concatenate([self.table, table])
        self.has_others = np.concatenate([self.has_others, [x is not None for x in others]]).astype(bool)
        self.memo.fresh = []

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, list[Counter]]:
        """The sums of each text, and its other words."""
        if len(self.memo) * self.width > MEMO:
            self._forget()
        pieces = [(t or "").lower().split() for t in texts]
        rows = [np.fromiter(map(self.memo.__getitem__, p), np.int64, len(p)) for p in pieces]
        self._resolve()
        sums = np.array([self.table[r].sum(0) for r in rows]).reshape(len(rows), self.width)
        return sums, [Counter(w for k in r[self.has_others[r]] for w in self.others[k]) for r in rows]


class _Memo(dict):
    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


def lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def cover(words: DataFrame, grams: DataFrame) -> DataFrame:
    """word, shares (of each size of n-gram), langs, gains for each distinct word: the mean over
    its letters, and the marks at its ends, of the longest known n-gram that starts there."""
    if grams.count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    marked = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    each = F.transform(F.sequence(F.lit(1), F.length(marked)), lambda i: F.transform(F.array(*map(F.lit, range(1, LONGEST + 1))), lambda k: F.struct(i.alias("i"), F.substring(marked, i, k).alias("key"))))
    # at the end of a word the longer pieces are its last letters again: nothing changes by them
    pieces = words.repartition("word").select("word", F.inline(F.flatten(each)))
    longest = pieces.join(grams.select("key", "size"), "key").groupBy("word", "i").agg(F.max(F.struct("size", "key")).alias("p"))
    found = longest.select("word", F.col("p.key").alias("key")).join(grams, "key").select("word", "size", F.explode(F.arrays_zip("langs", "gains")).alias("e"), F.element_at("langs", 1).alias("first"))
    once = F.col("e.langs") == F.col("first")  # one row for each piece
    counts = [F.count(F.when(once & (F.col("size") == k), 1)).alias(f"c{k}") for k in range(1, LONGEST + 1)]
    sums = found.groupBy("word", F.col("e.langs").alias("lang")).agg(F.sum("e.gains").alias("gain"), *counts)
    own = sums.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("lang", "gain"))).alias("e"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(1, LONGEST + 1)))
    n = sum((F.col(f"c{k}") for k in range(2, LONGEST + 1)), F.col("c1")).cast("double")
    own = own.withColumn("n", n)
    shares = F.array(F.lit(0.0), *(F.col(f"c{k}") / F.col("n") for k in range(1, LONGEST + 1)))
    return own.select("word", shares.alias("shares"), F.col("e.lang").alias("langs"), F.transform("e", lambda x: x["gain"] / F.col("n")).alias("gains"))


def judged(sums: np.ndarray, words: np.ndarray, languages: list[str]) -> tuple[list[str], list[float]]:
    """Language and its odds for rows of summed log frequencies over so many words."""
    names, odds = [], []
    for own, n in zip(sums, words, strict=True):
        if not n or not languages:
            names.append("und")
            odds.append(0.0)
            continue
        mean = own / n * min(n, 30.0)  # words are not independent: beyond 30 they add no certainty
        each = np.exp(mean - mean.max())
        best = int(np.argmax(each))
        names.append(languages[best])
        odds.append(float(each[best] / each.sum()))
    return names, odds


def corrections(words: DataFrame, shared, base: np.ndarray) -> DataFrame:
    """hash and v0, v1 ... for each of words (key, langs, gains): what a count of it adds to a
    text's log frequencies in each language, in which its n-grams stand for it."""
    width = base.shape[1]
    names = ["hash", *(f"v{k}" for k in range(width))]

    def correct(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value[1]
        for part in small_batches(parts, 2_000):
            n = part.num_rows
            fix = np.zeros((n, width + LONGEST + 1))
            sizes = np.asarray(part.column("langs").value_lengths(), np.int64)
            np.add.at(fix, (np.repeat(np.arange(n), sizes), np.asarray(part.column("langs").flatten())), np.asarray(part.column("gains").flatten()))
            fix[:, width] += 1.0
            grams.cover_all(part.column("key").to_pylist(), np.arange(n), fix, width, -1.0)
            values = fix[:, :width] + fix[:, width:] @ base
            yield pa.RecordBatch.from_arrays([part.column("hash"), *(pa.array(v) for v in np.ascontiguousarray(values.T))], names)

    fields = "hash long, " + ", ".join(f"v{k} double" for k in range(width))
    return words.select(F.xxhash64("key").alias("hash"), "key", "langs", "gains").mapInArrow(correct, fields)


def covered(words: DataFrame, model: LanguageModel) -> DataFrame:
    """hash and v0, v1 ... for distinct words, known or not, from the model's tables."""
    known = model.words.select(F.col("key").alias("word"), "langs", "gains")
    asked = write_table(words.join(known, "word", "left"), "language-asked")
    own = asked.filter(F.col("langs").isNotNull()).select("word", F.array(F.lit(1.0), *[F.lit(0.0)] * LONGEST).alias("shares"), "langs", "gains")
    scored = own.unionByName(cover(asked.filter(F.col("langs").isNull()).select("word"), model.grams))
    held = scored.select(F.xxhash64("word").alias("hash"), "shares", F.map_from_arrays("langs", "gains").alias("held"))

    def value(lang: int) -> Column:
        return sum((F.col("shares")[k] * float(model.base[k, lang]) for k in range(LONGEST + 1)), F.coalesce(F.try_element_at("held", F.lit(lang)), F.lit(0.0)))

    return held.select("hash", *(value(k).alias(f"v{k}") for k in range(len(model.languages))))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text). Sums are taken in no fixed
    order, so a score may differ in its last digits between runs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not model.languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    languages, base, width = model.languages, model.base, len(model.languages)
    hot = frequent(model.words, HOT)
    whole = model.grams.count() <= BROADCAST_GRAMS
    words = Words(model.words.filter(hot).select(F.xxhash64("key").alias("hash"), "langs", "gains").toArrow())
    shared = docs.sparkSession.sparkContext.broadcast((words, Grams(model.grams.select("key", "langs", "gains").toArrow()) if whole else None))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, digest = Scorer(*shared.value, width), xxhash.xxh64_intdigest
        for part in small_batches(parts, 500):
            sums, others = scorer.scan(part.column("text").to_pylist())
            sizes = [len(x) for x in others]
            flat = [w for x in others for w in x]
            hashes = np.fromiter((digest(w.encode(), 42) for w in flat), np.uint64, len(flat)).view(np.int64)
            totals = sums[:, :width] + sums[:, width:-1] @ base
            arrays = [part.column("rid"), part.column("doc_id"), lists(totals.ravel(), [width] * len(totals), pa.float64()), pa.array(sums[:, -1].astype(np.int64)), lists(hashes, sizes, pa.int64())]
            arrays += [lists([] if whole else flat, [0] * len(sizes) if whole else sizes, pa.string()), lists([n for x in others for n in x.values()], sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "sums", "n", "hashes", "words", "times"])

    # rid is written with the rows, so it stays the same wherever it is read
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    read = write_table(numbered.mapInArrow(scan, "rid long, doc_id long, sums array<double>, n long, hashes array<long>, words array<string>, times array<int>"), "language-scan")
    if whole:
        others = read.select("rid", F.inline(F.arrays_zip("hashes", "times")))
        scored = corrections(model.words.filter(~hot), shared, base)
    else:
        others = read.select("rid", F.inline(F.arrays_zip("hashes", "words", "times")))
        scored = covered(others.select(F.col("words").alias("word")).distinct(), model)
    met = others.select("rid", F.col("hashes").alias("hash"), "times").join(scored, "hash")
    more = met.groupBy("rid").agg(*(F.sum(F.col(f"v{k}") * F.col("times")).alias(f"v{k}") for k in range(width)))
    more = more.select("rid", F.array(*(f"v{k}" for k in range(width))).alias("more"))

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(parts, 500):
            table = [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width) for c in ("sums", "more")]
            names, odds = judged(table[0] + table[1], np.asarray(part.column("n")), languages)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(odds, pa.float64())], ["doc_id", "lang_pred", "score"])

    none = F.array_repeat(F.lit(0.0), width)
    full = read.select("rid", "doc_id", "sums", "n").join(more, "rid", "left").select("doc_id", "sums", "n", F.coalesce("more", none).alias("more"))
    return full.mapInArrow(finish, "doc_id long, lang_pred string, score double")
