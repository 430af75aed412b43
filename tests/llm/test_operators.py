"""Operators 3 to 7, 9 and 10 against brute force on small tables, with nulls, empty and
very long texts, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import decontaminate, graph, language_id, line_quality, media_sequences, pattern_packing, simhash_dedup, suffix_dedup
from ledgerline.llm.common import write_table
from ledgerline.llm.graph import components

EXTRA = ", fp long, h long, words string, score double, a long, spans string, label string, length long"


def table(spark, rows):
    """doc_id, text and columns with names that operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, "w", 0.5, 3, "s", "l", 9) for r in rows], "doc_id long, text string" + EXTRA)


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(1 + w % 3)) for w in (r.randrange(vocabulary) for _ in range(words)))


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (None, "a document without an id"), (904, "é日本😀 " * 40)]


# --- 3 ---


def leaks_by_force(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda w: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    weight = lambda s: sum(map(len, s))
    out = set()
    for doc, text in docs:
        w = words(text)
        for item, other in items:
            v = words(other)
            if not v or not w:
                continue
            for k in range(max(1, len(w) - len(v) + 1)):
                a, b = cut(w[k : k + len(v)]), cut(v)
                if weight(a & b) >= 0.8 * weight(a | b):
                    out.add((doc, item))
    return out


def test_leaks(spark):
    items = [(n, prose(50 + n, 20 + 9 * n)) for n in range(5)] + [(7, None), (8, "Quite short"), (9, "one"), (10, "just four words here"), (11, ""), (12, "?!"), (0, prose(50, 20))]
    docs = [(n, prose(n, 60)) for n in range(12)]
    for n in range(5):
        docs.append((20 + n, prose(n, 30) + " " + items[n][1].upper().replace(" ", ", ") + ". " + prose(n + 9, 30)))
        w = items[n][1].split()
        docs.append((30 + n, " ".join([*w[:2], "changed", *w[3:]])))
        docs.append((40 + n, " ".join(w[: len(w) - 2])))
        docs.append((50 + n, " ".join(w[: len(w) // 2])))
    docs += [docs[12]] * 2 + ODD + [(77, prose(1, 3000) + " " + items[3][1])]
    docs += [(80, "A quite, short text"), (81, "quite a short text"), (82, prose(5, 30) + " just four words here"), (83, "just four words")]
    found = decontaminate.contaminated(table(spark, docs), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, size int"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == leaks_by_force(docs, items)
    assert {(20 + n, n) for n in range(5)} <= got


def test_leaks_at_the_threshold(spark):
    """Items of 15 to 59 words of which the last ones or one in the middle differ, at either end
    of a document and inside; items that share passages."""
    items = [(n, prose(600 + n, 15 + 4 * (n % 12), 3000)) for n in range(12)]
    items += [(100 + n, prose(700, 20, 3000) + " " + prose(701 + n, 12, 3000)) for n in range(3)]
    docs = []
    for n, text in items:
        w = text.split()
        for cut in range(1 + len(w) // 20, 1 + len(w) // 8):
            part, last = " ".join(w[:-cut]), prose(9000 + n, cut, 3000)
            docs += [f"{part} {last}", f"{part} {last} {prose(n, 40, 3000)}", f"{prose(n + 1, 40, 3000)} {part}", f"{prose(n, 33, 3000)} {part} {prose(n + 2, 30, 3000)}"]
        docs.append(" ".join([*w[:3], "other", *w[4:]]))
    docs = list(enumerate(docs))
    found = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks_by_force(docs, items)
    assert len(want) > 60
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_leaks_shuffled_and_empty(spark, monkeypatch):
    item = spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string")
    docs = table(spark, [(1, prose(3, 30)), (2, prose(4, 30))])
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCUMENTS", 0)
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, item).collect()] == [1]
    assert decontaminate.contaminated(table(spark, []), item).count() == 0
    assert decontaminate.contaminated(docs, item.limit(0)).count() == 0


def test_blocks_meet_all_within_radius(spark):
    r = random.Random(5)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = []
    for _ in range(60):
        x = r.getrandbits(64)
        rows.append((signed(x), signed(x ^ sum(1 << k for k in r.sample(range(64), decontaminate.RADIUS)))))
    df = spark.createDataFrame(rows, "x long, y long").select(decontaminate.blocks(F.col("x"), decontaminate.RADIUS).alias("a"), decontaminate.blocks(F.col("y"), decontaminate.RADIUS).alias("b"))
    assert df.filter(F.size(F.array_intersect("a", "b")) == 0).count() == 0


def test_radius_holds_pairs_near_the_threshold(spark):
    """Items of 13 to 60 words whose last words differ, as many as a similarity of 0.8 allows,
    at the start, inside and at the end of a document: found within the radius and without."""
    items, docs = [], []
    for n in range(13, 61):
        for k in range(3):
            number = n * 10 + k
            words = prose(number, n).split()
            items.append((number, " ".join(words)))
            changed = words[: n - (n - 4) // 9] + prose(number + 5000, (n - 4) // 9).split()
            before, after = ("" if k == 0 else prose(number + 7000, 20)), ("" if k == 2 else prose(number + 9000, 20))
            docs.append((number, " ".join([before, *changed, after])))
    held = spark.createDataFrame(items, "item_id long, text string")
    whole, near = ({(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table(spark, docs), held, radius=radius).collect()} for radius in (None, decontaminate.RADIUS))
    assert near <= whole
    assert len(whole) > 0.8 * len(items)
    for low, high in ((13, 20), (21, 30), (31, 45), (46, 60)):
        own = {x for x in whole if low <= x[1] // 10 <= high}
        assert len(near & own) >= 0.95 * len(own)


# --- 4 ---


def test_forward_backward_by_enumeration():
    r = np.random.default_rng(1)
    starts = np.array([0, 1, 4, 9])
    scores, moves = r.normal(size=(9, 2)), r.normal(size=(2, 2))
    marginals, pairs, total = line_quality.forward_backward(scores, moves, starts)
    for d, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        weight, by = 0.0, np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            p = np.exp(sum(scores[a + k, y[k]] for k in range(b - a)) + sum(moves[y[k], y[k + 1]] for k in range(b - a - 1)))
            weight += p
            for k in range(b - a):
                by[k, y[k]] += p
        assert np.isclose(np.log(weight), total[d])
        assert np.allclose(by / weight, marginals[a:b])
    assert np.allclose(pairs[[2, 3, 5]].sum((1, 2)), 1)


def test_slopes_by_small_differences():
    r = np.random.default_rng(3)
    starts = np.array([0, 1, 4, 9])
    widths = [len(v) + 1 for v in line_quality.EDGES.values()]
    own = np.stack([sum(widths[:k]) + r.integers(0, w, 9) for k, w in enumerate(widths)], axis=1)
    labels, share = np.array([1, 0, 1]), np.array([0.3, 0.1, 0.2])
    x = r.normal(size=2 * line_quality.SIZE + 4)
    got = line_quality.slopes(own, starts, labels, share, line_quality.model_of(x))
    loss = lambda x: line_quality.slopes(own, starts, labels, share, line_quality.model_of(x))[0]
    for k in [*r.integers(0, len(x), 40), *range(2 * line_quality.SIZE - 6, len(x))]:
        step = np.eye(len(x))[k] * 1e-5
        assert abs((loss(x + step) - loss(x - step)) / 2e-5 - got[1 + k]) < 1e-6
    halves = [line_quality.slopes(own[a:b], starts[i:j] - a, labels[i : j - 1], share[i : j - 1], line_quality.model_of(x)) for a, b, i, j in ((0, 4, 0, 3), (4, 9, 2, 4))]
    assert np.allclose(sum(halves), got)


def test_fit_reaches_the_least_loss(spark):
    r = np.random.default_rng(4)
    rows = [(int(y), bytes(np.concatenate([line_quality.features([("ok. " if y else "$$ ") * int(n)])[0] for n in r.integers(1, 9, 5)]).astype(np.uint8))) for y in r.integers(0, 2, 40)]
    chains = spark.createDataFrame([(y, bytearray(b)) for y, b in rows], "quality int, lines binary").repartition(3)
    model = line_quality.fit(chains)
    x = np.concatenate([model.weights.ravel(), model.moves.ravel()])
    n = [5 * sum(y == k for y, _ in rows) for k in (0, 1)]
    found = line_quality.summed(chains, np.array([0.5 / k for k in n]), x)
    decay = np.r_[np.full(2 * line_quality.SIZE, line_quality.DECAY), np.full(4, 10 * line_quality.DECAY)]
    assert np.abs(found[1:] + decay * x).max() < 2e-3
    assert found[0] < 0.05
    assert line_quality.fit(chains.limit(0)).weights.any() == 0


def test_lines_keep_the_text():
    for text in ("", "a\n\nb", "word " * 1000, "x" * 5000):
        assert "".join(line_quality.lines_of(text)) == text.replace("\n", "")


def test_quality_held_out(spark):
    good = [(n, ". ".join(prose(n * 7 + k, 9).capitalize() for k in range(12)) + ".") for n in range(60)]
    bad = [(100 + n, " ".join(w + "$$$" for w in prose(n, 100).split())) for n in range(30)] + [(200 + n, (prose(n, 1) + " ") * 150) for n in range(30)]
    docs = table(spark, good + bad + ODD + [(905, "long text " * 30_000)])
    labels = spark.createDataFrame([(n, 1, 0) for n, _ in good] + [(n, 0, 0) for n, _ in bad] + [(900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = line_quality.learn(docs, labels.filter("doc_id % 5 > 0"))
    got = {r["doc_id"]: r["score"] for r in line_quality.score(docs, model).collect()}
    assert len(got) == len(good + bad + ODD) + 1
    assert all(0 <= s <= 1 for s in got.values())
    assert all(got[n] >= 0.3 for n, _ in good if n % 5 == 0)
    assert all(got[n] < 0.3 for n, _ in bad if n % 5 == 0)
    kept = line_quality.scored_rows(docs, model)
    assert kept.select("row.*").columns == docs.columns
    assert sorted(map(str, kept.select("row.*").collect())) == sorted(map(str, docs.collect()))
    empty = line_quality.learn(docs, labels.limit(0))
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in line_quality.score(docs, empty).collect())
    assert line_quality.score(table(spark, []), model).count() == 0


# --- 5 ---


def test_segments_in_order():
    html = "<p>One <b>two</b></p><figure><img src='sha256:x' alt='no'><figcaption> a  b </figcaption></figure>tail<script>x()</script><img src=y alt=z><img>"
    got = [(s["pos"], s["kind"], s["text"] or s["ref"], s["caption"]) for s in media_sequences.segments_of(html)]
    assert got == [(0, "text", "One two", None), (1, "media", "sha256:x", "a b"), (2, "text", "tail", None), (3, "media", "y", "z")]
    assert media_sequences.segments_of(None) == []


@pytest.mark.parametrize("text", [None, "", "x", "é" * 288, "y" * 577, "long " * 50_000])
def test_png_round_trip(text):
    n, payload = media_sequences.payload_of(text)
    assert len(payload) % 576 == 0
    assert len(payload) > 0
    assert payload[:n] == (text or "").encode()
    assert set(payload[n:]) <= {255}
    assert media_sequences.decode_png(media_sequences.encode_png(payload)).tobytes() == payload


def test_store_and_sequences(spark):
    rows = [*ODD, (1, "same"), (2, "same"), (1, "same"), (1, "other")]
    store = media_sequences.store_texts(table(spark, rows))
    index = media_sequences.media_index(store)
    assert index.count() == len({media_sequences.payload_of(t)[1] for _, t in rows})
    html = F.concat(F.lit("<p>t</p><img src='sha256:"), F.col("digest"), F.lit("' alt='c'><img src='sha256:00'>"))
    pages = store.select("doc_id", F.lit("x").alias("segments"), F.lit("y").alias("rid"), html.alias("html"))
    out = media_sequences.interleave(media_sequences.parse_pages(pages), index).collect()
    assert len(out) == len(rows)
    want = sorted((str(d), hashlib.sha256(media_sequences.payload_of(t)[1]).hexdigest()) for d, t in rows)
    assert sorted((str(r["row"]["doc_id"]), r["segments"][1]["media"]["payload_sha256"]) for r in out) == want
    assert {tuple(r["row"])[1:] for r in out} == {("x", "y")}
    assert all(r["segments"][2]["media"] is None and r["segments"][1]["caption"] == "c" for r in out)


def test_real_pages(spark):
    """Whole pages: text in order, nothing of scripts and styles, positions without gaps."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = media_sequences.parse_pages(pages).select("row.page_id", "segments").collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(got) == len(html)
    for r in got:
        assert [s["pos"] for s in r["segments"]] == list(range(len(r["segments"])))
        said = "".join(s["text"] or "" for s in r["segments"]).replace(" ", "")
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title|template|noscript)\b.*?</\1>|<[^>]*>", "", html[r["page_id"]] or "")
        assert said == "".join(unescape(plain).split())


# --- 6 ---


def prints_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_masks_lose_no_pair():
    masks = simhash_dedup.covering_masks(4)
    r = random.Random(3)
    assert len(masks) == 31
    for _ in range(3000):
        apart = sum(1 << k for k in r.sample(range(64), r.randint(0, 4)))
        assert any(apart & m == 0 for m in masks)


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    """However small Spark takes a table to be: masks explode it."""
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write_table(df, name)

    monkeypatch.setattr(simhash_dedup, "write_table", written)
    monkeypatch.setattr(graph, "write_table", written)
    rows = [(n, f"one two three four five six seven {n % 3}", "x") for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert simhash_dedup.near_duplicates(docs).count() == 6
    kept = simhash_dedup.one_of_each(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_near_duplicates(spark):
    rows = [(n, prose(n % 40, 120)) for n in range(60)]
    for n in range(60, 150):
        w = prose(n % 7, 200).split()
        w[n % 200] = "edit"
        rows.append((n, " ".join(w)))
    rows += [*ODD, (3, prose(3, 120)), (906, "X Y  z"), (907, "x y z"), (908, "long " * 20_000)]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_dedup.near_duplicates(table(spark, rows)).collect()}
    want = {(d, f"{prints_by_force(t):016x}") for d, t in rows}
    assert set(got) == want
    group = {x: x for x in want}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in want:
        for b in want:
            if (int(a[1], 16) ^ int(b[1], 16)).bit_count() <= 4:
                group[root(a)] = root(b)
    least = defaultdict(list)
    for x in want:
        least[root(x)].append(x[0])
    for x in want:
        ids = [i for i in least[root(x)] if i is not None]
        assert got[x] == (min(ids) if ids else None)
    assert simhash_dedup.near_duplicates(table(spark, [])).count() == 0


def test_hub_and_far_clusters(spark):
    """Many fingerprints around two centres a few bits apart: chains must join them."""
    r = random.Random(8)
    centre = r.getrandbits(64)
    points = {centre ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for _ in range(150)}
    signed = [x - 2**64 if x >= 2**63 else x for x in points]
    got = {x["node"]: x["label"] for x in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4).collect()}
    group = {x: x for x in signed}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: got.get(x, x) for x in signed} == {x: root(x) for x in signed}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91), (5, 5)], "u long, v long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 91: 90}
    assert components(edges.limit(0)).count() == 0


# --- 7 ---


def test_languages_held_out(spark):
    say = {"xx": "aeiou", "yy": "äöüß", "zz": "ñóíé"}
    rows = []
    for k, (lang, vowels) in enumerate(say.items()):
        for n in range(30):
            r = random.Random(n * 9 + k)
            rows.append((len(rows), " ".join("".join(r.choice("bdklmst") + r.choice(vowels) for _ in range(r.randint(1, 4))) for _ in range(30)), lang))
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "12 3!", "yy"), (903, "x²", None), (None, "bä dö", "yy"), (5, rows[5][1], "xx"), (904, "ba " * 50_000, None)]
    docs = spark.createDataFrame([(*r, 1.0, "s") for r in rows], "doc_id long, text string, lang string, score double, word string")
    model = language_id.learn(docs.filter("doc_id % 4 <> 2"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()]
    assert len(got) == len(rows)
    assert all(0 <= s <= 1 for _, _, s in got)
    by = {d: p for d, p, _ in got}
    assert all(by[d] == lang for d, _, lang in rows[:90])
    assert [by[d] for d in (900, 901, 902)] == ["und"] * 3
    nothing = language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def languages_by_force(taught, texts):
    """Log frequencies over all counts; unknown words by the longest known n-gram at each place."""
    cut = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    names = sorted({lang for _, lang in taught})
    counts = [defaultdict(lambda: np.zeros(len(names))) for _ in range(4)]
    for text, lang in taught:
        for w in cut(text):
            counts[0][w][names.index(lang)] += 1
            for k in (1, 2, 3):
                for i in range(len(w) + 3 - k):
                    counts[k][f"_{w}_"[i : i + k]][names.index(lang)] += 1
    totals = [sum(c.values()) + 0.5 * len(c) for c in counts]
    log = lambda k, key: np.log((counts[k][key] + 0.5) / totals[k])
    out = []
    for text in texts:
        score, words = np.zeros(len(names)), cut(text)
        for w in words:
            if w in counts[0]:
                score += log(0, w)
                continue
            m = f"_{w}_"
            best = [next((k for k in (3, 2, 1) if i + k <= len(m) and m[i : i + k] in counts[k]), 0) for i in range(len(m))]
            pieces = [log(k, m[i : i + k]) for i, k in enumerate(best) if k]
            score += sum(pieces) / len(pieces)
        odds = np.exp((score - score.max()) / len(words) * min(len(words), 30)) if words else None
        out.append((names[int(np.argmax(odds))], odds.max() / odds.sum()) if words else ("und", 0.0))
    return out


@pytest.mark.parametrize(("hot", "grams"), [(200_000, 500_000), (30, 0), (0, 0)])
def test_languages_lose_no_word(spark, monkeypatch, hot, grams):
    monkeypatch.setattr(language_id, "HOT", hot, raising=False)
    monkeypatch.setattr(language_id, "BROADCAST_GRAMS", grams, raising=False)
    taught = [(prose(n, 60, 90), lang) for n, lang in enumerate(["xx", "yy", "zz"] * 4)] + [(prose(50, 9), "only")]
    texts = [prose(n, 3 + n % 30, 300) for n in range(40)] + [None, "", "12", "zzqx", "日本 é", "ba zzqx " * 3000]
    docs = spark.createDataFrame([(7 if n < 3 else n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    model = language_id.learn(spark.createDataFrame(taught, "text string, lang string"))
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(docs, model).collect())
    want = languages_by_force(taught, texts)
    assert got == sorted((7 if n < 3 else n, p, round(float(s), 9)) for n, (p, s) in enumerate(want))


def test_languages_keep_rare_words_and_languages(spark):
    """30,000 words of one language and 210 languages: all are known afterwards."""
    name = lambda n: "".join("bdgklmnprs"[int(c)] + "aeiouaeiou"[int(c)] for c in f"{n:05d}")
    rows = [(" ".join(name(n) for n in range(30_000)), "big"), (" ".join(name(n) for n in range(30_000, 60_000)), "also")]
    rows += [(f"{name(70_000 + n)} x", f"l{n:03d}") for n in range(210)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(n, name(n)) for n in (29_999, 59_999, 70_000, 70_209)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert len(model.languages) == 212
    assert got[70_000] == "l000"
    assert got[70_209] == "l209"


# --- 9 ---


def removed_by_force(rows):
    seen, out = {}, {}
    order = sorted({(d is not None, d or 0, zlib.crc32((t or "").encode()), t or "") for d, t in rows})
    for known, doc, _, text in order:
        raw = text.encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                mark[p : p + 100] = b"\1" * 100
            else:
                seen[raw[p : p + 100]] = 1
        out[(doc if known else None, text)] = (sum(mark), len(bytes(mark).replace(b"\0", b" ").split()), bytes(x for x, y in zip(raw, mark, strict=True) if not y))
    return out


@pytest.mark.parametrize("group", [4000, 4])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "BATCH", group)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if group == 4 else "10m")
    monkeypatch.setattr(suffix_dedup, "HOT", group)
    monkeypatch.setattr(suffix_dedup, "PIECE", 150 if group == 4 else 16_384)
    shared, edge = prose(1, 60), prose(2, 40)[:100]
    rows = [(n, prose(n, 40) + " " + shared + " " + prose(n + 60, 30)) for n in range(25)]
    rows += [(30 + n, edge[n : n + 99] + "é" + edge) for n in range(4)] + [(40, "ab" * 400), (41, "a" * 350), (42, shared), (43, shared + shared)]
    rows += [*ODD, (42, shared), (42, shared[::-1] + shared), (909, prose(77, 20_000)), (910, edge), (911, edge)]
    docs = table(spark, rows)
    done = suffix_dedup.remove(docs, suffix_dedup.repeated_spans(docs))
    assert done.select("row.*").columns == docs.columns
    got = done.select("row.doc_id", "row.text", "spans", "kept").collect()
    want = removed_by_force(rows)
    assert len(got) == len(rows)
    for r in got:
        spans = r["spans"] or []
        assert (sum(s["b"] - s["a"] for s in spans), len(spans), bytes(r["kept"])) == want[(r["doc_id"], r["text"] or "")], r["doc_id"]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    empty = table(spark, [])
    assert suffix_dedup.remove(empty, suffix_dedup.repeated_spans(empty)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_two_stage_order(seed):
    r = random.Random(seed)
    text = np.array([r.choice([0, 1, 1, 2, 2, 2, 255][: 2 + seed % 6]) for _ in range(r.randint(1, 300))], np.uint8)
    order = suffix_dedup.two_stage_order(text, 400)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
    shared = suffix_dedup.common_prefixes(text, order, 400)
    for n in range(1, len(order)):
        a, b = raw[order[n - 1] :], raw[order[n] :]
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[n] == k or shared[n] > k >= min(len(a), len(b))  # zeros after the end count as shared


# --- 10 ---

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_nnls():
    r = np.random.default_rng(2)
    matrix = r.random((12, 30))
    truth = np.where(r.random(30) < 0.2, r.random(30) * 9, 0)
    x = pattern_packing.nnls(matrix, matrix @ truth)
    assert (x >= 0).all()
    assert np.linalg.norm(matrix @ (x - truth)) < 1e-6


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5}, {1025: 7}, {700: 30, 648: 10, 1: 3, 2047: 2}])
def test_plan_places_every_piece(histogram):
    planned = pattern_packing.plan(dict(histogram), 2048)
    used = defaultdict(int)
    for lengths, times in planned:
        assert sum(lengths) <= 2048
        for k in lengths:
            used[k] += times
    assert dict(used) == histogram


def test_plan_is_tight():
    r = random.Random(4)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2048, 1 + int(r.expovariate(1 / 500)))] += 1
    sequences = sum(t for _, t in pattern_packing.plan(dict(histogram), 2048))
    assert sequences <= 1.005 * sum(k * n for k, n in histogram.items()) / 2048 + 1


def test_packing(spark):
    rows = [(n, prose(n, 5 + 37 * n % 900)) for n in range(40)] + ODD + [(3, prose(3, 116))] * 2 + [(912, "many words " * 3000)]
    packed = pattern_packing.pack_documents(table(spark, rows), BYTES, 0, 512, keep_ids=True)
    got = packed.collect()
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    want = []
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 512 or 512, len(ids) + 1, 512)]
        want += [(doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: str(tuple(r)[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in pattern_packing.sequences(packed).collect()}
    assert joined == {s: b"".join(bytes(r["ids"]) for r in sorted(own, key=lambda r: r["offset"])) for s, own in by.items()}
    assert pattern_packing.pack_documents(table(spark, []), BYTES, 0, 512).count() == 0
