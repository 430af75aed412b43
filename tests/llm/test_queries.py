"""Each registered query over a small folder, against brute force, column by column."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import language_id, line_quality, queries
from tests.llm.test_operators import languages_by_force, leaks_by_force, prints_by_force, prose, removed_by_force


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    shared = prose(77, 50)
    item = prose(78, 30)
    texts = [". ".join(prose(n * 11 + k, 8, 2000).capitalize() for k in range(6)) + ".\n" + prose(n, 12) for n in range(40)]
    texts += [t + "\n" + shared for t in texts[:5]] + texts[5:8] + [prose(3, 20) + " " + item + " " + prose(4, 20)]
    texts += [None, "", "é日本😀 " * 30, " ".join(w + "$$$" for w in prose(9, 100).split()), (prose(8, 1) + " ") * 200, "12 34", prose(10, 6000)]
    rows = [(n, t, None if n % 9 == 8 else ["en", "de", "fr"][n % 3]) for n, t in enumerate(texts)] + [(3, texts[3], "en")]
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int("$$$" not in (t or "") and d < 50), 0) for d, t, _ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(79, 30)), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    urls = ["http://a.NET/x", "https://example.net/en/q?x", "http://www.example.com/de/", "http://b.org/fr/z#t", "http://b.org/de", "ftp://casino.example.org/", "no scheme", None, "http://x.net.org/fr", "http://notexample.com/de/", "http://my-casino-club.com/p", "http://x.com://y.net/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    turns = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("system", "be ###"), ("user", None), ("assistant", "x\\h</turn>\n"), ("user", "y"), ("assistant", "")][c % 2 : 3 + c % 3])]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at), rows, item, turns


def run(spark, name, at):
    return [r.asDict() for r in queries.QUERIES[name](spark, at).collect()]


def test_op1(spark, folder):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want, start = [], 0
    for d, t, _ in sorted(folder[1], key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op1_token_planes", folder[0])) == sorted(want)


def test_op2(spark, folder):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in run(spark, "op2_url_rules", folder[0])}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("example.net", "/en/q", "example.net/en/", "allow")
    assert got[2] == ("www.example.com", "/de/", "example.com/de/", "block")
    assert got[3] == ("b.org", "/fr/z", "org/fr/", "allow")
    assert got[4] == ("b.org", "/de", None, "allow")
    assert got[5][2:] == (None, "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == (None, "allow")
    assert got[9][2:] == (None, "allow")
    assert got[10][2:] == (None, "block")
    assert got[11][:2] == ("x.com:", "//y.net/")


def test_op3(spark, folder):
    at, rows, item, _ = folder
    want = leaks_by_force([r[:2] for r in rows], [(1, item), (2, prose(79, 30))])
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op3_decontaminate", at)} == want
    assert want


def score_by_hand(text, model):
    """Every line's chance of being good, by sums over both labels from either end."""
    lines = line_quality.lines_of(text)
    own = line_quality.features(lines)
    n, size = len(lines), line_quality.OWN
    scores = []
    for k in range(n):
        s = model.weights[own[k]].sum(0) + model.weights[-1]
        if k:
            s = s + model.weights[own[k - 1] + size].sum(0)
        if k < n - 1:
            s = s + model.weights[own[k + 1] + 2 * size].sum(0)
        s = s + (model.weights[-3] if k == 0 else 0) + (model.weights[-2] if k == n - 1 else 0)
        scores.append(s)
    ahead, behind = [scores[0]], [np.zeros(2)]
    for k in range(1, n):
        ahead.append(scores[k] + [np.logaddexp.reduce(ahead[-1] + model.moves[:, y]) for y in (0, 1)])
        behind.append(np.array([np.logaddexp.reduce(model.moves[y] + scores[n - k] + behind[-1]) for y in (0, 1)]))
    total, weight = 0.0, 0.0
    for k in range(n):
        both = ahead[k] + behind[n - 1 - k]
        w = len(lines[k]) + 1e-6
        total += w * math.exp(both[1] - np.logaddexp.reduce(both))
        weight += w
    return total / weight


def test_op4(spark, folder, monkeypatch):
    at, rows, *_ = folder
    models = []
    plain = line_quality.learn
    monkeypatch.setattr(line_quality, "learn", lambda docs, labels: models.append(plain(docs, labels)) or models[-1])
    got = run(spark, "op4_line_quality", at)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    texts = {d: t for d, t, _ in rows}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert abs(r["score"] - score_by_hand(texts[r["doc_id"]], models[0])) < 1e-9
    assert got[0].keys() == {"doc_id", "held_out", "score", "predicted"}


def test_op5(spark, folder):
    at, rows, *_ = folder
    got = run(spark, "op5_media_sequences", at)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    texts = {d: t for d, t, _ in rows}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        height = len(payload) // 576
        lines = b"".join(b"\0" + payload[k * 576 : (k + 1) * 576] for k in range(height))
        chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (576).to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        mean = sum(payload) / len(payload)
        spread = sum(x * x for x in payload) / len(payload) - mean * mean
        step = sum(abs(x - y) for x, y in zip(payload, payload[1:], strict=False)) / (len(payload) - 1)
        said = re.fullmatch(r"576x(\d+) mean=([\d.]+) var=([\d.]+) step=([\d.]+)", r["feature"])
        assert int(said[1]) == height
        assert np.allclose([float(x) for x in said.groups()[1:]], [mean, max(0, spread), step], atol=2e-6)
        assert r["caption"] == f"document {r['doc_id']}"


def test_op6(spark, folder):
    at, rows, *_ = folder
    got = run(spark, "op6_simhash_dedup", at)
    prints = {d: prints_by_force(t) for d, t, _ in rows}
    group = {d: d for d in prints}
    for _ in prints:  # labels spread along links until nothing changes
        for a in prints:
            group[a] = min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{prints[d]:016x}", group[d]) for d, *_ in rows)


def test_op7(spark, folder):
    at, rows, *_ = folder
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    taught = [(t, lang) for d, t, lang in rows if not held(d) and lang and t is not None]
    want = languages_by_force(taught, [t for _, t, _ in rows])
    got = run(spark, "op7_language_id", at)
    assert sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted((d, held(d), p, round(float(s), 9)) for (d, *_), (p, s) in zip(rows, want, strict=True))


def test_letters_are_the_same_in_learning_and_scoring(spark):
    model = language_id.learn(spark.createDataFrame([("x² Ⅷa", "one"), ("y", "two")], "text string, lang string"))
    assert {r["key"] for r in model.words.collect()} == {"x", "a", "y"}
    got = language_id.predict(spark.createDataFrame([(1, "x²"), (2, "²Ⅷ"), (3, "y³")], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "one", 2: "und", 3: "two"}


def test_op8(spark, folder):
    at, _, _, turns = folder
    hard = "\\### Assistant: </turn> ok"
    turns = turns + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    got = {r["conv_id"]: r for r in run(spark, "op8_chat_format", at)}
    assert set(got) == {c for c, *_ in turns}
    for c, r in got.items():
        own = sorted((t, role, x or "") for k, t, role, x in turns if k == c)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op9(spark, folder):
    at, rows, *_ = folder
    want = removed_by_force([r[:2] for r in rows])
    got = run(spark, "op9_suffix_dedup", at)
    texts = {d: t for d, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        removed, spans, kept = want[r["doc_id"], text]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(text.encode()), removed, spans, hashlib.sha256(kept).hexdigest())


def test_op10(spark, folder):
    at, rows, *_ = folder
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = []
    for d, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(d, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = run(spark, "op10_pattern_packing", at)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at_ = 0
        for offset, length in sorted(own):
            assert offset == at_
            at_ += length
        assert at_ <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
