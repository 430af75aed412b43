"""Operator 2: rules against a plain loop over all of them."""

from ledgerline.llm import url_rules as ur

RULES = [ur.host_rule("net/", "block"), ur.host_rule("example.net/en/", "allow"), ur.host_rule("org/a*b/", "block"), ur.word_rule("spam", "block")]
URLS = ["http://a.example.net/en/1", "http://example.net/english", "https://NET/x?y", "http://net", "x.net/", None, "", "://net/#f", "http://internet/", "http://my-spam.org/acb/1", "http://my-spam.org/acb", "http://spam:80/", "http://x.org/a/b/", "a://b.net://c"]
EXPECTED = [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/english", "net/", "block"), ("net", "/x", "net/", "block"), ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/", "net/", "block"), ("internet", "/", None, "allow"), ("my-spam.org", "/acb/1", "org/a*b/", "block"), ("my-spam.org", "/acb", "word:spam", "block"), ("spam:80", "/", "word:spam", "block"), ("x.org", "/a/b/", "org/a*b/", "block"), ("b.net:", "//c", None, "allow")]


def judged(spark, urls):
    pages = spark.createDataFrame([(n, u, "host", "p") for n, u in enumerate(urls)], "page_id long, url string, host string, path string")
    return [tuple(r) for r in ur.judge_urls(pages, RULES).select("host", "path", "fitted", "verdict", "page_id").orderBy("page_id").collect()]


def test_rules(spark):
    assert [r[:4] for r in judged(spark, URLS)] == EXPECTED


def test_repeats_and_empty(spark):
    assert len(judged(spark, ["http://a.net/"] * 5)) == 5
    assert judged(spark, []) == []


def test_rarest_token(spark):
    urls = spark.createDataFrame([("a.example.net", "/en/")] + [("example.net", "/x")] * 3, "host string, path string")
    index = {r["name"]: r["token"] for r in ur.rule_index(urls, RULES).collect()}
    assert index["example.net/en/"] == "p:en"


def test_shuffled_rules_agree(spark, monkeypatch):
    monkeypatch.setattr(ur, "BROADCAST_RULES", 0)
    assert [r[:4] for r in judged(spark, URLS)] == EXPECTED


def test_phrases_ties_and_long_urls(spark):
    rules = [ur.word_rule("free bets", "block"), ur.word_rule("casino", "block"), ur.host_rule("a.org/x", "allow"), ur.host_rule("a.org/x*y", "block"), ur.word_rule("a b", "block"), ur.word_rule("c b", "allow")]
    urls = ["http://free-bets.example.com/", "http://freebets.com/", "http://bets.free.com/", "http://www.free.bets/", "http://a.org/x/" + "long/" * 20_000 + "y", "http://a.org/x", "http://c.b.a.b.com/", "http://b.a/", "http://x.com/casino", "http://casino/" + "z" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string")
    got = ur.judge_urls(pages, rules).select("page_id", "fitted", "verdict").collect()
    assert len(got) == 2 * len(urls)
    assert {r["page_id"]: (r["fitted"], r["verdict"]) for r in got} == {
        0: ("word:free bets", "block"), 1: (None, "allow"), 2: (None, "allow"), 3: ("word:free bets", "block"), 4: ("a.org/x*y", "block"), 5: ("a.org/x", "allow"),
        6: ("word:c b", "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("word:casino", "block"),
    }
