"""Queries over the synthetic tables, one for each operator, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import budget_mix, chat_format, decontaminate, language_id, line_quality, media_sequences, pattern_packing, periodic_runs, simhash_dedup, suffix_dedup, token_planes, url_rules, whitening
from ledgerline.llm.common import new_path, read, write_table


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-planes")
    token_planes.write_token_file(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_planes.read_token_file(spark, path)


#: The stated rules, and words and phrases whose hosts the filter itself blocks. Words that
#: say nothing alone stand in phrases only.
URL_RULES = [url_rules.host_rule(r, v) for r, v in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]
URL_WORDS = [
    "bet", "bets", "betting", "casino", "casinos", "jackpot", "lottery", "poker", "roulette", "slots", "wager",
    "escort", "escorts", "hentai", "nude", "nudes", "porn", "porno", "xxx", "live cams", "hot singles", "adult chat",
    "cialis", "pills", "viagra", "weightloss", "cheap meds", "diet miracle", "online pharmacy",
    "keygen", "serials", "torrent", "torrents", "warez", "cracked software", "free movies", "free download crack",
    "adserver", "doubleclick", "popunder", "spam", "ads track", "ad click", "click track", "link farm", "traffic exchange",
    "get rich", "free money", "payday loan", "payday loans", "forex signals", "crypto giveaway", "free bets", "casino win",
]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = URL_RULES + [url_rules.word_rule(w, "block") for w in URL_WORDS]
    judged = url_rules.judge_urls(read(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("fitted")).alias("rule"), "verdict")


OP2_SQL = rf"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[^a-z0-9])({"|".join(w.replace(" ", "[^a-z0-9]+") for w in URL_WORDS)})([^a-z0-9]|$)') THEN 'block'
    ELSE 'allow' END AS verdict FROM ruled
"""

#: A conversation that holds the template's own marks and escape character.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    stored = write_table(chat_format.format_conversations(turns), "chats")
    back = stored.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("segments")).alias("loss_text"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
    )


OP8_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>'), ':', '\c') || ': '
        || replace(replace(replace(text, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>') || '</turn>' || chr(10) AS formatted,
        coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') || '>' || role
            IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS accepted
    FROM turns
), chats AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss_text,
        sum(length(formatted)) AS formatted_chars, bool_and(accepted) AS valid, last(role ORDER BY turn, role, text) = 'assistant' AS ended
    FROM marked GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss_text) AS BIGINT) AS loss_chars,
    sha256(loss_text) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, valid, valid AND ended AS complete FROM chats
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = line_quality.learn(docs.select("doc_id", "text"), labels.filter(~held_out))
    scored = line_quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = media_sequences.store_texts(read(spark, sf_dir, "documents"))
    caption = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    pages = store.select("doc_id", "n_bytes", F.concat(F.lit("<p>Stored as media.</p>"), figure).alias("html"))
    sequences = media_sequences.interleave(media_sequences.parse_pages(pages), media_sequences.media_index(store))
    media = sequences.select("row.doc_id", "row.n_bytes", F.explode(F.filter("segments", lambda s: s["kind"] == "media")).alias("s"))
    return media.select("doc_id", "n_bytes", "s.media.payload_bytes", "s.media.payload_sha256", "s.media.tail_crc32", "s.media.media_bytes", "s.media.media_sha256", "s.media.feature", "s.caption")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.learn(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = suffix_dedup.remove(docs, suffix_dedup.repeated_spans(docs))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]), F.lit(0).cast("long"))
    return done.select(
        "row.doc_id",
        F.coalesce(F.octet_length("row.text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        removed.alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=4)
    return whitened.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = budget_mix.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "copies")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(docs, rewrite=periodic_runs.periodic_tail, texts=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("best", best).select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_url_rules": op2_url_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_quality": op4_line_quality,
    "op5_media_sequences": op5_media_sequences,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pattern_packing": op10_pattern_packing,
    "op11_whitening": op11_whitening,
    "op12_budget_mix": op12_budget_mix,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {"op2_url_rules": OP2_SQL, "op8_chat_format": OP8_SQL}
