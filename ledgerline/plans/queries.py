"""Queries that exercise the engine's operators on the star-schema tables, and SQL that
says the same independently."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import labels, text
from ledgerline.operators import batch, clients, edits, folders, matching, metrics, numbering, page, present, reconcile, segments
from ledgerline.operators.tables import shared_folder
from ledgerline.sources import package_files, readers, sinks, store, workbook_files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        name = function.__name__
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], n: Column) -> Column:
    """The n-th of values, from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


# --- scalar functions ---


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned_md5, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS INTEGER) AS n FROM documents")
def q01_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("cleaned_md5"), F.length("t").alias("n"))


@query(r"SELECT n_nationkey, lower(trim(r_name) || ' > ' || trim(n_name)) AS area FROM nation JOIN region ON n_regionkey = r_regionkey")
def q02_normalise(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", text.normalise(F.concat(F.lit("  "), "r_name", F.lit(">\t"), "n_name")).alias("area"))


def _three_levels(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", "r_name", "n_name", "c_mktsegment", F.concat_ws(" > ", "r_name", "n_name", "c_mktsegment").alias("area"))


_FORMS_SQL = """
    SELECT r || ' > ' || n || ' > ' || s AS area, unnest([r || ' > ' || n || ' > ' || s, n || ' > ' || s, r || ' > ' || n, n, s]) AS form
    FROM (SELECT DISTINCT lower(r_name) AS r, lower(n_name) AS n, lower(c_mktsegment) AS s
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query(f"SELECT area, form, CAST(row_number() OVER (PARTITION BY area ORDER BY length(form) DESC, form) - 1 AS INTEGER) AS priority FROM (SELECT DISTINCT * FROM ({_FORMS_SQL}))")
def q03_area_variants(spark: SparkSession, d: str) -> DataFrame:
    areas = _three_levels(spark, d).select(text.normalise(F.col("area")).alias("area")).distinct()
    return areas.select("area", F.posexplode(text.area_variants(F.col("area"))).alias("priority", "form")).select("area", "form", "priority")


@query("SELECT n_nationkey, lower(r_name) || ' > ' || lower(n_name) AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey")
def q04_canonical_area(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", text.canonical_area(F.concat_ws(" > ", "r_name", "n_name", F.concat(F.lit("("), "n_name", F.lit(")")), "n_name")).alias("canonical"))


@query(r"""
SELECT 'c' AS side, c_custkey AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS firm FROM customer
UNION ALL SELECT 's', s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || ' co' FROM supplier
""")
def q05_firm_key(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("  LLP")).alias("n"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" & Co. Ltd.")).alias("n"))
    return c.unionByName(s).select("side", "id", text.firm_key(F.col("n")).alias("firm"))


@query(r"SELECT event_id, CASE WHEN regexp_matches(trim(json_extract_string(props, '$.k')), '^[+-]?[0-9]+$') AND event_id % 3 > 0 THEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS INTEGER) END AS k FROM events")
def q06_tolerant_int(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    written = F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(".0"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(k)
    return table(spark, d, "events").select("event_id", text.to_int(written).alias("k"))


@query("SELECT page_id, 'page_' || page_id || '.docx' AS name, CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 7 AS INTEGER) END AS copy FROM pages")
def q07_copy_suffix(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    name = F.when(F.col("page_id") % 3 == 0, F.concat(stem, F.lit(" ("), (F.col("page_id") % 7).cast("string"), F.lit(").docx"))).otherwise(F.concat(stem, F.lit(".docx")))
    plain, copy = text.copy_suffix(name)
    return table(spark, d, "pages").select("page_id", plain.alias("name"), copy.alias("copy"))


@query(r"""
WITH n AS (SELECT page_id, trim(url_decode(list_extract(string_split(string_split(url, '?')[1], '/'), -1))) AS f FROM pages)
SELECT page_id, CASE WHEN f = '' OR contains(f, '.') THEN f ELSE f || '.docx' END AS name FROM n
""")
def q08_uri_to_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.uri_to_filename(F.col("url")).alias("name"))


@query(r"SELECT p_partkey, p_type AS first, p_brand AS second, p_name || ' - ' || p_size AS third FROM part")
def q09_split_dropdown(spark: SparkSession, d: str) -> DataFrame:
    parts = text.split_dropdown(F.concat_ws("  - ", "p_type", "p_brand", F.concat_ws(" - ", "p_name", F.col("p_size").cast("string"))))
    return table(spark, d, "part").select("p_partkey", *(F.get(parts, k).alias(n) for k, n in enumerate(("first", "second", "third"))))


@query("SELECT event_id, event_type AS plain FROM events")
def q10_unwrap(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_type"), F.col("event_id") % 4
    wrapped = F.when(n == 0, F.concat(F.lit("["), e, F.lit("]"))).when(n == 1, F.concat(F.lit("(“"), e, F.lit("”)"))).when(n == 2, F.concat(F.lit("{ '"), e, F.lit("' }"))).otherwise(e)
    return table(spark, d, "events").select("event_id", text.unwrap(wrapped).alias("plain"))


@query(r"""
WITH rgb AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part),
c AS (SELECT p_partkey, (v // 65536) / 255.0 AS r, (v // 256 % 256) / 255.0 AS g, (v % 256) / 255.0 AS b FROM rgb),
h AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
s AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi + lo <= 1 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2 - hi - lo) END AS sat,
    CASE WHEN hi = lo THEN NULL WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END * 60 AS hue FROM h)
SELECT p_partkey, CASE WHEN sat < 0.25 THEN NULL WHEN (hue + 360) % 360 < 15 OR (hue + 360) % 360 > 345 THEN 'Non-publishable'
    WHEN (hue + 360) % 360 > 75 AND (hue + 360) % 360 < 160 THEN 'Publishable' END AS kind FROM s
""")
def q11_colour_kind(spark: SparkSession, d: str) -> DataFrame:
    fill = F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")
    return table(spark, d, "part").select("p_partkey", text.colour_kind(fill).alias("kind"))


#: Labels and the class that each must get.
NOMINATIONS = [("Associate : leading counsel 1", "associates"), ("Partner 1: leading individual", "lead_partners"), ("Partner: leading next generation partner 1", "next_gen"), ("Counsel: of note", "associates"), ("Partner: counsel to the board", "unclassified"), ("Partners: two", None), ("Name", None), ("Rising Star 2", "associates"), ("Lead partner(s)", None), ("Next Generation Partner 2", "next_gen")]
ANSWERS = [("Yes", "new"), ("no", "not"), ("", "blank"), ("N/A", "unrecognised"), ("(Sí)", "new"), ("New client", "new"), ("Existing", "not"), ("TBC", "unrecognised"), ("[Não]", "not"), ("Y.", "new")]
_CASE = lambda column, pairs: f"CASE {column} % {len(pairs)} " + " ".join(f"WHEN {n} THEN '{v}'" for n, (_, v) in enumerate(pairs) if v) + " END"


@query(f"SELECT p_partkey, {_CASE('p_partkey', NOMINATIONS)} AS category FROM part")
def q12_nominations(spark: SparkSession, d: str) -> DataFrame:
    label = pick([k for k, _ in NOMINATIONS], F.col("p_partkey") % len(NOMINATIONS))
    return table(spark, d, "part").select("p_partkey", labels.nomination(label).alias("category"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("answer", labels.answer(pick([k for k, _ in ANSWERS], F.col("event_id") % len(ANSWERS))))


@query(f"SELECT event_type, {_CASE('event_id', ANSWERS)} AS answer, count(*) AS n FROM events GROUP BY ALL")
def q13_answers(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).groupBy("event_type", "answer").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size % 2 = 0 AS elite FROM part")
def q14_elite_gate(spark: SparkSession, d: str) -> DataFrame:
    area = F.concat(F.when(F.col("p_size") % 2 == 0, "Tax ELITE").otherwise("Elitex"), F.lit(" > Elite "), "p_name")
    return table(spark, d, "part").select("p_partkey", labels.is_elite_area(area).alias("elite"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q15_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


# --- windows over rows ---

_SEG_SQL = "SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS seg FROM conversations"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")


@query(f"SELECT conv_id, seg, count(*) AS n, min(turn) AS first_turn FROM ({_SEG_SQL}) GROUP BY ALL")
def q16_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).groupBy("conv_id", "seg").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' AND lead(role) OVER w = 'assistant' THEN lead(turn) OVER w END AS adopts
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def q17_adopt_next(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return segments.adopt_next(rows, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "adopts")


@query(f"SELECT conv_id, seg, md5(coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '')) AS answer_md5 FROM ({_SEG_SQL}) WHERE seg > 0 GROUP BY ALL")
def q18_value_below(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).filter("seg > 0")
    found = segments.value_below(rows, ["conv_id", "seg"], "turn", F.col("role") == "user", "text", 1, "answer")
    return found.select("conv_id", "seg", F.md5(F.coalesce("answer", F.lit(""))).alias("answer_md5"))


# --- counts and numbering ---


@query("""
WITH k AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS clean,
    max(l_linenumber) - count(DISTINCT l_linenumber) AS gaps FROM lineitem GROUP BY ALL),
w AS (SELECT l_orderkey, count(*) AS items, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS clean,
    max(l_linenumber) - count(DISTINCT l_linenumber) AS gaps FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(any_value(items) AS INTEGER) AS items, bool_and(k.clean) AS by_kind, any_value(w.clean) AS combined,
    bool_and(k.clean) OR any_value(w.clean) AS clean, CAST(least(sum(k.gaps), any_value(w.gaps)) AS INTEGER) AS absent
FROM k JOIN w USING (l_orderkey) GROUP BY l_orderkey
""")
def q19_numbering(spark: SparkSession, d: str) -> DataFrame:
    return numbering.check_numbering(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")


def recounted(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the lines counted and the number of lines that the last one reports."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("recount"), F.max("l_linenumber").cast("int").alias("reported"))
    both = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.drop("l_orderkey").fillna(0, ["recount"])  # counted, and there are none; what is reported stays unknown


_RECOUNT_SQL = "SELECT o_orderkey, o_custkey, o_orderdate, CAST(count(l_orderkey) AS INTEGER) AS recount, CAST(max(l_linenumber) AS INTEGER) AS reported FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"


@query(f"SELECT o_orderkey, recount, reported FROM ({_RECOUNT_SQL}) WHERE recount <> reported")
def q20_recount(spark: SparkSession, d: str) -> DataFrame:
    return recounted(spark, d).filter(labels.differs(F.col("recount"), F.col("reported"))).select("o_orderkey", "recount", "reported")


#: A third of users give no answer that cannot be read: theirs says the first one instead.
_ANSWER_SQL = f"SELECT user_id, CAST(ts AS DATE) AS day, {_CASE('(CASE WHEN user_id % 3 = 0 AND event_id % 10 IN (3, 7) THEN 0 ELSE event_id END)', ANSWERS)} AS answer FROM events"


def _known_answers(spark: SparkSession, d: str) -> DataFrame:
    read = F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 10).isin(3, 7), 0).otherwise(F.col("event_id"))
    return table(spark, d, "events").withColumns({"answer": labels.answer(pick([k for k, _ in ANSWERS], read % len(ANSWERS))), "day": F.to_date("ts")})


@query(f"""
SELECT user_id, count(*) AS active, CASE WHEN count(*) FILTER (answer = 'unrecognised') = 0 THEN count(*) FILTER (answer = 'new') END AS new_clients,
    count(*) FILTER (answer = 'blank') AS blanks, count(*) FILTER (answer = 'unrecognised') AS unrecognised FROM ({_ANSWER_SQL}) GROUP BY user_id
""")
def q21_client_counts(spark: SparkSession, d: str) -> DataFrame:
    return clients.count_answers(_known_answers(spark, d), ["user_id"])


@query(f"""
SELECT user_id, CAST(sum(CASE WHEN blank < n OR n = 1 THEN blank ELSE 0 END) AS BIGINT) AS suspicious, count(*) AS tables
FROM (SELECT user_id, day, count(*) AS n, count(*) FILTER (answer = 'blank') AS blank FROM ({_ANSWER_SQL}) GROUP BY ALL) GROUP BY user_id
""")
def q22_suspicious_blanks(spark: SparkSession, d: str) -> DataFrame:
    return clients.suspicious_blanks(_known_answers(spark, d), ["user_id", "day"], ["user_id"])


@query("""
WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM u)
SELECT l_orderkey, CAST(min(n) AS INTEGER) AS first, CAST(max(n) AS INTEGER) AS last FROM g GROUP BY l_orderkey, run
""")
def q23_islands(spark: SparkSession, d: str) -> DataFrame:
    return numbering.islands(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
WITH m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, unnest(range(1, top + 1)) AS n FROM m),
x AS (SELECT a.* FROM a ANTI JOIN lineitem l ON a.l_orderkey = l.l_orderkey AND a.n = l.l_linenumber),
g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM x),
r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_orderkey, run)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) WHEN a + 1 = b THEN a || ', ' || b ELSE a || ' to ' || b END, ', ' ORDER BY a) AS absent FROM r GROUP BY l_orderkey
""")
def q23b_absent_ranges(spark: SparkSession, d: str) -> DataFrame:
    found = numbering.absent_numbers(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")
    return found.filter(F.size("absent") > 0).select("l_orderkey", text.ranges_text(F.col("absent")).alias("absent"))


@query("""
SELECT l_orderkey, string_agg(t, '; ' ORDER BY n, t) AS evidence FROM (SELECT l_orderkey, l_linenumber AS n, l_linenumber || ':' || l_returnflag AS t,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber || ':' || l_returnflag) AS k FROM lineitem) WHERE k <= 4 GROUP BY l_orderkey
""")
def q24_evidence(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat_ws(":", F.col("l_linenumber").cast("string"), "l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(present.ordered_texts(F.col("l_linenumber"), said, most=4).alias("evidence"))


@query(f"""
SELECT count(*) AS documents, count(*) FILTER (reported IS NULL) AS failed, count(*) FILTER (recount <> reported) AS corrections, count(*) FILTER (recount = reported) AS agreed FROM ({_RECOUNT_SQL})
""")
def q25_tiles(spark: SparkSession, d: str) -> DataFrame:
    return recounted(spark, d).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("reported").isNull()).alias("failed"),
        F.count_if(labels.differs(F.col("recount"), F.col("reported"))).alias("corrections"),
        F.count_if(F.col("recount") == F.col("reported")).alias("agreed"),
    )


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS different, count(*) - count(DISTINCT o_custkey) AS repeats FROM orders GROUP BY ALL")
def q26_distinct_and_repeats(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("n"))  # distinct by two steps: no expand
    return each.groupBy("o_orderstatus").agg(F.count("*").alias("different"), (F.sum("n") - F.count("*")).alias("repeats"))


# --- joins by several keys ---


@query("""
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'exact' WHEN page_id % 2 = 0 THEN 'plain' END AS listed FROM pages
""")
def q27_two_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    copy, plain = F.concat(stem, F.lit(" (1).docx")), F.concat(stem, F.lit(".docx"))
    pages = table(spark, d, "pages").select("page_id", copy.alias("copy"), plain.alias("plain"))
    listing = pages.filter("page_id % 9 = 0").select(F.col("copy").alias("key"), F.lit("exact").alias("listed"))
    listing = listing.unionByName(pages.filter("page_id % 2 = 0").select(F.col("plain").alias("key"), F.lit("plain").alias("listed")))
    return matching.first_key_join(pages, listing, "page_id", F.array("copy", text.copy_suffix(F.col("copy"))[0]), "key").select("page_id", "listed")


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) = 1")
def q28_unique_only(spark: SparkSession, d: str) -> DataFrame:
    return matching.unique_only(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"])


@query("""
WITH a AS (SELECT c_custkey, lower(r_name) AS r, lower(n_name) AS n, lower(c_mktsegment) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT c_custkey, r, unnest([r || ' > ' || n || ' > ' || s, n || ' > ' || s, r || ' > ' || n, n, s]) AS form FROM a),
e AS (SELECT lower(r_name) AS r, lower(r_name) || ' > ' || lower(n_name) AS form, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
    UNION ALL SELECT lower(r_name), lower(n_name), n_nationkey + 100 FROM nation JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT c_custkey, e.form, id, rank() OVER (PARTITION BY c_custkey ORDER BY length(e.form) DESC, e.form) AS k FROM f JOIN e ON f.form = e.form AND f.r = e.r)
SELECT a.c_custkey, h.form, CAST(id AS BIGINT) AS id FROM a LEFT JOIN h ON a.c_custkey = h.c_custkey AND k = 1
""")
def q29_longest_spelling(spark: SparkSession, d: str) -> DataFrame:
    left = _three_levels(spark, d).select("c_custkey", "area", F.lower("r_name").alias("region"))
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region, key = F.lower("r_name").alias("region"), F.col("n_nationkey").cast("long")
    wide = both.filter("n_nationkey % 2 = 0").select(region, text.normalise(F.concat_ws(">", "r_name", "n_name")).alias("form"), key.alias("id"))
    right = wide.unionByName(both.select(region, text.normalise(F.col("n_name")).alias("form"), (key + 100).alias("id")))
    spelled = matching.with_variants(left, "area", "keys")
    return matching.first_key_join(spelled, right, "c_custkey", F.col("keys"), "form", ["region"]).select("c_custkey", "form", "id")


@query("""
SELECT a.s_suppkey, a.s_name || ' Ltd' AS one, b.s_name || ' LLP' AS other FROM supplier a JOIN supplier b ON lower(a.s_name) = lower(b.s_name) WHERE a.s_suppkey % 3 > 0
""")
def q30_other_spelling(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    # a third of suppliers are spelled alike on both sides, so they are no other spelling
    one = s.select("s_suppkey", F.concat("s_name", F.when(F.col("s_suppkey") % 3 > 0, " Ltd").otherwise(" LLP")).alias("one"))
    other = s.select(F.concat("s_name", F.lit(" LLP")).alias("other"))
    same = text.firm_key(F.col("one")) == text.firm_key(F.col("other"))
    return one.join(other, same & (text.normalise(F.col("one")) != text.normalise(F.col("other"))))


@query("SELECT c_custkey, string_agg(DISTINCT n.n_name, ', ' ORDER BY n.n_name) AS nations FROM (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer) c JOIN (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) o ON c.c_mktsegment = o.c_mktsegment AND c.c_nationkey <> o.c_nationkey JOIN nation n ON n.n_nationkey = o.c_nationkey GROUP BY c_custkey")
def q30b_other_regions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    held = c.select("c_mktsegment", "c_nationkey").distinct().join(names, "c_nationkey")
    sets = held.groupBy("c_mktsegment").agg(F.array_sort(F.collect_set(F.struct("n_name", "c_nationkey"))).alias("all"))  # one entry a nation
    others = F.transform(F.filter("all", lambda x: x["c_nationkey"] != F.col("c_nationkey")), lambda x: x["n_name"])
    return c.join(sets, "c_mktsegment").select("c_custkey", F.array_join(others, ", ").alias("nations")).filter("nations <> ''")


@query(f"SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 99 ELSE recount END AS final FROM ({_RECOUNT_SQL})")
def q31_overrides(spark: SparkSession, d: str) -> DataFrame:
    rows = recounted(spark, d).select("o_orderkey", "recount")
    typed = table(spark, d, "orders").filter("o_orderkey % 7 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 1, 99).alias("value"), F.lit(True).alias("present"))
    return rows.join(typed, "o_orderkey", "left").select("o_orderkey", present.final_value(F.col("present"), F.col("value"), F.col("recount")).alias("final"))


@query("""
WITH p AS (SELECT * FROM (VALUES ('4-low', 2), ('1-urgent', 1), ('3-medium', 3)) AS t(k, pos))
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY pos NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders LEFT JOIN p ON lower(o_orderpriority) = k
""")
def q32_pasted_order(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([("1-URGENT", 1), ("4-LOW", 2), ("3-MEDIUM", 3), ("1-URGENT", 4)], "name string, line_no int")
    first = lines.groupBy(text.normalise(F.col("name")).alias("key")).agg(F.min("line_no").alias("pos"))
    placed = table(spark, d, "orders").withColumn("key", text.normalise(F.col("o_orderpriority"))).join(first, "key", "left")
    order = Window.partitionBy("o_custkey").orderBy(F.col("pos").asc_nulls_last(), "o_orderkey")
    return placed.select("o_orderkey", F.row_number().over(order).alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q33_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q34_semi(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(wanted, "c_custkey", "left_semi")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 THEN 'o_orderstatus' END AS "column",
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'present' ELSE o_orderstatus END AS old,
    CASE WHEN o_orderkey % 13 = 0 THEN 'present' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'X' END AS new
FROM orders WHERE (o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0) OR o_orderkey % 5 = 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0
""")
def q35_keyed_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = rows.filter("o_orderkey % 11 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return present.keyed_diff(rows.filter("o_orderkey % 13 > 0"), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


# --- newest wins ---


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, o_orderdate FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey) USING (o_custkey, o_orderdate) GROUP BY ALL")
def q36_latest(spark: SparkSession, d: str) -> DataFrame:
    return matching.latest(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""
WITH m AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS top FROM orders), n AS (SELECT *, count(*) FILTER (o_orderdate = top) OVER (PARTITION BY o_custkey) AS k FROM m)
SELECT o_orderkey, o_orderdate < top AND k = 1 AS superseded, o_orderdate = top AND k > 1 AS undecided FROM n
""")
def q37_superseded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return matching.mark_superseded(rows, ["o_custkey"], "o_orderdate").select("o_orderkey", "superseded", "undecided")


@query("SELECT o_custkey, count(*) FILTER (NOT gone) AS kept FROM (SELECT o_custkey, o_orderdate < max(o_orderdate) OVER w AS gone FROM orders WINDOW w AS (PARTITION BY o_custkey)) GROUP BY ALL")
def q38_kept_per_slot(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n"))
    return newest.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "n"))["n"].alias("kept"))


@query("SELECT doc_id, CAST(copy_no AS INTEGER) AS copy_no FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3 = 0, doc_id) AS copy_no FROM documents) WHERE copy_no > 1")
def q39_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("name"))
    return matching.mark_copies(rows, "name", F.col("doc_id") % 3 == 0, "doc_id").filter("copy_no > 1").select("doc_id", "copy_no")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS reached FROM orders
""")
def q40_reached(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("attempted", F.count_if(F.col("o_orderstatus") == "F").over(Window.partitionBy("o_custkey")))
    return reconcile.reached(rows, "o_custkey", "o_orderkey", "attempted").select("o_orderkey", "reached")


# --- what is shown ---


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").cast("int").alias("lines"),
        F.max("l_linenumber").cast("int").alias("last_line"),
        F.size(F.collect_set("l_partkey")).alias("parts"),
        F.size(F.collect_set("l_suppkey")).alias("suppliers"),
    )
    return present.unpivot_metrics(each, ["l_orderkey"], {"lines": ("last_line", "lines"), "suppliers": ("parts", "suppliers")})


_METRICS_SQL = """
    SELECT l_orderkey, 'lines' AS metric, CAST(max(l_linenumber) AS INTEGER) AS reported, CAST(count(*) AS INTEGER) AS recounted FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey, 'suppliers', CAST(count(DISTINCT l_partkey) AS INTEGER), CAST(count(DISTINCT l_suppkey) AS INTEGER) FROM lineitem GROUP BY l_orderkey
"""


@query(f"SELECT * FROM ({_METRICS_SQL}) WHERE reported <> recounted")
def q41_changes(spark: SparkSession, d: str) -> DataFrame:
    return present.changes(_metrics(spark, d))


@query(f"SELECT l_orderkey, string_agg(metric || ': ' || reported || ' to ' || recounted, '; ' ORDER BY metric) AS note FROM ({_METRICS_SQL}) WHERE reported <> recounted GROUP BY l_orderkey")
def q42_review_note(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.col("metric"), F.lit(": "), F.col("reported").cast("string"), F.lit(" to "), F.col("recounted").cast("string"))
    return present.changes(_metrics(spark, d)).groupBy("l_orderkey").agg(present.ordered_texts(F.col("metric"), said).alias("note"))


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'elite' WHEN o_orderkey % 10 = 1 THEN 'parse_error' WHEN reported IS NULL OR recount = 0 THEN 'unmatched'
    WHEN recount > 1 THEN 'ambiguous' WHEN o_orderkey % 10 = 2 THEN 'duplicate' WHEN o_orderkey % 10 = 3 THEN 'superseded' ELSE 'matched' END AS status,
    CASE WHEN reported IS NULL THEN 'unrecognised' WHEN o_orderkey % 10 = 0 THEN 'elite' WHEN o_orderkey % 10 = 4 THEN 'no document' WHEN o_orderkey % 10 = 1 THEN 'could not read'
    WHEN o_orderkey % 10 = 3 THEN 'older version' WHEN o_orderkey % 10 IN (2, 5) THEN 'uploaded' WHEN o_orderkey % 10 = 6 THEN 'check page' WHEN o_orderkey % 10 <= 7 THEN 'missing' ELSE 'not reached' END AS page_status
FROM ({_RECOUNT_SQL})
""")
def q43_statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = recounted(spark, d)
    k, known = F.col("o_orderkey") % 10, F.col("reported").isNotNull()
    status = matching.result_status(k == 2, k == 0, k == 1, known, F.col("recount"), k == 3)
    page = matching.page_status(known, k == 0, k != 4, k.isin(1, 2, 5), k == 1, k == 3, k == 6, k <= 7)
    return rows.select("o_orderkey", status.alias("status"), page.alias("page_status"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN n_name END, 'unknown') AS nation,
    concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_custkey % 4 = 0 THEN 'no nation' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'check segment' END) AS issues
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def q44_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    listed = F.when(F.col("c_custkey") % 4 > 0, F.col("n_name")).otherwise("")
    found = present.issues((F.col("c_acctbal") < 0, "negative balance"), (F.nullif(listed, F.lit("")).isNull(), "no nation"), (F.col("c_mktsegment") == "BUILDING", "check segment"))
    return rows.select("c_custkey", F.coalesce(F.nullif(listed, F.lit("")), F.lit("unknown")).alias("nation"), F.array_join(found, "; ").alias("issues"))


@query("SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_custkey AS VARCHAR)) AS INTEGER) AS place FROM customer")
def q45_ids_as_text(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.rank().over(order).alias("place"))


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY first_seen LIMIT 5")
def q46_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_seen")).orderBy("first_seen").limit(5)


@query("""
WITH s AS (SELECT p_brand, count(*) FILTER (lower(p_type) LIKE '%e%') AS a, count(*) FILTER (lower(p_name) LIKE '%e%') AS b FROM part GROUP BY p_brand)
SELECT p_brand, CASE WHEN a >= b THEN 'p_type' ELSE 'p_name' END AS best, greatest(a, b) AS score FROM s
""")
def q47_best_column(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "part").groupBy("p_brand").agg(*(F.count_if(F.lower(c).like("%e%")).alias(c) for c in ("p_type", "p_name")))
    top = F.array_max(F.array(*(F.struct(F.col(c).alias("score"), F.lit(-n).alias("before"), F.lit(c).alias("best")) for n, c in enumerate(("p_type", "p_name")))))
    return scores.select("p_brand", top["best"].alias("best"), top["score"].alias("score"))


# --- pages and batches ---


@query("""
WITH l AS (SELECT o_custkey AS page_id, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY page_id, o_orderpriority ORDER BY line_no) AS turn FROM l),
p AS (SELECT o_custkey AS page_id, o_orderpriority, o_orderkey AS candidate, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS size,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderkey % 3 > 0 THEN 1 ELSE 2 END, o_orderkey % 10 = 0, o_orderkey) AS place,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey % 3 = 0, o_orderkey % 10 = 0, o_orderkey) AS again
    FROM orders WHERE o_orderkey % 4 > 0)
SELECT t.page_id, CAST(t.line_no AS INTEGER) AS line_no, candidate, CASE WHEN o_orderstatus = 'F' AND t.turn <= size THEN candidate END AS file_no, CAST(CASE WHEN t.turn > size THEN f.line_no END AS INTEGER) AS repeat_of
FROM t JOIN p ON p.page_id = t.page_id AND p.o_orderpriority = t.o_orderpriority AND CASE WHEN t.turn > size THEN again = 1 ELSE place = t.turn END
JOIN t f ON f.page_id = t.page_id AND f.o_orderpriority = t.o_orderpriority AND f.turn = place JOIN orders ON o_orderkey = candidate
""")
def q48_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines; the fewer listed ones of a customer and priority are what a line may
    mean, each with its own file if it is finished."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), "o_orderkey", F.col("o_orderpriority").alias("pool"), "o_orderstatus")
    lines = rows.select("page_id", "pool", F.row_number().over(Window.partitionBy("page_id").orderBy("o_orderkey")).alias("line_no"))
    k, name = F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("name")
    listed = rows.filter(k % 4 > 0)
    pools = listed.select("page_id", "pool", k.alias("candidate"), k.alias("rank"), (k % 10 == 0).alias("is_elite"), (k % 3 > 0).alias("has_document"), name, F.lit(None).cast("string").alias("identity"))
    files = listed.filter("o_orderstatus = 'F'").select("page_id", k.alias("file_no"), name, F.lit(False).alias("by_code"))
    return reconcile.assign_lines(lines, pools, files)


_STATUS_IDS = "CASE s WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END"


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderdate AS dated, lower(c_mktsegment) AS seg FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT k AS doc_no, * FROM o UNION ALL SELECT k + 1000000000, * FROM o WHERE k % 10 = 0),
m AS (SELECT *, k % 3 > 0 AS listed, CASE WHEN c % 4 = 0 THEN 0 WHEN c % 4 < 3 THEN 1 WHEN k % 3 > 0 AND k % 13 = 0 THEN 0 ELSE 2 END AS candidates FROM d),
t AS (SELECT *, CASE WHEN listed AND k % 7 = 0 THEN 'elite' WHEN k % 11 = 0 THEN 'parse_error' WHEN k % 6 = 0 OR candidates = 0 THEN 'unmatched'
    WHEN candidates = 2 THEN 'ambiguous' WHEN listed AND k % 10 = 0 AND doc_no = k THEN 'duplicate' ELSE 'matched' END AS state,
    CASE WHEN listed THEN 'f' || k || '.docx' ELSE 'f' || k || CASE WHEN k % 5 = 0 AND doc_no = k THEN ' (1)' ELSE '' END || '.docx' END AS filename,
    CASE WHEN listed AND k % 13 = 0 THEN 'other' ELSE 'status' END AS word, CASE WHEN listed THEN CAST(dated AS TIMESTAMP) ELSE TIMESTAMP '0001-01-01' END AS day FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY c, s, word ORDER BY day DESC, doc_no) AS place, max(day) OVER (PARTITION BY c, s, word) AS newest,
    count(DISTINCT filename) OVER (PARTITION BY c, s, word) AS names FROM t WHERE state = 'matched'),
x AS (SELECT *, count(*) FILTER (day = newest) OVER (PARTITION BY c, s, word) AS tied FROM w),
y AS (SELECT doc_no, CASE WHEN place > 1 THEN 'superseded' ELSE 'matched' END AS status, place = 1 AND names > 1 AND tied > 1 AS undecided FROM x),
z AS (SELECT t.*, coalesce(y.status, state) AS status, coalesce(undecided, false) AS undecided, state NOT IN ('elite', 'parse_error') AND k % 6 > 0 AND candidates = 1 AS compared FROM t LEFT JOIN y USING (doc_no))
SELECT doc_no, filename, status, undecided, CASE WHEN compared THEN c * 10 + {_STATUS_IDS} END AS export_id,
    CASE WHEN listed THEN 'r' || c WHEN compared THEN 'x' || c END AS firm_ref FROM z
""")
def q49_batch(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, most of them listed, some twice uploaded, elite, unreadable or
    without a region; customers' statuses as the export, spelled in two ways."""
    c, n = (table(spark, d, t) for t in ("customer", "nation"))
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "n_name")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(named, "o_custkey")
    k, plain = F.col("o_orderkey"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".docx"))
    status, ref = F.concat(F.lit("Status "), "o_orderstatus"), F.col("o_custkey").cast("string")
    none = F.lit(None).cast("string")

    def document(number: Column, name: Column) -> list[Column]:
        error = F.when(k % 11 == 0, "unreadable")
        return [number.alias("doc_no"), name.alias("file_name"), F.col("c_name").alias("firm"), F.when(k % 6 > 0, F.col("n_name")).alias("region"), F.col("c_mktsegment").alias("grp"), status.alias("area"), none.alias("typed"), status.alias("dropdown"), error.alias("error"), F.array().cast("array<string>").alias("warnings")]

    copied = F.when(k % 5 == 0, F.regexp_replace(plain, r"\.docx$", " (1).docx")).otherwise(plain)
    again = orders.withColumn("twice", k % 10 == 0).filter("twice")
    documents = orders.select(*document(k, copied)).unionByName(again.select(*document(k + 1_000_000_000, plain)))
    listing = orders.withColumn("listed", k % 3 > 0).filter("listed").select(
        k.alias("portal_id"), F.col("c_name").alias("firm"), F.concat(F.lit("r"), ref).alias("firm_ref"), F.col("n_name").alias("region"),
        F.when(k % 7 == 0, F.concat(F.lit("Elite "), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("grp"),
        F.when(k % 13 == 0, F.concat(F.lit("Other "), "o_orderstatus")).otherwise(status).alias("area"), none.alias("tbl"), none.alias("submission_type"), none.alias("person"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), plain.alias("filename"), F.lit(True).alias("has_document"), F.lit("L").alias("sheet"), k.alias("row_no"),
    )
    pairs = orders.select("o_custkey", "o_orderstatus", "c_name", "c_mktsegment", "n_name").distinct()
    kind = F.col("o_custkey") % 4
    number = F.col("o_custkey") * 10 + F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    rows = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    area = F.when(kind == 1, F.concat_ws(" > ", "c_mktsegment", status)).otherwise(status)
    export = pairs.select(F.explode(rows).alias("more"), number.alias("number"), F.col("c_name").alias("firm"), F.concat(F.lit("x"), ref).alias("firm_ref"), F.col("n_name").alias("region"), area.alias("area"))
    export = export.withColumn("export_id", F.col("number") + F.col("more"))
    return batch.batch(documents, listing, export).select("doc_no", "filename", "status", "undecided", "export_id", "firm_ref")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN n_nationkey % 2 = 0 ELSE c_custkey % 5 < 3 END AS recognised FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def q50_recognised(spark: SparkSession, d: str) -> DataFrame:
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    file_name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".docx"))
    listing = both.withColumn("listed", F.col("n_nationkey") % 2 == 0).filter("listed").select(F.col("r_name").alias("grp"), F.col("n_name").alias("area"), F.lit(None).cast("string").alias("tbl"), file_name.alias("filename"))
    known = page.vocabulary(both.select(F.concat_ws(">", "r_name", "n_name").alias("area")), listing)
    kind = F.col("c_custkey") % 5
    value = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat_ws("  > ", "r_name", "n_name")).when(kind == 2, F.concat(F.lit("Elsewhere > "), "n_name")).when(kind == 3, F.upper(file_name)).otherwise("nothing of the kind")
    pasted = c.join(both, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", value.alias("value"))
    return page.recognised(pasted, known, "value").select("c_custkey", "recognised")


@query("""
SELECT c_custkey, CAST(row_number() OVER (w ORDER BY c_custkey % 3 = 0, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 11 END, c_custkey) AS INTEGER) AS pasted,
    CAST(row_number() OVER (w ORDER BY c_custkey % 2 = 0, CASE WHEN c_custkey % 2 > 0 THEN c_custkey % 101 END, c_custkey) AS INTEGER) AS export,
    CAST(row_number() OVER (w ORDER BY c_custkey % 97, c_custkey) AS INTEGER) AS listing,
    CAST(row_number() OVER (w ORDER BY c_custkey % 5 = 0, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 12 AS VARCHAR) END, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 31 AS VARCHAR) END, c_custkey) AS INTEGER) AS hierarchy,
    CAST(row_number() OVER (w ORDER BY c_custkey % 7 = 0, CASE WHEN c_custkey % 7 > 0 THEN lower(c_mktsegment) END, c_custkey) AS INTEGER) AS alphabet,
    CAST(row_number() OVER (w ORDER BY c_custkey) AS INTEGER) AS upload
FROM customer WINDOW w AS (PARTITION BY c_nationkey)
""")
def q51_row_orders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_nationkey", k.alias("doc_no"), F.when(k % 3 > 0, k % 11).alias("page_position"), F.when(k % 2 > 0, k % 101).alias("export_order"), (k % 97).alias("listing_order"),
        F.when(k % 5 > 0, k % 12).alias("group_id"), (k % 31).alias("area_id"), F.when(k % 7 > 0, F.col("c_mktsegment")).alias("region"), F.when(k % 7 > 0, "one").alias("area"),
    )
    place = {o: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*present.in_order(o))) for o in present.ORDERS}
    return rows.select(F.col("doc_no").alias("c_custkey"), *(p.alias(o) for o, p in place.items()))


@query("""
WITH s AS (SELECT s_suppkey AS candidate, n_nationkey AS nation, 'g' || s_suppkey % 3 AS g, 'a' || s_suppkey % 5 AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT n_nationkey AS page_id, line_no, CASE line_no WHEN 1 THEN 'g0 > a1' WHEN 2 THEN 'a2' ELSE 'elsewhere' END AS v FROM nation, (VALUES (1), (2), (3)) AS t(line_no)),
h AS (SELECT page_id, line_no, candidate, nation FROM l JOIN s ON v = g || ' > ' || a OR v = a),
k AS (SELECT DISTINCT nation % 5 AS fifth FROM s WHERE candidate % 4 = 0),
f AS (SELECT *, page_id % 5 = 0 OR page_id % 5 NOT IN (FROM k) OR candidate % 4 = 0 AND nation % 5 = page_id % 5 AS own FROM h),
r AS (SELECT *, nation = page_id AND page_id % 2 = 0 AS there FROM f WHERE own),
x AS (SELECT *, bool_or(there) OVER (PARTITION BY page_id, line_no) AS any_there FROM r)
SELECT page_id, CAST(line_no AS INTEGER) AS line_no, candidate, candidate % 2 = 0 AS has_document FROM x WHERE there OR NOT any_there
""")
def q52_line_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pages of nations; a page's firms are some suppliers of five nations, or none are named."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("s_suppkey")
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    listing = named.select(
        k.alias("candidate"), batch.firm_keys(F.lit(None).cast("string"), F.col("s_name")).alias("firm_keys"), F.col("n_name").alias("region"), F.concat(F.lit("G"), (k % 3).cast("string")).alias("grp"),
        F.concat(F.lit("A"), (k % 5).cast("string")).alias("area"), F.lit(None).cast("string").alias("tbl"), (k % 2 == 0).alias("has_document"),
    )
    lines = n.select(F.col("n_nationkey").alias("page_id"), F.posexplode(F.array(F.lit("G0 > A1"), F.lit("A2"), F.lit("elsewhere"))).alias("at", "value")).select("page_id", (F.col("at") + 1).alias("line_no"), "value")
    fifths = named.withColumns({"fifth": F.col("n_nationkey") % 5, "own": k % 4 == 0}).filter("own").select("fifth", F.explode(batch.firm_keys(F.lit(None).cast("string"), F.col("s_name"))).alias("firm_key"))
    pages = n.select(F.col("n_nationkey").alias("page_id"), (F.col("n_nationkey") % 5).alias("fifth"), "n_name")
    firms = pages.filter("fifth > 0").join(fifths, "fifth").select("page_id", "firm_key")
    regions = pages.filter("page_id % 2 = 0").select("page_id", text.normalise(F.col("n_name")).alias("region_key"))
    return reconcile.line_candidates(lines, listing, firms, regions).select("page_id", "line_no", "candidate", "has_document")


@query("""
WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus) AS n, l_returnflag AS r, l_linestatus = 'O' AS filled, l_quantity > 25 AS named, l_partkey AS p FROM lineitem),
d AS (SELECT k, CASE k % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'alternate' WHEN 2 THEN 'no submission' ELSE 'ordinary' END AS route, count(*) AS lines,
    count(*) FILTER (r = 'A') AS yes, count(*) FILTER (r = 'N') AS no, count(*) FILTER (r = 'R' AND n % 3 = 0) AS odd, count(*) FILTER (r = 'R' AND n % 3 > 0) AS blank,
    count(*) FILTER (filled) AS matters, coalesce(min(n) FILTER (filled), 1) AS low, coalesce(max(n) FILTER (filled), 0) AS high, count(*) FILTER (named) AS leads,
    string_agg('Publishable matter ' || n, '; ' ORDER BY n) FILTER (filled) AS matter_texts, string_agg('Partner: leading individual 1 - P' || p, '; ' ORDER BY n) FILTER (named) AS lead_texts,
    string_agg('P' || p || ' - partner', '; ' ORDER BY n) FILTER (r = 'A') AS partner_texts, string_agg('P' || p || ' - not a partner', '; ' ORDER BY n) FILTER (r = 'N') AS other_texts FROM l GROUP BY k),
m AS (SELECT *, unnest(['matters', 'active_clients', 'new_clients', 'lead_partners', 'next_gen', 'associates']) AS metric, route = 'ordinary' AS plain, route = 'alternate' AS alt FROM d)
SELECT k AS doc_id, route, metric, CAST(CASE WHEN plain THEN CASE metric WHEN 'matters' THEN matters WHEN 'active_clients' THEN lines WHEN 'new_clients' THEN CASE WHEN odd = 0 THEN yes END WHEN 'lead_partners' THEN leads ELSE 0 END
    WHEN alt THEN CASE metric WHEN 'active_clients' THEN lines WHEN 'new_clients' THEN CASE WHEN odd = 0 THEN yes END WHEN 'lead_partners' THEN yes WHEN 'associates' THEN no END END AS INTEGER) AS value,
    coalesce(CASE WHEN plain THEN CASE metric WHEN 'matters' THEN matter_texts WHEN 'lead_partners' THEN lead_texts WHEN 'active_clients' THEN 'Active key clients: ' || lines || ' client rows' WHEN 'new_clients' THEN 'Active key clients: ' || lines || ' client rows' END
    WHEN alt THEN CASE metric WHEN 'lead_partners' THEN partner_texts WHEN 'associates' THEN other_texts WHEN 'active_clients' THEN 'D0 Clients: ' || lines || ' client rows' WHEN 'new_clients' THEN 'D0 Clients: ' || lines || ' client rows' END END, '') AS evidence,
    plain AND metric = 'matters' AND NOT (low = 1 AND high = matters) AS numbering_gap,
    CASE WHEN plain THEN metric = 'active_clients' AND blank > 0 AND (blank < lines OR lines = 1) ELSE alt AND metric <> 'next_gen' END AS needs_check FROM m
""")
def q53_routing(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of four kinds, their lines as clients, matters and nominations: a
    letter and an unreadable file have no figures, the alternate form has its own."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    li = lines.select("doc_id", turn.alias("n"), F.col("l_returnflag").alias("r"), "l_linestatus", "l_quantity", F.concat(F.lit("P"), "l_partkey").alias("p"))
    n, kind, empty = F.col("n"), F.col("doc_id") % 5, F.lit("")
    row = lambda tbl, at, *cells: F.struct(tbl.cast("int").alias("tbl_no"), at.cast("int").alias("row_no"), F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells)).alias("cells"))
    answer = lambda yes, no: F.when(F.col("r") == "A", yes).when(F.col("r") == "N", no).when(n % 3 == 0, "maybe").otherwise("")
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    ordinary = F.array(
        row(zero, n, "p", answer("Yes", "No")),
        row(n * 10, zero, F.concat(F.lit("Publishable matter "), n)), row(n * 10, one, "Name of client"), row(n * 10, two, F.when(F.col("l_linestatus") == "O", "X").otherwise(empty)),
        row(n * 10 + 1, zero, "Partner: leading individual 1"), row(n * 10 + 1, one, "Name"), row(n * 10 + 1, two, F.when(F.col("l_quantity") > 25, F.col("p")).otherwise(empty)),
    )
    other = F.array(row(zero, n + 1, F.col("p"), F.when(F.col("r") == "A", "Y").when(F.col("r") == "N", "N").otherwise("?")), row(one, n + 1, F.lit("1"), F.col("p"), answer("Y", "N")))
    once = {
        1: F.array(row(zero, zero, "B9: ranked and unranked lawyers"), row(zero, one, "Name", "Partner Y/N"), row(one, zero, "D0 Clients"), row(one, one, "No", "Name of client", "New client")),
        2: F.array(row(zero, zero, "Dear", "Sir")), 3: F.array(row(zero, zero, "Active key clients", "New")), 4: F.array(row(zero, zero, "Active key clients", "New")),
    }
    docs = lines.select("doc_id").distinct()
    # the first line of an order says its heads too, so rows stay with their order
    heads = F.when(n == 1, F.coalesce(*(F.when(kind == k, v) for k, v in once.items())))
    body = F.when(kind == 1, other).when(kind > 2, ordinary)
    rows = li.select("doc_id", F.inline(F.concat(*(F.coalesce(x, F.slice(other, 1, 0)) for x in (heads, body))))).withColumn("fill", empty)
    documents = docs.select("doc_id", F.when(kind == 0, "broken").alias("error"))
    blocks = docs.select("doc_id", zero.alias("block_no"), F.lit("p").alias("kind"), F.lit("a paragraph").alias("text"))
    found = metrics.figures(documents, rows, blocks)
    return found.select("doc_id", "route", "metric", "value", F.array_join("evidence", "; ").alias("evidence"), "numbering_gap", "needs_check")


# Orders as a portal page a customer: what each line may mean, walked line by line.
_PAGE_SQL = """
WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS page_id, o_orderpriority AS area, o_orderstatus AS s, o_orderdate AS dated, k % 10 = 0 AS elite, k % 3 > 0 AS doc,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no FROM orders),
r AS (SELECT *, 'c' || page_id || '-' || (k % 5) || '.docx' AS name, CASE WHEN k % 7 = 0 THEN 'c' || k ELSE 'i' || (page_id * 10 + k % 4) END AS ident FROM o WHERE k % 4 > 0),
f AS (SELECT page_id, k AS file_no, name, k % 11 = 0 AS by_code,
    CASE WHEN elite THEN 'elite' WHEN k % 13 = 0 THEN 'parse_error' WHEN k % 17 = 0 THEN 'duplicate' WHEN k % 9 = 0 THEN 'superseded' ELSE 'matched' END AS status FROM r WHERE s = 'F'),
fq AS (SELECT page_id, name, list(file_no ORDER BY by_code, file_no) AS queue FROM f WHERE status NOT IN ('elite', 'duplicate') GROUP BY ALL),
pool AS (SELECT page_id, area, plain, list(struct_pack(k := k, doc := doc, ident := ident, q := coalesce(queue, [])) ORDER BY elite, k) AS rows
    FROM (SELECT page_id, area, plain, k, doc, ident, elite, queue, page_id IN (SELECT page_id FROM f) AND s IN ('F', 'O') AS there,
        bool_or(s IN ('F', 'O')) OVER (PARTITION BY page_id, area, plain) AS anywhere
        FROM r CROSS JOIN (VALUES (true), (false)) v(plain) LEFT JOIN fq USING (page_id, name) WHERE plain OR NOT elite)
    WHERE NOT anywhere OR there OR page_id NOT IN (SELECT page_id FROM f) GROUP BY ALL),
ask AS (SELECT o.page_id, o.line_no, coalesce(p.rows, []) AS rows FROM o LEFT JOIN pool p ON p.page_id = o.page_id AND p.area = o.area AND p.plain = (o.k % 2 = 0)),
walk AS (
    SELECT page_id, 0 AS line_no, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS placed, CAST([] AS STRUCT(ident VARCHAR, line BIGINT)[]) AS seen,
        CAST(NULL AS BIGINT) AS candidate, CAST(NULL AS BIGINT) AS file_no, CAST(NULL AS BIGINT) AS repeat_of FROM (SELECT DISTINCT page_id FROM o)
    UNION ALL
    SELECT page_id, line_no, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c.k) END, CASE WHEN file IS NULL THEN placed ELSE list_append(placed, file) END,
        CASE WHEN c IS NULL THEN seen ELSE list_append(seen, struct_pack(ident := c.ident, line := CAST(line_no AS BIGINT))) END, c.k, file,
        list_filter(seen, lambda x: x.ident = c.ident)[1].line
    FROM (SELECT *, CASE WHEN c IS NOT NULL THEN list_filter(c.q, lambda x: NOT list_contains(placed, x))[1] END AS file
        FROM (SELECT *, coalesce(list_filter(use, lambda r: len(list_filter(r.q, lambda x: NOT list_contains(placed, x))) > 0)[1], list_filter(use, lambda r: r.doc)[1], use[1]) AS c
            FROM (SELECT w.page_id, a.line_no, w.taken, w.placed, w.seen, CASE WHEN len(list_filter(a.rows, lambda r: NOT list_contains(w.taken, r.k))) > 0
                THEN list_filter(a.rows, lambda r: NOT list_contains(w.taken, r.k)) ELSE a.rows END AS use
                FROM walk w JOIN ask a ON a.page_id = w.page_id AND a.line_no = w.line_no + 1)))
),
l AS (SELECT w.page_id, w.line_no, w.candidate, w.file_no, w.repeat_of, coalesce(r.doc, false) AS doc, coalesce(r.elite, false) AS elite, r.area, r.s, r.dated, r.name, f.status AS fs
    FROM walk w LEFT JOIN r ON r.k = w.candidate LEFT JOIN f ON f.file_no = w.file_no WHERE w.line_no > 0),
m AS (SELECT *, max(dated) OVER slot AS newest FROM l WINDOW slot AS (PARTITION BY page_id, doc AND NOT elite, area, s)),
n AS (SELECT *, doc AND NOT elite AND dated < newest AND count(*) FILTER (dated = newest) OVER (PARTITION BY page_id, doc AND NOT elite, area, s) = 1 AS superseded FROM m),
x AS (SELECT *, doc AND NOT elite AND NOT superseded AS expected, count(*) FILTER (doc AND NOT elite AND NOT superseded) OVER (PARTITION BY page_id ORDER BY line_no) AS turn FROM n),
y AS (SELECT x.*, expected AND turn <= coalesce(g.n, 0) AS reached FROM x LEFT JOIN (SELECT page_id, count(*) AS n FROM f WHERE status <> 'elite' GROUP BY page_id) g USING (page_id)),
z AS (SELECT *, CASE WHEN candidate IS NULL THEN 'unrecognised' WHEN elite THEN 'elite' WHEN NOT doc THEN 'no document' WHEN fs = 'parse_error' THEN 'could not read' WHEN fs = 'superseded' THEN 'older version'
    WHEN file_no IS NOT NULL THEN 'uploaded' WHEN superseded THEN 'older version' WHEN repeat_of IS NOT NULL AND reached THEN 'check page' WHEN reached THEN 'missing' ELSE 'not reached' END AS status FROM y)
"""


def _page_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Lines, listing, results, firms and regions: every customer is a firm with a page. A
    line of an even order names the area alone, so it may mean elite rows too."""
    none = F.lit(None).cast("string")
    # keys once a firm, not once an order; merged, as firms grow too and lines are dealt by them anyway
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", batch.firm_keys(none, F.col("c_name")).alias("firm_keys")).hint("merge")
    k, page_id = F.col("o_orderkey"), F.col("o_custkey").alias("page_id")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate").join(c, "o_custkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = orders.select(page_id, place.alias("line_no"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat_ws(" > ", F.lit("Group"), "o_orderpriority")).alias("value"))
    listed = orders.filter(k % 4 > 0).withColumn("filename", F.concat(F.lit("c"), "o_custkey", F.lit("-"), k % 5, F.lit(".docx")))
    listing = listed.select(
        k.alias("candidate"), F.col("c_name").alias("firm"), "firm_keys", F.col("o_orderstatus").alias("region"), F.when(k % 10 == 0, "Elite group").otherwise("Group").alias("grp"),
        F.col("o_orderpriority").alias("area"), none.alias("tbl"), "filename", F.when(k % 7 > 0, F.col("o_custkey") * 10 + k % 4).alias("portal_id"), F.col("o_orderdate").cast("string").alias("created_at"), (k % 3 > 0).alias("has_document"),
    )
    status = F.when(k % 10 == 0, "elite").when(k % 13 == 0, "parse_error").when(k % 17 == 0, "duplicate").when(k % 9 == 0, "superseded").otherwise("matched")
    results = listed.filter("o_orderstatus = 'F'").select(page_id, k.alias("file_no"), F.col("filename").alias("name"), (k % 11 == 0).alias("by_code"), status.alias("status"))
    firms = orders.select(page_id, "firm_keys").distinct().select("page_id", F.explode("firm_keys").alias("firm_key"))
    regions = results.select("page_id").distinct().select("page_id", F.explode(F.array(F.lit("f"), F.lit("o"))).alias("region_key"))
    return lines, listing, results, firms, regions


@query(_PAGE_SQL + """
SELECT page_id, CAST(line_no AS INTEGER) AS line_no, candidate, file_no, CAST(repeat_of AS INTEGER) AS repeat_of, superseded, reached, status FROM z
""")
def q54_page(spark: SparkSession, d: str) -> DataFrame:
    """From pasted lines to the row, the file and the status of each."""
    done = reconcile.page_lines(*_page_tables(spark, d))
    return done.select("page_id", "line_no", "candidate", "file_no", "repeat_of", "superseded", "reached", "status")


@query(_PAGE_SQL + """
SELECT z.page_id, count(*) AS page_size, count(*) FILTER (expected) AS expected, count(*) FILTER (reached) AS in_batch, count(*) FILTER (z.status = 'missing') AS missing, count(*) FILTER (z.status = 'not reached') AS not_reached,
    count(*) FILTER (file_no IS NOT NULL AND z.status IN ('uploaded', 'older version')) AS accounted,
    count(DISTINCT CASE WHEN expected AND repeat_of IS NULL THEN name END) + count(*) FILTER (expected AND repeat_of IS NOT NULL) AS distinct_documents, count(*) FILTER (z.status = 'check page') AS unclear,
    count(*) FILTER (z.status = 'could not read') AS unreadable, coalesce(any_value(dup), 0) AS duplicates, coalesce(any_value(placeable), 0) - count(file_no) AS not_on_page,
    count(*) FILTER (z.status IN ('missing', 'not reached', 'check page', 'could not read')) + coalesce(any_value(dup), 0) = 0 AS accounted_for
FROM z LEFT JOIN (SELECT page_id, count(*) FILTER (status = 'duplicate') AS dup, count(*) FILTER (status NOT IN ('duplicate', 'elite')) AS placeable FROM f GROUP BY page_id) USING (page_id) GROUP BY z.page_id
""")
def q55_page_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What a page owes and has, counted."""
    tables = _page_tables(spark, d)
    done = reconcile.page_rollup(reconcile.page_lines(*tables), tables[2])
    return done.select("page_id", "page_size", "expected", "in_batch", "missing", "not_reached", "accounted", "distinct_documents", "unclear", "unreadable", "duplicates", "not_on_page", "accounted_for")


@query(_PAGE_SQL + """
, p AS (SELECT z.page_id, count(*) AS page_size, count(*) FILTER (status = 'no document') AS without_document, count(*) FILTER (status = 'unrecognised') AS unrecognised, count(*) FILTER (status = 'elite') AS elite,
    count(*) FILTER (superseded) AS superseded, count(*) FILTER (expected) AS expected, count(DISTINCT CASE WHEN expected AND repeat_of IS NULL THEN name END) + count(*) FILTER (expected AND repeat_of IS NOT NULL) AS documents FROM z GROUP BY z.page_id),
b AS (SELECT page_id, count(*) AS files, count(*) FILTER (status = 'elite') AS elite, count(*) FILTER (status = 'superseded') AS older, count(*) FILTER (status = 'duplicate') AS copies FROM f GROUP BY page_id),
e AS (SELECT page_id, count(*) AS n, count(*) FILTER (k IN (SELECT file_no FROM f WHERE status = 'matched')) AS matched FROM r WHERE NOT elite GROUP BY page_id),
u AS (SELECT page_id, 'page' AS chain, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS line_no, unnest(['rows pasted', 'without a document', 'not found for this firm', 'elite, not recounted', 'replaced by a newer row', 'rows to check', 'share a document with another row', 'separate documents to download']) AS label,
        unnest([page_size, -without_document, -unrecognised, -elite, -superseded, expected, documents - expected, documents]) AS n, unnest([NULL, NULL, NULL, NULL, NULL, true, NULL, true]) AS follows FROM p
    UNION ALL SELECT page_id, 'files', unnest([1, 2, 3, 4, 5]), unnest(['documents uploaded', 'elite, not recounted', 'older versions removed', 'second copies removed', 'rows in the table']), unnest([files, -elite, -older, -copies, files - elite - older - copies]), unnest([NULL, NULL, NULL, NULL, true]) FROM b
    UNION ALL SELECT page_id, 'export', unnest([1, 2, 3]), unnest(['rows in the export for these firms', 'not matched to any document', 'matched and compared']), unnest([n, matched - n, matched]), unnest([NULL, NULL, true]) FROM e)
SELECT page_id, chain, line_no, label, n, follows FROM u WHERE n <> 0 OR label IN ('rows pasted', 'rows to check', 'separate documents to download', 'documents uploaded', 'rows in the table', 'rows in the export for these firms', 'matched and compared')
""")
def q56_ledgers(spark: SparkSession, d: str) -> DataFrame:
    """How a page, its files and the export come down, line by line, to what is compared."""
    tables = _page_tables(spark, d)
    results, exported = tables[2], F.col("candidate").alias("export_id")
    pages = reconcile.page_rollup(reconcile.page_lines(*tables), results)
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate"), F.col("o_custkey").alias("page_id"))
    export = tables[1].filter("NOT grp LIKE 'Elite%'").join(owners, "candidate").select("page_id", exported)
    matched = results.filter("status = 'matched'").select(F.col("file_no").alias("export_id"))
    parts = [
        edits.chain(pages, ["page_id"], "page", edits.PAGE_CHAIN), edits.chain(edits.file_counts(results, ["page_id"]), ["page_id"], "files", edits.FILE_CHAIN),
        edits.chain(edits.export_counts(export, matched, ["page_id"]), ["page_id"], "export", edits.EXPORT_CHAIN),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH n AS (SELECT n_nationkey, lower(n_name) AS region FROM nation), c AS (SELECT c_custkey, lower(c_name) AS firm, region FROM customer JOIN n ON c_nationkey = n_nationkey),
l AS (SELECT o_orderkey * 4 AS line_no, 'file|f' || o_orderkey || '.docx' AS key FROM orders WHERE o_orderkey % 40 = 1
    UNION ALL SELECT c_custkey * 4 + 1, unnest(['fra|' || firm || '|' || region || '|1-urgent', 'ra|' || region || '|1-urgent', 'a|1-urgent']) FROM c WHERE c_custkey % 30 = 1
    UNION ALL SELECT n_nationkey * 4 + 2, unnest(['ra|' || region || '|2-high', 'a|2-high']) FROM n WHERE n_nationkey % 2 = 0
    UNION ALL SELECT 3, 'a|3-medium'),
m AS (SELECT key, min(line_no) AS place FROM l GROUP BY key),
k AS (SELECT o_orderkey, unnest([1, 2, 3, 4]) AS turn, unnest(['file|f' || o_orderkey || '.docx', 'fra|' || firm || '|' || region || '|' || lower(o_orderpriority), 'ra|' || region || '|' || lower(o_orderpriority), 'a|' || lower(o_orderpriority)]) AS key
    FROM orders JOIN c ON o_custkey = c_custkey)
SELECT o_orderkey, CAST(arg_min(place, turn) AS INTEGER) AS position FROM k JOIN m USING (key) GROUP BY o_orderkey
""")
def q57_pasted_positions(spark: SparkSession, d: str) -> DataFrame:
    """A page that names files, firms with regions, regions, and areas: each order stands where
    the most specific of its keys does."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("firm"), "region")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("area"))
    none = F.lit(None).cast("string")
    line = lambda df, at, file=none, firm=none, region=none, area=none: df.select(F.lit(1).alias("page_id"), at.cast("int").alias("line_no"), file.alias("file"), firm.alias("firm"), region.alias("region"), area.alias("area"))
    k, name = F.col("o_orderkey"), F.concat(F.lit("f"), "o_orderkey", F.lit(".docx"))
    lines = line(orders.filter(k % 40 == 1), k * 4, file=name)
    lines = lines.unionByName(line(c.filter("c_custkey % 30 = 1"), F.col("c_custkey") * 4 + 1, firm=F.col("firm"), region=F.col("region"), area=F.lit("1-URGENT")))
    lines = lines.unionByName(line(n.filter("n_nationkey % 2 = 0"), F.col("n_nationkey") * 4 + 2, region=F.col("region"), area=F.lit("2-HIGH")))
    lines = lines.unionByName(line(n.filter("n_nationkey = 0"), F.lit(3), area=F.lit("3-MEDIUM")))
    parts = (F.col("file"), F.col("firm"), F.col("region"), none, F.col("area"))
    rows = orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit(1).alias("page_id"), "o_orderkey", name.alias("file"), "firm", "region", "area")
    return page.positions(rows, page.order_map(lines, *parts), "o_orderkey", *parts).select("o_orderkey", "position")


# What the count and a person say, in a log: every seventh order was entered, every 21st taken back.
_DECIDED_SQL = f"""
SELECT l_orderkey, metric, reported, recounted, CASE WHEN l_orderkey % 7 = 0 AND l_orderkey % 21 > 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN reported END ELSE recounted END AS value FROM ({_METRICS_SQL})
"""


def _overrides(metrics_: DataFrame) -> DataFrame:
    """First an impossible figure, then the export's own or unknown; some are taken back."""
    k = F.col("l_orderkey")
    entered = metrics_.filter(k % 7 == 0).select(k.cast("string").alias("name"), "metric", k, "reported")
    entry = lambda at, value, removed: F.struct(F.lit(at).alias("at"), value.cast("int").alias("value"), removed.alias("removed"))
    steps = F.array(entry(1, F.lit(-5), F.lit(False)), entry(2, F.when(k % 2 == 0, F.col("reported")), F.lit(False)), entry(3, F.lit(None), F.lit(True)))
    log = entered.select("name", "metric", F.inline(F.when(k % 21 == 0, steps).otherwise(F.slice(steps, 1, 2))))
    return edits.latest_overrides(log)


@query(f"""
SELECT l_orderkey, metric, reported AS exported, recounted AS counted, value, array_to_string(list_filter([CASE WHEN recounted IS NULL THEN 'count by hand' END, CASE WHEN l_orderkey % 5 = 0 THEN 'check the count' END,
    CASE WHEN value <> reported THEN 'differs from the export' END], lambda x: x IS NOT NULL), ', ') AS why FROM ({_DECIDED_SQL}) WHERE recounted IS NULL OR l_orderkey % 5 = 0 OR value <> reported
""")
def q58_review_rows(spark: SparkSession, d: str) -> DataFrame:
    """Figures of orders that a person may have to decide, with what was entered for some."""
    found = _metrics(spark, d)
    asked = found.select("l_orderkey", F.col("l_orderkey").cast("string").alias("name"), "metric", F.col("reported").alias("exported"), F.col("recounted").alias("counted"), (F.col("l_orderkey") % 5 == 0).alias("needs_check"))
    return edits.review_rows(asked, _overrides(found)).select(F.col("name").cast("long").alias("l_orderkey"), "metric", "exported", "counted", "value", "why")


# --- folders of firms ---


# A folder a customer, its orders' documents, a listing of all and one a nation. "Firm 1" is
# also part of "Firm 12", so folders and rows are chosen, not just met.
_FOLDERS_SQL = """
WITH c AS (SELECT c_custkey AS k, n_name AS n, CASE c_custkey % 3 WHEN 0 THEN n_name || '/Firm' || c_custkey WHEN 1 THEN 'Firm' || c_custkey || '/2026' ELSE 'Firm ' || c_custkey END AS folder FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT c.*, o_orderkey AS r, o_orderdate AS dated, o_orderstatus AS area, o_orderpriority = '5-LOW' AS elite, o_orderkey % 13 > 0 AS has, '_submission_' || o_orderkey || '_EC' || o_orderkey % 10 || '.docx' AS tail FROM orders JOIN c ON o_custkey = k),
docs AS (SELECT folder, 'x_' || k || tail AS name FROM o WHERE r % 5 > 0),
listing AS (SELECT 'real/all.csv' AS export, * EXCLUDE (folder), 'X_' || k || tail AS name FROM o WHERE r % 7 > 0 UNION ALL SELECT n || '/spreadsheets/p.csv', * EXCLUDE (folder), 'X_' || k || tail FROM o WHERE r % 11 > 0 AND k % 2 = 0),
firms AS (SELECT 'Firm ' || k AS firm, 'firm' || k AS short FROM c),
folders AS (SELECT DISTINCT folder, lower(replace(folder, ' ', '')) AS short, string_split(folder, '/') AS path FROM docs),
picked AS (SELECT firm, d.folder FROM firms f JOIN folders d ON contains(d.short, f.short)
    QUALIFY row_number() OVER (PARTITION BY firm ORDER BY NOT contains(lower(replace(path[-1], ' ', '')), f.short), len(path), path) = 1),
pairs AS (SELECT f.firm, l.k FROM firms f JOIN (SELECT DISTINCT k FROM listing) l ON contains('firm ' || l.k || ' llp', lower(f.firm))),
asked AS (SELECT p.firm, l.* FROM pairs p JOIN listing l USING (k)),
near AS (SELECT DISTINCT firm, folder, export, CASE WHEN export = regexp_replace(folder, '[^/]*$', 'spreadsheets/p.csv') THEN 2 WHEN export = 'real/all.csv' THEN 3 END AS turn FROM asked JOIN picked USING (firm)),
chosen AS (SELECT firm, folder, export FROM near WHERE turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY firm ORDER BY turn) = 1),
own AS (SELECT a.*, folder FROM asked a JOIN chosen USING (firm, export)),
tops AS (SELECT *, max(dated) OVER (PARTITION BY firm, k, n, area) AS top FROM own WHERE NOT elite AND has),
marked AS (SELECT *, dated < top AND count_if(dated = top) OVER (PARTITION BY firm, k, n, area) = 1 AS older FROM tops),
held AS (SELECT firm, folder, export, name FROM chosen JOIN docs USING (folder)),
codes AS (SELECT DISTINCT firm, k || '/' || r % 10 AS code FROM own WHERE elite),
checked AS (SELECT firm, folder, export, coalesce(h.name, m.name) AS name, CASE WHEN h.name IS NULL THEN 'missing' WHEN m.name IS NOT NULL THEN 'present'
    WHEN EXISTS (FROM codes e WHERE e.firm = firm_ AND e.code = regexp_replace(h.name, '^x_(\\d+)_.*EC(\\d+).docx$', '\\1/\\2')) THEN 'elite' ELSE 'extra' END AS side, n AS region, area, dated
    FROM (SELECT *, firm AS firm_, lower(name) AS key FROM held) h FULL JOIN (SELECT *, lower(name) AS key FROM marked WHERE NOT older) m USING (firm, folder, export, key)
    UNION ALL SELECT firm, folder, export, name, 'older version', n, area, dated FROM marked WHERE older
    UNION ALL SELECT firm, folder, export, NULL, 'no document', n, area, dated FROM own WHERE NOT elite AND NOT has)
"""


def _folder_check(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, r = F.col("c_custkey").cast("string"), F.col("o_orderkey")
    place = F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit("/Firm"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Firm"), k, F.lit("/2026"))).otherwise(F.concat(F.lit("Firm "), k))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("folder", place)
    tail = F.concat(k, F.lit("_submission_"), r, F.lit("_EC"), r % 10, F.lit(".docx"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("tail", tail)
    documents = o.filter(r % 5 > 0).select("folder", F.concat(F.lit("x_"), "tail").alias("name"))
    exports = F.array_compact(F.array(F.when(r % 7 > 0, F.lit("real/all.csv")), F.when((r % 11 > 0) & (F.col("c_custkey") % 2 == 0), F.concat("n_name", F.lit("/spreadsheets/p.csv")))))
    has = r % 13 > 0
    listing = o.select(
        F.explode(exports).alias("export"), r.alias("row_no"), F.concat(F.lit("Firm "), k, F.lit(" LLP")).alias("firm"), F.col("n_name").alias("region"), F.when(F.col("o_orderpriority") == "5-LOW", "Elite").otherwise("Group").alias("grp"),
        F.col("o_orderstatus").alias("area"), F.concat(F.lit("X_"), "tail").alias("filename"), has.alias("has_document"), F.col("o_orderdate").alias("created_at"),
    )
    firms = c.select(F.concat(F.lit("Firm "), k).alias("firm"))
    return firms, folders.check_folders(listing, documents, firms, ["real"])


@query(_FOLDERS_SQL + "SELECT firm, folder, export, name, side, region, area, strftime(dated, '%Y-%m-%d') AS created FROM checked")
def q59_folder_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents in every customer's folder against what the nearest listing says of it."""
    return _folder_check(spark, d)[1].withColumn("created", F.date_format("created_at", "yyyy-MM-dd")).drop("created_at")


@query(_FOLDERS_SQL + f"""
, n AS (SELECT firm, folder, export, {", ".join(f"count_if(side = '{s}') AS {c}" for s, c in folders.SIDES.items())} FROM checked GROUP BY ALL)
SELECT f.firm, n.* EXCLUDE (firm), missing = 0 AS complete FROM firms f LEFT JOIN n USING (firm)
""")
def q60_folder_counts(spark: SparkSession, d: str) -> DataFrame:
    """A row a customer: what is present, missing, replaced, extra, and whether that is all."""
    return folders.folder_counts(*_folder_check(spark, d))


@query("""
SELECT o_custkey, CAST(count(DISTINCT (o_orderstatus, o_orderpriority)) AS INTEGER) AS n_rows, CAST(count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END) AS INTEGER) AS n_urgent FROM orders GROUP BY o_custkey
""")
def q61_kept_decodes(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's kinds of orders, written as a spreadsheet and decoded again; equal files
    are decoded once, and the second run finds all of them in the store."""
    kinds = table(spark, d, "orders").select("o_custkey", F.concat_ws(",", "o_orderstatus", "o_orderpriority").alias("kind")).distinct()
    packages = kinds.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("kind")), "\n").cast("binary").alias("content")).withColumn("doc_id", F.col("o_custkey").cast("string"))
    kept = f"{shared_folder(packages)}/decoded/{uuid.uuid4().hex}"
    for _ in range(2):
        found = store.decoded(packages.select("doc_id", "content"), readers.decode_tables, kept)
    count = lambda f: F.size(F.filter("cells", f)).alias
    return found.select(F.col("doc_id").cast("long").alias("o_custkey"), count(lambda c: c["col_no"] == 1)("n_rows"), count(lambda c: c["value"] == "1-URGENT")("n_urgent"))


@query("""
WITH lines AS (
  SELECT l_suppkey, l_linenumber, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey, l_linenumber
)
SELECT l_suppkey, CAST(count(CASE WHEN n_lines <> n_parts THEN 1 END) AS BIGINT) AS n_changes,
  CAST(sum(CASE WHEN n_lines <> n_parts THEN n_lines - n_parts ELSE 0 END) AS BIGINT) AS repeated
FROM lines GROUP BY l_suppkey
""")
def q62_workbook_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines and parts of each supplier by line number, written as one workbook a supplier and
    read back: of each workbook only the sheet of changes is opened."""
    for source in (workbook_files, package_files):
        source.register(spark)
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))
    recount = counts.withColumn("line", F.col("l_linenumber")).select("l_suppkey", "l_linenumber", "line", "n_lines", "n_parts")
    changes = recount.filter(labels.differs(F.col("n_lines"), F.col("n_parts")))
    books = sinks.result_workbooks(recount, changes, recount.limit(0), "l_suppkey", "l_linenumber")
    path = f"{shared_folder(books)}/books/{uuid.uuid4().hex}"
    books.write.format(workbook_files.NAME).mode("append").save(path)
    found = spark.read.format("submission_tables").option("sheets", "Changes").load(path)
    figure = lambda column: F.filter("cells", lambda c: (c["row_no"] > 1) & (c["col_no"] == column) & c["value"].rlike("^[0-9]+$"))
    total = lambda column: F.aggregate(figure(column), F.lit(0).cast("long"), lambda a, c: a + c["value"].cast("long"))
    key = F.regexp_extract("doc_id", r"^(.*)\.xlsx$", 1).cast("long")
    return found.select(key.alias("l_suppkey"), F.size(figure(2)).cast("long").alias("n_changes"), (total(2) - total(3)).alias("repeated"))


_FLAGSHIP_SQL = f"""
WITH m AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders)
SELECT r.o_custkey, r.o_orderkey, r.recount, r.reported, CASE WHEN r.recount < r.reported THEN 'lines missing' ELSE 'lines repeated' END AS reason
FROM ({_RECOUNT_SQL}) r JOIN m ON r.o_orderkey = m.o_orderkey AND k = 1 WHERE r.recount <> r.reported
"""


@query(_FLAGSHIP_SQL)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer, where its lines differ from what is reported."""
    newest = matching.latest(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate"), ["o_orderkey"])
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("recount"), F.max("l_linenumber").cast("int").alias("reported"))
    both = newest.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    reason = F.when(F.col("recount") < F.col("reported"), "lines missing").otherwise("lines repeated")
    return both.filter(labels.differs(F.col("recount"), F.col("reported"))).select("o_custkey", "o_orderkey", "recount", "reported", reason.alias("reason"))
