"""A reader's edits of the shown table: overrides and ticks, as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.labels import differs
from ledgerline.operators.present import final_value, issues


def apply_edits(overrides: DataFrame, rendered: DataFrame, typed: DataFrame) -> DataFrame:
    """overrides (name, metric, value) after an edit. rendered and typed: name, metric,
    value, and in rendered recount. Only cells that differ from what was shown are edits;
    typing the recount removes the override, clearing a cell overrides with null."""
    both = rendered.select("name", "metric", F.col("value").alias("shown"), "recount").join(typed.select("name", "metric", F.col("value").alias("typed")), ["name", "metric"])
    edits = both.filter(~F.col("shown").eqNullSafe(F.col("typed")))
    untouched = overrides.join(edits, ["name", "metric"], "left_anti")
    made = edits.filter(F.col("typed").isNull() | ~F.col("typed").eqNullSafe(F.col("recount")))
    return untouched.select("name", "metric", "value").unionByName(made.select("name", "metric", F.col("typed").alias("value")))


def replace_ticks(typed: DataFrame) -> DataFrame:
    """The ticks of the table as shown are all the ticks there are."""
    return typed.filter("ticked").select(F.lower("name").alias("name")).distinct()


def latest_overrides(log: DataFrame) -> DataFrame:
    """name, metric, value of the overrides in force, from a log that is only appended to:
    name, metric, value, at, and removed (the override was taken back). The last entry of a
    cell wins; a null value says that the figure is unknown, which is not the same as none."""
    last = F.max_by(F.struct("value", "removed"), "at")
    done = log.groupBy(F.lower("name").alias("name"), "metric").agg(last.alias("last"))
    return done.filter(~F.coalesce("last.removed", F.lit(False))).select("name", "metric", "last.value")


def decided(metrics: DataFrame, overrides: DataFrame, name: str = "name") -> DataFrame:
    """metrics (name, metric, counted ...) with value, the figure that holds, and by_hand: it
    is not the one that was counted."""
    entered = overrides.select(F.lower("name").alias("_name"), F.col("metric").alias("_metric"), F.col("value").alias("_entered"), F.lit(True).alias("_present"))
    both = metrics.join(entered, (F.lower(F.col(name)) == F.col("_name")) & (F.col("metric") == F.col("_metric")), "left")
    value = final_value(F.col("_present"), F.col("_entered"), F.col("counted"))
    return both.withColumn("value", value).withColumn("by_hand", ~F.col("value").eqNullSafe(F.col("counted"))).drop("_name", "_metric", "_entered", "_present")


def review_rows(metrics: DataFrame, overrides: DataFrame, everything: bool = False) -> DataFrame:
    """name, metric, exported, counted, value, why: figures that a person may have to decide.
    metrics: name, metric, exported, counted, needs_check. A figure is listed if it could not
    be counted, if its numbering or rows want a look (a tick does not hide that here), or if
    what holds differs from the export; everything lists all."""
    both = decided(metrics, overrides)
    flags = issues(
        (F.col("counted").isNull(), "count by hand"),
        (F.coalesce("needs_check", F.lit(False)), "check the count"),
        (differs(F.col("exported"), F.col("value")), "differs from the export"),
    )
    listed = both.withColumn("why", F.array_join(flags, ", "))
    return (listed if everything else listed.filter("why <> ''")).select("name", "metric", "exported", "counted", "value", "why")


def near_misses(rows: DataFrame) -> DataFrame:
    """Labels (columns label, category, matter, client as operators.metrics.labelled gives
    them) that look like one of the form's and matched none."""
    text = F.lower("label")
    hints = (F.contains(text, F.lit("matter")) & ~F.contains(text, F.lit("summary"))) | text.rlike("^(partner|associate)") | F.contains(text, F.lit("active key client"))
    return rows.filter(~F.col("matter") & ~F.col("client") & F.col("category").isNull() & (F.length("label") <= 80) & hints).select("doc_id", "tbl_no", "row_no", "label")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of keys that several rows share."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def chain(counts: DataFrame, keys: list[str], name: str, lines: list[tuple[str, str, str]]) -> DataFrame:
    """keys, chain, line_no, label, n, follows: a chained balance of each row of counts.

    lines: label, column and role: a start, an amount taken away (minus), or a total. Amounts
    of zero are left out, totals are not. follows (totals only): the total is what the lines
    before it leave, so every figure is shown to turn into the next."""
    rows, left = [], F.lit(0).cast("long")
    for k, (label, column, role) in enumerate(lines):
        n = F.coalesce(F.col(column), F.lit(0)).cast("long")
        follows = F.lit(None).cast("boolean")
        if role == "minus":
            left = left - n
        else:
            follows = (left == n) if role == "total" else follows
            left = n
        shown = F.struct(F.lit(name).alias("chain"), F.lit(k + 1).alias("line_no"), F.lit(label).alias("label"), (-n if role == "minus" else n).alias("n"), follows.alias("follows"))
        rows.append(F.when((n != 0) | F.lit(role != "minus"), shown))
    return counts.select(*keys, F.inline(F.array_compact(F.array(*rows))))


#: The figures of a batch in the order in which one turns into the next.
PAGE_CHAIN = [
    ("rows pasted", "page_size", "start"), ("without a document", "without_document", "minus"), ("not found for this firm", "unrecognised", "minus"), ("elite, not recounted", "elite", "minus"),
    ("replaced by a newer row", "superseded", "minus"), ("rows to check", "expected", "total"), ("share a document with another row", "shared_rows", "minus"), ("separate documents to download", "distinct_documents", "total"),
]
FILE_CHAIN = [
    ("documents uploaded", "files", "start"), ("elite, not recounted", "elite_files", "minus"), ("older versions removed", "older_files", "minus"), ("second copies removed", "duplicates", "minus"), ("rows in the table", "table_rows", "total"),
]
EXPORT_CHAIN = [("rows in the export for these firms", "export_rows", "start"), ("not matched to any document", "unmatched_rows", "minus"), ("matched and compared", "matched_rows", "total")]


def file_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """What FILE_CHAIN counts, from results with a status."""
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    return results.groupBy(*keys).agg(F.count("*").alias("files"), status("elite").alias("elite_files"), status("superseded").alias("older_files"), status("duplicate").alias("duplicates"), F.count_if(~F.col("status").isin("elite", "superseded", "duplicate")).alias("table_rows"))


def export_counts(export: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """What EXPORT_CHAIN counts: export (keys, export_id) without elite rows, and the
    export_ids that documents matched. Rows are counted, not the documents that match one."""
    used = matched.select("export_id", F.lit(True).alias("used")).distinct()
    both = export.join(used, "export_id", "left").groupBy(*keys).agg(F.count("*").alias("export_rows"), F.count("used").alias("matched_rows"))
    return both.withColumn("unmatched_rows", F.col("export_rows") - F.col("matched_rows"))


def ledger(**counts: DataFrame) -> DataFrame:
    """One row a label, with the number of rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("line"), "n") for label, df in counts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adds_up(lines: DataFrame, total: str, *parts: str) -> DataFrame:
    """total, parts, adds_up: whether lines (line, n) named parts sum to the one named total."""
    named = lambda *names: F.sum(F.when(F.col("line").isin(*names), F.col("n")).otherwise(0))
    sums = lines.agg(named(total).alias("total"), named(*parts).alias("parts"))
    return sums.select("total", "parts", (F.col("total") == F.col("parts")).alias("adds_up"))
