"""A training corpus from documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's docs. All but the last return
the columns of documents, and columns of any other names as they are.

Every stage judges rows, not ids: a null doc_id is like any other, rows that repeat a doc_id
are judged each by their text, and of rows that are alike in every column each is treated
alike (near-duplicate removal keeps one). A null text counts as empty and is passed on as
null. Texts are read whole, however long. An empty table gives an empty one with the same
columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, line_quality, pattern_packing, simhash_dedup, suffix_dedup
from ledgerline.llm.common import read, whole_rows, write_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines are good: score of 0.3 or more (a tie stays). The model is
    fitted on labelled rows of documents, as in op4. A null or blank text is scored like any
    other, as one empty line. Scored rows keep their columns, so nothing is joined back and
    repeated or null ids do no harm."""
    labels = read(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = line_quality.learn(read(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return line_quality.scored_rows(docs, model).filter("score >= 0.3").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the least doc_id, of several rows with
    that id the one whose text has the least hash; a row without an id only where no row of
    its group has one. Null and blank texts are one group."""
    return simhash_dedup.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that start earlier elsewhere out of texts, and sets n_chars. Bytes of
    a character of which only a part remains go too. Rows stay, also with an empty text; null
    texts stay null. Rows of equal doc_id and text are one document and lose the same bytes; a
    null doc_id comes first."""
    done = suffix_dedup.remove(docs, suffix_dedup.repeated_spans(docs.select("doc_id", "text")))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark. What a row says decides, not its
    doc_id: rows without an id, or with one that others have too, go if their own text holds
    an item and stay if it does not, as null and empty texts do. A similarity of exactly 0.8
    counts."""
    rows = whole_rows(docs, text_key=F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)), text=F.col("text"))
    found = decontaminate.contaminated(rows.select(F.col("text_key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("text_key")).distinct(), "text_key", "left_anti").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, and their places in sequences. Each row is packed,
    repeated ones and null ids too; a null text is its end token alone."""
    return pattern_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can express a trained model, fingerprint components or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
