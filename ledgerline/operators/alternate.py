"""The alternate form: one row a lawyer and numbered client lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ledgerline.functions import labels
from ledgerline.functions.text import clean, unwrap

#: Section codes, headings and the upload address of that form.
SITE = "myaccount.chambers.com"
LAWYERS, CLIENTS = (("B9",), "ranked and unranked lawyers"), (("D0", "E0"), "clients")
PARTNER_COLUMN, NAME_COLUMN, NEW_COLUMN = "partner~y~/~n", "name of client", "new client"


def is_section(label: Column, section: tuple[tuple[str, ...], str]) -> Column:
    """A label that begins with one of the section's codes and mentions its subject."""
    codes, subject = section
    return labels.may_hold(label, [c.lower() for c in codes]) & labels.begins(clean(label), codes, labels.END) & labels.mentions(clean(label), [subject])


def is_coded(label: Column) -> Column:
    """A table's label with one of the form's section codes."""
    return is_section(label, LAWYERS) | is_section(label, CLIENTS)


def is_sited(text: Column) -> Column:
    """A paragraph with the form's upload address."""
    return labels.mentions(text, [SITE])


def is_alternate(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id of documents that carry the form's own codes or address, never by absence."""
    label = F.get("cells", F.lit(0))
    coded = rows.filter((F.col("row_no") == 0) & is_coded(label))
    sited = blocks.filter((F.col("kind") == "p") & is_sited(F.col("text")))
    return coded.select("doc_id").unionByName(sited.select("doc_id")).distinct()


def _column_of(heading: str) -> Column:
    """The first cell that begins with heading, from 1; null if none does."""
    hits = F.transform("cells", lambda c: labels.begins(clean(c), [heading]))
    return F.nullif(F.array_position(hits, True), F.lit(0)).cast("int")


def sections(own: WindowSpec) -> dict[str, Column]:
    """lawyers_section, clients_section: the label of a table of that section, in all its rows.
    own: all rows of a table."""
    label = F.get("cells", F.lit(0))
    said = lambda section: F.max(F.when((F.col("row_no") == 0) & is_section(label, section), clean(label))).over(own)
    return {"lawyers_section": said(LAWYERS), "clients_section": said(CLIENTS)}


def heads(own: WindowSpec) -> dict[str, Column]:
    """lawyers_head, clients_head: of a section's table, the first row that has the first column's
    heading, and the place of each column."""

    def head(section: str, **columns: str) -> Column:
        places = [F.when(F.col(section).isNotNull(), _column_of(p)).alias(k) for k, p in columns.items()]
        return F.min(F.when(F.col(section).isNotNull() & places[0].isNotNull(), F.struct("row_no", *places))).over(own)

    return {"lawyers_head": head("lawyers_section", partner=PARTNER_COLUMN), "clients_head": head("clients_section", name=NAME_COLUMN, new=NEW_COLUMN)}


def _below(head: str, row: Callable[[Column], Column]) -> Column:
    """What row makes of rows from the head row on; null above it."""
    return F.when(F.col("row_no") >= F.col(f"{head}.row_no"), row(F.col("row_no") == F.col(f"{head}.row_no")))


def lawyer() -> Column:
    """is_head, name, answer, kind (partner, other or null) of a row with the columns of sections and
    heads; null for a row that names no lawyer. A head row says that the table was found."""

    def row(is_head: Column) -> Column:
        answer = unwrap(clean(F.get("cells", F.col("lawyers_head.partner") - 1)))
        kind = F.when(F.lower(answer).isin(*labels.NEW_YES), "partner").when(F.lower(answer).isin(*labels.NEW_NO), "other")
        name = clean(F.get("cells", F.lit(0)))
        return F.when(is_head | (name != ""), F.struct(is_head.alias("is_head"), name.alias("name"), answer.alias("answer"), kind.alias("kind")))

    return _below("lawyers_head", row)


def listed_client() -> Column:
    """is_head, name, answer, kind (new, not, blank, unrecognised) of a row with the columns of
    sections and heads; null for a row that names no client."""

    def row(is_head: Column) -> Column:
        answer = unwrap(clean(F.get("cells", F.col("clients_head.new") - 1)))
        name = clean(F.get("cells", F.col("clients_head.name") - 1))
        return F.when(is_head | ((name != "") & ~labels.not_applicable(name)), F.struct(is_head.alias("is_head"), name.alias("name"), answer.alias("answer"), labels.answer(answer).alias("kind")))

    return _below("clients_head", row)


def _in_sections(rows: DataFrame) -> DataFrame:
    own = Window.partitionBy("doc_id", "tbl_no")
    return rows.withColumns(sections(own)).withColumns(heads(own))


def lawyers(rows: DataFrame) -> DataFrame:
    """doc_id, tbl_no, row_no, is_head, name, answer, kind: the rows of lawyer tables."""
    return _in_sections(rows).select("doc_id", "tbl_no", "row_no", lawyer().alias("found")).filter("found IS NOT NULL").select("doc_id", "tbl_no", "row_no", "found.*")


def listed_clients(rows: DataFrame) -> DataFrame:
    """doc_id, tbl_no, row_no, section, is_head, name, answer, kind: the rows of client tables, and
    their head rows."""
    found = _in_sections(rows).select("doc_id", "tbl_no", "row_no", F.col("clients_section").alias("section"), listed_client().alias("found"))
    return found.filter("found IS NOT NULL").select("doc_id", "tbl_no", "row_no", "section", "found.*")


def count_lawyers(rows: DataFrame) -> DataFrame:
    """doc_id, lead_partners (Y), associates (N), unreadable."""
    named = lawyers(rows)
    body = ~F.col("is_head")
    return named.groupBy("doc_id").agg(F.count_if(body & (F.col("kind") == "partner")).cast("int").alias("lead_partners"), F.count_if(body & (F.col("kind") == "other")).cast("int").alias("associates"), F.count_if(body & F.col("kind").isNull()).cast("int").alias("unreadable"))


def count_clients(rows: DataFrame) -> DataFrame:
    """doc_id, active, new_clients: null if any answer is neither yes nor no."""
    body = ~F.col("is_head")
    counted = listed_clients(rows).groupBy("doc_id").agg(F.count_if(body).cast("int").alias("active"), F.count_if(body & (F.col("kind") == "new")).cast("int").alias("new"), F.count_if(body & (F.col("kind") == "unrecognised")).alias("odd"))
    return counted.select("doc_id", "active", F.when(F.col("odd") == 0, F.col("new")).alias("new_clients"))
