"""What a document says about itself: firm, region, group and area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.labels import END, begins, mentions
from ledgerline.functions.text import clean, let, split_dropdown

#: The prompt of the typed box, and what begins another part of the form.
TYPED_PROMPT, TYPED_LONGEST = "type in this box", 200
OTHER_PARTS = ("choose one from", "contact details", "what is the team", "head(s) of team", "either select", "practice area", "country", "firm name")


def firm_names(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, firm: the first filled first cell of a table among the three blocks after the
    first paragraph that reads "firm name"."""
    label = F.min(F.when((F.col("kind") == "p") & (F.lower(clean(F.col("text"))) == "firm name"), F.col("block_no")))
    at = blocks.groupBy("doc_id").agg(label.alias("at")).filter("at IS NOT NULL")
    near = blocks.join(at, "doc_id").filter("kind = 'tbl' AND block_no > at AND block_no <= at + 3").select("doc_id", "block_no", "tbl_no")
    cells = rows.filter("row_no = 0").select("doc_id", "tbl_no", clean(F.get("cells", F.lit(0))).alias("firm"))
    found = near.join(cells, ["doc_id", "tbl_no"]).filter("firm <> ''").groupBy("doc_id").agg(F.min_by("firm", "block_no").alias("firm"))
    return at.select("doc_id").join(found, "doc_id", "left")


def dropdowns(controls: DataFrame) -> DataFrame:
    """doc_id, dropdown, unlabelled: a control named for the practice area, else the first
    that splits into three parts, which is worth a warning."""
    text = clean(F.col("text"))
    named = F.coalesce(F.contains(F.lower("alias"), F.lit("practice")), F.lit(False))
    fits = controls.filter((text != "") & (named | (F.size(split_dropdown(text)) == 3)))
    best = F.min(F.struct((~named).alias("unlabelled"), "sdt_no", text.alias("dropdown")))
    return fits.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.dropdown", "b.unlabelled")


def typed_areas(blocks: DataFrame) -> DataFrame:
    """doc_id, typed: what follows the prompt on its line, or the nearest of the next five
    paragraphs before a table, unless it belongs to another part of the form."""
    prompt = (F.col("kind") == "p") & mentions(F.col("text"), [TYPED_PROMPT])
    own = Window.partitionBy("doc_id")
    at = blocks.withColumn("at", F.min(F.when(prompt, F.col("block_no"))).over(own)).filter("at IS NOT NULL AND block_no BETWEEN at AND at + 5")
    stop = F.min(F.when(F.col("kind") == "tbl", F.col("block_no"))).over(own)
    near = at.withColumn("stop", stop).filter("kind = 'p' AND (stop IS NULL OR block_no < stop)")
    tail = F.when(F.contains("text", F.lit("►")), F.element_at(F.split("text", "►"), -1)).when(F.contains("text", F.lit(":")), F.element_at(F.split("text", ":"), -1)).otherwise("")
    said = near.withColumn("said", clean(F.when(F.col("block_no") == F.col("at"), tail).otherwise(F.col("text"))))
    fits = said.filter((F.col("said") != "") & (F.length("said") <= TYPED_LONGEST) & ~begins(F.col("said"), OTHER_PARTS, END))
    return fits.groupBy("doc_id").agg(F.min_by("said", "block_no").alias("typed"))


def headers(documents: DataFrame, blocks: DataFrame, rows: DataFrame, controls: DataFrame) -> DataFrame:
    """doc_id, firm, region, grp, area, warnings. A dropdown of two parts has no group; a
    typed text of other than three parts is an area alone."""
    wide = documents.select("doc_id")
    for part in (firm_names(blocks, rows), dropdowns(controls), typed_areas(blocks)):
        wide = wide.join(part, "doc_id", "left")
    parts, typed = split_dropdown(F.col("dropdown")), split_dropdown(F.col("typed"))
    cases = F.struct(
        F.col("dropdown").alias("dropdown"), F.col("typed").alias("typed"),
        F.coalesce(F.size(parts), F.lit(-1)).alias("n"), F.coalesce(F.size(typed), F.lit(-1)).alias("m"), parts.alias("p"), typed.alias("q"),
    )

    def split(x):
        a, b, whole = (lambda k: F.get(x["p"], F.lit(k))), (lambda k: F.get(x["q"], F.lit(k))), F.lit(None).cast("string")
        use_typed = x["dropdown"].isNull()
        three, two, q3 = x["n"] == 3, x["n"] == 2, use_typed & (x["m"] == 3)
        return F.struct(
            F.when(three | two, a(0)).when(q3, b(0)).otherwise(whole).alias("region"),
            F.when(three, a(1)).when(q3, b(1)).otherwise(whole).alias("grp"),
            F.when(three, a(2)).when(two, a(1)).when(q3, b(2)).when(use_typed, x["typed"]).otherwise(whole).alias("area"),
            F.array_compact(F.array(
                F.when(x["dropdown"].isNotNull() & ~(three | two), F.concat(F.lit("the dropdown did not split into two or three parts: "), x["dropdown"])),
                F.when(use_typed & x["typed"].isNotNull(), F.concat(F.lit("the dropdown was not used; read from the typed box: "), x["typed"])),
                F.when(use_typed & x["typed"].isNull(), "no practice area was selected or typed"),
            )).alias("warnings"),
        )

    return wide.select("doc_id", "firm", "unlabelled", let(cases, split).alias("h")).select("doc_id", "firm", "h.*", F.coalesce("unlabelled", F.lit(False)).alias("check_area"))
