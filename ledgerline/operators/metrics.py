"""The recount: six figures per document from rows of tables, unknown rather than zero, each
with what was counted (evidence), what is worth knowing (notes) and flags.

Everything that bears on a figure is a fact of its document: a row of (source, place, texts).
Facts of all kinds are grouped once by document, in order, and the figures are expressions
over that one array. What kind of document it is decides which figures those are: one that
cannot be read and one that is no submission have none, the alternate form has its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ledgerline.functions import labels, text
from ledgerline.operators import alternate
from ledgerline.operators.present import few, sorted_notes

#: Headings of the nomination sections, and of the people who worked on a matter.
HEADINGS = {"lead_partners": "leading partners", "next_gen": "next gen", "associates": "leading associates"}
TEAM = ("lead partner", "lead partners", "lead partner(s)", "other key team members", "other team members")
#: Rows of a matter box.
CLIENT_ROW, CLIENT_ROW_LOOSE, SECTOR_ROW = ("name of client",), ("name of client", "name of the client"), ("industry sector",)
SUMMARY_ROW = ("matter summary", "matter description")


def section_heading(text: Column, name: str) -> Column:
    """Your team ...: name."""
    return F.coalesce(text.rlike(f"{labels.FLAGS}{labels.wording(['your team'])}.*:\\s*{labels.wording([name])}"), F.lit(False))


def labelled(rows: DataFrame, own: WindowSpec | None = None) -> DataFrame:
    """rows (doc_id, tbl_no, row_no, cells) with label, what it says, and what its table holds.
    own: a window over all rows of a table, in any order."""
    first = text.clean(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    own = own or Window.partitionBy("doc_id", "tbl_no")
    out = rows.withColumn("label", first).withColumns({"category": labels.nomination(F.col("label")), "matter": labels.is_matter(F.col("label")), "client": labels.is_client_table(F.col("label"))})
    out = out.withColumn("filled", F.exists("cells", lambda c: F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))))
    any_label = F.col("matter") | F.col("client") | F.col("category").isNotNull()
    held = {"any_matter": F.col("matter"), "any_label": any_label, "team": F.lower("label").isin(*TEAM), "any_filled": F.col("filled"), "in_clients": (F.col("row_no") == 0) & F.col("client")}
    return out.withColumns({k: F.max(c).over(own) for k, c in held.items()} | alternate.sections(own))


def boxed(rows: DataFrame) -> DataFrame:
    """Labelled rows in the order of their document, with the box that each is in: from a row
    that starts one up to the next such row of the table, or the whole next table where the
    label ends its table and the next one is unlabelled.

    starts: a matter's label, or a nomination's outside matter boxes, where roles are the
    matter's team; seg: its place among those of its table; first: the table's first row;
    real, name, split: of the box, whether it is filled in (a client beside or below "Name of
    client" decides, else any text), who is nominated, and whether its body is the next
    table; followed: the row is in a table that is the body of a filled matter box; laid_out:
    the table has rows of a matter and no label. Windows agree in their order and the first
    is of the document, so rows travel at most once, and not at all if they lie by document
    already."""
    document = Window.partitionBy("doc_id").orderBy("tbl_no", "row_no")
    table = Window.partitionBy("doc_id", "tbl_no").orderBy("row_no")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.withColumn("before", F.lag("tbl_no").over(document))
    mine = labelled(placed, whole(table)).withColumn("starts", F.col("matter") | (F.col("category").isNotNull() & ~F.col("any_matter") & ~F.col("team")))
    asks = F.when(~F.col("any_label") & F.col("row_no").between(1, 3), labels.begins(F.col("label"), CLIENT_ROW_LOOSE))
    tells = F.when(~F.col("any_label") & F.col("row_no").between(1, 8), labels.begins(F.col("label"), SUMMARY_ROW))
    laid_out = F.coalesce(F.max(asks).over(whole(table)) & F.max(tells).over(whole(table)), F.lit(False))
    mine = mine.withColumns({"seg": F.count_if("starts").over(upto(table)).cast("int"), "laid_out": laid_out, **alternate.heads(whole(table))})
    mine = mine.withColumn("last", F.lag(F.struct("starts", "matter")).over(document)).withColumn("first", F.coalesce(F.col("before") != F.col("tbl_no"), F.lit(True)))
    adopted = F.col("last.starts") & (F.col("before") == F.col("tbl_no") - 1) & ~F.col("any_label") & F.col("any_filled") & (F.col("last.matter") | ~F.col("team"))
    mine = mine.withColumn("opens", F.col("starts") | (F.col("first") & ~F.coalesce(adopted, F.lit(False))))
    mine = mine.withColumns({"box": F.count_if("opens").over(upto(document)), "ahead": F.lead(F.struct("opens", "filled", "label")).over(document)})

    box = whole(Window.partitionBy("doc_id", "box").orderBy("tbl_no", "row_no"))
    body, more = ~F.col("starts"), ~F.col("ahead.opens")
    beside = F.exists(F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(0))), lambda c: (text.clean(c) != "") & ~labels.begins(text.clean(c), SECTOR_ROW))
    client = F.coalesce(beside, F.lit(False)) | F.coalesce(more & F.col("ahead.filled"), F.lit(False))
    first_client = F.min(F.when(body & labels.begins(F.col("label"), CLIENT_ROW), F.struct("tbl_no", "row_no", client.alias("client")))).over(box)["client"]
    below = F.min(F.when(body & (F.lower("label") == "name"), F.struct("tbl_no", "row_no", F.coalesce(F.when(more, F.col("ahead.label")), F.lit("")).alias("name")))).over(box)["name"]
    # the label is the first row, so the second row of the body is the third
    usual = F.nth_value("label", 3).over(box)
    told = {
        "real": F.coalesce(first_client, F.max(F.when(body, F.col("filled"))).over(box), F.lit(False)), "name": F.coalesce(below, usual, F.lit("")),
        "adopts": F.max("tbl_no").over(box) > F.col("tbl_no"), "of_matter": F.max(F.col("starts") & F.col("matter")).over(box),
    }
    out = mine.withColumns(told).withColumn("followed", F.col("of_matter") & F.col("real") & ~F.col("any_label"))
    return out.withColumn("split", F.col("adopts") & F.when(F.col("matter"), F.col("real")).otherwise(F.col("name") != ""))


def client_answers(rows: DataFrame) -> DataFrame:
    """doc_id, tbl_no, row_no, name, answer of every client row."""
    tables = rows.filter((F.col("row_no") == 0) & F.col("client")).select("doc_id", "tbl_no")
    body = rows.filter("row_no > 0").join(tables, ["doc_id", "tbl_no"], "left_semi")
    named = body.withColumns({"row_class": labels.client_row(F.col("label")), "answer": labels.answer(F.coalesce(F.get("cells", F.lit(1)), F.lit("")))})
    return named.filter("row_class = 'client'").select("doc_id", "tbl_no", "row_no", F.col("label").alias("name"), "answer")


def trace(rows: DataFrame) -> DataFrame:
    """doc_id, tbl_no, row_no, label, what, row_class, answer: every filled row in order, with
    what its label was taken for (matter, clients, a nomination's category, or null), and for
    rows of client tables whether they count and how their answer was read."""
    mine = labelled(rows).filter("filled")
    what = F.when(F.col("matter"), "matter").when(F.col("client"), "clients").otherwise(F.col("category"))
    inside = F.coalesce("in_clients", F.lit(False)) & (F.col("row_no") > 0)
    row_class = F.when(inside, labels.client_row(F.col("label")))
    answer = F.when(row_class == "client", labels.answer(F.coalesce(F.get("cells", F.lit(1)), F.lit(""))))
    return mine.select("doc_id", "tbl_no", "row_no", "label", what.alias("what"), row_class.alias("row_class"), answer.alias("answer"))


def looks_like_submission(rows: DataFrame) -> DataFrame:
    """doc_id of documents of which a table's first row carries one of the form's labels."""
    strict = labels.begins(F.col("label"), labels.STRICT_NAMES, labels.END)
    return labelled(rows).filter((F.col("row_no") == 0) & (F.col("client") | F.col("matter") | strict)).select("doc_id").distinct()


METRICS = ("matters", "active_clients", "new_clients", "lead_partners", "next_gen", "associates")
#: A fact: where it comes from, its place, two texts, a kind, a number and a mark.
FACT = "source string, tbl_no int, row_no int, a string, b string, kind string, n int, mark boolean"


def _fact(source: str, **columns: Column | str) -> Column:
    types = dict(f.split() for f in FACT.split(", "))
    given = {"source": F.lit(source)} | {k: F.col(c) if isinstance(c, str) else c for k, c in columns.items()}
    return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))


def facts(rows: DataFrame) -> DataFrame:
    """doc_id, fact: all that rows say of the figures of a document. Each row says its own facts,
    a box's label those of the box, so no fact is joined to another."""
    mine = boxed(rows)
    label, first = F.col("label"), F.col("row_no") == 0
    strict = labels.begins(label, labels.STRICT_NAMES, labels.END)
    row_class = F.when(F.col("in_clients") & ~first, labels.client_row(label))
    mine = mine.withColumns({"row_class": row_class, "said": F.when(row_class.isNotNull(), text.unwrap(text.clean(F.get("cells", F.lit(1)))))})
    mine = mine.withColumn("answered", F.when(F.col("row_class") == "client", labels.answer(F.col("said"))).otherwise(F.col("row_class")))
    mine = mine.withColumns({"colour": F.when(F.col("first") & F.col("laid_out") & ~F.col("followed"), text.colour_kind(F.col("fill"))), "lawyer": alternate.lawyer(), "listed": alternate.listed_client()})
    more = F.col("answered").isin("new", "not") & ~labels.answer_is_bare(F.col("said"))
    matter, nominee = F.col("starts") & F.col("matter"), F.col("starts") & ~F.col("matter")
    said = F.array(
        F.when(first & F.col("client"), _fact("client_table", tbl_no="tbl_no", a="label")),
        F.when(first & (F.col("client") | F.col("matter") | strict), _fact("submission")),
        F.when(first & (F.col("lawyers_section").isNotNull() | F.col("clients_section").isNotNull()), _fact("alternate")),
        F.when(F.col("category").isNotNull() & (F.col("any_matter") | F.col("team")), _fact("team", tbl_no="tbl_no", row_no="row_no", a="label")),
        F.when(matter, _fact("matter", tbl_no="tbl_no", row_no="seg", a="label", kind=labels.matter_kind(label), n=labels.matter_number(label), mark="split", b=F.when(F.col("real"), "real"))),
        F.when(F.col("colour").isNotNull(), _fact("coloured", tbl_no="tbl_no", a="label", kind="colour", n=F.nullif(F.regexp_extract(label, r"(\d+)\s*$", 1), F.lit("")).try_cast("int"))),
        F.when(F.col("row_class").isNotNull(), _fact("client", tbl_no="tbl_no", row_no="row_no", a="label", b="said", kind="answered", mark=more, n=F.when(labels.answer_is_substituted(F.col("said")), 1))),
        F.when(nominee, _fact("nominee", tbl_no="tbl_no", row_no="seg", a="label", b="name", kind="category", mark="split")),
        F.when(F.col("lawyer").isNotNull(), _fact("lawyer", tbl_no="tbl_no", row_no="row_no", a="lawyer.name", b="lawyer.answer", kind="lawyer.kind", mark="lawyer.is_head")),
        F.when(F.col("listed").isNotNull(), _fact("listed_client", tbl_no="tbl_no", row_no="row_no", a=F.when(F.col("listed.is_head"), F.col("clients_section")).otherwise(F.col("listed.name")), b="listed.answer", kind="listed.kind", mark="listed.is_head")),
    )
    # an array that is a column is compiled, and its type is told once, not once a row
    return mine.select("doc_id", said.alias("said")).select("doc_id", F.explode(F.array_compact("said")).alias("fact"))


def paragraph_facts(blocks: DataFrame) -> DataFrame:
    """doc_id, fact: what paragraphs say: headings of nominations, the alternate form's address."""
    of = F.coalesce(*(F.when(section_heading(F.col("text"), p), k) for k, p in HEADINGS.items()))
    paragraphs = blocks.filter("kind = 'p'").select("doc_id", of.alias("of"), alternate.is_sited(F.col("text")).alias("sited"))
    said = F.array(F.when(F.col("of").isNotNull(), _fact("heading", kind="of")), F.when(F.col("sited"), _fact("alternate")))
    return paragraphs.filter("of IS NOT NULL OR sited").select("doc_id", F.explode(F.array_compact(said)).alias("fact"))


def _notes(*cases: tuple[Column, Column]) -> Column:
    """The notes whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(condition, note) for condition, note in cases)))


def _say(*parts: Column | str | int) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def _quoted(texts: Column) -> Column:
    return F.transform(texts, lambda t: _say("'", t, "'"))


def _listed(texts: Column, most: int | None = None) -> Column:
    """Quoted texts joined by commas; beyond most of them, how many more there are."""
    return few(_quoted(texts), most) if most else F.array_join(_quoted(texts), ", ")


def _texts(found: Column, field: str = "a") -> Column:
    return F.transform(found, lambda f: f[field])


def _numbers(found: Column) -> Column:
    """The numbers of facts that have one, sorted, with what a check of 1..N needs."""
    n = F.array_sort(F.filter(F.transform(found, lambda f: f["n"]), lambda x: x.isNotNull()))
    return text.let(n, lambda a: F.struct(a.alias("all"), F.array_distinct(a).alias("each"), F.coalesce(F.array_max(a), F.lit(0)).alias("top")))


def _straight(x: Column) -> Column:
    """Exactly 1 to N, each once: as many different numbers as numbers, and the largest as large."""
    return (F.size(x["each"]) == F.size(x["all"])) & (x["top"] == F.size(x["all"])) & (F.coalesce(F.array_min(x["all"]), F.lit(1)) == 1)


def _gap_note(name: str, across: str, x: Column) -> Column:
    """What is absent below the largest number, as ranges, and what is there twice."""
    before = F.concat(F.array(F.lit(0)), x["each"])
    holes = F.filter(F.zip_with(before, x["each"], lambda a, b: F.struct((a + 1).alias("a"), (b - 1).alias("b"))), lambda h: (h["b"] >= h["a"]) & h["a"].isNotNull())
    ranges = F.array_join(F.transform(holes, lambda h: F.when(h["a"] == h["b"], h["a"].cast("string")).when(h["a"] + 1 == h["b"], _say(h["a"], ", ", h["b"])).otherwise(_say(h["a"], " to ", h["b"]))), ", ")
    twice = F.filter(x["each"], lambda n: F.size(F.filter(x["all"], lambda m: m == n)) > 1)
    detail = F.array_join(_notes((F.size(holes) > 0, _say("no ", ranges)), (F.size(twice) > 0, _say("repeated ", text.ranges_text(twice)))), "; ")
    return _say(f"{name} are numbered up to ", x["top"], f"{across}, and ", F.size(x["all"]), " were counted (", detail, "): one may have been deleted or mistyped, or missed by the count")


def _metric(name: str, value: Column, evidence: Column, notes: Column, check: Column, gap: Column | None = None) -> Column:
    """A figure of the result."""
    return F.struct(F.lit(name).alias("metric"), value.cast("int").alias("value"), evidence.alias("evidence"), notes.alias("notes"), F.coalesce(gap if gap is not None else F.lit(False), F.lit(False)).alias("numbering_gap"), F.coalesce(check, F.lit(False)).alias("needs_check"))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _matter_figure(of, always_check: Column) -> Column:
    boxes, coloured = of("matter"), of("coloured")

    def kinds(real: Column) -> Column:
        of_kind = lambda x, kind: _numbers(F.filter(x, lambda f: f["kind"] == kind))
        told = lambda x: F.struct(real.alias("real"), x.alias("counted"), of_kind(x, "Publishable").alias("open"), of_kind(x, "Non-publishable").alias("closed"), _numbers(x).alias("both"))
        return text.let(F.concat(real, coloured), told)

    def gaps(x: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("real", "counted", "open", "closed", "both")), (~(_straight(x["open"]) & _straight(x["closed"])) & ~_straight(x["both"])).alias("gap"))

    def figure(x: Column) -> Column:
        real, counted, gap = x["real"], x["counted"], x["gap"]
        n, empty = F.size(counted), F.size(boxes) - F.size(real)
        split, merged = F.size(F.filter(real, lambda f: f["mark"])), F.size(F.filter(boxes, lambda f: f["row_no"] > 1))
        by_kind = lambda test: [test(x[c]) for c in ("open", "closed")]
        absent = lambda y: y["top"] - F.size(y["each"])
        a, b = by_kind(_straight)
        each = sum(by_kind(absent)[1:], by_kind(absent)[0]) <= absent(x["both"])
        lost = (n == 0) & (empty == 0)
        notes = _notes(
            (F.size(coloured) > 0, _say(F.size(coloured), " matter(s) were told by the colour of an unusual label: ", _listed(_texts(coloured)))),
            (lost, F.lit("no matter was found: the section of work highlights could not be located")),
            (empty > 0, _say(empty, " empty matter box(es) were left out")),
            (split > 0, _say(split, " matter(s) have their label in a table of its own and the details in the next one")),
            (~lost & (merged > 0), _say(merged, " matter(s) share a table with the one above and were counted separately")),
            (gap & each & ~a, _gap_note("Publishable matters", "", x["open"])),
            (gap & each & ~b, _gap_note("Non-publishable matters", "", x["closed"])),
            (gap & ~each, _gap_note("Matters", " across publishable and non-publishable", x["both"])),
        )
        return _metric("matters", F.when(~lost, n), _texts(counted), notes, always_check, gap)

    return text.let(text.let(text.let(F.filter(boxes, lambda f: f["b"].isNotNull()), kinds), gaps), figure)


def _client_figures(of) -> Column:
    """The figures of active and of new clients, as an array, so that both are made once."""
    tables, rows = of("client_table"), of("client")
    real = F.filter(rows, lambda f: f["kind"].isin("new", "not", "blank", "unrecognised"))
    kind = lambda *k: F.filter(rows, lambda f: f["kind"].isin(*k))
    inside = lambda found, t: F.filter(found, lambda f: f["tbl_no"] == t["tbl_no"])

    def odd(t: Column, x: Column) -> Column:
        """Rows of a table that answer nothing where others do, or that stand alone."""
        own, empty = inside(x["real"], t), inside(x["blank"], t)
        return F.when((F.size(empty) < F.size(own)) | (F.size(own) == 1), _texts(empty)).otherwise(_nothing())

    def figures(x: Column) -> Column:
        real, blank, unread = x["real"], x["blank"], x["unread"]
        found = F.size(tables) > 0
        missing = F.lit("no table of active key clients: the section of clients could not be located")
        evidence = F.transform(tables, lambda t: _say(t["a"], ": ", F.size(inside(real, t)), " client rows"))
        headers, away, qualified = kind("header"), kind("not_applicable"), F.filter(real, lambda f: f["mark"])
        substituted = F.filter(F.filter(real, lambda f: f["kind"].isin("new", "not")), lambda f: f["n"] == 1)
        active = _notes(
            (~found, missing),
            (F.size(x["odd"]) > 0, _say(F.size(x["odd"]), " row(s) answer nothing about new clients: ", _listed(F.transform(x["odd"], lambda t: text.shorten(t, 44)), 4), "; counted, check that they are clients")),
            (F.size(away) > 0, _say(F.size(away), " row(s) say N/A for a client and were not counted")),
        )
        fresh = _notes(
            (~found, missing),
            (F.size(headers) > 0, _say("repeated header row(s) were left out: ", _listed(_texts(headers)))),
            (F.size(substituted) > 0, _say(F.size(substituted), " answer(s) say new or existing for yes or no")),
            (F.size(blank) > 0, _say(F.size(blank), " blank answer(s) count as not new")),
            (F.size(qualified) > 0, _say(F.size(qualified), " answer(s) say more than yes or no and were read by their first word: ", _listed(sorted_notes(_texts(qualified, "b"))))),
            (F.size(unread) > 0, _say(F.size(unread), " answer(s) are neither yes nor no: ", _listed(sorted_notes(_texts(unread, "b"))), "; count this column by hand")),
        )
        return F.array(
            _metric("active_clients", F.when(found, F.size(real)), evidence, active, F.size(x["odd"]) > 0),
            _metric("new_clients", F.when(found & (F.size(unread) == 0), F.size(kind("new"))), evidence, fresh, F.lit(False)),
        )

    parts = F.struct(real.alias("real"), kind("blank").alias("blank"), kind("unrecognised").alias("unread"))
    whole = lambda x: F.struct(*(x[c].alias(c) for c in ("real", "blank", "unread")), F.flatten(F.transform(tables, lambda t: odd(t, x))).alias("odd"))
    return text.let(text.let(parts, whole), figures)


def _nomination_figure(of, key: str) -> Column:
    boxes = of("nominee")
    vague = F.filter(boxes, lambda f: (f["kind"] == "unclassified") & (f["b"] != "")) if key != "associates" else None
    mine = F.struct(F.filter(boxes, lambda f: f["kind"] == key).alias("mine"), (F.lit(None) if vague is None else vague).alias("vague"))

    def counts(x: Column) -> Column:
        named = F.filter(x["mine"], lambda f: f["b"] != "")
        return F.struct(named.alias("named"), F.size(x["mine"]).alias("all"), x["vague"].alias("vague"), F.exists(of("heading"), lambda f: f["kind"] == key).alias("headed"))

    def figure(x: Column) -> Column:
        named, vague_, headed = x["named"], x["vague"], x["headed"]
        n, empty, none = F.size(named), x["all"] - F.size(named), x["all"] == 0
        split, merged = F.size(F.filter(named, lambda f: f["mark"])), F.size(F.filter(boxes, lambda f: f["row_no"] > 1))
        unsure = [] if vague is None else [(F.size(vague_) > 0, _say(F.size(vague_), " partner nomination(s) say neither leading nor next generation: ", _listed(sorted_notes(_texts(vague_))), "; counted as neither, decide by hand"))]
        notes = _notes(
            *unsure,
            (none & headed, F.lit("the heading of this category is there, but no nomination below it was recognised")),
            (none & ~headed, F.lit("no nominations of this kind")),
            (~none & (F.size(of("team")) > 0), _say(F.size(of("team")), " role(s) inside matters are no nominations: ", _listed(sorted_notes(_texts(of("team"))), 3))),
            (empty > 0, _say(empty, " empty nomination box(es) were left out")),
            (split > 0, _say(split, " nomination(s) have their label in a table of its own and the details in the next one")),
            (~none & (merged > 0), _say(merged, " nomination(s) share a table with the one above and were counted separately")),
        )
        return _metric(key, F.when(~(none & headed), n), F.transform(named, lambda f: _say(f["a"], " - ", f["b"])), notes, F.lit(False) if vague is None else F.size(vague_) > 0)

    return text.let(text.let(mine, counts), figure)


def _alternate_figures(of) -> dict[str, Column]:
    lawyers, clients = of("lawyer"), of("listed_client")
    people = F.filter(lawyers, lambda f: ~f["mark"])
    unread = F.filter(people, lambda f: f["kind"].isNull())
    told = F.transform(unread, lambda f: text.shorten(F.when(f["b"] == "", f["a"]).otherwise(_say(f["a"], ": '", f["b"], "'")), 34))
    no_column = F.lit("no column that asks whether a lawyer is a partner was found")
    found = F.size(lawyers) > 0
    about = _notes((~found, no_column), (F.size(unread) > 0, _say(F.size(unread), " lawyer(s) are said to be neither partner nor not: ", few(told, 4), "; not counted")))

    def of_kind(metric: str, kind: str, word: str) -> Column:
        own = F.filter(people, lambda f: f["kind"] == kind)
        return _metric(metric, F.when(found, F.size(own)), F.transform(own, lambda f: _say(f["a"], f" - {word}")), about, found)

    heads, rows = F.filter(clients, lambda f: f["mark"]), F.filter(clients, lambda f: ~f["mark"])
    listed = F.size(heads) > 0
    odd = F.filter(rows, lambda f: f["kind"] == "unrecognised")
    evidence = F.transform(heads, lambda h: _say(text.shorten(h["a"], 48), ": ", F.size(F.filter(rows, lambda f: f["tbl_no"] == h["tbl_no"])), " client rows"))
    none = F.lit("no numbered list of clients was found")
    fresh = _notes((~listed, none), (F.size(odd) > 0, _say(F.size(odd), " answer(s) are neither yes nor no: ", _listed(sorted_notes(_texts(odd, "b")), 4), "; count this column by hand")))
    return {
        "active_clients": _metric("active_clients", F.when(listed, F.size(rows)), evidence, _notes((~listed, none)), listed),
        "new_clients": _metric("new_clients", F.when(listed & (F.size(odd) == 0), F.size(F.filter(rows, lambda f: f["kind"] == "new"))), evidence, fresh, listed),
        "lead_partners": of_kind("lead_partners", "partner", "partner"),
        "next_gen": _metric("next_gen", F.lit(None), _nothing(), F.array(F.lit("the alternate form has no section for the next generation")), F.lit(False)),
        "associates": of_kind("associates", "other", "not a partner"),
    }


#: Where facts come from.
SOURCES = ("matter", "coloured", "client_table", "client", "nominee", "team", "heading", "submission", "alternate", "lawyer", "listed_client")


def routed(documents: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, route, error, facts (a struct of arrays by source, each in order): what kind of
    document each is. unreadable: it could not be opened; alternate: it carries the alternate
    form's codes or address; no submission: none of the form's tables is there; else
    ordinary. The first that applies."""
    gathered = lambda found, name: found.groupBy("doc_id").agg(F.collect_list("fact").alias(name))
    whole = documents.select("doc_id", "error").join(gathered(facts(rows), "by_rows"), "doc_id", "left").join(gathered(paragraph_facts(blocks), "by_text"), "doc_id", "left")
    none = F.array().cast(f"array<struct<{FACT.replace(' ', ':').replace(',:', ',')}>>")
    every = F.array_sort(F.concat(F.coalesce("by_rows", none), F.coalesce("by_text", none)))
    whole = whole.select("doc_id", "error", every.alias("every"))
    of = lambda source: F.filter("every", lambda f: f["source"] == source)
    has = lambda source: F.exists("every", lambda f: f["source"] == source)
    route = F.when(F.col("error").isNotNull(), "unreadable").when(has("alternate"), "alternate").when(~has("submission"), "no submission").otherwise("ordinary")
    lost = F.lit("this does not look like a submission: none of its tables (clients, matters, nominations) was found")
    kept = F.struct(*(of(s).alias(s) for s in SOURCES))
    return whole.select("doc_id", route.alias("route"), F.when(route == "no submission", lost).otherwise(F.col("error")).alias("error"), kept.alias("facts"))


def figures(documents: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, route, error, metric, value (null: could not be counted), evidence, notes,
    numbering_gap, needs_check; six rows a document, whatever its kind."""
    kinds = routed(documents, rows, blocks)
    alike = F.col("route") == "alternate"

    def counted(facts: Column) -> Column:
        of = lambda source: facts[source]
        matters_ = F.array(_matter_figure(of, alike))
        other = _alternate_figures(of)
        plain = F.concat(_client_figures(of), F.array(*(_nomination_figure(of, k) for k in HEADINGS)))
        return F.concat(matters_, F.when(alike, F.array(*(other[k] for k in METRICS[1:]))).otherwise(plain))

    none = F.array(*(_metric(k, F.lit(None), _nothing(), F.array("error"), F.lit(False)) for k in METRICS))
    return kinds.select("doc_id", "route", "error", F.inline(F.when(F.col("error").isNotNull(), none).otherwise(text.let(F.col("facts"), counted))))


def recount(documents: DataFrame, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, metric, value (null: could not be counted), needs_check (a flag of either kind);
    six rows a document."""
    return figures(documents, rows, blocks).select("doc_id", "metric", "value", (F.col("needs_check") | F.col("numbering_gap")).alias("needs_check"))
