"""Is every document that a firm's listing names in the firm's folder? All firms in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.text import table_code
from ledgerline.operators.tables import settled

#: Characters of the pieces by which names are looked up in texts.
PIECES = (1, 2, 4, 8, 16, 32)
#: Names of one size of pieces that are sent to every task.
FEW = 20000
#: Levels below the root in which folders are looked for.
DEPTH = 3
#: Fixed value: the folder of exports beside or inside a firm's folder.
SPREADSHEETS = "spreadsheets"


def _pieces(value: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    every = F.transform(F.sequence(F.lit(1), F.length(value) - size + 1), lambda i: F.substring(value, i, size))
    return F.when((size > 0) & (F.length(value) >= size), every).otherwise(F.array().cast("array<string>"))


def names_to_search(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, name: each pair once that names_within has to search, a few more than it finds.

    A name is filed under the one of its pieces, of the longest of the sizes PIECES that it has
    room for, that fewest texts have; a text's pieces of the sizes in use fetch names. Pieces
    are more than half as long as names below 64 characters, so numbered names do not meet
    all texts that share a few digits. A name with a piece that no text has is dropped at
    once. Pieces are counted where they are read; those of a size that files at most FEW names
    meet them there, so that a few short names do not make all texts travel by short pieces."""
    size = F.array_max(F.filter(F.array(*map(F.lit, PIECES)), lambda k: k <= F.length("name")))
    wanted = names.select("name").filter("name <> ''").distinct().withColumn("size", size)
    filed = wanted.select("name", F.explode(F.array_distinct(_pieces(F.col("name"), F.col("size")))).alias("piece"))
    whole = settled(texts.select("text").filter("text <> ''").distinct())
    cut = lambda sizes: whole.select("text", F.explode(F.array_distinct(F.flatten(F.array(*(_pieces(F.col("text"), k) for k in sizes))))).alias("piece"))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # as many as PIECES at most
    nothing = whole.select("text", F.lit(None).cast("string").alias("name")).limit(0)
    if not sizes:
        return nothing
    often = cut(sizes).groupBy("piece").agg(F.count("*").alias("n"))
    counted = filed.join(often, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = settled(counted.groupBy("name").agg(F.min(F.struct("n", "piece")).alias("r")).filter("r.n > 0").select("name", "r.piece", F.length("r.piece").alias("size")))
    filing = {r["size"]: r["n"] for r in rarest.groupBy("size").agg(F.count("*").alias("n")).collect()}
    few = [k for k, n in filing.items() if n <= FEW]
    many = [k for k in filing if k not in few]
    fetch = lambda some, near: cut(some).join(near(rarest.filter(F.col("size").isin(*some)).drop("size")), "piece").select("text", "name")
    found = [fetch(some, near) for some, near in ((few, F.broadcast), (many, lambda df: df)) if some]
    return reduce(DataFrame.unionByName, found) if found else nothing


def names_within(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, name: each distinct text with each distinct name that it holds, as they are spelled.
    Empty and null names are in no text. For short texts such as paths and cells: a text
    travels once for each of its pieces that some name has."""
    return names_to_search(texts, names).filter(F.contains("text", F.col("name")))


def _squeezed(value: Column) -> Column:
    return F.lower(F.replace(value, F.lit(" "), F.lit("")))


def documents_in(paths: DataFrame, root: str, depth: int = DEPTH) -> DataFrame:
    """folder (its path below root), name: the Word documents of folders up to depth levels
    down. paths: path. Documents in root itself and lock files of open ones do not count."""
    start = root.rstrip("/") + "/"
    below = paths.filter(F.contains("path", F.lit(start))).select(F.substring_index("path", start, -1).alias("below"))
    parts = below.select(F.regexp_replace("below", "/?[^/]*$", "").alias("folder"), F.element_at(F.split("below", "/"), -1).alias("name"))
    levels = F.size(F.split("folder", "/"))
    return parts.filter((F.col("folder") != "") & (levels <= depth) & F.endswith(F.lower("name"), F.lit(".docx")) & ~F.startswith("name", F.lit("~$")))


def pick_folders(documents: DataFrame, firms: DataFrame) -> DataFrame:
    """firm, folder: the folder of each firm (column firm), blanks and case aside: the first whose
    own name holds the firm's, or else the first whose path does. Folders come by level,
    then by the names along the path. A firm without a folder is left out."""
    folders = documents.select("folder").distinct().withColumn("text", _squeezed(F.col("folder")))
    wanted = firms.select("firm", _squeezed(F.col("firm")).alias("name")).distinct()
    found = names_within(folders, wanted).join(folders, "text").join(wanted, "name")
    path = F.split("folder", "/")
    own = F.contains(_squeezed(F.element_at(path, -1)), F.col("name"))
    return found.groupBy("firm").agg(F.min_by("folder", F.struct(~own, F.size(path), path)).alias("folder"))


def firm_names(listing: DataFrame, firms: DataFrame) -> DataFrame:
    """asked (the firm asked for), text: the firms of listing, in lower case, that hold it."""
    wanted = firms.select(F.col("firm").alias("asked"), F.lower("firm").alias("name")).distinct()
    return names_within(listing.select(F.lower("firm").alias("text")), wanted).join(wanted, "name").select("asked", "text")


def pick_exports(rows: DataFrame, folders: DataFrame, general: list[str]) -> DataFrame:
    """asked, folder, export: for each firm with a folder the first export that mentions it: of those
    in the folder's own spreadsheets, in the folder, in spreadsheets beside it, then in the
    general places in their order; by name within a place. rows: asked, export (a path below
    the same root), each pair once or more."""
    place = F.regexp_replace("export", "/?[^/]*$", "")
    beside = F.regexp_replace("folder", "[^/]+$", SPREADSHEETS)
    order = F.when(place == F.concat("folder", F.lit(f"/{SPREADSHEETS}")), 0).when(place == F.col("folder"), 1).when(place == beside, 2)
    for turn, name in enumerate(general, 3):
        order = order.when(place == name, turn)
    near = rows.select("asked", "export").distinct().join(folders.withColumnRenamed("firm", "asked"), "asked").withColumn("turn", order).filter("turn IS NOT NULL")
    return near.groupBy("asked", "folder").agg(F.min_by("export", F.struct("turn", "export")).alias("export"))


def _newest(rows: DataFrame, whose: list[str]) -> DataFrame:
    """rows with older: of due rows, the first of each name, and whether a newer one of its slot
    replaces it. whose: the columns within which names and slots are compared."""
    said = ["region", "area", "created_at"]
    named = Window.partitionBy(*whose, "filename").orderBy("row_no", "slot", *said)
    first = rows.withColumn("before", F.lag(F.lit(True)).over(named)).filter("before IS NULL")
    slot = Window.partitionBy(*whose, "slot")
    topped = first.withColumn("top", F.max("created_at").over(slot)).withColumn("n", F.count_if(F.col("created_at") == F.col("top")).over(slot))
    return topped.withColumn("older", F.coalesce((F.col("created_at") < F.col("top")) & (F.col("n") == 1), F.lit(False)))


def _entangled(due: DataFrame, texts: DataFrame) -> DataFrame | None:
    """text: firms of the listing that share a file name within an export, or a slot (spelled alike
    but for blanks around), with another one, and perhaps a few more; None if there are none.
    What replaces what among their rows depends on which of the firms are asked for."""
    name = F.xxhash64("export", "filename")
    shared = settled(due.groupBy(name.alias("h")).agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("h"))
    blanks = texts.filter("text <> trim(text)").select(F.trim("text").alias("bare"))
    found = texts.join(blanks, F.trim("text") == F.col("bare"), "left_semi").select("text")
    if not shared.isEmpty():
        found = found.unionByName(due.join(shared, name == F.col("h"), "left_semi").select("text"))
    found = settled(found.distinct())
    return None if found.isEmpty() else found


def check_folders(listing: DataFrame, documents: DataFrame, firms: DataFrame, general: list[str]) -> DataFrame:
    """firm, folder, export, name, side, region, area, created_at: what each firm's folder holds against
    what its export lists.

    listing: export, row_no, firm, region, grp, area, filename, has_document, created_at;
    documents: folder, name. side: "present" and "missing" documents that are listed; "older
    version" where a newer row of the firm, region and area replaces one (unless several are
    newest), which nobody need fetch; "no document" for rows without one; "elite" and "extra"
    for documents that no row waits for, elite if firm reference and table code in the name
    are those of an elite row. Elite rows are not expected. Names are compared without case;
    of rows with one name the first counts. A firm without a folder, or that no export near
    it mentions, has no rows here: folder_counts names it.

    A name that many firms hold is asked for with the rows of each, so rows are judged before
    they meet those who ask: which are first of their name and which are older is told once
    a firm of the listing and export. Only firms that share names or slots are judged once
    for each that asks. Of what is asked only documents to fetch travel again, to meet those
    held. Which firms hold which, the folders chosen and who asks for what are written once,
    as several steps use them."""
    keyed = listing.withColumn("text", F.lower("firm")).withColumn("elite", F.coalesce(F.col("grp").rlike(r"(?i)\belite\b"), F.lit(False)))
    pairs = settled(firm_names(listing, firms))
    mentioned = pairs.join(keyed.select("text", "export").distinct(), "text").select("asked", "export")
    chosen = settled(pick_exports(mentioned, pick_folders(documents, firms), general))
    # rows meet a firm only in the export that was chosen for it
    asking = settled(pairs.join(chosen, "asked").select("text", "export", "asked", "folder"))
    whose, head, said = ["text", "export"], ["asked", "folder", "export"], ["region", "area", "created_at"]

    slot = F.transform(F.array("firm", "region", "area"), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    due = keyed.filter("NOT elite AND has_document AND text IS NOT NULL").select(*whose, "row_no", "filename", slot.alias("slot"), *said)
    entangled = _entangled(due, pairs.select("text"))
    apart = due if entangled is None else due.join(entangled, "text", "left_anti")
    # what is told of a firm and export, and who asks for it, lies by both: one shuffle
    marked = _newest(apart.repartition(*whose), whose).join(asking, whose).select(*head, "filename", *said, "older")
    if entangled is not None:
        marked = marked.unionByName(_newest(due.join(entangled, "text", "left_semi").join(asking, whose), ["asked"]).select(*head, "filename", *said, "older"))

    code = lambda c: F.struct(*(x.alias(k) for k, x in zip(("ref", "code"), table_code(c), strict=True)))
    elite = keyed.filter("elite").select(*whose, code(F.col("filename")).alias("code")).filter("code.ref IS NOT NULL").join(asking, whose).select(F.col("asked").alias("holder"), "code").distinct()
    kept = documents.repartition("folder").groupBy("folder", F.lower("name").alias("key")).agg(F.min("name").alias("held"))
    held = chosen.join(kept, "folder").select(F.col("asked").alias("holder"), F.col("folder").alias("place"), F.col("export").alias("near"), "held", code(F.col("held")).alias("code"))
    held = held.join(elite.withColumn("known", F.lit(True)), ["holder", "code"], "left").drop("code")
    both = marked.filter("NOT older").drop("older").join(held, (F.col("asked") == F.col("holder")) & (F.lower("filename") == F.lower("held")), "full")
    side = F.when(F.col("held").isNull(), "missing").when(F.col("filename").isNotNull(), "present").when(F.col("known"), "elite").otherwise("extra")
    met = both.select(*(F.coalesce(a, b).alias(c) for a, b, c in (("asked", "holder", "firm"), ("folder", "place", "folder"), ("export", "near", "export"), ("held", "filename", "name"))), side.alias("side"), *said)

    columns = lambda df, what, n: df.select(F.col("asked").alias("firm"), "folder", "export", n.alias("name"), F.lit(what).alias("side"), *said)
    without = keyed.filter("NOT elite AND NOT has_document").join(asking, whose)
    return met.unionByName(columns(marked.filter("older"), "older version", F.col("filename"))).unionByName(columns(without, "no document", F.lit(None).cast("string")))


#: The sides of check_folders and the columns that count them.
SIDES = {"present": "present", "missing": "missing", "older version": "older", "no document": "without_document", "elite": "elite_files", "extra": "extra"}


def folder_counts(firms: DataFrame, checked: DataFrame) -> DataFrame:
    """firm, folder, export, a count a side, complete: one row a firm asked for. complete is null for
    a firm whose folder and export were not both found: unknown, not complete."""
    counts = checked.groupBy("firm", "folder", "export").agg(*(F.count_if(F.col("side") == s).alias(c) for s, c in SIDES.items()))
    return firms.select("firm").distinct().join(counts, "firm", "left").withColumn("complete", F.col("missing") == 0)
