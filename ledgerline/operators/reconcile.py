"""Reconciliation of an ordered page with a listing and a batch of files.

A page's lines mean rows of the listing; each row is used once, each file is placed once, in
the order of the lines. Lines whose rows share nothing are independent, so a page is split
into such parts, and a part is walked in order by one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.labels import is_elite
from ledgerline.functions.text import created_at, normalise, portal_area
from ledgerline.operators.matching import first_key_join, page_status, with_variants
from ledgerline.operators.page import rollup
from ledgerline.operators.tables import settled

ASSIGNED = "page_id long, line_no int, candidate long, file_no long, repeat_of int"


def line_pools(lines: DataFrame, listing: DataFrame, firms: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each line may mean, without a pair of each line and row: lines (page_id, line_no,
    pool), and pools (page_id, pool, candidate, rank, is_elite, has_document). A pool is a
    spelling; lines of a page with one spelling share it.

    lines: page_id, line_no, value. listing: candidate, firm_keys, region, grp, area, tbl,
    has_document. The first spelling of a line that any row has decides; then rows of the
    page's firms (page_id, firm_key) stay, where the page has any, and of these the ones in
    its regions (page_id, region_key), but only if that leaves something."""
    named = listing.withColumn("whole", portal_area(F.col("grp"), F.col("area"), F.col("tbl")))
    forms = settled(with_variants(named, "whole", "forms").select("candidate", "firm_keys", normalise(F.col("region")).alias("region_key"), is_elite(F.col("grp")).alias("is_elite"), "has_document", F.explode("forms").alias("pool")))
    keyed = with_variants(lines.select("page_id", "line_no", "value"), "value", "keys").withColumn("line_id", F.struct("page_id", "line_no"))
    meant = settled(first_key_join(keyed, forms.select(F.col("pool").alias("form"), F.col("pool")).distinct(), "line_id", F.col("keys"), "form").filter("pool IS NOT NULL").select("page_id", "line_no", "pool"))
    asked = meant.select("page_id", "pool").distinct()
    by_firm = firms.select("page_id", "firm_key").distinct()
    own = asked.join(by_firm, "page_id").join(forms.select("*", F.explode("firm_keys").alias("firm_key")), ["pool", "firm_key"])
    free = asked.join(by_firm, "page_id", "left_anti").join(forms, "pool")
    columns = ["page_id", "pool", "candidate", "region_key", "is_elite", "has_document"]
    rows = own.select(columns).unionByName(free.select(columns)).distinct()
    there = rows.join(regions.select("page_id", "region_key", F.lit(True).alias("there")).distinct(), ["page_id", "region_key"], "left")
    any_there = F.max(F.coalesce("there", F.lit(False))).over(Window.partitionBy("page_id", "pool"))
    kept = there.withColumn("any", any_there).filter(~F.col("any") | F.col("there"))
    return meant, kept.select("page_id", "pool", "candidate", F.col("candidate").alias("rank"), "is_elite", "has_document").distinct()


def line_candidates(lines: DataFrame, listing: DataFrame, firms: DataFrame, regions: DataFrame) -> DataFrame:
    """page_id, line_no, candidate, rank, is_elite, has_document: line_pools as pairs."""
    meant, pools = line_pools(lines, listing, firms, regions)
    return meant.join(pools, ["page_id", "pool"]).drop("pool")


def parts_of(pools: DataFrame) -> DataFrame:
    """page_id, pool, part: pools of a page that share a candidate, a file name or an identity,
    directly or through others, are one part. Parts take on the least pool of what they share,
    round by round, until none changes; a round is two windows over the links."""
    keys = F.array_compact(F.array(F.concat(F.lit("c"), F.col("candidate").cast("string")), F.concat(F.lit("n"), "name"), F.concat(F.lit("i"), "identity")))
    links = settled(pools.select("page_id", "pool", F.explode(keys).alias("key")).distinct().withColumn("part", F.col("pool")))
    while True:
        near = F.min("part").over(Window.partitionBy("page_id", "key"))
        least = F.min("near").over(Window.partitionBy("page_id", "pool"))
        after = links.withColumn("near", near).withColumn("least", least)
        after = settled(after.select("page_id", "pool", "key", F.col("least").alias("part"), (F.col("least") < F.col("part")).alias("changed")))
        links = after.drop("changed")
        if after.filter("changed").isEmpty():
            return links.select("page_id", "pool", "part").distinct()


def assign_lines(lines: DataFrame, pools: DataFrame, files: DataFrame) -> DataFrame:
    """page_id, line_no, candidate, file_no, repeat_of of each line with a pool.

    lines: page_id, line_no, pool. pools: page_id, pool, candidate, rank, is_elite,
    has_document, name (of the file it lists) and identity (null: the candidate itself).
    files: page_id, file_no, name (listed) and by_code.

    A line takes, of the rows of its pool that no line has taken (of all, if all are), the
    first with a file that is not placed yet, else the first with a document, else the first;
    elite rows come last. The files of a name wait in a queue, those that a name matched
    before those that a code did. repeat_of: the first line that took a row of this identity.

    A task walks a part in order. It remembers what the part has taken, and for each pool how
    far it is used up, so it looks at each row of a pool a bounded number of times."""
    queues = files.filter("name IS NOT NULL AND name <> ''").groupBy("page_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("by_code", "file_no"))), lambda f: f["file_no"]).alias("queue"))
    known = settled(pools.join(queues, ["page_id", "name"], "left"))
    parts = parts_of(known.select("page_id", "pool", "candidate", F.when(F.col("queue").isNotNull(), F.col("name")).alias("name"), "identity"))
    identity = F.coalesce(F.concat(F.lit("i"), F.col("identity").cast("string")), F.concat(F.lit("c"), F.col("candidate").cast("string")))
    rows = known.select("page_id", "pool", F.lit(None).cast("int").alias("line_no"), "is_elite", "rank", "candidate", "has_document", identity.alias("identity"), "queue")
    asking = lines.select("page_id", "pool", "line_no", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[3:]))
    both = rows.unionByName(asking).join(parts, ["page_id", "pool"])
    dealt = both.repartition("page_id", "part").sortWithinPartitions("page_id", "part", F.col("line_no").asc_nulls_first(), "pool", "is_elite", "rank", "candidate")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "part", "pool", "line_no", "candidate", "has_document", "identity", "queue"))
            for page, name, pool, line, candidate, has_document, own, queue in zip(*columns, strict=True):
                if (page, name) != part:
                    part, state = (page, name), _Part()
                if line is None:
                    state.add(pool, candidate, has_document, own, queue or ())
                else:
                    out.append((page, line, *state.take(pool, line)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [f.split()[0] for f in ASSIGNED.split(", ")])
            out.clear()

    return dealt.select("page_id", "part", "pool", "line_no", "candidate", "has_document", "identity", "queue").mapInArrow(walk, ASSIGNED)


class _Part:
    """What the lines of a part have taken so far."""

    def __init__(self) -> None:
        self.pools: dict[str, list[tuple]] = {}
        self.used_up: dict[tuple, int] = {}  # up to where no row of a pool can be chosen, by what is asked
        self.taken: set[int] = set()
        self.placed: set[int] = set()
        self.first_line: dict[str, int] = {}

    def add(self, pool: str, *row) -> None:
        self.pools.setdefault(pool, []).append(row)

    def _first(self, pool: str, asked: str, fits) -> tuple | None:
        """The first row that fits. Rows that do not fit never will again, so they are left
        behind: taken and placed only grow."""
        rows, at = self.pools[pool], self.used_up.get((pool, asked), 0)
        while at < len(rows) and not fits(rows[at]):
            at += 1
        self.used_up[pool, asked] = at
        return rows[at] if at < len(rows) else None

    def waiting(self, row: tuple) -> int | None:
        return next((f for f in row[3] if f not in self.placed), None)

    def take(self, pool: str, line: int) -> tuple[int, int | None, int | None]:
        free = lambda r: r[0] not in self.taken
        first = self._first(pool, "free", free)
        if first is not None:
            row = self._first(pool, "file", lambda r: free(r) and self.waiting(r) is not None) or self._first(pool, "document", lambda r: free(r) and r[1]) or first
        else:
            row = self._first(pool, "any file", lambda r: self.waiting(r) is not None) or self._first(pool, "any document", lambda r: r[1]) or self.pools[pool][0]
        file = self.waiting(row)
        repeats = self.first_line.get(row[2])
        self.taken.add(row[0])
        if file is not None:
            self.placed.add(file)
        self.first_line.setdefault(row[2], line)
        return row[0], file, repeats


def page_lines(lines: DataFrame, listing: DataFrame, results: DataFrame, firms: DataFrame, regions: DataFrame) -> DataFrame:
    """A page from its lines to their statuses: page_id, line_no, value, candidate, filename,
    file_no, repeat_of, is_elite, has_document, superseded, reached, status.

    lines: page_id, line_no, value. listing: candidate, firm, firm_keys, region, grp, area,
    tbl, filename, portal_id, created_at (text or time), has_document. results, the files of
    the batch: page_id, file_no, name (of the listed row, or null), by_code, status. firms
    and regions: as line_pools.

    Copies and elite files wait for no line. A line with a file has the file's status; else a
    newer line of its slot makes it an older version. As many expected lines count as
    reached, from the top, as the page has files that are not elite. Lines of a page are
    ordered by one window, so a page is one task there."""
    meant, pools = line_pools(lines, listing, firms, regions)
    about = listing.select("candidate", F.lower("filename").alias("name"), F.nullif(F.col("portal_id").cast("string"), F.lit("")).alias("identity"))
    files = results.filter("status NOT IN ('duplicate', 'elite')").select("page_id", "file_no", F.lower("name").alias("name"), "by_code")
    assigned = settled(assign_lines(meant, pools.join(about, "candidate"), files))
    rows = listing.select("candidate", "firm", "region", portal_area(F.col("grp"), F.col("area"), F.col("tbl")).alias("whole_area"), "filename", is_elite(F.col("grp")).alias("is_elite"), "has_document", created_at(F.col("created_at")).alias("at"))
    placed = results.select("page_id", "file_no", F.col("status").alias("file_status"))
    whole = lines.select("page_id", "line_no", "value").join(assigned, ["page_id", "line_no"], "left").join(rows, "candidate", "left").join(placed, ["page_id", "file_no"], "left")
    known = F.col("candidate").isNotNull()
    whole = whole.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_elite", "has_document")})
    marked = page_superseded(whole, F.col("firm"), F.col("region"), F.col("whole_area"), "at")
    expected = F.col("has_document") & ~F.col("is_elite") & ~F.col("superseded")
    counted = results.filter("status <> 'elite'").groupBy("page_id").agg(F.count("*").alias("attempted"))
    turn = F.count_if(expected).over(Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.join(counted, "page_id", "left").withColumn("reached", expected & (turn <= F.coalesce("attempted", F.lit(0))))
    has_file = F.col("file_no").isNotNull()
    older = F.when(has_file, F.coalesce(F.col("file_status") == "superseded", F.lit(False))).otherwise(F.col("superseded"))
    status = page_status(known, F.col("is_elite"), F.col("has_document"), has_file, F.coalesce(F.col("file_status") == "parse_error", F.lit(False)), older, F.col("repeat_of").isNotNull(), F.col("reached"))
    return marked.select("page_id", "line_no", "value", "candidate", "filename", "file_no", "repeat_of", "is_elite", "has_document", "superseded", "reached", status.alias("status"))


def page_rollup(lines: DataFrame, results: DataFrame) -> DataFrame:
    """One row a page from what page_lines gives: the counts of page.rollup, and in_batch (the
    expected lines reached), superseded, duplicates, not_on_page (files that no line has) and
    accounted_for: nothing missing, not reached, unclear, unreadable, and no copies."""
    counts = rollup(lines.withColumns({"placed": F.col("file_no").isNotNull(), "first_candidate": F.coalesce("filename", F.lit(""))}))
    spans = lines.groupBy("page_id").agg(F.count_if("reached").alias("in_batch"), F.count_if("superseded").alias("superseded"), F.count("file_no").alias("placed_files"))
    given = results.groupBy("page_id").agg(F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(~F.col("status").isin("duplicate", "elite")).alias("placeable"))
    both = counts.join(spans, "page_id").join(given, "page_id", "left").na.fill(0, ["duplicates", "placeable"])
    whole = both.withColumns({"not_on_page": F.col("placeable") - F.col("placed_files"), "accounted_for": F.col("accounted_for") & (F.col("duplicates") == 0)})
    return whole.drop("placeable", "placed_files")


def reached(lines: DataFrame, page: str, line: str, attempted: str) -> DataFrame:
    """reached: the line is among the first attempted ones of its page."""
    order = Window.partitionBy(page).orderBy(line)
    return lines.withColumn("reached", F.row_number().over(order) <= F.col(attempted))


def page_superseded(lines: DataFrame, firm: Column, region: Column, area: Column, at: str) -> DataFrame:
    """lines (page_id, line_no, is_elite, has_document ...) with superseded: a newer line of the page
    covers the slot, and one only is the newest. Elite lines, lines without a document, firm
    or area are left alone."""
    counts = F.col("has_document") & ~F.col("is_elite") & (normalise(firm) != "") & (normalise(area) != "")
    slot = Window.partitionBy("page_id", F.when(counts, normalise(firm)), normalise(region), normalise(area), counts)
    top = F.max(at).over(slot)
    marked = lines.withColumns({"_counts": counts, "_top": top}).withColumn("_newest", F.count_if(F.col(at) == F.col("_top")).over(slot))
    return marked.withColumn("superseded", F.coalesce(F.col("_counts") & (F.col("_newest") == 1) & (F.col(at) < F.col("_top")), F.lit(False))).drop("_counts", "_top", "_newest")
