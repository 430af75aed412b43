"""Scalar text functions as Column expressions. All of them stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def clean(text: Column) -> Column:
    """Null to empty, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "))


def normalise(text: Column) -> Column:
    """clean, blanks around >, lower case. The result of the > step is not trimmed again."""
    tidy = clean(text)
    return F.lower(F.when(F.contains(text.cast("string"), F.lit(">")), F.regexp_replace(tidy, r"(?U)\s*>\s*", " > ")).otherwise(tidy))


#: Legal forms that a firm's name may end with.
LEGAL_FORMS = "llp|ltd|limited|plc|lp|inc|incorporated|solicitors"


def firm_key(text: Column) -> Column:
    """A firm's name without legal forms and punctuation; for diagnostics only."""
    bare = F.regexp_replace(normalise(text), rf"(?<![a-z0-9_])({LEGAL_FORMS})(?![a-z0-9_])\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]+", " "), " +", " "))


def level_words(text: Column) -> Column:
    """The words of one level of an area; letters of any script count."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _levels(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, " > "), lambda x: F.trim(x)), lambda x: x != "")


def levels(area: Column) -> Column:
    """The non-empty levels of a normalised area."""
    return _levels(normalise(area))


def _kept(parts: Column) -> Column:
    """How many levels stay without trailing ones that have the words of the one before: up to
    the last that differs from the one before it."""
    differs = lambda words: F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i + 1).otherwise(1))
    return F.coalesce(F.array_max(let(F.transform(parts, level_words), differs)), F.lit(0))


def canonical_levels(area: Column) -> Column:
    """Levels without trailing ones that repeat the level before."""
    return let(levels(area), lambda parts: F.slice(parts, F.lit(1), _kept(parts)))


def canonical_area(area: Column) -> Column:
    return F.array_join(canonical_levels(area), " > ")


def area_variants(area: Column) -> Column:
    """Every spelling under which an area may be listed, longest first, ties by text.

    A trailing level that repeats the one before may be left out or stand alone; of three
    or more levels two neighbours may stand alone; every level but the first may stand
    alone. The first level of several never does: it is a group, not an area."""
    none = F.array().cast("array<string>")
    join = lambda a: F.array_join(a, " > ")

    def forms(x: Column) -> Column:
        text, parts, kept = x["text"], x["parts"], x["kept"]
        shortened = F.transform(F.sequence(kept, F.size(parts)), lambda n: join(F.slice(parts, F.lit(1), n)))
        pairs = F.when(kept >= 3, F.array(join(F.slice(parts, kept - 1, F.lit(2))), join(F.slice(parts, 1, 2)))).otherwise(none)
        # levels but the first, the last of what stays, and what repeats it
        single = F.filter(F.transform(parts, lambda level, i: F.when((i > 0) | (kept == 1), level)), lambda level: level.isNotNull())
        every = F.concat(F.array(text), F.when(kept > 0, F.concat(shortened, pairs, single)).otherwise(none))
        found = F.array_distinct(F.filter(every, lambda f: f != ""))
        ordered = F.array_sort(F.transform(found, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f"))))
        return F.transform(ordered, lambda s: s["f"])

    split = lambda text: F.struct(text.alias("text"), _levels(text).alias("parts"))
    counted = lambda x: F.struct(x["text"].alias("text"), x["parts"].alias("parts"), _kept(x["parts"]).alias("kept"))
    return let(let(let(normalise(area), split), counted), forms)


def to_int(text: Column) -> Column:
    """Trimmed digits with an optional sign, else null."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed).try_cast("int")


def copy_suffix(name: Column) -> tuple[Column, Column]:
    """stem (N).docx: the name without the suffix, and N (null if there is none)."""
    pattern = r"(?is)^(.*?)\s*\((\d+)\)(\.docx)$"
    number = F.when(F.contains(name, F.lit("(")), F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")))
    plain = F.when(number.isNotNull(), F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 3))).otherwise(name)
    return plain, number.try_cast("int")


def uri_to_filename(uri: Column) -> Column:
    """The last segment, percent-decoded; .docx is added to a name without a dot."""
    path = F.replace(F.split(F.coalesce(uri, F.lit("")), r"\?", 2)[0], F.lit("\\"), F.lit("/"))
    raw = F.element_at(F.split(path, "/"), -1)
    decoded = F.trim(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    return F.when((decoded == "") | F.contains(decoded, F.lit(".")), decoded).otherwise(F.concat(decoded, F.lit(".docx")))


def table_code(name: Column) -> tuple[Column, Column]:
    """Firm reference and table code of a name such as x_12_submission_y_EC34.docx."""
    pattern = r"(?i)_([0-9]+)_submission_.*_EC([0-9]+)\.docx$"
    one = lambda k: F.when(F.contains(F.lower(name), F.lit("_submission_")), F.nullif(F.regexp_extract(name, pattern, k), F.lit("")))
    return one(1), one(2)


def portal_area(group: Column, area: Column, table: Column) -> Column:
    """Group > area, and > table where that differs from the area."""
    table_part = F.when(F.lower(clean(table)) != F.lower(clean(area)), F.nullif(clean(table), F.lit("")))
    return F.concat_ws(" > ", F.nullif(clean(group), F.lit("")), F.nullif(clean(area), F.lit("")), table_part)


def created_at(text: Column) -> Column:
    """ISO dates and dd/mm/yyyy; anything else counts as the earliest time."""
    iso = F.regexp_replace(text.cast("string"), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")
    at = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(iso, 1, 19).try_cast("timestamp_ntz"))  # no zone: no hour is skipped
    return F.coalesce(at, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def created_text(at: Column) -> Column:
    return F.when(F.year(at) <= 1, "unknown date").otherwise(F.date_format(at, "yyyy-MM-dd"))


def split_dropdown(text: Column) -> Column:
    """Up to three non-empty parts around dashes between blanks."""
    return F.filter(F.split(text, r"(?U)\s+-\s+", 3), lambda x: x != "")


#: Pairs of brackets and quotes that may enclose an answer.
PAIRS = (("[", "]"), ("(", ")"), ("{", "}"), ('"', '"'), ("'", "'"), ("“", "”"))


_OPENING = "".join("\\" + a for a, _ in PAIRS)


def unwrap(text: Column) -> Column:
    """Strips enclosing pairs of brackets or quotes until none is left: no more often than
    there are openings at the text's start. Most texts begin with none and stay as they are."""

    def strip(acc: Column, _: Column) -> Column:
        ends = F.concat(F.left(acc, F.lit(1)), F.right(acc, F.lit(1)))
        enclosed = (F.length(acc) >= 2) & ends.isin([a + b for a, b in PAIRS])
        return F.when(enclosed, F.trim(F.substring(acc, F.lit(2), F.length(acc) - 2))).otherwise(acc)

    opening = F.length(F.regexp_extract(text, f"^[{_OPENING}\\s]*", 0))
    stripped = F.aggregate(F.sequence(F.lit(0), F.coalesce(opening, F.lit(0))), text, strip)
    return F.when(F.left(text, F.lit(1)).isin([a for a, _ in PAIRS]), stripped).otherwise(text)


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…")))


def colour_kind(fill: Column) -> Column:
    """Red hues are Non-publishable, green ones Publishable; pale or other ones null. The turn is
    added before the remainder for all hues: that rounds hues at a border to it."""
    rgb = F.struct(*((F.conv(F.substring(fill, at, 2), 16, 10).cast("double") / 255).alias(c) for c, at in (("r", 1), ("g", 3), ("b", 5))))

    def spread(x: Column) -> Column:
        high, low = F.greatest(x["r"], x["g"], x["b"]), F.least(x["r"], x["g"], x["b"])
        return F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"), high.alias("high"), low.alias("low"), (high - low).alias("span"))

    def tone(x: Column) -> Column:
        r, g, b, high, low, span = (x[c] for c in ("r", "g", "b", "high", "low", "span"))
        saturation = F.when(span == 0, 0.0).when((high + low) / 2 <= 0.5, F.try_divide(span, high + low)).otherwise(F.try_divide(span, 2 - high - low))
        turn = F.when(high == r, F.try_divide(g - b, span)).when(high == g, 2 + F.try_divide(b - r, span)).otherwise(4 + F.try_divide(r - g, span))
        return F.struct(saturation.alias("saturation"), ((turn * 60 + 360) % 360).alias("hue"))

    def kind(x: Column) -> Column:
        return F.when(x["saturation"] < 0.25, F.lit(None)).when((x["hue"] < 15) | (x["hue"] > 345), "Non-publishable").when((x["hue"] > 75) & (x["hue"] < 160), "Publishable")

    return F.when(fill.rlike("^[0-9A-Fa-f]{6}$"), let(let(let(rgb, spread), tone), kind))


def ranges_text(numbers: Column) -> Column:
    """A sorted array of numbers as runs: a; a, b; a to b."""
    start = F.struct(F.array().cast("array<struct<a: int, b: int>>").alias("runs"))

    def add(acc: Column, n: Column) -> Column:
        runs = acc["runs"]
        last = F.try_element_at(runs, F.lit(-1))
        joins = F.coalesce(last["b"] + 1 == n, F.lit(False))
        longer = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), n.alias("b"))))
        return F.struct(F.when(joins, longer).otherwise(F.concat(runs, F.array(F.struct(n.alias("a"), n.alias("b"))))).alias("runs"))

    runs = F.aggregate(F.transform(numbers, lambda x: x.cast("int")), start, add, lambda acc: acc["runs"])
    word = lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).when(r["a"] + 1 == r["b"], F.concat_ws(", ", r["a"], r["b"])).otherwise(F.concat_ws(" to ", r["a"], r["b"]))
    return F.array_join(F.transform(runs, word), ", ")


def order_forms(group: Column, area: Column) -> Column:
    """Forms of a row's area, then those of group > area."""
    group, area = normalise(group), normalise(area)
    return F.array_distinct(F.concat(area_variants(area), F.when(group != "", area_variants(F.concat_ws(" > ", group, area))).otherwise(F.array().cast("array<string>"))))


def own_order_keys(filename: Column, firm: Column, region: Column, forms: Column) -> Column:
    """The keys of a row that few others have, most specific first: its file; firm, region and
    form. forms: as order_forms gives them."""
    file_, firm, region = (normalise(c) for c in (filename, firm, region))
    empty = F.array().cast("array<string>")
    named = F.when((firm != "") & (region != ""), F.transform(forms, lambda x: F.concat_ws("|", F.lit("fra"), firm, region, x))).otherwise(empty)
    return F.concat(F.when(file_ != "", F.array(F.concat_ws("|", F.lit("file"), file_))).otherwise(empty), named)


def shared_order_keys(region: Column, forms: Column) -> Column:
    """The keys that a row shares with all of its region or area: region and form; form."""
    region = normalise(region)
    within = F.when(region != "", F.transform(forms, lambda x: F.concat_ws("|", F.lit("ra"), region, x))).otherwise(F.array().cast("array<string>"))
    return F.concat(within, F.transform(forms, lambda x: F.concat_ws("|", F.lit("a"), x)))


def order_keys(filename: Column, firm: Column, region: Column, group: Column, area: Column) -> Column:
    """Keys of a row, most specific first: its file; firm, region and form; region and
    form; form. Forms of the area come first, then those of group > area."""
    forms = order_forms(group, area)
    return F.concat(own_order_keys(filename, firm, region, forms), shared_order_keys(region, forms))
