"""Value tables for the scalar functions and classifiers."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import labels, text


def values(spark, function, *inputs):
    """function over a column holding the inputs, in order."""
    df = spark.createDataFrame([(n, x) for n, x in enumerate(inputs)], "n int, x string")
    return [r[0] for r in df.orderBy("n").select(function(F.col("x"))).collect()]


def test_clean_and_normalise(spark):
    assert values(spark, text.clean, None, " a  b \n", "") == ["", "a b", ""]
    assert values(spark, text.normalise, "A>B", ">a", " X  >  Y ", None) == ["a > b", " > a", "x > y", ""]


def test_firm_key(spark):
    assert values(spark, text.firm_key, "Smith & Co. LLP", "Smith and Co Ltd.", "The Incorporated Club Inc", "LP") == ["smith co", "smith and co", "the club", ""]


def variants_by_hand(value):
    """The spellings again, from their description."""
    whole = " ".join((value or "").split()).lower()
    whole = " > ".join(p.strip() for p in whole.split(">"))
    parts = [p.strip() for p in whole.split(" > ") if p.strip()]
    words = lambda t: "".join(c if c.isalnum() else " " for c in t).split()
    forms = {whole} if whole.strip() else set()
    while len(parts) >= 2 and words(parts[-1]) == words(parts[-2]):
        forms.add(parts.pop())
        forms.add(" > ".join(parts))
    if len(parts) >= 3:
        forms |= {" > ".join(parts[-2:]), " > ".join(parts[:2])}
    forms |= set(parts[1:]) | set(parts[-1:])
    return sorted(forms, key=lambda f: (-len(f), f))


AREAS = ["Transport > Travel", "Transport > Travel > Travel", "a > b > c > (c) > c", "Tax", "Energy (and renewables) > Energy and renewables", "x > y > z", "  A  >  B ", "a > a", "p > q > r > s"]


def test_area_variants(spark):
    assert values(spark, text.area_variants, *AREAS) == [variants_by_hand(a) for a in AREAS]
    assert values(spark, text.area_variants, None, "") == [[], []]
    assert values(spark, text.area_variants, "Transport > Travel") == [["transport > travel", "travel"]]


def test_canonical_area(spark):
    assert values(spark, text.canonical_area, "A > B > b", "A > A", "x > y > x", "A", None) == ["a > b", "a", "x > y > x", "a", ""]


def test_to_int(spark):
    assert values(spark, text.to_int, " 21 ", "5.0", "", None, "-3", "1_000", "99999999999") == [21, None, None, None, -3, None, None]


def test_file_names(spark):
    plain = lambda c: text.copy_suffix(c)[0]
    copy = lambda c: text.copy_suffix(c)[1]
    names = ["A (12).docx", "A (patents).docx", "A.docx", "b(1).DOCX"]
    assert values(spark, plain, *names) == ["A.docx", "A (patents).docx", "A.docx", "b.DOCX"]
    assert values(spark, copy, *names) == [12, None, None, 1]
    uris = ["https://h/x/firm_2027%20Edition.docx?web=1", "h/name", "a\\b.pdf", "h/", None, "h/a+b%", "h/100%25.docx"]
    assert values(spark, text.uri_to_filename, *uris) == ["firm_2027 Edition.docx", "name.docx", "b.pdf", "", "", "a+b%.docx", "100%.docx"]


def test_dates(spark):
    said = lambda c: text.created_text(text.created_at(c))
    assert values(spark, said, "2026-03-01 00:00:00", "28/01/2026", "2026-03", "x", None) == ["2026-03-01", "2026-01-28", "unknown date", "unknown date", "unknown date"]


def test_dropdown_and_unwrap(spark):
    assert values(spark, text.split_dropdown, "UK - Tax - VAT - more", "UK -  - Tax", "one-word") == [["UK", "Tax", "VAT - more"], ["UK", "- Tax"], ["one-word"]]
    assert values(spark, text.unwrap, "[Yes]", "([“x”])", "(a", "()", '"') == ["Yes", "x", "(a", "", '"']


def test_colours(spark):
    assert values(spark, text.colour_kind, "F1A3A3", "EE0000", "D99594", "FC9299") == ["Non-publishable"] * 4
    assert values(spark, text.colour_kind, "C5E0B3", "B3E5A1", "A8D08D") == ["Publishable"] * 3
    assert values(spark, text.colour_kind, "D0CECE", "FFFFFF", "FFF2CC", "DAE8F8", "", None) == [None] * 6


def test_colours_at_a_border(spark):
    """A hue of exactly 75 degrees is not beyond it."""
    assert values(spark, text.colour_kind, "C2F42C", "C1F42C") == [None, "Publishable"]


def test_ranges(spark):
    say = lambda c: text.ranges_text(F.transform(F.split(c, ","), lambda x: x.cast("int")))
    assert values(spark, say, "5,7,8,9," + ",".join(map(str, range(30, 230))), "3,4", "1") == ["5, 7 to 9, 30 to 229", "3, 4", "1"]


ANSWERS = {
    "new": ["Yes", "yes", "Y", "Sí", "SI", "Sim", "[Yes]", "(Sí)", "Ye", "New", "Yes (for this work type)"],
    "not": ["No", "N", "Não", "Nao", "[No]", "(No)", "No.", "Existing client"],
    "unrecognised": ["N/A", "TBC", "?", "Since 2019", "Simple", "-", "n.a.", "not applicable"],
    "blank": ["", "  ", None],
}


@pytest.mark.parametrize("kind", ANSWERS)
def test_answers(spark, kind):
    assert values(spark, labels.answer, *ANSWERS[kind]) == [kind] * len(ANSWERS[kind])


def test_qualified(spark):
    assert values(spark, labels.answer_is_qualified, "Yes", "Yes (new)", "No.", "TBC", "New client", "Existing") == [False, True, False, False, True, False]


NOMINATIONS = {
    "associates": ["Associate : leading counsel 1", "Associates: leading associate 1", "Counsel: anything", "Rising Star 1"],
    "lead_partners": ["Partner 1: leading individual", "Leading partner 2", "Partner – senior 1"],
    "next_gen": ["Partner: leading next generation partner 1", "Next Gen Partners 2"],
    "unclassified": ["Partner: of the year"],
    None: ["Partners: two", "Name", "Partnership", "Lead partner(s)", "", None],
}


@pytest.mark.parametrize("kind", NOMINATIONS)
def test_nominations(spark, kind):
    assert values(spark, labels.nomination, *NOMINATIONS[kind]) == [kind] * len(NOMINATIONS[kind])


def test_matters(spark):
    yes = ["Publishable - Matter 1", "Publishable matter: 1", "Non-publishable matter1", "Publishable #Matter 1", "Confidential matter 1", "Non-published matter 1", "Publishable matter"]
    no = ["Publishable matter summary", "Publishable Matter description", "matter 1", None]
    assert values(spark, labels.is_matter, *yes, *no) == [True] * 7 + [False] * 4
    assert values(spark, labels.matter_number, *yes) == [1, 1, 1, 1, 1, 1, None]
    assert [k[0] for k in values(spark, labels.matter_kind, *yes)] == ["P", "P", "N", "P", "N", "N", "P"]


def test_elite_is_read_from_the_group_only(spark):
    assert values(spark, labels.is_elite_area, "Tax Elite > x", "Tax > elite", "Elitist > x", None) == [True, False, False, False]


def test_order_keys(spark):
    keys = lambda c: text.order_keys(c, F.lit("Firm"), F.lit("UK"), F.lit("Tax"), F.lit("VAT"))
    got = values(spark, keys, "A.docx")[0]
    assert got[0] == "file|a.docx"
    assert got[1:4] == ["fra|firm|uk|vat", "fra|firm|uk|tax > vat", "ra|uk|vat"]
    assert got[-1] == "a|tax > vat"


def test_a_cheap_look_loses_no_label(spark):
    """Cased, spaced and folded labels; the look is False only for texts without the word."""
    assert values(spark, lambda c: labels.may_hold(c, ["matter"]), "MATTER 1", "client", "", None, "ma\u1e6dter") == [True, False, False, False, True]
    assert values(spark, labels.is_matter, "PUBLISHABLE  Matter 3", "publi\u017fhable matter 2", "client", "", None) == [True, True, False, False, False]
    assert values(spark, labels.nomination, "PARTNER : Leading", "Ri\u017fing Star", "Next\u00a0Gen", "P17", "", None) == ["lead_partners", "associates", "next_gen", None, None, None]
    assert values(spark, labels.is_client_table, " ACTIVE key\u00a0clients", "P17", "", None) == [True, False, False, False]
    assert values(spark, text.unwrap, "[(a)]", " (a)", "a)", "()", "", None) == ["a", " (a)", "a)", "", "", None]
