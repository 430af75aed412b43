"""Small Word documents for tests."""

import zipfile
from io import BytesIO

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def tbl(*rows, fill=""):
    shade = f'<w:tcPr><w:shd w:fill="{fill}"/></w:tcPr>' if fill else ""
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{shade}{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def control(inner, alias="x"):
    return f'<w:sdt><w:sdtPr><w:alias w:val="{alias}"/></w:sdtPr><w:sdtContent>{inner}</w:sdtContent></w:sdt>'


def matter(label, client, fill=""):
    return [(label, ""), ("Name of client", "Industry sector"), (client, "Energy" if client else ""), ("Matter description", "")]


def nominee(label, name):
    return [(label,), ("Name", "Location", "Ranked"), (name, "", ""), ("Supporting information",), ("text",)]


def clients(*rows):
    return [("Active key clients (over the last 12 months)", "New client (yes/no)"), *rows, ("To add more clients, use ‘Insert row below’", "")]


def package(body, part="word/document.xml"):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(part, f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


#: name -> (document, matters, active, new, lead, next gen, associates)
GOLDEN = {
    "alpha.docx": (
        "".join(tbl(*matter(f"Publishable matter {n}", f"Client {n}")) for n in range(1, 6))
        + tbl(*clients(("A", "Yes"), ("B", "No"), ("C", ""), ("D", "no"), ("E", "No")))
        + tbl(*nominee("Partner: leading individual 1", "Ann"))
        + tbl(*nominee("Partner: next generation partner 1", "Bo"))
        + tbl(*nominee("Partner: next generation partner 1", "Cy")),
        (5, 5, 1, 1, 2, 0),
    ),
    "beta.docx": (
        tbl(*matter("Publishable matter 1", "A"), *matter("Publishable matter 2", "B"), *matter("Publishable matter 3", "C"))
        + "".join(tbl(*matter(f"Non-publishable matter {n}", "X")) for n in (1, 2, 3))
        + tbl(("Non-publishable matter 4", ""))
        + tbl(("Name of client", "Industry sector"), ("Y", ""))
        + tbl(*matter("Publishable matter 9", ""))
        + tbl(*clients(("A", "Y"), ("B", "Sí"), ("C", "New"), ("D", "N"), ("E", "Existing"), ("F", "no")))
        + tbl(*nominee("Partner: leading individual 1", "A"))
        + control(tbl(*nominee("Leading partner 2", "B")))
        + tbl(*nominee("Next Generation Partner 1", "C"))
        + tbl(*nominee("Associates: leading associate 1", "D"), *nominee("Counsel: of note", "E")),
        (7, 6, 3, 2, 1, 2),
    ),
    "gamma.docx": (
        "".join(tbl(*matter(f"Publishable matter {n}", "A")) for n in (1, 2, 4))
        + tbl(*matter("Highlight 1", "Z"), fill="C5E0B3")
        + p("*NEW* Publishable matter summary")
        + tbl(("Summary (including client name)",))
        + tbl(*clients(("Client name", "New / Existing"), ("A", "Existing"), ("N/A", ""), ("B", "Yes (for this work type)"), ("C", "New")))
        + tbl(*nominee("Partner: leading individual 1", "A"))
        + tbl(*nominee("Partner: leading individual 2", "")),
        (4, 3, 2, 1, 0, 0),
    ),
    "empty.docx": (p("nothing") + p("Your team: leading partners"), (None, None, None, None, None, None)),
}
