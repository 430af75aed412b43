"""Small decoders of Word and spreadsheet packages, for use inside tasks."""

from __future__ import annotations

import csv
import posixpath
import re
import zipfile
from io import BytesIO, StringIO
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Package:
    """A zip package whose part names are found whatever their case; odd covers (a local
    header that spells a name otherwise than the directory) are read by offset."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(BytesIO(content))
        self.names = {n.lower().lstrip("/"): n for n in self.zip.namelist()}
        self.notes: list[str] = []
        self.content = content

    def part(self, name: str) -> bytes:
        real = self.names[name.lower().lstrip("/")]
        if real != name.lstrip("/"):
            self.notes.append(f"{name} is stored as {real}")
        try:
            return self.zip.read(real)
        except zipfile.BadZipFile:
            info = self.zip.getinfo(real)
            at = info.header_offset
            size = int.from_bytes(self.content[at + 26 : at + 28], "little")
            self.notes.append(f"{real} has another name in its local header")
            info.orig_filename = self.content[at + 30 : at + 30 + size].decode("cp437" if not info.flag_bits & 0x800 else "utf-8")
            return self.zip.read(info)


    def main_part(self) -> str:
        """The document that the package's relations name, else the usual one."""
        if "_rels/.rels" in self.names:
            for relation in ElementTree.fromstring(self.part("_rels/.rels")):
                target = relation.get("Target") or ""
                if (relation.get("Type") or "").endswith("/officeDocument") and target.lower().lstrip("/") in self.names:
                    return target
        return "word/document.xml"

    def audit(self) -> list[str]:
        """How many relations and content types name a part in another case than it has."""
        stored = set(self.names.values())

        def misspelt(target: str) -> bool:
            return target not in stored and target.lower() in self.names

        relations = types = 0
        for lower, name in self.names.items():
            if lower.endswith(".rels"):
                base = posixpath.dirname(posixpath.dirname(name))
                for relation in ElementTree.fromstring(self.part(name)):
                    target = relation.get("Target") or ""
                    if relation.get("TargetMode") != "External" and target:
                        relations += misspelt(target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target)))
            elif lower == "[content_types].xml":
                types += sum(misspelt((x.get("PartName") or "").lstrip("/")) for x in ElementTree.fromstring(self.part(name)))
        return [f"{n} {what} name a part in another case" for n, what in ((relations, "relations"), (types, "content types")) if n]


def _text(paragraph: ElementTree.Element) -> str:
    """Text of a paragraph's own runs; text inside inline content controls is not part of it."""
    out: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            if child.tag == W + "t":
                out.append(child.text or "")
            elif child.tag in (W + "tab", W + "br", W + "cr"):
                out.append("\t" if child.tag == W + "tab" else "\n")
            elif child.tag in (W + "r", W + "hyperlink"):
                walk(child)

    walk(paragraph)
    return "".join(out)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


#: What a Word document is decoded to, beside its notes and error.
PARTS = frozenset({"blocks", "rows", "controls"})


def read_document(content: bytes, parts: frozenset[str] = PARTS) -> dict:
    """blocks, rows and controls of a Word document in document order, or error. Those that
    parts leaves out stay empty and cost nothing."""
    out: dict = {"blocks": [], "rows": [], "controls": [], "notes": [], "error": None}
    try:
        package = Package(content)
        body = ElementTree.fromstring(package.part(package.main_part())).find(W + "body")
        out["notes"] = package.notes + (package.audit() if package.notes else [])
    except Exception as problem:  # a document that cannot be read is a result, not a failure
        return out | {"error": f"{type(problem).__name__}: {problem}"}
    tables = 0

    def cell_rows(node: ElementTree.Element) -> list[tuple[list[str], str]]:
        above: dict[int, str] = {}
        rows = []
        for tr in node.findall(W + "tr"):
            cells, fill, column = [], "", 0
            for tc in tr.findall(W + "tc"):
                text = _squeezed("\n".join(_text(p) for p in tc.findall(W + "p")))
                merge, span = tc.find(f"{W}tcPr/{W}vMerge"), tc.find(f"{W}tcPr/{W}gridSpan")
                if merge is not None and merge.get(W + "val") != "restart":
                    text = above.get(column, text)  # a continued cell shows the top one's text
                above[column] = text
                shade = tc.find(f"{W}tcPr/{W}shd")
                if not cells and shade is not None and re.fullmatch("[0-9A-Fa-f]{6}", shade.get(W + "fill") or ""):
                    fill = shade.get(W + "fill")
                cells.append(text)
                column += int(span.get(W + "val")) if span is not None else 1
            rows.append((cells, fill))
        return rows

    def walk(node: ElementTree.Element) -> None:
        nonlocal tables
        for child in node:
            if child.tag == W + "p":
                out["blocks"].append({"block_no": len(out["blocks"]), "kind": "p", "text": _squeezed(_text(child)), "tbl_no": None})
            elif child.tag == W + "tbl":
                number = tables
                tables += 1
                out["blocks"].append({"block_no": len(out["blocks"]), "kind": "tbl", "text": None, "tbl_no": number})
                if "rows" in parts:
                    out["rows"] += [{"tbl_no": number, "row_no": k, "cells": c, "fill": f} for k, (c, f) in enumerate(cell_rows(child))]
                for cell in child.findall(f"{W}tr/{W}tc"):
                    walk(cell)
            elif child.tag == W + "sdt" and (inner := child.find(W + "sdtContent")) is not None:
                walk(inner)

    if parts & {"blocks", "rows"}:
        walk(body)
    if "blocks" not in parts:
        out["blocks"] = []
    for sdt in body.iter(W + "sdt") if "controls" in parts else ():
        alias = sdt.find(f"{W}sdtPr/{W}alias")
        text = _squeezed("".join(t.text or "" for t in sdt.iter(W + "t")))
        if not re.match(r"(?i)^(choose an item|click here to enter text)\.?$", text):
            out["controls"].append({"sdt_no": len(out["controls"]), "alias": alias.get(W + "val") if alias is not None else None, "text": text})
    return out


def read_workbook(content: bytes, sheets: frozenset[str] | None = None) -> list[dict]:
    """Cells of all sheets in their order: sheet_no, sheet, row_no, col_no, value, link, fill
    (RRGGBB or empty). With sheets, only sheets of these names are opened."""
    package = Package(content)
    relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(package.part("xl/_rels/workbook.xml.rels"))}
    shared = []
    if "xl/sharedstrings.xml" in package.names:
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(package.part("xl/sharedStrings.xml"))]
    fills, styles = [], []
    if "xl/styles.xml" in package.names:
        sheet = ElementTree.fromstring(package.part("xl/styles.xml"))
        for fill in sheet.iter(S + "fill"):
            colour = fill.find(f"{S}patternFill/{S}fgColor")
            fills.append((colour.get("rgb") or "")[-6:] if colour is not None else "")
        styles = [int(x.get("fillId") or 0) for x in sheet.findall(f"{S}cellXfs/{S}xf")]
    out = []
    for number_of, sheet in enumerate(ElementTree.fromstring(package.part("xl/workbook.xml")).iter(S + "sheet")):
        if sheets is not None and sheet.get("name") not in sheets:
            continue
        target = relations[sheet.get(R + "id")].lstrip("/")
        path = target if target.startswith("xl/") else "xl/" + target
        tree = ElementTree.fromstring(package.part(path))
        names = path.rpartition("/")
        rels = f"{names[0]}/_rels/{names[2]}.rels"
        links_to = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(package.part(rels))} if rels.lower() in package.names else {}
        links = {h.get("ref"): links_to.get(h.get(R + "id")) for h in tree.iter(S + "hyperlink")}
        for row in tree.iter(S + "row"):
            for cell in row.findall(S + "c"):
                value = cell.find(S + "v")
                text = value.text if value is not None else None
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(S + "t"))
                letters, number = re.match("([A-Z]+)([0-9]+)", cell.get("r")).groups()
                column = 0
                for letter in letters:
                    column = column * 26 + ord(letter) - 64
                style = int(cell.get("s") or 0)
                fill = fills[styles[style]] if style < len(styles) and styles[style] < len(fills) else ""
                if text is not None or fill:
                    out.append({"sheet_no": number_of, "sheet": sheet.get("name"), "row_no": int(number), "col_no": column, "value": text, "link": links.get(cell.get("r")), "fill": fill})
    return out


_XML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}


def read_csv(content: bytes) -> list[dict]:
    """Cells of a comma-separated text, as of a workbook of one sheet; a byte order mark
    before it is dropped."""
    out = []
    for number, row in enumerate(csv.reader(StringIO(content.decode("utf-8-sig"), newline="")), 1):
        out += [{"sheet_no": 0, "sheet": "csv", "row_no": number, "col_no": k, "value": v, "link": None, "fill": ""} for k, v in enumerate(row, 1) if v != ""]
    return out


def _escaped(text: object) -> str:
    return re.sub('[&<>"]', lambda m: _XML[m[0]], re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(text)))


def _letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _note_parts(notes: list[tuple[int, int, str]], main: str) -> tuple[str, str]:
    """The comments of a sheet, and the drawing that gives each its box, from (row, column, text)."""
    listed = "".join(f'<comment ref="{_letters(c)}{r}" authorId="0"><text><t xml:space="preserve">{_escaped(t)}</t></text></comment>' for r, c, t in notes)
    box = 'type="#note" fillcolor="#ffffe1" style="position:absolute;width:320px;height:110px;visibility:hidden"'
    shapes = "".join(f'<v:shape id="n{k}" {box}><x:ClientData ObjectType="Note"><x:Row>{r - 1}</x:Row><x:Column>{c - 1}</x:Column></x:ClientData></v:shape>' for k, (r, c, _) in enumerate(notes))
    spaces = 'xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"'
    kind = '<v:shapetype id="note" coordsize="21600,21600" o:spt="202" path="m,l,21600r21600,l21600,xe"/>'
    return f"<comments {main}><authors><author>recount</author></authors><commentList>{listed}</commentList></comments>", f"<xml {spaces}>{kind}{shapes}</xml>"


def write_workbook(sheets: dict[str, list[list[tuple]]]) -> bytes:
    """A workbook of sheets of rows of (value, fill) or (value, fill, comment); the first row
    of each stays in view. fill is green, amber or empty."""
    colours = {"": 0, "green": 1, "amber": 2}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    parts = {}
    for n, rows in enumerate(sheets.values(), 1):
        lines = []
        notes = [(r, c, x[2]) for r, row in enumerate(rows, 1) for c, x in enumerate(row, 1) if len(x) > 2 and x[2]]
        for r, row in enumerate(rows, 1):
            cells = []
            for c, (value, fill, *_) in enumerate(row, 1):
                at, style = f"{_letters(c)}{r}", colours[fill]
                if isinstance(value, (int, float)) and not isinstance(value, bool):
                    cells.append(f'<c r="{at}" s="{style}"><v>{value}</v></c>')
                elif value is not None or style:
                    cells.append(f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_escaped("" if value is None else value)}</t></is></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        widths = [min(48, 2 + max((len(str(row[c][0] or "")) for row in rows[:400] if c < len(row)), default=0)) for c in range(max(map(len, rows), default=0))]
        cols = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths, 1))
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {main} xmlns:r=\"{office}\">{view}{f'<cols>{cols}</cols>' if cols else ''}<sheetData>{''.join(lines)}</sheetData>{'<legacyDrawing r:id="rId1"/>' if notes else ''}</worksheet>"
        if notes:
            parts[f"xl/worksheets/_rels/sheet{n}.xml.rels"] = f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/vmlDrawing" Target="../drawings/vmlDrawing{n}.vml"/><Relationship Id="rId2" Type="{office}/comments" Target="../comments{n}.xml"/></Relationships>'
            parts[f"xl/comments{n}.xml"], parts[f"xl/drawings/vmlDrawing{n}.vml"] = _note_parts(notes, main)
    listed = "".join(f'<sheet name="{_escaped(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {main} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>'
    related = "".join(f'<Relationship Id="rId{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{package}/relationships">{related}<Relationship Id="rId0" Type="{office}/styles" Target="styles.xml"/></Relationships>'
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("C6EFCE", "FFE699"))
    xfs = "".join(f'<xf fontId="0" borderId="0" numFmtId="0" fillId="{f}" applyFill="1"/>' for f in (0, 2, 3))
    fills = f'<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills>'
    parts["xl/styles.xml"] = f'<styleSheet {main}><fonts count="1"><font/></fonts>{fills}<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{xfs}</cellXfs></styleSheet>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
    overrides += "".join(f'<Override PartName="/{name}" ContentType="{kind}.comments+xml"/>' for name in parts if name.startswith("xl/comments"))
    parts["[Content_Types].xml"] = f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{overrides}</Types>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name, body in parts.items():
            target.writestr(name, head + body)
    return out.getvalue()
