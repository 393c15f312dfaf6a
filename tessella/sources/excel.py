"""Office Open XML workbooks with the standard library: reading one sheet, writing plain tables."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from ..errors import DataError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _dates(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    styles = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return [i in _DATE_FORMATS or bool(re.search("[ymdh]", custom.get(i, ""), re.I)) for i in ids]


def _shown(cell: ElementTree.Element, strings: list[str], dates: list[bool]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind != "n":
        return v.text
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        at = datetime(1899, 12, 30) + timedelta(days=float(v.text))
        return at.date().isoformat() if at == datetime(at.year, at.month, at.day) else at.isoformat(sep=" ")
    return re.sub(r"\.0+\Z", "", v.text)


def read_sheet(path: str, sheet: str | None = None) -> tuple[list[str | None], list[list[str | None]]]:
    """Header and rows of a sheet; rows without any value are left out."""
    try:
        with zipfile.ZipFile(path) as book:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = {s.get("name"): targets[s.get(f"{_REL}id")] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
            if sheet is not None and sheet not in sheets:
                raise DataError(f"{path} has no sheet {sheet!r}")
            target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
            strings = []
            if "xl/sharedStrings.xml" in book.namelist():
                strings = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
            dates = _dates(book)
            rows = []
            for row in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                values: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    k = column_number(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (k + 1 - len(values))
                    values[k] = _shown(cell, strings, dates)
                if any(v is not None for v in values):
                    rows.append(values)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError) as e:
        raise DataError(f"{path} is not a workbook: {e}") from None
    if not rows:
        raise DataError(f"{path}: the sheet is empty")
    return rows[0], rows[1:]


def _name(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(path: str, sheets: dict[str, Iterable[Sequence[object]]]) -> None:
    """SNK4: a workbook with a sheet for each table of rows. Text stays text, so that no cell is a formula."""
    kinds = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        every = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{kinds}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{every}</Types>')
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{kinds}/spreadsheetml/2006/main" xmlns:r="{kinds}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{kinds}/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            out = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    at = f"{_name(c)}{r}"
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{at}"><v>{v}</v></c>')
                    else:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>')
                out.append(f'<row r="{r}">{"".join(cells)}</row>')
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{kinds}/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>')
