"""Reports as CSV and XLSX files, byte for byte the same for the same rows. Rows stream through the
driver one partition at a time; files are for people, who read reports of a bounded size."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from datetime import date
from itertools import chain
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def rows_of(df: DataFrame) -> Iterator[list[str | None]]:
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield [None if v is None else str(v) for v in r]


def csv_cell(value: str | None) -> str:
    v = value or ""
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v


def csv_bytes(headers: Sequence[str], rows: Iterable[Sequence[str | None]], bom: bool = True) -> Iterator[bytes]:
    """RFC 4180 lines with CRLF; quotes only where they are needed."""
    if bom:
        yield b"\xef\xbb\xbf"
    for row in chain([headers], rows):
        yield (",".join(map(csv_cell, row)) + "\r\n").encode()


def write_csv(path: str, df: DataFrame, headers: Sequence[str] | None = None, bom: bool = True) -> None:
    with open(path, "wb") as f:
        f.writelines(csv_bytes(headers or df.columns, rows_of(df), bom))


def column_letters(index: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_names(names: Sequence[str]) -> list[str]:
    """Names that a workbook takes: no forbidden characters, 31 at most, none twice."""
    out: list[str] = []
    for name in names:
        clean = re.sub(r"[\[\]:*?/\\]", " ", name).strip().strip("'")[:31] or "Sheet"
        n, tried = 2, clean
        while tried.lower() in {o.lower() for o in out}:
            end = f" {n}"
            tried, n = clean[: 31 - len(end)] + end, n + 1
        out.append(tried)
    return out


def _xml(text: str) -> str:
    return escape(_CONTROL.sub("", text), {'"': "&quot;"})


def _sheet(headers: Sequence[str], rows: Iterable[Sequence[str | None]]) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    for n, row in enumerate(chain([headers], rows), 1):
        cells = "".join(f'<c r="{column_letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{_xml(v)}</t></is></c>' for i, v in enumerate(row) if v is not None)
        yield f'<row r="{n}">{cells}</row>'
    yield "</sheetData></worksheet>"


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'


def write_xlsx(path: str, sheets: Sequence[tuple[str, Sequence[str], Iterable[Sequence[str | None]]]]) -> None:
    """One workbook of (name, headers, rows); NULL is no cell, an empty text is an empty cell. The
    parts are stored with one fixed date, so equal rows give equal bytes."""
    names = sheet_names([s[0] for s in sheets])

    def add(z: zipfile.ZipFile, name: str, chunks: Iterable[str]) -> None:
        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_STORED
        with z.open(info, "w") as f:
            for c in chunks:
                f.write(c.encode())

    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=False) as z:
        add(z, "[Content_Types].xml", [_TYPES.format("".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)))])
        add(z, "_rels/.rels", [_RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml"))])
        listed = "".join(f'<sheet name="{_xml(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        add(z, "xl/workbook.xml", [f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>'])
        add(z, "xl/_rels/workbook.xml.rels", [_RELS.format("".join(_REL.format(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)))])
        for i, (_, headers, rows) in enumerate(sheets, 1):
            add(z, f"xl/worksheets/sheet{i}.xml", _sheet(headers, rows))


def file_name(host: str, report: str, on: date, extension: str) -> str:
    part = lambda s: re.sub(r"[^A-Za-z0-9]+", "-", s).strip("-").lower()
    return f"{part(host)}-{part(report)}-{on.isoformat()}.{extension}"


def export(tables: Sequence[tuple[str, Sequence[str], DataFrame]], path: str, kind: str = "csv") -> list[str]:
    """Several reports: one workbook, or one CSV file each in a folder."""
    if kind == "xlsx":
        write_xlsx(path, [(n, h, rows_of(df)) for n, h, df in tables])
        return [path]
    Path(path).mkdir(parents=True, exist_ok=True)
    out = []
    for name, headers, df in tables:
        out.append(f"{path}/{re.sub(r'[^A-Za-z0-9]+', '-', name).strip('-').lower()}.csv")
        write_csv(out[-1], df, headers)
    return out
