"""A workbook of a few reports: the sink for results that people read. Not for data of any size: a sheet holds 1,048,576 rows."""

from __future__ import annotations

import io
import math
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

ROWS, CHARS = 1_048_575, 32_767  # fixed values: what a sheet and a cell of the format hold
_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(at: str, v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) < 1e15 and math.isfinite(v):
        return f'<c r="{at}"><v>{v!r}</v></c>'
    text = escape(_BAD.sub("�", str(v)))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def workbook(sheets: dict[str, DataFrame], rows: int = 100_000) -> bytes:
    """The file's bytes. Raises where a report has more than ``rows`` rows (of at most those a sheet holds), or a cell more characters than one holds: nothing is cut."""
    if not 0 < rows <= ROWS:
        raise ValueError(f"rows must be from 1 to {ROWS}")
    if not sheets or any(not n or len(n) > 31 or re.search(r"[\[\]:*?/\\]", n) for n in sheets) or len({n.lower() for n in sheets}) < len(sheets):
        raise ValueError("sheets need distinct names of 1 to 31 characters without []:*?/\\")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts, names, links, kinds = {}, [], [], []
    for n, (name, df) in enumerate(sheets.items(), 1):
        got = df.limit(rows + 1).collect()  # bounded by ``rows``
        if len(got) > rows:
            raise ValueError(f"{name} has more than {rows} rows")
        lines = []
        for i, row in enumerate([tuple(df.columns), *got], 1):
            for v in row:
                if isinstance(v, str) and len(v) > CHARS:
                    raise ValueError(f"{name} has a cell of more than {CHARS} characters")
            lines.append(f'<row r="{i}">' + "".join(_cell(f"{_name(j)}{i}", v) for j, v in enumerate(row)) + "</row>")
        parts[f"xl/worksheets/sheet{n}.xml"] = f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        names.append(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>')
        links.append(f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>')
        kinds.append(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
    parts["xl/workbook.xml"] = f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(names)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'{head}<Relationships xmlns="{package}/relationships">{"".join(links)}</Relationships>'
    parts["_rels/.rels"] = f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["[Content_Types].xml"] = f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(kinds)}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], path: str, rows: int = 100_000) -> None:
    """The workbook as one file in any file system that the session knows; an existing file is not overwritten."""
    content = workbook(sheets, rows)
    spark = next(iter(sheets.values())).sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
