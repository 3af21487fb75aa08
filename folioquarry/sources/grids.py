"""Tables within files as grids of text, and containers with what is in them.

A grid is struct(caption, rows): rows of cells as text, null where a cell is missing. Delimited files, pipe tables of
Markdown, tables of HTML, workbook sheets and document tables give grids; the last two are read from the XML parts of
their archives with the standard library. Archives and mail attachments are expanded to any depth: each member is a row
that names its parent, and what cannot be read is a row with an error.

Defined cases: empty files give no grid; rows shorter than the widest are filled with nulls; a container's members beyond
``max_members``, members over ``max_bytes``, and what would bring a file's members beyond ``max_total`` bytes or below
``max_depth`` levels come out with an error (an archive may hold itself); dot files are passed over.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from folioquarry.sources import textlike

DELIMITERS = ",;\t|"
GRID = "array<struct<caption: string, rows: array<array<string>>>>"
EXPANDED = f"path string, parent string, parser string, text string, error string, sha256 string, grids {GRID}"


def filled(rows: list[list[str | None]]) -> list[list[str | None]]:
    width = max(map(len, rows), default=0)
    return [[*r, *[None] * (width - len(r))] for r in rows]


def delimiter_of(text: str) -> str:
    """The delimiter that gives most of the first lines the same number of fields, more than one; a comma where none does."""
    best = (0.0, 0, ",")
    for d in DELIMITERS:
        widths = Counter(len(r) for _, r in zip(range(50), csv.reader(io.StringIO(text[:100_000]), delimiter=d)) if r)
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        if width > 1:
            best = max(best, (n / sum(widths.values()), width, d))
    return best[2]


def csv_grid(text: str, caption: str | None = None) -> list[tuple[str | None, list]]:
    csv.field_size_limit(1 << 30)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter_of(text)) if any(x.strip() for x in r)]
    return [(caption, filled(rows))] if rows else []


def markdown_grids(text: str) -> list[tuple[str | None, list]]:
    """Pipe tables, each under the heading in force."""
    out, heading = [], None
    for kind, body, _ in textlike._markdown(text):
        if kind == "heading":
            heading = body
        elif kind == "table":
            out.append((heading, filled([[c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))] for line in body.split("\n")])))
    return out


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[tuple[str | None, list]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "caption": None, "into": None})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th", "caption"):
            t = self.open[-1]
            t["into"] = tag
            if tag == "caption":
                t["caption"] = ""
            else:
                if not t["rows"]:
                    t["rows"].append([])
                span = dict(attrs).get("colspan") or "1"
                t["span"] = min(int(span), 1000) if span.isdigit() else 1
                t["rows"][-1].append("")

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th") and t["into"] in ("td", "th"):
            t["rows"][-1][-1] = " ".join(t["rows"][-1][-1].split())
            t["rows"][-1] += [t["rows"][-1][-1]] * (t["span"] - 1)
        if tag in ("td", "th", "caption"):
            t["into"] = None
        elif tag == "table":
            self.open.pop()
            rows = [r for r in t["rows"] if r]
            if rows:
                self.done.append((None if t["caption"] is None else " ".join(t["caption"].split()), filled(rows)))

    def handle_data(self, data):
        if self.open and (t := self.open[-1])["into"]:
            if t["into"] == "caption":
                t["caption"] += data
            else:
                t["rows"][-1][-1] += data


def html_grids(html: str) -> list[tuple[str | None, list]]:
    p = _Tables()
    p.feed(html)
    p.close()
    return p.done


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(e, name: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == name)


def workbook(content: bytes) -> tuple[str, list[tuple[str | None, list]]]:
    """Text and grids of a workbook's sheets, in the workbook's order."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = [_texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(e) == "si"] if "xl/sharedStrings.xml" in names else []
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    grids = []
    for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
        target = next((links[v] for k, v in sheet.attrib.items() if k.endswith("}id") and v in links), None)
        part = None if target is None else target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part not in names:
            continue
        rows: list[list[str | None]] = []
        for r in (e for e in ElementTree.fromstring(z.read(part)).iter() if _local(e) == "row"):
            row: list[str | None] = []
            for c in (e for e in r if _local(e) == "c"):
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r") or "").group():
                    at = at * 26 + ord(letter) - 64
                row += [None] * (min(at, 16384) - 1 - len(row))
                value = next((x.text for x in c if _local(x) == "v"), None)
                kind = c.get("t")
                row.append(shared[int(value)] if kind == "s" and value is not None else _texts(c) if kind == "inlineStr" else value)
            if any(x not in (None, "") for x in row):
                rows.append(row)
        if rows:
            grids.append((sheet.get("name"), filled(rows)))
    return "\n\n".join("\n".join([name or "", *("\t".join(x or "" for x in r) for r in rows)]) for name, rows in grids), grids


def document(content: bytes) -> tuple[str, list[tuple[str | None, list]]]:
    """Text and tables of a word processor's document, each table under the paragraph before it that is a heading."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = next((e for e in body if _local(e) == "body"), body)
    lines, grids, heading = [], [], None

    def line(p) -> str:
        return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in p.iter())

    for e in body:
        if _local(e) == "p":
            lines.append(line(e))
            style = next((v for x in e.iter() if _local(x) == "pStyle" for v in x.attrib.values()), "")
            heading = lines[-1].strip() if style.lower().startswith(("heading", "title", "berschrift", "überschrift")) else heading
        elif _local(e) == "tbl":
            rows = [[" ".join(filter(None, (line(p).strip() for p in c.iter() if _local(p) == "p"))) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            if rows:
                grids.append((heading, filled(rows)))
                lines += ["\t".join(r) for r in rows]
    return "\n".join(lines).strip("\n"), grids


def slides(content: bytes) -> tuple[str, list]:
    z = zipfile.ZipFile(io.BytesIO(content))
    parts = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
    pages = ["\n".join(t for p in ElementTree.fromstring(z.read(n)).iter() if _local(p) == "p" and (t := _texts(p)).strip()) for n in parts]
    return "\n\n".join(p for p in pages if p), []


OFFICE = {"xlsx": workbook, "docx": document, "pptx": slides}


def read(name: str, parser: str | None, content: bytes, injected: dict) -> tuple[str, list, list[tuple[str, bytes]]]:
    """(text, grids, members) of one file; raises where it can't be read."""
    suffix = name.rsplit(".", 1)[-1].lower()
    if parser in injected:
        return injected[parser](content), [], []
    if parser == "zip":
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in z.infolist() if not i.is_dir() and not i.filename.rsplit("/", 1)[-1].startswith(".") and not i.filename.startswith("__MACOSX")]
        return "", [], [(i.filename, i.file_size, lambda i=i: z.read(i)) for i in infos]
    if parser == "eml":
        m = textlike.read_mail(content)
        lines = [m["subject"] or "", *(f"{k}: {m[v]}" for k, v in (("From", "sender"), ("To", "recipient"), ("Cc", "cc"), ("Date", "sent")) if m[v]), m["body"], *(f"[attachment: {a}]" for a in m["attachments"])]
        parts = email.message_from_bytes(content, policy=email.policy.default).iter_attachments()
        members = []
        for p in parts:
            data = p.get_content().as_bytes() if p.get_content_type() == "message/rfc822" else p.get_payload(decode=True) or b""
            name = p.get_filename() or ("message.eml" if p.get_content_type() == "message/rfc822" else "attachment")
            members.append((name, len(data), lambda data=data: data))
        return "\n".join(lines), [], members
    if parser == "office" and suffix in OFFICE:
        return *OFFICE[suffix](content), []
    if parser in ("text", "csv", "json", "markdown", "html"):
        text = content.decode("utf-8-sig", "replace").replace("\r\n", "\n")
        if parser == "html":
            return textlike.visible(text), html_grids(text), []
        return text, csv_grid(text) if parser == "csv" else markdown_grids(text) if parser == "markdown" else [], []
    raise ValueError("no parser for this suffix" if parser is None else f"parser {parser} must be injected")


def parser_name(path: str) -> str | None:
    s = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return next((p for p, kinds in textlike.SUFFIXES.items() if s in kinds), None)


def family(path: str, content: bytes, injected: dict, max_members: int = 200, max_bytes: int = 50 << 20, max_total: int = 500 << 20, max_depth: int = 20) -> Iterator[tuple]:
    """Rows of a file and of all that is in it, parents first."""
    total, stack = 0, [(path, None, content, 0, None)]
    while stack:
        at, parent, data, depth, error = stack.pop()
        text, grids, members, parser = None, [], [], parser_name(at)
        if error is None:
            try:
                text, grids, members = read(at, parser, data, injected)
            except Exception as e:  # one bad file must not end the job
                error = str(e) if isinstance(e, ValueError) and "pars" in str(e) else f"{type(e).__name__}: {e}"
        yield at, parent, parser, text, None if error is None else error[:300], None if data is None else hashlib.sha256(data).hexdigest(), [{"caption": c, "rows": r} for c, r in grids]
        seen: Counter = Counter()
        below = []
        for k, (name, size, load) in enumerate(members):
            seen[name] += 1
            child = f"{at}::{name}" if seen[name] == 1 else f"{at}::{seen[name]}::{name}"
            why = "too many members" if k >= max_members else "member too large" if size > max_bytes else "too much in one file" if total + size > max_total else "too deep" if depth >= max_depth else None
            inner = None
            if why is None:
                try:
                    inner = load()
                    total += len(inner)
                except Exception as e:
                    why = f"{type(e).__name__}: {e}"
            below.append((child, at, inner, depth + 1, why))
        stack += reversed(below)


def expand(files: DataFrame, injected: dict | None = None, **limits) -> DataFrame:
    """``path``, ``parent``, ``parser``, ``text``, ``error``, ``sha256``, ``grids`` of files (path, content) and all that is in them, to any depth."""
    given = injected or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if content is not None:
                    yield pd.DataFrame(list(family(path, bytes(content), given, **limits)), columns=["path", "parent", "parser", "text", "error", "sha256", "grids"])

    return files.select("path", "content").mapInPandas(run, EXPANDED)
