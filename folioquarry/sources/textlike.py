"""Parsers of text-like files into elements, and line and page tables.

An element is struct(kind, text, level): kind is heading, text, table or code; level is a heading's depth. Column
expressions where Spark can say it; Arrow UDFs for the line machines of Markdown, HTML and mail.
Null texts give null or no rows; empty texts give no elements.
"""

from __future__ import annotations

import email
import email.policy
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

ELEMENTS = ArrayType(StructType().add("kind", StringType()).add("text", StringType()).add("level", IntegerType()))

# File suffixes by the parser that reads them.
SUFFIXES = {
    "text": ("txt", "log", "text"), "markdown": ("md", "markdown"), "html": ("html", "htm", "xhtml"), "eml": ("eml",), "msg": ("msg",), "zip": ("zip",), "csv": ("csv", "tsv"),
    "office": ("docx", "doc", "pptx", "ppt", "xlsx", "xls", "odt", "ods", "odp", "rtf", "epub"), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp"), "json": ("json", "jsonl"),
}
OPTIONAL = ("msg", "office", "pdf", "image")  # they need an injected parser


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parser_for(path: Column) -> Column:
    """Name of the parser by a path's suffix; null where none reads it."""
    s, out = suffix(path), F.lit(None).cast("string")
    for name, kinds in SUFFIXES.items():
        out = F.when(s.isin(*kinds), name).otherwise(out)
    return out


def needs_scan(text: Column) -> Column:
    """Whether a page has too little text to be more than a scan."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 50


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed; blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def paragraph_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, F.posexplode(paragraphs(F.col("text"))).alias("seq", "text"))


def line_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``line_no`` from 1 and ``text`` of every line that isn't blank."""
    return docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "").select(id_col, (F.col("pos") + 1).alias("line_no"), "text")


def _markdown(text: str) -> list[tuple[str, str, int | None]]:
    out, buf, rows, fence, code = [], [], [], None, []

    def flush() -> None:
        if buf:
            out.append(("text", " ".join(buf), None))
            buf.clear()
        if rows:
            out.append(("table", "\n".join(rows), None))
            rows.clear()

    for line in text.split("\n"):
        s = line.strip()
        if fence:
            if s.startswith(fence):
                out.append(("code", "\n".join(code), None))
                fence, code = None, []
            else:
                code.append(line)
        elif m := re.match(r"(```+|~~~+)", s):
            flush()
            fence = m.group(1)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", s):
            flush()
            out.append(("heading", m.group(2), len(m.group(1))))
        elif s.startswith("|") and s.endswith("|") and len(s) > 1:
            if buf:
                flush()
            if not re.fullmatch(r"[|:\s-]+", s):
                rows.append(s)
        elif not s:
            flush()
        else:
            if rows:
                flush()
            buf.append(s)
    if fence and code:
        out.append(("code", "\n".join(code), None))
    flush()
    return out


@F.pandas_udf(ELEMENTS)
def markdown_elements(texts: pd.Series) -> pd.Series:
    """ATX headings, pipe tables, fenced code and paragraphs."""
    return texts.map(lambda t: [{"kind": k, "text": x, "level": n} for k, x, n in _markdown(t)], na_action="ignore")


_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_SKIP = frozenset(("script", "style", "head", "noscript", "template"))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in _SKIP
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def visible(html: str) -> str:
    p = _Visible()
    p.feed(html)
    p.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """Text of a page without scripts, styles and head; block tags end lines; blank lines collapse."""
    return html.map(visible, na_action="ignore")


EMAIL = StructType([StructField(n, StringType()) for n in ("subject", "sender", "recipient", "cc", "sent", "body")] + [StructField("attachments", ArrayType(StringType()))])


def read_mail(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    part = m.get_body(preferencelist=("plain", "html"))
    body = ""
    if part is not None:
        try:
            body = part.get_content()
        except (LookupError, ValueError):
            body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
        if part.get_content_subtype() == "html":
            body = visible(body)
    head = {k: None if m[k] is None else str(m[k]) for k in ("subject", "from", "to", "cc", "date")}
    return {"subject": head["subject"], "sender": head["from"], "recipient": head["to"], "cc": head["cc"], "sent": head["date"], "body": body.replace("\r\n", "\n").strip("\n"), "attachments": [a.get_filename() or "attachment" for a in m.iter_attachments()]}


@F.pandas_udf(EMAIL)
def mail_parts(raw: pd.Series) -> pd.DataFrame:
    """Headers, best body and attachment names of RFC 822 bytes."""
    cols = ["subject", "sender", "recipient", "cc", "sent", "body", "attachments"]
    return pd.DataFrame([read_mail(r) if r is not None else dict.fromkeys(cols) for r in raw], columns=cols)


def mail_headers(text: Column) -> dict[str, Column]:
    """Header fields of an email rendered as text: subject line first, then From, To, Cc and Date lines."""

    def one(name: str) -> Column:
        v = F.regexp_extract(text, rf"(?m)\A[^\n]*(?:\n(?:From|To|Cc|Date): [^\n]*)*?\n{name}: ([^\n]*)", 1)
        return F.when(v != "", v)

    return {"subject": F.substring_index(text, "\n", 1), "sender": one("From"), "recipient": one("To"), "cc": one("Cc"), "sent": one("Date")}


def image_rows(files: DataFrame) -> DataFrame:
    """Images have no text: one row each, to be transcribed."""
    return files.where(parser_for(F.col("path")) == "image").select("path", F.lit("").alias("text"), F.lit(True).alias("needs_transcription"))


def unique_ids(df: DataFrame, base: str, order: str, out: str = "doc_uid") -> DataFrame:
    """Distinct ids from base ids: the first keeps its base, later ones get ``_2``, ``_3`` and so on, in order of a whole number that is unique."""
    from folioquarry.operators.temporal import numbered

    d = numbered(df, base, order, "_nth")
    return d.withColumn(out, F.when(F.col("_nth") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("_nth").cast("string")))).drop("_nth")


def read_files(spark, path: str, glob: str = "*") -> DataFrame:
    """Files as rows with their identity, digest and parser; bytes are read by the tasks."""
    from folioquarry.functions.text import stat_identity

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select("path", "length", "modificationTime", "content", F.sha2("content", 256).alias("sha256"), stat_identity(F.col("path"), F.col("length"), F.col("modificationTime")).alias("source_identity"), parser_for(F.col("path")).alias("parser"))
