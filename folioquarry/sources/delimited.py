"""Delimited rows by table layout: valid rows typed, others apart with the first reason that holds.

A batch of raw lines is laid into one byte buffer. Numpy masks of the quotes and their prefix parity (restarted at
every record) tell which delimiters stand outside quotes; field bounds, field counts and the quoting rules follow
from array arithmetic, without a loop over characters.

Reasons, in order: ``layout`` (no layout of that name, or one that lacks what its columns need), ``quoting``,
``column_count``, ``value``.

A number is loaded exactly or not at all: cells of valid rows whose number has more than 28 digits before or 10 after
the decimal mark keep it as ``text`` and have a null ``number``.

Defined cases: a null line counts as an empty line; an empty line is one empty field; a null or unknown
``table_name`` gives ``layout``; repeated rows are judged each by itself; extra columns of the input are kept aside
(only ``row_key`` and the columns named in ``keep`` come out); an empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens that are nulls of every type, currency signs, English month names.
NULL_TOKENS = frozenset({"", "-", "n/a", "nil"})
CURRENCY = "$€£"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
BLANKS = " \t\r\n "

CELL_SCHEMA = "array<struct<name: string, type: string, text: string, number: decimal(38,10), day: date>>"
_QUOTE = 34
_INTEGER = re.compile(r"-?[0-9]+")


def date_pattern(date_format: str) -> tuple[re.Pattern, tuple[str, ...]]:
    """A regular expression for a ``yyyy MM MMM MMMM dd d`` format and the order of its parts."""
    parts, out = [], ""
    for piece in re.findall(r"y+|M+|d+|[^yMd]+", date_format or ""):
        if piece[0] == "y":
            out, parts = out + f"([0-9]{{{len(piece)}}})", [*parts, "y"]
        elif piece[0] == "d":
            out, parts = out + ("([0-9]{2})" if len(piece) == 2 else "([1-9][0-9]?)"), [*parts, "d"]
        elif piece in ("MM", "M"):
            out, parts = out + ("([0-9]{2})" if len(piece) == 2 else "([1-9][0-9]?)"), [*parts, "M"]
        elif piece[0] == "M":
            out, parts = out + "([A-Za-z]+)", [*parts, "N" if len(piece) == 3 else "L"]
        else:
            out += re.escape(piece)
    return re.compile(out), tuple(parts)


_LONG = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def parse_day(value: str, pattern: re.Pattern, parts: tuple[str, ...]) -> dt.date | None:
    """The day that ``value`` names, or None where it isn't exactly in the format or doesn't exist."""
    m = pattern.fullmatch(value)
    if not m:
        return None
    y, mo, d = 1, 1, 1
    for kind, text in zip(parts, m.groups()):
        if kind == "y":
            y = int(text)
        elif kind == "d":
            d = int(text)
        elif kind == "M":
            mo = int(text)
        else:
            names = MONTHS if kind == "N" else _LONG
            if text not in names:
                return None
            mo = names.index(text) + 1
    try:
        return dt.date(y, mo, d)
    except ValueError:
        return None


def amount_pattern(decimal_mark: str) -> re.Pattern:
    """Amounts by a layout's decimal mark; the other of ``.`` and ``,`` sets off groups of three."""
    group = "," if decimal_mark == "." else "."
    digits = rf"(?:[0-9]{{1,3}}(?:{re.escape(group)}[0-9]{{3}})+|[0-9]+)(?:{re.escape(decimal_mark)}[0-9]+)?"
    sign = f"[{re.escape(CURRENCY)}]?"
    return re.compile(rf"-?{sign}{digits}|\({sign}{digits}\)")


def amount_value(value: str, decimal_mark: str) -> str:
    """A matched amount as a plain decimal string."""
    negative = value[:1] in "-("
    body = re.sub(rf"[^0-9{re.escape(decimal_mark)}]", "", value).replace(decimal_mark, ".")
    return ("-" if negative else "") + body


class StructuralIndex:
    """Field bounds and quoting of many records that share a delimiter."""

    def __init__(self, lines: list[str], delimiter: str):
        coded = [x.encode("utf-8", "surrogatepass") for x in lines]
        self.raw = b"".join(coded)
        n = len(coded)
        self.buf = buf = np.frombuffer(self.raw, dtype=np.uint8)
        lens = np.fromiter(map(len, coded), dtype=np.int64, count=n)
        ends = np.cumsum(lens)
        starts = ends - lens
        quote = buf == _QUOTE
        seen = np.zeros(len(buf) + 1, dtype=np.int64)  # quotes before each position
        np.cumsum(quote, out=seen[1:])
        delim = delimiter.encode()
        if len(delim) == 1:
            at = np.flatnonzero(buf == delim[0])
        else:  # a delimiter of several bytes: positions of its first byte
            at = np.array([m.start() for m in re.finditer(re.escape(delim), self.raw)], dtype=np.int64)
        rec = np.searchsorted(ends, at, side="right")
        outside = ((seen[at] - seen[starts[rec]]) & 1) == 0
        at, rec = at[outside], rec[outside]
        self.counts = np.bincount(rec, minlength=n) + 1
        # Fields in order of their start: one at each record start, one after each delimiter that stands outside quotes.
        f_start = np.concatenate([starts, at + len(delim)])
        f_rec = np.concatenate([np.arange(n), rec])
        order = np.lexsort((f_start, f_rec))
        self.f_start, self.f_rec = f_start[order], f_rec[order]
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.f_end = np.empty(len(order), dtype=np.int64)
        if n:
            self.f_end[:-1] = self.f_start[1:] - len(delim)
            self.f_end[self.first + self.counts - 1] = ends
        self.quotes = seen[self.f_end] - seen[self.f_start]
        self.bad_quotes = np.zeros(n, dtype=bool)
        held = np.flatnonzero(self.quotes > 0)
        if len(held):
            s, e, q = self.f_start[held], self.f_end[held], self.quotes[held]
            bad = (buf[s] != _QUOTE) | (buf[e - 1] != _QUOTE) | (q & 1 == 1)
            # Within a quoted field, quotes 1 and 2, 3 and 4, ... must be neighbours, all but the last.
            where = np.flatnonzero(quote)
            field = np.searchsorted(self.f_start, where, side="right") - 1
            nth = seen[where] - seen[self.f_start[field]]
            inner = (nth & 1 == 1) & (nth < self.quotes[field] - 1)
            nxt = np.append(where[1:], -1)
            apart = inner & (nxt != where + 1)
            self.bad_quotes[self.f_rec[held[bad]]] = True
            self.bad_quotes[self.f_rec[field[apart]]] = True

    def field(self, k: int) -> str:
        s, e = self.f_start[k], self.f_end[k]
        if self.quotes[k]:
            return self.raw[s + 1 : e - 1].decode("utf-8", "surrogatepass").replace('""', '"')
        return self.raw[s:e].decode("utf-8", "surrogatepass")


def judge_lines(lines: list[str], types: list[str], delimiter: str, date_format: str, decimal_mark: str, typed: bool = False):
    """Reason per line (None where valid) and, with ``typed``, the cells of the valid lines."""
    index = StructuralIndex(lines, delimiter)
    reason = np.full(len(lines), None, dtype=object)
    reason[index.counts != len(types)] = "column_count"
    reason[index.bad_quotes] = "quoting"
    fine = np.flatnonzero(reason == None)  # noqa: E711
    day_re, parts = date_pattern(date_format)
    money = amount_pattern(decimal_mark)
    days: dict[str, dt.date | None] = {}
    cells: list[list | None] = [None] * len(lines) if typed else []
    if typed:
        for i in fine:
            cells[i] = [None] * len(types)
    for j, kind in enumerate(types):
        if kind == "text" and not typed:
            continue
        for i in fine:
            value = index.field(index.first[i] + j).strip(BLANKS)
            number = day = None
            ok = True
            if value.lower() in NULL_TOKENS:
                value = None
            elif kind == "date":
                if value not in days:
                    days[value] = parse_day(value, day_re, parts)
                day = days[value]
                ok = day is not None
            elif kind == "integer":
                ok = _INTEGER.fullmatch(value) is not None
                number = value
            elif kind == "amount":
                ok = money.fullmatch(value) is not None
                number = amount_value(value, decimal_mark) if ok and typed else None
            if not ok:
                reason[i] = "value"
            elif typed:
                cells[i][j] = (kind, value, number, day)
    return reason, cells


def exact_number(value: str | None):
    """The number as ``number`` of a cell: exact within 28 digits before and 10 after the mark, else null."""
    from decimal import Context, Decimal

    if value is None:
        return None
    x = Decimal(value)
    scaled = x.quantize(Decimal("1e-10"), context=Context(prec=len(value) + 12))
    return scaled if scaled == x and len(scaled.as_tuple().digits) <= 38 else None


def _spec() -> F.Column:
    """A layout as one string, so that each row carries a single extra column to Python; null where it lacks what its columns need."""
    has = lambda kind: F.coalesce(F.array_contains("col_types", kind), F.lit(False))
    whole = (F.length("delimiter") > 0) & (F.size("col_types") > 0) & (F.size("header") == F.size("col_types")) & ~F.exists("col_types", lambda t: F.coalesce(~t.isin("date", "amount", "integer", "text"), F.lit(True)))
    whole = whole & (~has("date") | F.coalesce(F.length("date_format") > 0, F.lit(False))) & (~has("amount") | F.coalesce(F.col("decimal_mark").isin(".", ","), F.lit(False)))
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("delimiter"), F.col("date_format"), F.col("decimal_mark"), F.array_join("col_types", ","), F.array_join("header", "\x1e", ""))]
    return F.when(whole, F.concat_ws("\x1f", *parts))


def load_rows(raw_rows: DataFrame, raw_tables: DataFrame, typed: bool = True, keep: tuple[str, ...] = ("table_name", "doc_id", "page", "row_idx")) -> DataFrame:
    """``row_key``, the columns in ``keep``, ``reason`` (null: valid) and, with ``typed``, ``cells`` of valid rows.

    The layouts are joined on ``table_name`` on the JVM side (Catalyst picks the join; AQE splits a hot table name), so
    neither the layouts nor the rows pass through the driver, and every task judges whatever rows its split holds.
    """
    layouts = raw_tables.select(F.col("table_name").alias("_layout"), _spec().alias("_spec")).dropDuplicates(["_layout"])
    rows = raw_rows.select("row_key", *keep, F.coalesce("raw_line", F.lit("")).alias("_line"), F.col("table_name").alias("_of"))
    kept = ("row_key", *keep)  # they pass Python as strings: whole numbers with nulls would become floats there
    joined = rows.join(layouts, F.col("_of") == F.col("_layout"), "left").select(*[F.col(c).cast("string").alias(c) for c in kept], "_line", "_spec")
    types = {f.name: f.dataType.simpleString() for f in raw_rows.schema.fields}
    schema = ", ".join([*(f"`{c}` string" for c in kept), "reason string"] + ([f"cells {CELL_SCHEMA}"] if typed else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reason = np.full(len(pdf), "layout", dtype=object)
            cells = np.full(len(pdf), None, dtype=object)
            for spec, at in pdf.groupby("_spec", sort=False).indices.items():
                delimiter, date_format, mark, kinds, header = spec.split("\x1f")
                names = header.split("\x1e")
                got, values = judge_lines(pdf["_line"].iloc[at].tolist(), kinds.split(","), delimiter, date_format, mark, typed)
                reason[at] = got
                if typed:
                    for i, row, why in zip(at, values, got):
                        if why is None:
                            cells[i] = [{"name": n, "type": k, "text": v, "number": exact_number(x), "day": d} for n, (k, v, x, d) in zip(names, row)]
            out = pdf[["row_key", *keep]].copy()
            out["reason"] = reason
            if typed:
                out["cells"] = cells
            yield out

    out = joined.mapInPandas(run, schema)
    return out.select(*[F.col(c).cast(types[c]).alias(c) for c in kept], "reason", *(["cells"] if typed else []))


def split_rows(raw_rows: DataFrame, raw_tables: DataFrame) -> DataFrame:
    """``table_name``, ``row_key`` and ``fields`` of every row whose table has a layout, split where its delimiter stands outside quotes.

    Badly quoted rows are split by the same parity, their fields as delivered. A null line is one empty field.
    """
    layouts = raw_tables.select(F.col("table_name").alias("_layout"), F.col("delimiter").alias("_delimiter")).dropDuplicates(["_layout"])
    rows = raw_rows.select(F.col("row_key").cast("string").alias("row_key"), "table_name", F.coalesce("raw_line", F.lit("")).alias("_line"))
    joined = rows.join(layouts, F.col("table_name") == F.col("_layout")).select("row_key", "table_name", "_line", "_delimiter")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fields = np.full(len(pdf), None, dtype=object)
            for delimiter, at in pdf.groupby("_delimiter", sort=False).indices.items():
                index = StructuralIndex(pdf["_line"].iloc[at].tolist(), delimiter)
                for i, k, n, bad in zip(at, index.first, index.counts, index.bad_quotes):
                    fields[i] = [index.raw[index.f_start[f] : index.f_end[f]].decode("utf-8", "surrogatepass") if bad else index.field(f) for f in range(k, k + n)]
            out = pdf[["row_key", "table_name"]].copy()
            out["fields"] = fields
            yield out

    out = joined.mapInPandas(run, "row_key string, table_name string, fields array<string>")
    return out.select("table_name", F.col("row_key").cast(raw_rows.schema["row_key"].dataType).alias("row_key"), "fields")


def judge_outcomes(outcomes: DataFrame) -> DataFrame:
    """``outcome_id`` and ``reason`` (null: valid) of ingest outcomes; repeated rows come out once.

    Valid is ``parsed`` with a document and without an error, or ``parse_failed`` without a document and with an error,
    and 0 <= untranscribed <= total scanned pages. Nulls in the counts or the status make a row invalid.
    """
    parsed = (F.col("status") == "parsed") & F.col("doc_id").isNotNull() & F.col("error").isNull()
    failed = (F.col("status") == "parse_failed") & F.col("doc_id").isNull() & F.col("error").isNotNull()
    pages = (F.col("scanned_pages_untranscribed") >= 0) & (F.col("scanned_pages_untranscribed") <= F.col("scanned_pages_total"))
    valid = F.coalesce((parsed | failed) & pages, F.lit(False))
    return outcomes.select(F.col("outcome_id"), F.when(~valid, F.lit("value")).alias("reason")).distinct()


def rejects(raw_rows: DataFrame, raw_tables: DataFrame, outcomes: DataFrame) -> DataFrame:
    """All rows that fail: ``origin``, ``record_key``, ``reason``."""
    rows = load_rows(raw_rows, raw_tables, typed=False, keep=()).where("reason is not null")
    bad = judge_outcomes(outcomes).where("reason is not null")
    return rows.select(F.lit("raw_rows").alias("origin"), F.col("row_key").cast("string").alias("record_key"), "reason").unionByName(
        bad.select(F.lit("ingest_outcomes").alias("origin"), F.col("outcome_id").cast("string").alias("record_key"), "reason")
    )
