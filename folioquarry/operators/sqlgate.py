"""SQL from outside: one predicate over one table, or one selection over registered views, checked before it runs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions a predicate may call, and words it may not hold.
FUNCTIONS = frozenset("abs round lower upper length substr substring trim ltrim rtrim coalesce ifnull nullif like ilike glob typeof instr min max count sum avg least greatest in and or not between is null case when then else end cast".split())
FORBIDDEN = re.compile(r"(?i)\b(select|union|intersect|except|insert|update|delete|drop|alter|create|attach|pragma|with|into|from|join|exists)\b|;|--|/\*")
MAX_PREDICATE, MAX_SELECTION = 10_000, 8_000


def _bare(sql: str) -> str:
    return re.sub(r"'(?:[^']|'')*'", "''", sql)


def where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows by a predicate without subqueries and set operations, calling allowed functions only; ValueError otherwise."""
    if not predicate.strip() or len(predicate) > MAX_PREDICATE:
        raise ValueError("the predicate is empty or too long")
    bare = _bare(predicate)
    if FORBIDDEN.search(bare):
        raise ValueError("a predicate may hold no statement, subquery, set operation or comment")
    odd = {f.lower() for f in re.findall(r"([A-Za-z_]\w*)\s*\(", bare)} - FUNCTIONS
    if odd:
        raise ValueError(f"functions not allowed: {sorted(odd)}")
    return df.where(F.expr(predicate))


def select(spark: SparkSession, views: dict[str, DataFrame], sql: str, arity: int | None = None) -> DataFrame:
    """One SELECT or WITH over the given views and nothing else, of ``arity`` columns."""
    text = sql.strip()
    if not text or len(text) > MAX_SELECTION or ";" in _bare(text) or not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("one SELECT or WITH statement, of at most 8000 characters")
    if re.search(r"(?i)\b(insert|update|delete|drop|alter|create|attach|pragma|parquet|json|csv|text|binaryfile|java_method|reflect)\b\s*[.`(]", _bare(text)):
        raise ValueError("only registered views may be read")
    names = {}
    for name, df in views.items():
        names[name] = f"fq_{name}_{uuid.uuid4().hex[:8]}"
        df.createOrReplaceTempView(names[name])
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith\b|,)\s*([A-Za-z_]\w*)\s+as\s*\(", _bare(text))}
    used = {t.lower() for t in re.findall(r"(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)", _bare(text))}
    if strange := used - {n.lower() for n in views} - ctes:
        raise ValueError(f"unknown views: {sorted(strange)}")
    for name, real in names.items():
        text = re.sub(rf"(?i)(\b(?:from|join)\s+){re.escape(name)}\b(?!\s*\.)", rf"\1{real} as {name}", text)
    text = re.sub(r"(?i)\bas (\w+) as (\w+)\b", r"as \2", text)
    out = spark.sql(text)
    if arity is not None and len(out.columns) != arity:
        raise ValueError(f"the selection has {len(out.columns)} columns, not {arity}")
    return out
