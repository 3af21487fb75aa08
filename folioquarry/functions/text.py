"""Text functions as Column expressions; Arrow UDFs only where Spark has no expression for the meaning."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Fixed values of the query language: its token pattern, number pattern, year pattern and stop words.
TOKEN = r"[A-Za-z][A-Za-z0-9_-]{2,}|\b\d+(?:[,.]\d+)*\b"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
YEAR = r"(?<!\d)[12]\d{3}(?!\d)"
STOP_WORDS = ("the", "and", "for", "was", "were", "with", "what", "which", "how", "many", "much", "does", "did")


def extract_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def terms(query: Column, head: int = 12) -> Column:
    """Distinct query terms in order: the first ``head`` that aren't stop words, and all numeric ones. Null for null."""
    found = F.filter(extract_all(query, TOKEN), lambda t: ~F.lower(t).isin(*STOP_WORDS))
    return F.array_distinct(F.concat(F.slice(found, 1, head), F.filter(found, lambda t: t.rlike(r"^\d"))))


def numbers(query: Column) -> Column:
    """All numbers of a query as doubles, thousands commas taken off."""
    return F.transform(extract_all(query, NUMBER), lambda t: F.replace(t, F.lit(","), F.lit("")).cast("double"))


def years(text: Column) -> Column:
    return F.array_distinct(extract_all(text, YEAR))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, as the full-text index has them."""
    return extract_all(F.lower(text), r"[\p{L}\p{N}_]+")


def dedup_tokens(text: Column) -> Column:
    """Lower-case ASCII tokens of two characters and more, with repetitions."""
    return extract_all(F.lower(text), r"[a-z0-9]{2,}")


def slug(text: Column, size: int = 48) -> Column:
    """A document id from a file stem: lower case, other characters to underscores, at most ``size`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, size)


def identifier(header: Column) -> Column:
    """A column name from header text: snake case, ``c_`` before a leading digit, ``column`` for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(header)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s.isNull() | (s == ""), "column").when(s.rlike("^[0-9]"), F.concat(F.lit("c_"), s)).otherwise(s)


_DASHES = "‐‑‒–—―−﹘﹣－"
_QUOTES_1, _QUOTES_2 = "‘’‚‛´`", "“”„‟«»"


def quote_key(text: Column) -> Column:
    """Text as quotations are compared by built-in functions: dashes and quotes folded, white space runs to one space, lower case.

    Compatibility forms and full case folding need ``quote_key_full``.
    """
    folded = F.translate(text, _DASHES + _QUOTES_1 + _QUOTES_2, "-" * len(_DASHES) + "'" * len(_QUOTES_1) + '"' * len(_QUOTES_2))
    return F.lower(F.trim(F.regexp_replace(folded, r"\s+", " ")))


_FOLD = str.maketrans(_DASHES + _QUOTES_1 + _QUOTES_2, "-" * len(_DASHES) + "'" * len(_QUOTES_1) + '"' * len(_QUOTES_2))


def fold_quote(text: str | None) -> str | None:
    """One text by ``quote_key`` with compatibility forms per character and full case folding."""
    if text is None:
        return None
    return " ".join("".join(unicodedata.normalize("NFKC", c) for c in text.translate(_FOLD)).translate(_FOLD).split()).casefold()


@F.pandas_udf(StringType())
def quote_key_full(texts: pd.Series) -> pd.Series:
    return texts.map(fold_quote, na_action="ignore")


_BOXES = "☐☑☒✓✗"


def label_key(value: Column) -> Column:
    """An answer label without check boxes, underscores, case and outer punctuation; '' for null."""
    t = F.translate(F.coalesce(value, F.lit("")), _BOXES + "_", " " * (len(_BOXES) + 1))
    return F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+", " "), r"^[ .!`*\"'\t\n]+|[ .!`*\"'\t\n]+$", "")


def comparison_key(value: Column) -> Column:
    """Equality of answers for votes: lower case, only value punctuation kept."""
    t = F.translate(F.coalesce(value, F.lit("")), _BOXES, " " * len(_BOXES))
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s/@.:$%-]", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .]+|[ .]+$", "")


# Labels that mean absence or that nothing applies.
ABSENT = ("", "none", "nil", "unknown", "blank", "leave blank", "not reached", "not specified", "needs review")
NOT_APPLICABLE = ("n/a", "na", "not applicable")


def answer_kind(value: Column, not_found: str = "not found in matter corpus") -> Column:
    """value, affirmative, negative, absent or not_applicable."""
    k = label_key(value)
    absent = k.isin(*ABSENT)
    for p in ("not found", not_found.lower()):
        absent = absent | (k == p) | k.startswith(p + " ") | k.startswith(p + ":")
    return F.when(k == "yes", "affirmative").when(k == "no", "negative").when(k.isin(*NOT_APPLICABLE), "not_applicable").when(absent, "absent").otherwise("value")


def is_negative(value: Column) -> Column:
    return answer_kind(value).isin("negative", "absent", "not_applicable")


def plain_answer(value: Column) -> Column:
    """Lower case, single spaces, no outer blanks and dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"\s+", " "), r"^[ .]+|[ .]+$", "")


def redacted(value: Column, mode: str = "redacted") -> Column:
    """``full`` as it is; ``redacted``: its length and the first 12 hex digits of its digest; ``metadata``: null."""
    if mode == "full":
        return value
    if mode == "metadata":
        return F.lit(None).cast("string")
    if mode != "redacted":
        raise ValueError("mode must be full, redacted or metadata")
    return F.when(value.isNotNull(), F.concat(F.lit("[redacted "), F.length(value).cast("string"), F.lit(" "), F.substring(F.sha2(value, 256), 1, 12), F.lit("]")))


def stat_identity(path: Column, size: Column, modified: Column) -> Column:
    """What tells an unchanged file without reading it."""
    return F.sha2(F.concat_ws("|", path, size.cast("string"), modified.cast("string")), 256)


def simhash_md5(tokens: list[str]) -> int:
    """64-bit SimHash of tokens with multiplicity: bit i of the little-endian first 8 md5 bytes votes; a tie sets the bit; 0 for none. As a signed number."""
    if not len(tokens):
        return 0
    votes = [0] * 64
    seen: dict[str, int] = {}
    for t in tokens:
        seen[t] = seen.get(t, 0) + 1
    for t, n in seen.items():
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little")
        for i in range(64):
            votes[i] += n if h >> i & 1 else -n
    out = sum(1 << i for i in range(64) if votes[i] >= 0)
    return out - (1 << 64) if out >> 63 else out


@F.pandas_udf(LongType())
def simhash64(tokens: pd.Series) -> pd.Series:
    """``simhash_md5`` by batches: one bit table per distinct token of the batch, then array sums."""
    import numpy as np

    place: dict[str, int] = {}
    flat, sizes = [], []
    for ts in tokens:
        ts = [] if ts is None else ts
        sizes.append(len(ts))
        flat.extend(place.setdefault(t, len(place)) for t in ts)
    raw = b"".join(hashlib.md5(t.encode()).digest()[:8] for t in place)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    out, at = np.zeros(len(sizes), dtype=np.uint64), 0
    ids = np.array(flat, dtype=np.int64)
    for k, n in enumerate(sizes):
        if n:
            count = np.bincount(ids[at : at + n])
            some = np.flatnonzero(count)
            votes = count[some] @ bits[some]
            out[k] = np.packbits(votes >= 0, bitorder="little").view(np.uint64)[0]
        at += n
    return pd.Series(out.view(np.int64))
