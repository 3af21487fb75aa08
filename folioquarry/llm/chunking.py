"""Content-defined chunking with overlap (p3).

A gear hash rolls over the characters; a position whose hash has ``mask_bits`` zero bits is a landmark. Each landmark
snaps to a natural boundary: to the nearest end of a paragraph within ``REACH`` characters, else to the nearest end of a
sentence within them, else to the nearest end of a paragraph, sentence or line. A piece ends at the first snapped landmark
between the minimum and the maximum size, else at the last natural boundary within them, else at white space, else at the
maximum size. The next piece starts ``overlap`` characters before that end. Since landmarks depend on the text near them
only, an edit alters the pieces about it, and the cuts fall into step again after it.

Defined cases: null and empty texts have no pieces; a text within the limit is one piece; lengths and offsets are in
code points; texts of any length are cut whole; repeated rows are cut alike, each under its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SIZE, MIN_SIZE, OVERLAP, MASK_BITS, REACH = 1500, 700, 200, 7, 150
#: Characters that end a sentence before white space, those that may follow them, and those that end one anywhere.
ENDERS, CLOSERS, FULL = ".!?…", "\"')]}»”’」』）", "。！？"


def _gear(codes: np.ndarray) -> np.ndarray:
    """Gear hash over windows of 64 characters, at every position."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        for s in (1, 2, 4, 8, 16, 32):  # sums over 2, 4, ..., 64 characters
            if len(h) <= s:
                break
            step = h.copy()
            step[s:] += h[:-s] << np.uint64(s)
            h = step
    return h


def _boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions after which the text may be cut: ends of paragraphs, of sentences, all natural boundaries, and white space."""
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0) | (codes == 0x2028) | (codes == 0x2029) | (codes == 0x3000)
    line = codes == 10
    closer = np.isin(codes, [ord(c) for c in CLOSERS])

    def closed(done: np.ndarray) -> np.ndarray:
        for _ in range(2):  # up to two closing quotes or brackets
            done[1:] |= closer[1:] & done[:-1]
        return done

    full = closed(np.isin(codes, [ord(c) for c in FULL]))
    full[:-1] &= ~closer[1:]  # the closing quote stays with its sentence
    sentence = full.copy()
    sentence[1:] |= blank[1:] & closed(np.isin(codes, [ord(c) for c in ENDERS]))[:-1]
    paragraph = np.zeros(len(codes), dtype=bool)
    paragraph[1:] = line[1:] & (line[:-1] | ((codes[:-1] == 13) & np.append([False], line[:-2] if len(line) > 1 else []).astype(bool)))
    return tuple(np.flatnonzero(x) + 1 for x in (paragraph, sentence, paragraph | sentence | line, blank))


def _nearest(places: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each mark the nearest place (the earlier of two); there is one at least."""
    right = np.searchsorted(places, marks)
    left = places[np.clip(right - 1, 0, len(places) - 1)]
    right = places[np.clip(right, 0, len(places) - 1)]
    return np.where(np.abs(right - marks) < np.abs(marks - left), right, left)


def cuts(text: str, max_size: int = MAX_SIZE, overlap: int = OVERLAP, min_size: int = MIN_SIZE, mask_bits: int = MASK_BITS) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``."""
    n = len(text)
    if n == 0:
        return []
    if n <= max_size:
        return [(0, n)]
    if not overlap < min_size <= max_size:
        raise ValueError("needs overlap < min_size <= max_size")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    paragraph, sentence, natural, blank = _boundaries(codes)
    marks = np.flatnonzero(_gear(codes) & np.uint64((1 << mask_bits) - 1) == 0) + 1
    snapped = marks
    if len(natural):
        snapped = _nearest(natural, marks)
        for places in (sentence, paragraph):
            if len(places):
                near = _nearest(places, marks)
                snapped = np.where(np.abs(near - marks) <= REACH, near, snapped)
        snapped = np.unique(snapped)
    out, start = [], 0
    while n - start > max_size:
        low, high = start + min_size, start + max_size
        end = 0
        for where, first in ((snapped if len(natural) else natural, True), (paragraph, False), (sentence, False), (natural, False), (blank, False)):
            k = np.searchsorted(where, low) if first else np.searchsorted(where, high, side="right") - 1
            if 0 <= k < len(where) and low <= where[k] <= high:
                end = int(where[k])
                break
        end = end or high
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def pieces(chunks: DataFrame, max_size: int = MAX_SIZE, overlap: int = OVERLAP, min_size: int = MIN_SIZE, with_text: bool = True) -> DataFrame:
    """``chunk_id``, ``doc_id``, ``heading_path``, ``piece_no`` (from 0), ``char_start``, ``char_end`` (within the document) and ``text``.

    Chunks within the limit stay on the JVM side; only the others go through Python, row by row and without a shuffle.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    # Ids pass Python as strings: with nulls they would become floats there.
    base = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "heading_path", F.coalesce("char_start", F.lit(0)).cast("int").alias("_at"), "text").where("length(text) > 0")
    text = ["text"] if with_text else []
    small = base.where(F.length("text") <= max_size).select(
        "chunk_id", "doc_id", "heading_path", F.lit(0).alias("piece_no"), F.col("_at").alias("char_start"), (F.col("_at") + F.length("text")).alias("char_end"), *text
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, d, h, at, t in zip(pdf["chunk_id"], pdf["doc_id"], pdf["heading_path"], pdf["_at"], pdf["text"]):
                for k, (s, e) in enumerate(cuts(t, max_size, overlap, min_size)):
                    rows.append((c, d, h, k, at + s, at + e, *((t[s:e],) if with_text else ())))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "heading_path", "piece_no", "char_start", "char_end", *text])

    schema = f"chunk_id string, doc_id string, heading_path string, piece_no int, char_start int, char_end int" + ", text string" * with_text
    out = small.unionByName(base.where(F.length("text") > max_size).mapInPandas(run, schema))
    return out.withColumn("chunk_id", F.col("chunk_id").cast(kinds["chunk_id"])).withColumn("doc_id", F.col("doc_id").cast(kinds["doc_id"]))


def oversized(chunks: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """Ids of the chunks that had to be cut: those with a second piece."""
    return pieces(chunks, max_size, with_text=False).where("piece_no = 1").select("chunk_id")
