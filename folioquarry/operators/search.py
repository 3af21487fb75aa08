"""Search of escalating cost: table cells, patterns, full text, vectors. Each rung is a DataFrame; the ladder decides on the driver which to run."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions import text as T
from folioquarry.functions.stem import stems
from folioquarry.plans.runtime import cut, spread

K1, B = 1.2, 0.75
LARGE, SWEEP, VECTOR_BATCH = 1000, 20, 64


def _check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or not 0 <= k <= 1000:
        raise ValueError("k must be a whole number from 0 to 1000")
    return k


# Rung 0: table cells


def route_tables(manifest: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, table_name) worth a look: a term overlaps a column name or the caption of a trusted or unchecked table, or the query has numbers and the table isn't untrusted.

    ``manifest``: table_name, columns, caption, status; ``queries``: query_id, terms, numbers. An automaton of the distinct
    terms of the stated queries finds those within each table's names, and queries meet tables by an equi-join on the
    term. Queries with numbers take every such table, which is no more than what comes out.
    """
    m = manifest.withColumn("_hay", F.lower(F.concat_ws(" ", F.array_join("columns", " "), F.coalesce("caption", F.lit("")))))
    m = m.where("status in ('trusted', 'unchecked', 'reextracted')").select("table_name", "_hay")
    numeric = queries.where(F.size("numbers") > 0).select("query_id")
    q = queries.where(~F.coalesce(F.size("numbers") > 0, F.lit(False))).select("query_id", F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t)))).alias("term"))
    terms = [r.term for r in q.select("term").distinct().where("term <> ''").collect()]  # of the stated queries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for t in terms:
            a.add_word(t, t)
        a.make_automaton()
        for pdf in batches:
            rows = {(n, t) for n, hay in zip(pdf["table_name"], pdf["_hay"]) for _, t in (a.iter(hay) if terms else ())}
            yield pd.DataFrame(sorted(rows), columns=["table_name", "term"])

    met = m.mapInPandas(run, "table_name string, term string").join(q, "term").select("query_id", "table_name").distinct()
    return met.unionByName(numeric.join(m.select("table_name"), F.lit(True)).select("query_id", "table_name"))


def cell_hits(cells: DataFrame, terms: list[str], numbers: list[float], tables: DataFrame | None = None, per_table: int = 20) -> DataFrame:
    """Distinct rows with a text cell that contains a term or a number equal to one asked for; the first ``per_table`` rows of each table."""
    words = [t.lower() for t in terms if not t[:1].isdigit()]
    clauses: list[Column] = [F.col("num_value").isNull() & F.contains(F.col("text_value"), F.lit(w)) for w in words]
    if numbers:
        clauses.append(F.col("num_value").isin(*numbers))
    if not clauses:
        return cells.select("table_name", "row_idx").limit(0)
    cond = clauses[0]
    for c in clauses[1:]:
        cond = cond | c
    c = cells if tables is None else cells.join(tables.select("table_name").distinct(), "table_name", "left_semi")
    rows = c.where(cond).select("table_name", "row_idx").distinct()  # before the window, or a row with two hits takes two places
    rn = F.row_number().over(Window.partitionBy("table_name").orderBy("row_idx"))
    return rows.withColumn("rn", rn).where(F.col("rn") <= per_table).drop("rn")


def rank_hits(hits: DataFrame, terms: list[str], asked_years: list[str], text: str, headings: str | None = None, serial: str = "serial", k: int = 20) -> DataFrame:
    """Top ``k`` by (years agree 2, unknown 1, conflict 0; terms contained), earlier hits first among equals."""
    _check_k(k)
    head = F.lower(F.coalesce(F.col(headings), F.lit(""))) if headings else F.lit("")
    hay = F.concat_ws(" ", F.lower(text), head)
    covered = sum((F.contains(hay, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    there = T.years(head)
    match = F.when(F.lit(not asked_years) | (F.size(there) == 0), 1).when(F.size(F.array_except(F.array(*[F.lit(y) for y in asked_years]) if asked_years else F.array().cast("array<string>"), there)) == 0, 2).otherwise(0)
    return hits.withColumn("year_match", match).withColumn("coverage", covered).orderBy(F.desc("year_match"), F.desc("coverage"), F.asc(serial)).limit(k)


# Rung 1: patterns


def grep_context(docs: DataFrame, pattern: str, context: int = 0, max_hits: int | None = None) -> DataFrame:
    """Matching lines with ``context`` lines on both sides, from the array of a document's lines: no self-join. ``max_hits`` keeps the first hits by (doc_id, line)."""
    d = docs.where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    low = lambda i: F.greatest(i - context, F.lit(1))
    found = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: F.element_at("l", i).rlike(pattern))
    # A hit carries its own lines only, not its document's.
    hits = d.select("doc_id", F.explode(F.transform(found, lambda i: F.struct(i.alias("hit_line"), F.slice("l", low(i), i + context - low(i) + 1).alias("near")))).alias("h"))
    if max_hits is not None:
        hits = hits.orderBy("doc_id", "h.hit_line").limit(max_hits)
    hits = hits.select("doc_id", F.col("h.hit_line").alias("hit_line"), F.posexplode("h.near").alias("_i", "text"))
    return hits.select("doc_id", "hit_line", (low(F.col("hit_line")) + F.col("_i")).cast("int").alias("line_no"), "text").withColumn("is_hit", F.col("line_no") == F.col("hit_line"))


def match_spans(df: DataFrame, key: str, terms: list[str], bucket: int = 300) -> DataFrame:
    """Spans of the alternation of ``terms`` in each text, the first of every ``bucket`` characters."""
    import re

    pattern = "|".join(re.escape(t) for t in terms if t)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rx = re.compile(pattern, re.I) if pattern else None
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf["text"]):
                seen = set()
                for m in rx.finditer(t) if rx and isinstance(t, str) else ():
                    if m.start() // bucket not in seen:
                        seen.add(m.start() // bucket)
                        rows.append((k, m.start(), m.end(), m.group()))
            yield pd.DataFrame(rows, columns=[key, "start", "end", "match"])

    return df.select(key, "text").mapInPandas(run, f"{key} {kind}, start int, end int, match string")


# Rung 2: full text


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, key, tf, length) of every chunk: the inverted index."""
    w = chunks.select(key, T.words(F.col("text")).alias("w")).where("w is not null")
    return w.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", k: int = 10, few_terms: int = 200, stemmed: bool = False, every: bool = False) -> DataFrame:
    """Okapi BM25 of many queries (query_id, terms) at once over words, or with ``stemmed`` over their stems; with ``every`` only of chunks that have all of a query's terms: (query_id, key, score), the best ``k`` of each.

    Only the postings of asked terms are made: the chunk's words are filtered by the distinct query terms before they
    are counted, so what is shuffled grows with the hits. Corpus statistics are over all chunks.
    """
    _check_k(k)
    s = _scores(chunks, queries, key, few_terms, stemmed, every)
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return s.withColumn("rank", rn).where(F.col("rank") <= k)


def _terms(text: Column, stemmed: bool) -> Column:
    return stems(T.words(text)) if stemmed else T.words(text)


def _scores(chunks: DataFrame, queries: DataFrame, key: str, few_terms: int, stemmed: bool, every: bool) -> DataFrame:
    lower = F.transform("terms", lambda t: F.lower(t))
    q = queries.select("query_id", F.explode(F.array_distinct(stems(lower) if stemmed else lower)).alias("term"))
    asked = q.select("term").distinct()
    w = spread(chunks.select(key, "text"), key).select(key, _terms(F.col("text"), stemmed).alias("w")).where("w is not null")
    few = [r.term for r in asked.limit(few_terms + 1).collect()]
    if len(few) <= few_terms:  # a few terms are filtered within each word list, and the texts are taken apart once
        base = cut(w.select(key, F.size("w").alias("length"), F.filter("w", lambda x: x.isin(*few)).alias("hits")))
        hits = base.select(key, "length", F.explode("hits").alias("term"))
    else:  # many meet the words by a join
        base = w.select(key, F.size("w").alias("length"))
        hits = w.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).join(asked, "term", "left_semi")
    corpus = base.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    p = hits.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = p.join(df, "term").join(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    s = scored.withColumn("weight", weight).join(q, "term").groupBy("query_id", key).agg(F.round(F.sum("weight"), 6).alias("score"), F.count(F.lit(1)).alias("_n"))
    if every:
        s = s.join(q.groupBy("query_id").agg(F.count(F.lit(1)).alias("_all")), "query_id").where("_n = _all")
    return s.select("query_id", key, "score")


def match(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", k: int = 10) -> DataFrame:
    """Full-text search of query texts (query_id, query) over stems: (query_id, key, score, rank), the best ``k`` of each.

    A chunk has all words of the query; where the query holds a double quote, balanced or not, its words stand in it as one
    phrase. Queries without words, null ones too, find nothing.
    """
    _check_k(k)
    q = queries.select("query_id", T.words(F.col("query")).alias("terms"), F.contains(F.col("query"), F.lit('"')).alias("phrase")).where("size(terms) > 0")
    s = _scores(chunks, q, key, 200, True, True).join(q.select("query_id", "phrase", F.array_join(stems(F.col("terms")), " ").alias("said")), "query_id")
    words = chunks.select(key, F.array_join(_terms(F.col("text"), True), " ").alias("all"))
    held = s.where("phrase").join(words, key).where(F.contains(F.concat(F.lit(" "), F.col("all"), F.lit(" ")), F.concat(F.lit(" "), F.col("said"), F.lit(" "))))
    s = s.where("not phrase").select("query_id", key, "score").unionByName(held.select("query_id", key, "score"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return s.withColumn("rank", rn).where(F.col("rank") <= k)


def phrase_hits(chunks: DataFrame, phrases: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(phrase_id, key) of chunks that contain a phrase of two words: both meet on the hash of neighbouring words."""
    w = chunks.select(key, T.words(F.col("text")).alias("w")).where("size(w) > 1")
    pairs = w.select(key, F.explode(F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))).alias("pair"))
    return pairs.join(phrases.select("phrase_id", F.lower("phrase").alias("pair")), "pair").select("phrase_id", key).distinct()


# Rung 4: vectors


def unit(v: Column) -> Column:
    """A vector of norm 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantized(u: Column) -> Column:
    """Components times 127, rounded and kept within a byte."""
    return F.transform(u, lambda x: F.greatest(F.least(F.rint(x * 127), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, pool: int | None = None, key: str = "vec_id", block: int = 2000) -> DataFrame:
    """(query_id, key, score): the best ``k`` by cosine for each query; with ``pool``, int8 scores choose that many first and exact ones rank them.

    The stated queries go to the tasks in blocks of ``block`` vectors (a proven bound); each task keeps a running best over
    all it reads, and only that is shuffled.
    """
    _check_k(k)
    import numpy as np

    kinds = dict(vectors.dtypes)
    schema = f"query_id bigint, {key} {kinds[key]}, coarse double, score double"
    keep = pool or k
    block = max(1, min(block, 4_000_000 // max(1, keep)))  # what a task keeps is bounded
    n = -(-queries.count() // block)
    out = None
    for b in range(n):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).select("query_id", "embedding").collect()  # about a block
        if not asked:
            continue
        ids, q = np.array([r.query_id for r in asked]), np.array([r.embedding for r in asked], dtype=np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, norm, out=q.copy(), where=norm > 0)

        def run(batches, ids=ids, q=q):
            q8 = np.clip(np.rint(q * 127), -127, 127)
            best_c, best_s, best_k = np.zeros((len(ids), 0)), np.zeros((len(ids), 0)), None
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.array(pdf["embedding"].tolist(), dtype=np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, size, out=v.copy(), where=size > 0)
                exact = np.round(q @ v.T, 6)
                coarse = q8 @ np.clip(np.rint(v * 127), -127, 127).T if pool else exact
                keys = np.broadcast_to(pdf[key].to_numpy(), exact.shape)
                # The task's best so far and this batch: the first ``keep`` by score, then by key.
                c, s = np.concatenate([best_c, coarse], 1), np.concatenate([best_s, exact], 1)
                k2 = keys if best_k is None else np.concatenate([best_k, keys], 1)
                order = np.lexsort((k2, -c), axis=1)[:, :keep]
                best_c, best_s, best_k = (np.take_along_axis(x, order, 1) for x in (c, s, k2))
            if best_k is not None:
                for at in range(len(ids)):
                    yield pd.DataFrame({"query_id": ids[at], key: best_k[at], "coarse": best_c[at], "score": best_s[at]})

        part = vectors.where("embedding is not null").select(key, "embedding").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query_id bigint, {key} {kinds[key]}, score double, rank int")
    if pool:
        rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coarse"), F.asc(key)))
        out = out.withColumn("rn", rn).where(F.col("rn") <= pool).drop("rn")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return out.withColumn("rank", rn).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


# The ladder


class Ladder:
    """Escalating search of one query: the first rung with any hit answers. ``rungs`` maps 0, 1, 2, 4 to functions (query, k) -> DataFrame of hits."""

    def __init__(self, rungs: dict[int, Callable[[str, int], DataFrame]], chunks: Callable[[], int], expand: Callable[[str, list[str]], list[str]] | None = None, max_rounds: int = 3, max_new: int = 5):
        self.rungs, self.chunks, self.expand, self.max_rounds, self.max_new = rungs, chunks, expand, max_rounds, max_new

    def _some(self, rung: int, query: str, k: int) -> list:
        return self.rungs[rung](query, k).limit(k).collect() if rung in self.rungs else []

    def search(self, query: str, k: int = 10, large: int = LARGE) -> tuple[int, list]:
        """(rung, at most ``k`` hits). Over ``large`` chunks (0: never) the vectors are not run but estimated, and what is left is an estimate of a whole sweep."""
        if _check_k(k) == 0:
            return -1, []
        for rung in (0, 1, 2):
            if hits := self._some(rung, query, k):
                return rung, hits
        known, frontier = {query.lower()}, [query]
        for _ in range(self.max_rounds if self.expand else 0):
            fresh = [t for f in frontier for t in self.expand(f, sorted(known)) if t.lower() not in known][: self.max_new]
            if not fresh:
                break
            known.update(t.lower() for t in fresh)
            if hits := self._some(2, " ".join(fresh), k):
                return 3, hits
            frontier = fresh
        n = self.chunks()
        if 4 in self.rungs:
            if large and n > large:
                return 4, [{"kind": "estimate", "batches": -(-n // VECTOR_BATCH)}]
            try:
                if hits := self._some(4, query, k):
                    return 4, hits
            except Exception as e:  # the only rung that may fail without failing the search
                logging.getLogger(__name__).warning("rung 4 failed: %s", e)
        return 5, [{"kind": "estimate", "batches": -(-n // SWEEP)}]


def sweep_batches(chunks: DataFrame, size: int = SWEEP, key: str = "chunk_id") -> DataFrame:
    """Batches of ``size`` chunks of a document, in order, for an injected reader of everything."""
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(key)) - 1
    return chunks.withColumn("batch", F.concat_ws("/", F.col("doc_id").cast("string"), F.floor(rn / size).cast("string")))
