"""Quotations held against retained text, and what a hit binds to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.functions.text import fold_quote
from folioquarry.plans.runtime import spread

MAX_MATCHES = 8


def verify_quotes(quotes: DataFrame, docs: DataFrame, max_block: int = 20_000) -> DataFrame:
    """(quote_id, doc_id, matches, truncated): documents whose folded text contains a folded quotation, with overlapping matches counted to 8 and a flag beyond.

    The quotations are the stated query set: they go to the tasks in blocks of at most ``max_block``, each block a
    multi-pattern automaton, so a document is folded and read once per block whatever the number of quotations. Empty
    quotations never match; null texts hold nothing.
    """
    kinds = dict(docs.dtypes)
    qkind = dict(quotes.dtypes)["quote_id"]
    schema = f"quote_id {qkind}, doc_id {kinds['doc_id']}, matches int, truncated boolean"

    def blocks() -> Iterator[list]:
        block = []
        for r in quotes.select("quote_id", "quote").orderBy("quote_id").toLocalIterator():
            needle = fold_quote(r.quote) or ""
            if needle:
                block.append((r.quote_id, needle))
            if len(block) == max_block:
                yield block
                block = []
        if block:
            yield block

    out = None
    for block in blocks():

        def run(batches, block=block):
            import ahocorasick

            auto = ahocorasick.Automaton()
            by: dict[str, list] = {}
            for q, needle in block:
                by.setdefault(needle, []).append(q)
            for needle, qs in by.items():
                auto.add_word(needle, qs)
            auto.make_automaton()
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    n: dict = {}
                    for _, qs in auto.iter(fold_quote(t)):
                        for q in qs:
                            n[q] = n.get(q, 0) + 1
                    rows.extend((q, d, min(c, MAX_MATCHES), c > MAX_MATCHES) for q, c in n.items())
                yield pd.DataFrame(rows, columns=["quote_id", "doc_id", "matches", "truncated"])

        part = spread(docs.where("text is not null").select("doc_id", "text"), "doc_id").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def passed(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, quote_id) answers and the found quotations: an answer passes with at least one quotation and all of them found."""
    j = answers.join(found.select("quote_id").distinct().withColumn("hit", F.lit(True)), "quote_id", "left")
    return j.groupBy("answer_id").agg(F.count("quote_id").alias("quotes"), F.count("hit").alias("found")).withColumn("passed", (F.col("quotes") > 0) & (F.col("quotes") == F.col("found")))


def bind_tables(hits: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose pages a hit's page lies on: ``page_end`` null means one page, ``page_start`` null means any page."""
    t = tables.select(F.col("doc_id").alias("_d"), "table_name", "page_start", F.coalesce("page_end", "page_start").alias("page_end"))
    return hits.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("page_start").isNull() | F.col("page").between(F.col("page_start"), F.col("page_end")))).drop("_d")


def exact_rows(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """How each table row (row_id, doc_id, line) is found in its document: its line number where one line equals it, ``page_only`` where none or several do."""
    lines = docs.where("text is not null").select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    want = rows.select("row_id", "doc_id", F.trim("line").alias("line"))
    hit = want.join(lines.select("doc_id", "pos", F.trim("line").alias("line")), ["doc_id", "line"], "left").groupBy("row_id", "doc_id").agg(F.count("pos").alias("n"), F.min("pos").alias("pos"))
    return hit.select("row_id", "doc_id", F.when(F.col("n") == 1, "line").otherwise("page_only").alias("precision"), F.when(F.col("n") == 1, F.col("pos") + 1).alias("line_no"))


MAX_QUOTES, MAX_QUOTE_CHARS = 3, 4000


def final_verdict(answer, quotes):
    """Whether an answer with its quotations (array<string>) may stand: ok, needs_quotes, too_many_quotes, quote_too_long or exempt (answers without a value need none)."""
    from folioquarry.functions.text import answer_kind

    q = F.filter(F.coalesce(quotes, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return (
        F.when((F.size(q) == 0) & (answer_kind(answer) == "value"), "needs_quotes").when(F.size(q) == 0, "exempt").when(F.size(q) > MAX_QUOTES, "too_many_quotes")
        .when(F.exists(q, lambda x: F.length(x) > MAX_QUOTE_CHARS), "quote_too_long").otherwise("ok")
    )
