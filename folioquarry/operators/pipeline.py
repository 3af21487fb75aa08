"""From files to a published corpus: read, parse, page, chunk, index, publish; and the manifest of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import slug
from folioquarry.operators import layout, lifecycle
from folioquarry.plans.runtime import cut
from folioquarry.sources import textlike

TABLES = ("documents", "doc_text", "sections", "chunks", "ingest_outcomes", "table_columns", "cells", "tables")
DIGEST = "xxhash64(path)"


def documents_of(parsed: DataFrame) -> DataFrame:
    """Documents of parsed files and of what is in them: ids from a hash of the path, names from the stem, digests of bytes and text, the id of the container."""
    stem = F.regexp_extract("path", r"([^/\\:]+?)(?:\.[^./\\:]*)?$", 1)
    parent = F.when(F.col("parent").isNotNull(), F.xxhash64("parent")) if "parent" in parsed.columns else F.lit(None).cast("bigint")
    return parsed.select(
        F.expr(DIGEST).alias("doc_id"), slug(stem).alias("name"), "text", F.length("text").cast("bigint").alias("n_chars"), F.col("path").alias("source_path"), "sha256", "source_identity", "parser",
        F.when(F.length("text") > 0, F.sha2("text", 256)).alias("content_sha256"), F.lit(1).alias("n_pages"), F.element_at(F.split("text", "\n"), 1).alias("title"), parent.alias("parent_doc_id"), F.lit(None).cast("bigint").alias("duplicate_of"),
    )


def sections_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``char_start``, ``char_end``, ``heading_path``, ``text`` of the sections of texts: Markdown at its ATX headings, others whole."""
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("t"), F.when(F.col("parser") == "markdown", F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1))).otherwise(0).alias("level")))
    rows = docs.where("length(text) > 0").select("doc_id", F.length("text").alias("n"), F.posexplode(line).alias("seq", "l")).select("doc_id", "n", "seq", F.col("l.t").alias("line"), F.nullif(F.col("l.level"), F.lit(0)).alias("level"))
    at = Window.partitionBy("doc_id").orderBy("seq")  # a document's lines
    rows = rows.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = rows.where("level is not null or seq = 0").withColumn("text", F.regexp_replace("line", r"^#+\s+|\s+#*$", ""))
    heads = layout.heading_paths(heads, "doc_id", "seq").withColumn("char_end", F.coalesce(F.lead("char_start").over(at), F.col("n")))
    spans = heads.select("doc_id", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), "heading_path")
    return spans.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").select("doc_id", "char_start", "char_end", "heading_path", F.expr("substring(_t, char_start + 1, char_end - char_start)").alias("text"))


def tables_of(docs: DataFrame) -> dict[str, DataFrame]:
    """Pages, sections and chunks of documents, with offsets into their texts."""
    some = docs.where("length(text) > 0")
    pages = some.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    sections = sections_of(docs)
    w = layout.window_rows(sections.withColumnRenamed("char_start", "_at").drop("char_end"), "doc_id", "heading_path", "_at")
    chunks = w.select(F.xxhash64("doc_id", "_at", "chunk_no").alias("chunk_id"), "doc_id", F.lit(1).alias("page"), (F.col("_at") + F.col("char_start")).alias("char_start"), (F.col("_at") + F.col("char_end")).alias("char_end"), "heading_path", "text")
    return {"documents": docs, "doc_text": pages, "sections": sections.drop("text"), "chunks": chunks}


def ingest(spark: SparkSession, path: str, corpus_path: str, glob: str = "*", injected: dict | None = None) -> int:
    """Files under ``path``, with all that archives and mails among them hold, into a new version of a corpus; the version's number.

    In one pass: documents with their containers, pages, sections, chunks, and of tables the columns, the cells and the
    manifest. A version adds parts to those before it, so the cost follows the new files. What is known by identity is not
    read again, and what is known by digest of bytes or text is not added again, so a run that broke off is resumed by
    running it again. Every try is a row of ``ingest_outcomes`` (``lifecycle.latest_outcomes`` has the last of each file).
    If every file to read fails and there is no corpus yet, nothing is published and ValueError is raised.
    """
    from folioquarry.operators import build
    from folioquarry.sources import grids

    corpus = lifecycle.Corpus(spark, corpus_path)
    files = textlike.read_files(spark, path, glob)
    known = corpus.table("documents") if corpus.current() is not None else None
    if known is not None:
        files = lifecycle.to_ingest(files, known)
    root = F.substring_index("path", "::", 1)
    identity = files.select(F.col("path").alias("_root"), F.col("source_identity").alias("_identity"))
    parsed = grids.expand(files, injected).withColumn("_root", root).join(identity, "_root", "left")
    parsed = cut(parsed.withColumn("source_identity", F.when(F.col("parent").isNull(), F.col("_identity")).otherwise(F.sha2(F.concat_ws("|", "path", "_identity"), 256))).drop("_root", "_identity"))
    good = parsed.where("error is null")
    if known is None and not good.limit(1).count():
        raise ValueError(f"no file under {path} could be read")
    docs = documents_of(good)
    docs = cut(lifecycle.append_new(docs.limit(0) if known is None else known, docs).select(*docs.columns))
    outcomes = parsed.select(F.concat(F.lit("document:"), F.expr(DIGEST).cast("string")).alias("outcome_id"), F.col("path").alias("source_path"), F.when(F.col("error").isNull(), F.expr(DIGEST)).alias("doc_id"), F.when(F.col("parent").isNotNull(), F.xxhash64("parent")).alias("parent_doc_id"), F.when(F.col("error").isNull(), "parsed").otherwise("parse_failed").alias("status"), "error")
    outcomes = outcomes.withColumn("scanned_pages_total", F.lit(0)).withColumn("scanned_pages_untranscribed", F.lit(0))
    grid = cut(build.grid_rows(good, F.expr(DIGEST)).join(docs.select("doc_id"), "doc_id", "left_semi"))
    columns, cells = build.built(grid)
    return corpus.append({**tables_of(docs), "ingest_outcomes": outcomes, "table_columns": columns, "cells": cells, "tables": build.manifest(grid, columns)})


def manifest(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per parser: documents, characters, chunks, copies."""
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = docs.join(c, "doc_id", "left")
    return j.groupBy("parser").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("duplicate_of").alias("duplicates"))


def compact(docs: DataFrame, limit: int = 100) -> tuple[int, list]:
    """Number of documents and the first ``limit`` of them by id: what a prompt or a page shows of a large corpus."""
    return docs.count(), docs.select("doc_id", "title", "parser", "n_chars").orderBy("doc_id").limit(limit).collect()


def infer_headers(grid: DataFrame) -> DataFrame:
    """(table_name, n_header) of grids (table_name, row_idx from 0, col_idx, raw, flagged): the leading run of flagged rows; without flags one row, if it holds no number and contrasts with what is below: some column has a word over numbers only; else none and the columns get names of their own."""
    from folioquarry.functions import numeric as N

    num = N.coerce_cell(F.col("raw")).isNotNull()
    rows = grid.groupBy("table_name", "row_idx").agg(F.bool_or(F.coalesce("flagged", F.lit(False))).alias("f"), F.bool_or(num).alias("has_number"))
    end = rows.groupBy("table_name").agg(F.min(F.when(~F.col("f"), F.col("row_idx"))).alias("_end"))  # the first row without a flag
    lead = rows.join(end, "table_name").groupBy("table_name").agg(
        F.count_if(F.col("_end").isNull() | (F.col("row_idx") < F.col("_end"))).alias("flags"), F.max(F.when(F.col("row_idx") == 0, F.col("has_number").cast("int"))).alias("first_number"), F.count(F.lit(1)).alias("n_rows")
    )
    value = ~N.is_null_cell(F.col("raw"))
    cols = grid.groupBy("table_name", "col_idx").agg(
        F.max(F.when(F.col("row_idx") == 0, F.trim("raw"))).alias("name"), F.count_if((F.col("row_idx") > 0) & value).alias("n"), F.count_if((F.col("row_idx") > 0) & value & num).alias("k")
    )
    worded = F.coalesce(F.col("name").rlike(r"\p{L}"), F.lit(False))
    contrast = cols.groupBy("table_name").agg(F.bool_or(worded & (F.col("n") > 0) & (F.col("k") >= F.col("n") * 0.95)).alias("contrast"))
    j = lead.join(contrast, "table_name")
    one = (F.col("n_rows") > 1) & (F.coalesce("first_number", F.lit(0)) == 0) & F.col("contrast")
    return j.select("table_name", F.when(F.col("flags") > 0, F.col("flags")).when(one, 1).otherwise(0).cast("int").alias("n_header"))


def schema_map(a: DataFrame, b: DataFrame | None = None, near: float = 0.34) -> DataFrame:
    """Proposed correspondences of the columns (table_name, name) of two sets of tables: the nearest name of each by edit distance over length. Proposals only.

    Without ``b`` all tables of ``a`` are held against each other, ``table_a`` < ``table_b``. Distinct names are compared
    once, those whose lengths allow the distance: an edit distance is at least the difference of the lengths.
    """
    if not 0 <= near <= 0.9:
        raise ValueError("near must be from 0 to 0.9")
    x = a.select(F.col("table_name").alias("table_a"), F.col("name").alias("a"))
    y = (a if b is None else b).select(F.col("table_name").alias("table_b"), F.col("name").alias("b"))
    d = F.levenshtein(F.lower("a"), F.lower("b")) / F.greatest(F.length("a"), F.length("b"), F.lit(1))
    length = lambda c: F.length(F.lower(c))
    reach = 1 - near - 1e-6  # the distance is compared rounded
    lengths = F.sequence(F.floor(length("a") * reach), F.ceil(length("a") / reach))
    names = x.select("a").distinct().withColumn("_k", F.explode(lengths)).join(y.select("b").distinct().withColumn("_k", length("b").cast("bigint")), "_k")
    names = names.withColumn("distance", F.round(d, 6)).where(F.col("distance") <= near).drop("_k")
    j = x.join(names, "a").join(y, "b")
    if b is None:
        j = j.where("table_a < table_b")
    rn = F.row_number().over(Window.partitionBy("table_a", "a", "table_b").orderBy("distance", "b"))
    return j.withColumn("_r", rn).where("_r = 1").select("table_a", "a", "table_b", "b", "distance")
