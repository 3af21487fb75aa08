"""Pages, offsets, sections and windows of retained text. Every view keeps the offsets that lead back to the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 1500, 200


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Start offsets of overlapping windows: one for a text within the size, none for an empty or null one."""
    step = size - overlap
    n = F.when(F.length(text) <= size, 1).otherwise(1 + F.ceil((F.length(text) - size) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step))


def window_rows(df: DataFrame, *keep: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_no``, ``char_start``, ``char_end``, ``text`` of each window."""
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("needs 0 <= overlap <= size / 2")
    # A text is split once into pieces of a step: a window is its piece and the head of the next, so the cost is linear in the text.
    d = df.select(*keep, F.length("text").alias("_n"), windows(F.col("text"), size, overlap).alias("_w"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_p"))
    d = d.select(*keep, "_n", F.posexplode(F.transform("_w", lambda at, i: F.struct(at.alias("at"), F.concat(F.get("_p", i), F.coalesce(F.left(F.get("_p", i + 1), F.lit(overlap)), F.lit(""))).alias("text")))).alias("chunk_no", "_c"))
    return d.select(*keep, "chunk_no", F.col("_c.at").alias("char_start"), F.least(F.col("_c.at") + size, F.col("_n")).alias("char_end"), F.col("_c.text").alias("text"))


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Global offsets of pages from their lengths: repeated pages once, in page order."""
    once = pages.groupBy(doc, page).agg(F.min("text").alias("text"))
    end = F.sum(F.length("text")).over(Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    return once.select(doc, page, (end - F.length("text")).cast("int").alias("char_start"), end.cast("int").alias("char_end"), "text")


def assemble(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """The whole text of each document from its pages, once each and in order."""
    once = pages.groupBy(doc, page).agg(F.min("text").alias("text"))
    parts = once.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, "text"))).alias("p"))  # a document's own pages
    return parts.select(doc, F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def assemble_elements(elements: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Offsets of elements in the text that joins them with line breaks."""
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return elements.select("*", before.cast("int").alias("char_start"), (before + F.length("text")).cast("int").alias("char_end"))


def heading_paths(elements: DataFrame, doc: str = "doc_id", seq: str = "seq", levels: int = 6) -> DataFrame:
    """``heading_path`` of each element: the titles in force, outermost first, joined by ' > '; null before any heading.

    A title of a level holds until the next heading of its level or a higher one: the last heading position of each
    level is compared with those of the levels above.
    """
    w = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = elements
    for k in range(1, levels + 1):
        out = out.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.struct(F.col(seq).alias("at"), F.col("text").alias("title"))), ignorenulls=True).over(w))
    parts = []
    for k in range(1, levels + 1):
        above = [F.coalesce(F.col(f"_h{j}")["at"], F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"_h{k}").isNotNull() & ((F.col(f"_h{k}")["at"] > F.greatest(*above, F.lit(-1))) if above else F.lit(True))
        parts.append(F.when(alive, F.col(f"_h{k}")["title"]))
    path = F.array_join(F.array_compact(F.array(*parts)), " > ")
    return out.select(*elements.columns, F.when(path != "", path).alias("heading_path"))


def islands(df: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Runs of equal neighbours: ``island`` counts them from 1."""
    w = Window.partitionBy(partition).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def section_spans(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One span per run of neighbouring sections with one heading path."""
    runs = islands(sections, doc, "char_start", "heading_path")
    return runs.groupBy(doc, "island", "heading_path").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count(F.lit(1)).alias("sections"))


def pages_of_spans(spans: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans with every page they overlap: an equi-join on the document with a range condition."""
    p = pages.select(F.col(doc).alias("_d"), F.col("page"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    return spans.join(p, (F.col(doc) == F.col("_d")) & (F.col("_s") < F.col("char_end")) & (F.col("_e") > F.col("char_start"))).drop("_d", "_s", "_e")


def split_sections(sections: DataFrame, pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sections cut to windows, each with its offsets in the document and the page where it begins; blank sections dropped."""
    rows = sections.where(F.trim("text") != "").select("chunk_id", "doc_id", "heading_path", F.col("char_start").alias("_at"), "text")
    w = window_rows(rows, "chunk_id", "doc_id", "heading_path", "_at", size=size, overlap=overlap)
    w = w.select("chunk_id", "doc_id", "heading_path", "chunk_no", (F.col("_at") + F.col("char_start")).alias("char_start"), (F.col("_at") + F.col("char_end")).alias("char_end"), "text")
    p = pages.select(F.col("doc_id").alias("_d"), "page", F.col("char_start").alias("_s"), F.col("char_end").alias("_e")).distinct()
    return w.join(p, (F.col("doc_id") == F.col("_d")) & (F.col("char_start") >= F.col("_s")) & (F.col("char_start") < F.col("_e")), "left").drop("_d", "_s", "_e")


def snippets(hits: DataFrame, docs: DataFrame, sections: DataFrame, size: int = 600) -> DataFrame:
    """Bounded context of each hit (doc_id, hit_id, char_start, char_end): at most ``size`` characters about it, never over the edge of its section."""
    s = sections.select(F.col("doc_id").alias("_d"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"), "heading_path").dropDuplicates(["_d", "_s"])
    inside = hits.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("char_start") >= F.col("_s")) & (F.col("char_start") < F.col("_e")), "left")
    room = F.greatest(F.lit(size) - (F.col("char_end") - F.col("char_start")), F.lit(0))
    low = F.greatest(F.col("char_start") - F.floor(room / 2), F.coalesce("_s", F.lit(0)), F.lit(0)).cast("int")
    out = inside.withColumn("from", low).join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    high = F.least(F.col("from") + size, F.coalesce("_e", F.length("_t")), F.length("_t")).cast("int")
    return out.withColumn("to", high).select("doc_id", "hit_id", "heading_path", "from", "to", F.substring("_t", F.col("from") + 1, F.col("to") - F.col("from")).alias("snippet"))
