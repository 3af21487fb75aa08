"""Exact and near duplicates by digests and 64-bit fingerprints (those over word sets are a matter of the text pipeline's own operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.functions.text import dedup_tokens, simhash64
from folioquarry.plans.runtime import cut, spread

BANDS, RADIUS = 4, 3


def _rank():
    return F.struct(F.coalesce(F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("m"), F.col("doc_id").alias("d"))


def keepers(docs: DataFrame) -> DataFrame:
    """The keeper of every group of equal texts: the last modified, then the greatest id."""
    g = docs.where("text is not null").groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.max(_rank()).alias("r"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1").select(F.col("r.d").alias("keeper"), "content_sha256", "copies")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Documents with another's text, and the one kept. Only digests are shuffled; a group is one pre-aggregated row."""
    d = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return d.join(keepers(docs), "content_sha256").where("doc_id <> keeper").select("doc_id", F.col("keeper").alias("duplicate_of"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``simhash`` of texts with tokens; others never near-match."""
    d = spread(docs.where("text is not null").select("doc_id", "text"), "doc_id").select("doc_id", dedup_tokens(F.col("text")).alias("t")).where("size(t) > 0")
    return d.select("doc_id", simhash64("t").alias("simhash"))


def near_classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): documents of one fingerprint are one class (``simhash``, ``rep`` the least id, ``n``), and edges are the pairs of classes within 3 bits (``a`` < ``b`` reps, ``distance``).

    Fingerprints that near agree on one of four bands of 16 bits, so an equi-join on the bands finds all of them.
    """
    f = cut(prints.groupBy("simhash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    band = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("simhash", 16 * b).bitwiseAND(F.lit(0xFFFF)).alias("v")) for b in range(BANDS)])).alias("band")
    x = f.select(band, F.col("simhash").alias("sx"), F.col("rep").alias("rx"))
    y = f.select(band, F.col("simhash").alias("sy"), F.col("rep").alias("ry"))
    distance = F.bit_count(F.col("sx").bitwiseXOR(F.col("sy")))
    near = x.join(y, "band").where((F.col("rx") < F.col("ry")) & (distance <= RADIUS))
    return f, near.select(F.col("rx").alias("a"), F.col("ry").alias("b"), distance.alias("distance")).distinct()


def near_links(prints: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (the least id with its fingerprint) and ``links``: how many other documents are within 3 bits. Copies aren't expanded into pairs."""
    p = cut(prints)
    f, e = near_classes(p)
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(f.select(F.col("rep").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    per = f.join(others, f.rep == others.a, "left").select("simhash", F.col("rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return p.join(per, "simhash").select("doc_id", "class_id", "links")


def greedy_leaders(prints: DataFrame) -> DataFrame:
    """``doc_id``, ``leader`` of documents that joined an earlier leader, as a pass in order of ids decides it.

    A class is a leader if no earlier class near it is one. That is settled in rounds: whoever has an earlier leader near
    is a follower; whoever has only followers before them is a leader. All is joins on the edge table; the rounds are as
    many as the longest chain of doubts.
    """
    p = cut(prints)
    f, e = near_classes(p)
    e = cut(e.select("a", "b"))
    state = cut(f.select(F.col("rep").alias("id"), F.lit(0).alias("s")))  # 0 open, 1 leader, 2 follower
    while True:  # the least open class is settled in every round
        before = e.join(state.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").groupBy("b").agg(F.max((F.col("sa") == 1).cast("int")).alias("led"), F.max((F.col("sa") == 0).cast("int")).alias("open"))
        nxt = state.join(before, state.id == before.b, "left").select("id", F.when(F.col("s") != 0, F.col("s")).when(F.coalesce("led", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0).alias("s"))
        state = cut(nxt)
        if not state.where("s = 0").limit(1).count():
            break
    leaders = state.where("s = 1").select(F.col("id").alias("a"))
    followers = state.where("s = 2").select(F.col("id").alias("b"))
    led = e.join(leaders, "a", "left_semi").join(followers, "b", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    per = f.join(led, f.rep == led.b, "left").select("simhash", F.coalesce("leader", "rep").alias("leader"))
    return p.join(per, "simhash").where("doc_id <> leader").select("doc_id", "leader")
