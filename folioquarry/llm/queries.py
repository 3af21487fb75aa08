"""Queries of the training-text operators, p1 to p8 but for p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.llm import chunking, consensus, emails, leakage, mixing, neardup, truncation
from folioquarry.plans.runtime import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


@query("select chunk_id from chunks where length(text) > 1500")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.oversized(table(spark, sf_dir, "chunks"))


@query()
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every chunk, with its offsets in the document."""
    return chunking.pieces(table(spark, sf_dir, "chunks"))


@query("select chunk_id, count(*) as copies, max(length(text)) as n_chars, min(md5(text)) as digest, case when max(length(text)) > 1500 then 1500 else max(length(text)) end as room from chunks where length(text) > 0 group by 1")
def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chunk the digest of its text put together again from its pieces, without what neighbours share, and the room that they need at most."""
    p = chunking.pieces(table(spark, sf_dir, "chunks"))
    new = F.when(F.col("piece_no") == 0, F.col("text")).otherwise(F.substring("text", chunking.OVERLAP + 1, 1 << 30))
    whole = p.groupBy("chunk_id").agg(F.count_if(F.col("piece_no") == 0).alias("copies"), F.max(F.length("text")).alias("longest"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("piece_no", new.alias("t")))), lambda x: x["t"]), "").alias("text"))  # one chunk's pieces
    n = F.length("text")
    return whole.select("chunk_id", "copies", n.alias("n_chars"), F.md5("text").alias("digest"), F.when((n > chunking.MAX_SIZE) & (F.col("longest") <= chunking.MAX_SIZE), chunking.MAX_SIZE).otherwise(F.col("longest")).alias("room"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), spark.conf.get("folioquarry.tokenizers", "/opt/tokenizers"))


@query("""with t as (select sum(length(text)) as whole from documents), o as (select source, sum(length(text)) as own from documents group by 1) select w.source from source_weights w left join o using (source), t where target_share * whole > max_repeats * coalesce(own, 0)""")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_sized(spark, sf_dir), table(spark, sf_dir, "source_weights")).where("capped").select("source")


@query()
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "source_weights")).where("copies > 0")


@query()
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    out = mixing.report(_sized(spark, sf_dir), table(spark, sf_dir, "source_weights"))
    return out.select("source", "target_share", "max_repeats", "documents", "own_tokens", "all_tokens", F.round("budget", 3).alias("budget"), "epochs", "mixed_tokens", F.round("reached_share", 6).alias("reached_share"), "capped")


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.Consensus(consensus.latest_votes(table(spark, sf_dir, "field_results").select("result_id", "judge_history")))


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "field_results").where("judge_verdict is not null").select("result_id", F.col("judge_verdict").cast("int").alias("said")).distinct()
    got = _consensus(spark, sf_dir).consensus().select(F.col("item").alias("result_id"), "consensus")
    return said.join(got, "result_id").where("said <> consensus").select("result_id").distinct()


@query()
def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus verdict, its probability and the judges' agreement for each result."""
    got = _consensus(spark, sf_dir).consensus()
    return got.select(F.col("item").alias("result_id"), (F.col("consensus") == 1).alias("consensus"), F.round("confidence", 4).alias("confidence"), "votes", F.round("agreement", 6).alias("agreement"))


@query("""with h as (select result_id, unnest(judge_history) as h from field_results), v as (select result_id, lower(trim(h.judge)) as judge, h.judged_at as t, h.verdict::int as label from h where h.verdict is not null and h.judged_at is not null and trim(h.judge) <> ''),
  l as (select result_id, judge, max_by(label, {'t': t, 'label': label}) as label from v group by 1, 2), c as (select result_id, count(*) as n, sum(label) as a from l group by 1)
  select result_id, n as votes, case when n > 1 then round((a * (a - 1) + (n - a) * (n - a - 1)) / (n * (n - 1))::double, 6) end as agreement from c""")
def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of judges of each result and the share of their pairs that agree, apart from the model."""
    v = consensus.latest_votes(table(spark, sf_dir, "field_results").select("result_id", "judge_history"))
    c = v.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("a"))
    n, a = F.col("n"), F.col("a")
    return c.select(F.col("item").alias("result_id"), n.alias("votes"), F.round(F.try_divide(a * (a - 1) + (n - a) * (n - a - 1), n * (n - 1)), 6).alias("agreement"))


@query()
def p5_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each judge: the chance of a right verdict where the answer is wrong, and where it is right."""
    return _consensus(spark, sf_dir).reliability().select("judge", F.round("right_on_0", 4).alias("specificity"), F.round("right_on_1", 4).alias("sensitivity"))


@query()
def p5_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regularisation fitted, the passes over all items and the dual they reached."""
    m = _consensus(spark, sf_dir)
    return spark.createDataFrame([(m.alpha, m.beta, len(m.dual), round(m.dual[-1], 3) if m.dual else None)], "alpha double, beta double, passes int, dual double")


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the search verified, and that hold a run of 12 words."""
    got = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return got.where(F.col("longest_run") >= leakage.WIDTH).select("item_id", "doc_id")


@query()
def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with their extent: items of which a unit, or the whole, is in a document with a weighted-shingle similarity of 0.8."""
    got = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return got.select("item_id", "doc_id", "longest_run", F.round("unit_share", 4).alias("unit_share"), F.round("item_share", 4).alias("item_share"))


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.detect(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


@query()
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source's texts break off."""
    return truncation.rates(truncation.detect(table(spark, sf_dir, "documents"))).select("source", "records", "truncated_records", F.round("rate", 6).alias("rate"))


def _near(spark: SparkSession, sf_dir: str, **how) -> neardup.PathJoin:
    return neardup.PathJoin(table(spark, sf_dir, "documents"), **how)


@query("""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null), s as (select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
  n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
  select a as doc_id_a, b as doc_id_b from p join n x on x.doc_id = a join n y on y.doc_id = b where 10 * k >= 7 * (x.n + y.n - k)""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, k=3, threshold=(7, 10)).found().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def _pair_sql(k: int, num: int, den: int) -> str:
    grams = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null), s as (select distinct doc_id, {grams} as g from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) as i from w)),
  n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2), q as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where {den} * k >= {num} * (x.n + y.n - k))"""


@query(f"""with recursive {_pair_sql(5, 8, 10)}, e as (select a, b from q union all select b, a from q), r(id, reach) as (select doc_id, doc_id from n union select r.id, e.b from r join e on e.a = r.reach),
  c as (select id, min(reach) as class_id from r group by 1), d as (select a, count(*) as links from e group by 1) select id as doc_id, class_id, coalesce(links, 0) as links from c left join d on d.a = c.id""")
def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the general setting (five words, 0.8): class and number of links of each document."""
    return _near(spark, sf_dir).classes().withColumnRenamed("id", "doc_id")


@query()
def p2_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as pairs between representatives of equal word sets, with what they share, and membership: ``kind`` is link or member."""
    j = _near(spark, sf_dir)
    links = j.pairs().select(F.lit("link").alias("kind"), F.col("a").alias("representative"), F.col("b").alias("doc_id"), "shared", "total")
    return links.unionByName(j.members().select(F.lit("member").alias("kind"), F.col("rep").alias("representative"), F.col("id").alias("doc_id"), F.lit(None).cast("int").alias("shared"), F.lit(None).cast("int").alias("total")))


@query()
def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs made at the setting of p2_found, the verified pairs of representatives and the recall estimated from how many runs found each."""
    j = _near(spark, sf_dir, k=3, threshold=(7, 10))
    n = j.pairs().count()
    return spark.createDataFrame([(j.runs * j.turns, n, round(j.estimate, 6))], "runs int, links bigint, estimated_recall double")


def _new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails.new_lines(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_text"))


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_lines(spark, sf_dir)


@query()
def p1_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each email reduced to its newly written text."""
    kept = _new_lines(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("nos"))  # an email's own lines
    pages = emails.email_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_text"))
    lines = F.split("text", "\n")
    return pages.join(kept, "doc_id").select("doc_id", F.size("nos").alias("n_lines"), F.array_join(F.transform("nos", lambda k: F.element_at(lines, k)), "\n").alias("text"))
