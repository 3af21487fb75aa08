"""Queries of the search rungs, near-duplicate fingerprints and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import text as T
from folioquarry.operators import dedup, search, tables
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table

R = Registry()
query = R.query

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(f"""with w as (select chunk_id, {_WORDS} as w from chunks where text is not null), t as (select chunk_id, len(w) as length, unnest(w) as term from w)
  select term, chunk_id, cast(length as integer) as length, count(*) as tf from t group by all""")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all words of all chunks: the inverted index."""
    return search.postings(table(spark, sf_dir, "chunks"))


@query(f"""with q as (select distinct item_id as query_id, unnest({_WORDS.replace('text', 'question')}) as term from eval_items), w as (select chunk_id, {_WORDS} as w from chunks where text is not null), c as (select count(*) as n, avg(len(w)) as al from w),
  p as (select term, chunk_id, length, count(*) as tf from (select chunk_id, len(w) as length, unnest(w) as term from w) where term in (select term from q) group by all), d as (select term, count(*) as df from p group by 1),
  s as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) as score from p join d using (term) join q using (term), c group by 1, 2)
  select query_id, chunk_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) where rank <= 10""")
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks for every question of the test items."""
    q = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), T.words(F.col("question")).alias("terms"))
    return search.bm25(table(spark, sf_dir, "chunks"), q, k=10)


@query()
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every hundredth document as a query over stems, every second one as a phrase: a stated query set against all chunks."""
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    quote = F.when(F.col("doc_id") % 200 == 0, F.lit('"')).otherwise(F.lit(""))
    return search.match(table(spark, sf_dir, "chunks"), d.select(F.col("doc_id").alias("query_id"), F.concat(quote, "title").alias("query")))


@query("""with p as (select phrase_id, phrase from (values (1, 'harbour project'), (2, 'rental pool'), (3, 'kitchen fitting'), (4, 'no such phrase')) v(phrase_id, phrase)), w as (select chunk_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' as t from chunks where text is not null)
  select phrase_id, chunk_id from w join p on contains(t, ' ' || phrase || ' ')""")
def fts_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([(1, "harbour project"), (2, "rental pool"), (3, "kitchen fitting"), (4, "no such phrase")], "phrase_id int, phrase string")
    return search.phrase_hits(table(spark, sf_dir, "chunks"), p)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.to_cells(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "part", "p_partkey")
    return cells.unionByName(tables.to_cells(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer", "c_custkey"))


_RUNG0 = """with hits as (select distinct 'part' as table_name, p_partkey as row_idx from part where contains(lower(p_type), 'steel') or contains(lower(p_name), 'steel') or contains(lower(p_brand), 'steel') or 7 in (p_partkey, p_size)
  union select distinct 'customer', c_custkey from customer where contains(lower(c_name), 'steel') or contains(lower(c_mktsegment), 'steel') or 7 in (c_custkey, c_nationkey))
  select table_name, row_idx from (select *, row_number() over (partition by table_name order by row_idx) as rn from hits) where rn <= 20"""


@query(_RUNG0)
def rung0_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cell_hits(_index(spark, sf_dir), ["steel"], [7.0], per_table=20)


@query("""with q as (select item_id as query_id, list_filter(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: lower(x) not in ('the','and','for','was','were','with','what','which','how','many','much','does','did')) as w, len(regexp_extract_all(question, '-?[0-9][0-9,]*')) as n from eval_items),
  m as (select table_name, lower(array_to_string(header, ' ') || ' ' || coalesce(caption, '')) as hay from raw_tables where extractor <> 'docling') select query_id, table_name from q, m where n > 0 or len(list_filter(w, lambda t: contains(hay, lower(t)))) > 0""")
def route_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables worth a look for each question; those of one extractor count as untrusted."""
    m = table(spark, sf_dir, "raw_tables").select("table_name", F.col("header").alias("columns"), "caption", F.when(F.col("extractor") == "docling", "untrusted").otherwise("trusted").alias("status"))
    q = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.filter(T.terms(F.col("question")), lambda t: ~t.rlike("^[0-9]")).alias("terms"), T.numbers(F.col("question")).alias("numbers"))
    return search.route_tables(m, q)


@query("""with h as (select chunk_id, lower(text) as t, lower(coalesce(heading_path, '')) as h from chunks where contains(lower(text), 'invoice')), s as (select chunk_id, len(regexp_extract_all(h, '\\b[12][0-9]{3}\\b')) as n, contains(h, '2024') as yes, cast(contains(t || ' ' || h, 'invoice') as integer) + cast(contains(t || ' ' || h, 'permit') as integer) as coverage from h)
  select chunk_id, case when n = 0 then 1 when yes then 2 else 0 end as year_match, coverage from s order by 2 desc, 3 desc, 1 limit 25""")
def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a word, ranked by the year asked for and the terms they cover."""
    hits = table(spark, sf_dir, "chunks").where(F.contains(F.lower("text"), F.lit("invoice"))).select("chunk_id", "text", "heading_path")
    return search.rank_hits(hits, ["invoice", "permit"], ["2024"], "text", "heading_path", "chunk_id", 25).select("chunk_id", "year_match", "coverage")


@query()
def grep_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two words stand in each chunk, one hit in 300 characters."""
    return search.match_spans(table(spark, sf_dir, "chunks"), "chunk_id", ["harbour project", "registrar"])


@query("select chunk_id, cast(doc_id as varchar) || '/' || cast((row_number() over (partition by doc_id order by chunk_id) - 1) // 20 as varchar) as batch from chunks")
def sweep_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sweep_batches(table(spark, sf_dir, "chunks")).select("chunk_id", "batch")


@query("""with u as (select vec_id, list_transform(embedding, lambda x: cast(x as double) / nullif(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 0)) as e from embeddings), s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e), 6) as score from u q, u v where q.vec_id % 100 = 0)
  select query_id, vec_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")
def vector_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.knn(v, q, 10)


_UNIT = "list_transform(embedding, lambda x: cast(x as double) / nullif(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 0))"
_POOL = f"""u as (select vec_id, {_UNIT} as e from embeddings), q8 as (select vec_id, e, list_transform(e, lambda x: cast(greatest(least(round_even(x * 127, 0), 127), -127) as double)) as c from u),
  s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.c, v.c) as coarse, round(list_dot_product(q.e, v.e), 6) as score from q8 q, q8 v where q.vec_id % 100 = 0),
  pooled as (select *, row_number() over (partition by query_id order by coarse desc, vec_id) as r from s), near as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from pooled where r <= 100)"""


@query(f"with {_POOL} select query_id, vec_id, score, cast(rank as integer) as rank from near where rank <= 10")
def vector_knn_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a pool of 100 by quantised vectors."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.knn(v, q, 10, pool=100)


@query(f"with {_POOL}, x as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select x.query_id, round(count(near.vec_id) / count(*), 4) as recall from x left join near on near.query_id = x.query_id and near.vec_id = x.vec_id and near.rank <= 10 where x.rank <= 10 group by 1")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact ten that the quantised pool keeps."""
    a = vector_knn_exact(spark, sf_dir).select("query_id", "vec_id")
    b = vector_knn_int8(spark, sf_dir).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    return a.join(b, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


@query("select vec_id, array_to_string(list_transform(embedding, lambda x: cast(greatest(least(round_even(cast(x as double) / nullif(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 0) * 127, 0), 127), -127) as tinyint)), ' ') as q from embeddings")
def vector_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(search.quantized(search.unit(F.col("embedding"))).cast("array<string>"), " ").alias("q"))


@query("""with d as (select doc_id, sha256(text) as h, strftime(modified_at, '%Y-%m-%d %H:%M:%S') as m from documents where text is not null), k as (select h, max({'m': coalesce(m, ''), 'd': doc_id}).d as keeper, count(*) as n from d group by 1)
  select doc_id, keeper as duplicate_of from d join k using (h) where n > 1 and doc_id <> keeper""")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("""with d as (select doc_id, sha256(text) as h, strftime(modified_at, '%Y-%m-%d %H:%M:%S') as m from documents where text is not null) select doc_id as keeper, h as content_sha256, n as copies from (select doc_id, h, count(*) over (partition by h) as n, row_number() over (partition by h order by coalesce(m, '') desc, doc_id desc) as rn from d) where rn = 1 and n > 1""")
def dedup_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keepers(table(spark, sf_dir, "documents"))


_SIM = """t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as tok from documents where text is not null), n as (select doc_id, tok, count(*) as n from t group by 1, 2),
  b as (select tok, k, cast(('0x' || substring(md5(tok), 1 + 2 * (k // 8), 2)) as integer) as byte from (select tok, unnest(range(0, 64)) as k from (select distinct tok from t))),
  v as (select doc_id, k, sum(case when (byte >> (k % 8)) & 1 = 1 then n.n else -n.n end) as votes from n join b using (tok) group by 1, 2), s as (select doc_id, cast(sum(case when votes >= 0 then cast(1 as hugeint) << k else 0 end) as hugeint) as u from v group by 1)"""


@query(f"""with {_SIM}, c as (select u, min(doc_id) as class_id from s group by 1), l as (select a.doc_id, count(*) - 1 as links from s a join s b on bit_count(xor(a.u, b.u)) <= 3 group by 1) select doc_id, class_id, links from l join s using (doc_id) join c using (u)""")
def dedup_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by fingerprints: class and number of links of each document."""
    return dedup.near_links(dedup.fingerprints(table(spark, sf_dir, "documents")))


@query()
def dedup_near_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy leaders in order of doc_id: each document joins the first leader near it."""
    return dedup.greedy_leaders(dedup.fingerprints(table(spark, sf_dir, "documents")))


QUERIES, ORACLE = R.queries, R.oracle
