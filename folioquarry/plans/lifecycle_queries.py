"""Queries of corpus life: appends, families, outcomes, sets, forms, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.operators import forms, graph, lifecycle
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table

R = Registry()
query = R.query


@query("""with old as (select * from documents where doc_id % 3 = 0), f as (select * from documents d where d.doc_id % 3 <> 0 and not exists (select 1 from old where old.sha256 = d.sha256) and not exists (select 1 from old where old.content_sha256 = d.content_sha256))
  select min(doc_id) as doc_id from f group by coalesce(content_sha256, sha256, cast(doc_id as varchar))""")
def append_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents as the corpus, the others arriving: what is appended."""
    d = table(spark, sf_dir, "documents").select("doc_id", "sha256", "content_sha256")
    return lifecycle.append_new(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0")).select("doc_id")


@query("select doc_id from documents d where not exists (select 1 from documents o where o.doc_id % 2 = 0 and o.source_identity = d.source_identity)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source_identity")
    return lifecycle.to_ingest(d, d.where("doc_id % 2 = 0")).select("doc_id")


@query("""with recursive e as (select doc_id as id, parent_doc_id as parent from documents where parent_doc_id is not null), t(root, id) as (select doc_id, doc_id from documents where parent_doc_id is null and doc_id in (select parent from e) union select t.root, e.id from t join e on e.parent = t.id) select root, id from t""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families of all documents that are answered or accompanied and answer none."""
    d = table(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").alias("id"), F.col("parent_doc_id").alias("parent"))
    roots = d.where("parent_doc_id is null").select(F.col("doc_id").alias("id")).join(e.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
    return lifecycle.descendants(e, roots)


@query("""with recursive e as (select doc_id as id, parent_doc_id as parent from documents where parent_doc_id is not null), t(id) as (select doc_id from documents where parent_doc_id is null and doc_id % 5 = 0 union select e.id from t join e on e.parent = t.id) select chunk_id from chunks where doc_id not in (select id from t)""")
def delete_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that stay when a fifth of the root documents goes with all below them."""
    d = table(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").alias("id"), F.col("parent_doc_id").alias("parent"))
    family = lifecycle.descendants(e, d.where("parent_doc_id is null and doc_id % 5 = 0").select(F.col("doc_id").alias("id"))).select("id")
    return lifecycle.without({"chunks": table(spark, sf_dir, "chunks")}, family)["chunks"].select("chunk_id")


@query("""with b as (select doc_id, source_path as path, regexp_extract(source_path, '([^/\\\\]+)$', 1) as base from documents where source_path is not null) select path, doc_id from b union select base, min(doc_id) from b group by base having count(*) = 1""")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.file_index(table(spark, sf_dir, "documents"))


@query("""select source_path, outcome_id, status from (select *, row_number() over (partition by source_path order by case when status = 'parsed' then 1 when status is null then -1 else 0 end desc, outcome_id desc) as rn from (select distinct source_path, outcome_id, status from ingest_outcomes where source_path is not null and status is not null)) where rn = 1""")
def latest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome that stands for each file; rows without a status count for nothing."""
    o = table(spark, sf_dir, "ingest_outcomes").select("source_path", "outcome_id", "status").where("status is not null").distinct()
    return lifecycle.latest_outcomes(o)


@query("select count(*) as files, count(*) filter (status = 'parsed') as parsed, count(*) filter (status = 'parse_failed') as failed, coalesce(cast(sum(scanned_pages_total) as bigint), 0) as scanned_pages, coalesce(cast(sum(scanned_pages_untranscribed) as bigint), 0) as untranscribed_pages, count(distinct doc_id) as documents from ingest_outcomes")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.counters(table(spark, sf_dir, "ingest_outcomes"))


@query("""with p as (select doc_id, page, any_value(text) as text from doc_text group by 1, 2) select doc_id, page, length(case when (doc_id + page) % 4 = 1 then 'typed ' || page else text end) as size, case (doc_id + page) % 4 when 1 then 'transcribed' when 2 then 'failed' else 'kept' end as outcome from p""")
def merge_transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the pages transcribed, another with empty replies."""
    p = table(spark, sf_dir, "doc_text").groupBy("doc_id", "page").agg(F.first("text").alias("text"))
    k = (F.col("doc_id") + F.col("page")) % 4
    got = p.where(k.isin(1, 2)).select("doc_id", "page", F.when(k == 1, F.concat(F.lit("typed "), F.col("page").cast("string"))).otherwise(F.lit("  ")).alias("text"))
    return lifecycle.merge_transcriptions(p, got).select("doc_id", "page", F.length("text").cast("bigint").alias("size"), "outcome")


@query("select chunk_id from chunks c where not exists (select 1 from documents d where d.doc_id = c.doc_id and d.doc_id % 7 <> 0)")
def dangling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents that a corpus without every seventh document lacks."""
    return lifecycle.dangling(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents").where("doc_id % 7 <> 0"), "doc_id").select("chunk_id")


@query("select doc_id, 'left' as side from documents where doc_id % 10 = 1 union all select doc_id, 'right' from documents where doc_id % 10 = 2")
def rowset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return lifecycle.rowset_diff(d.where("doc_id % 10 <> 2"), d.where("doc_id % 10 <> 1"))


@query("select doc_id as pos from documents where doc_id % 9 = 4")
def order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "source")
    return lifecycle.order_diff(d, d.withColumn("source", F.when(F.col("pos") % 9 == 4, F.lit("other")).otherwise(F.col("source"))), "pos")


@query("""with recursive e as (select doc_id as a, parent_doc_id as b from documents where parent_doc_id is not null union select parent_doc_id, doc_id from documents where parent_doc_id is not null), t(node, reach) as (select a, a from e union select t.node, e.b from t join e on e.a = t.reach)
  select node, min(reach) as component from t group by 1""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: components of the links between messages and what they answer."""
    return graph.components(table(spark, sf_dir, "documents").select("doc_id", "parent_doc_id"), "doc_id", "parent_doc_id")


@query("""with m as (select distinct matter_code, author from documents where author is not null and matter_code is not null), p as (select a.author as x, b.author as y, count(*) as matters from m a join m b on a.matter_code = b.matter_code and a.author < b.author group by 1, 2) select x, y, matters from p where matters > 1""")
def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors that share more than one matter: relations of a graph summary. Every matter counts."""
    return graph.shared_pairs(table(spark, sf_dir, "documents"), "matter_code", "author").withColumnRenamed("shared", "matters")


def _fields(spark: SparkSession, sf_dir: str, lone: bool = False) -> DataFrame:
    """Fields made of parts; with ``lone`` every tenth group member stands in a group of its own."""
    p = table(spark, sf_dir, "part")
    group = F.col("p_partkey") % 3 == 0
    name = F.when(F.lit(lone) & (F.col("p_partkey") % 30 == 0), F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_brand"))
    notes = F.concat(F.lit("For the buyer — "), F.col("p_brand"), F.lit(". "), F.col("p_name"), F.lit("\n\n"), F.when(group, F.concat(F.lit('MUTUALLY EXCLUSIVE GROUP "'), name, F.lit('" (which one?) FIELD TYPE: checkbox'))).otherwise(F.lit("FIELD TYPE: date")))
    return p.select(F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("field_id"), notes.alias("notes"))


@query("""select 'f' || lpad(cast(p_partkey as varchar), 9, '0') as field_id, 'the buyer' as role, p_brand as subject, trim(p_name) as label, case when p_partkey % 3 = 0 then p_brand end as "group", case when p_partkey % 3 = 0 then 'which one?' end as group_question, case when p_partkey % 3 = 0 then 'checkbox' else 'date' end as field_type from part""")
def form_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.parse_fields(_fields(spark, sf_dir)).drop("question_id")


@query("""select p_brand as question_id, count(*) as members, case when count(*) > 1 then 'options' else 'value' end as mode from part where p_partkey % 3 = 0 group by 1 union all select 'field:f' || lpad(cast(p_partkey as varchar), 9, '0'), 1, 'value' from part where p_partkey % 3 <> 0""")
def form_group_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = forms.collapse(forms.parse_fields(_fields(spark, sf_dir)))
    return q.select("question_id", "members", "mode")


@query("""with g as (select p_brand as q, min(p_partkey) as chosen, count(*) as n from part where p_partkey % 3 = 0 group by 1) select q as question_id, 'f' || lpad(cast(p_partkey as varchar), 9, '0') as field_id, case when n = 1 then 'Not found' when p_partkey = chosen then 'yes' else 'No' end as field_value from part join g on q = p_brand where p_partkey % 3 = 0
  union all select 'field:f' || lpad(cast(p_partkey as varchar), 9, '0'), 'f' || lpad(cast(p_partkey as varchar), 9, '0'), 'Not found' from part where p_partkey % 3 <> 0""")
def form_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups answered with their first member; lone fields left unanswered."""
    f = forms.parse_fields(_fields(spark, sf_dir))
    a = forms.collapse(f).where("mode = 'options'").select("question_id", F.col("first_member").alias("choice"), F.lit(None).cast("string").alias("value"))
    return forms.fan_out(f, a)


@query("""select min('f' || lpad(cast(p_partkey as varchar), 9, '0')) as field_id, 'no alternative' as fault from part where p_partkey % 3 = 0 group by p_brand || case when p_partkey % 30 = 0 then '-' || p_partkey else '' end having count(*) = 1""")
def form_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.faults(forms.parse_fields(_fields(spark, sf_dir, lone=True)))


QUERIES, ORACLE = R.queries, R.oracle
