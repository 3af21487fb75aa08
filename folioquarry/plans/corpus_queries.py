"""Queries of the corpus as a whole: manifest, dates, headers, schema proposals, gold and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import dates
from folioquarry.functions import numeric as N
from folioquarry.operators import health, pipeline
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table
from folioquarry.sources import textlike

R = Registry()
query = R.query


@query("""with c as (select doc_id, count(*) as n from chunks group by 1) select parser, count(*) as documents, coalesce(cast(sum(length(text)) as bigint), 0) as chars, coalesce(cast(sum(n) as bigint), 0) as chunks, count(duplicate_of) as duplicates from documents left join c using (doc_id) group by 1""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.manifest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunks"))


@query("""with d as (select doc_id, trim(doc_date) as t from documents), p as (select doc_id, t, coalesce(case when regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(t, '%Y-%m-%d') end, try_strptime(t, '%-d/%-m/%Y'), try_strptime(t, '%-d %b %Y'), try_strptime(t, '%-d %B %Y'), try_strptime(t, '%-d.%-m.%Y'), try_strptime(t, '%b %-d, %Y'), try_strptime(t, '%B %-d, %Y')) as ts from d)
  select doc_id, t as doc_date, strftime(ts, '%Y-%m-%d') as day, case when month(ts) >= 7 then year(ts) + 1 else year(ts) end as fiscal_year from p""")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day each document names, whatever its format, and its fiscal year."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim("doc_date").alias("doc_date"), dates.day(F.col("doc_date")).alias("d"))
    return d.select("doc_id", "doc_date", F.date_format("d", "yyyy-MM-dd").alias("day"), dates.fiscal_year(F.col("d")).cast("bigint").alias("fiscal_year"))


@query("""select 'k' || o_custkey as table_name, case o_custkey % 3 when 0 then 2 when 1 then 1 else 0 end as n_header from (select distinct o_custkey from orders)""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of each customer's orders: a third with two flagged rows, a third with a measure's name over numbers, a third with names over words."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_custkey") % 3
    body = o.select("o_custkey", F.col("o_orderkey") + 10, F.array(F.lit("order"), F.when(k == 2, F.col("o_orderstatus")).otherwise(F.format_number("o_totalprice", 2))).alias("c"), F.lit(False).alias("flagged"))
    c = o.select("o_custkey").distinct()
    head = c.select("o_custkey", F.lit(0).cast("bigint").alias("row_idx"), F.array(F.lit("What"), F.lit("Amount")).alias("c"), (k == 0).alias("flagged"))
    second = c.where(k == 0).select("o_custkey", F.lit(1).cast("bigint").alias("row_idx"), F.array(F.lit("kind"), F.lit("AUD")).alias("c"), F.lit(True).alias("flagged"))
    rows = head.union(second).union(body)
    grid = rows.select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("table_name"), "row_idx", "flagged", F.posexplode("c").alias("col_idx", "raw"))
    return pipeline.infer_headers(grid)


@query("""with h as (select table_name, unnest(header) as name from raw_tables), x as (select * from h), y as (select * from h),
  j as (select x.table_name as table_a, x.name as a, y.table_name as table_b, y.name as b, round(levenshtein(lower(x.name), lower(y.name)) / cast(greatest(length(x.name), length(y.name), 1) as double), 6) as distance from x join y on x.table_name < y.table_name)
  select table_a, a, table_b, b, distance from (select *, row_number() over (partition by table_a, a, table_b order by distance, b) as rn from j where distance <= 0.34) where rn = 1""")
def schema_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all tables held against each other."""
    return pipeline.schema_map(table(spark, sf_dir, "raw_tables").select("table_name", F.explode("header").alias("name")))


@query("""select i.item_id, i.answer as gold, coalesce(f.answer, '') as answer, f.answer is not null as answered from eval_items i left join (select cast(substring(field_id, 3, 3) as integer) as k, min(answer) as answer from field_results where answer is not null group by 1) f on f.k = i.item_id % 1000""")
def gold_outer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold items with their answers; a missing answer is an empty one."""
    f = table(spark, sf_dir, "field_results").where("answer is not null").groupBy(F.substring("field_id", 3, 3).cast("int").alias("k")).agg(F.min("answer").alias("answer"))
    i = table(spark, sf_dir, "eval_items").select("item_id", F.col("answer").alias("gold"), (F.col("item_id") % 1000).alias("k"))
    return i.join(f, "k", "left").select("item_id", "gold", F.coalesce("answer", F.lit("")).alias("answer"), F.col("answer").isNotNull().alias("answered"))


@query("""with d as (select distinct result_id, expect, scored_by, agrees, judge_verdict from field_results where agrees is not null and judge_verdict is not null), s as (select expect, avg(cast(agrees as int)) as a, avg(cast(judge_verdict as int)) as b from d group by 1) select expect as "check", round(a, 6) as ours, round(b, 6) as base, a >= b - 0.02 as passed from s""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two summaries held against each other by class, within a margin."""
    d = table(spark, sf_dir, "field_results").where("agrees is not null and judge_verdict is not null").select("result_id", "expect", "scored_by", "agrees", "judge_verdict").distinct()
    s = d.groupBy(F.col("expect").alias("check")).agg(F.avg(F.col("agrees").cast("int")).alias("a"), F.avg(F.col("judge_verdict").cast("int")).alias("b"))
    return s.select("check", F.round("a", 6).alias("ours"), F.round("b", 6).alias("base"), (F.col("a") >= F.col("b") - 0.02).alias("passed"))


@query()
def gold_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers accepted by a gold value or one of the accepted alternatives of their field: here the other golden values of the field."""
    d = table(spark, sf_dir, "field_results").select("result_id", "field_id", "golden", "answer").distinct()
    alt = d.where("golden is not null").select("field_id", F.col("golden").alias("alternative")).distinct()
    j = d.join(alt, "field_id", "left").withColumn("ok", N.score_answer(F.col("answer"), F.col("alternative")))
    return j.groupBy("result_id").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("accepted"))


@query()
def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of Markdown made of each document's title and text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    md = F.concat(F.lit("# "), F.coalesce("title", F.lit("untitled")), F.lit("\n\n"), "text")
    return d.select("doc_id", F.posexplode(textlike.markdown_elements(md)).alias("seq", "e")).select("doc_id", "seq", "e.kind", "e.text", "e.level")


@query("""with t as (select table_name, header, count(*) as n from raw_rows join raw_tables using (table_name) group by all), l as (select table_name as doc, case when hash_k % 4 = 1 then n + 1 else n end as want, n, hash_k from (select *, length(table_name) as hash_k from t))
  select doc, cast(0 as integer) as table_idx, true as must_pass, hash_k % 5 <> 2 as extracted, hash_k % 5 <> 2 as headers_ok, hash_k % 5 <> 2 and want = n as rows_ok, hash_k % 5 <> 2 and want = n as passed from l""")
def table_extraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered tables against labels: some counts are off by one, some tables are missing."""
    from folioquarry.operators import evalstats

    t = table(spark, sf_dir, "raw_rows").groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).join(table(spark, sf_dir, "raw_tables").select("table_name", "header"), "table_name")
    k = F.length("table_name")
    labels = t.select(F.col("table_name").alias("doc"), F.lit(0).alias("table_idx"), F.col("header").alias("headers"), (F.col("n") + F.when(k % 4 == 1, 1).otherwise(0)).alias("n_data_rows"), F.lit(True).alias("must_pass"))
    manifest = t.where(k % 5 != 2).select(F.col("table_name").alias("doc"), F.lit(0).alias("table_idx"), F.col("header").alias("headers"), F.col("n").alias("n_data_rows"))
    return evalstats.extraction_score(labels, manifest)


@query("""with d as (select distinct result_id, answer, note from field_results), k as (select *, regexp_replace(regexp_replace(lower(replace(coalesce(answer, ''), '_', ' ')), '\\s+', ' ', 'g'), '^[ .!`*"''\t\n]+|[ .!`*"''\t\n]+$', '', 'g') as key from d)
  select result_id, case when coalesce(trim(note), '') <> '' then 'ok' when key in ('yes', 'no', 'n/a', 'na', 'not applicable', '', 'none', 'nil', 'unknown', 'blank', 'leave blank', 'not reached', 'not specified', 'needs review') or key = 'not found' or key like 'not found %' or key like 'not found:%' then 'exempt' else 'needs_quotes' end as verdict from k""")
def final_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each answer may stand with its note as the only quotation."""
    from folioquarry.operators import evidence

    d = table(spark, sf_dir, "field_results").select("result_id", "answer", "note").distinct()
    return d.select("result_id", evidence.final_verdict(F.col("answer"), F.array("note")).alias("verdict"))


_HEALTH = """with o as (select count(*) as files, count(*) filter (status = 'parse_failed') as failed, coalesce(sum(scanned_pages_untranscribed), 0) as untranscribed_pages from ingest_outcomes where scanned_pages_untranscribed >= 0),
  t as (select count(*) as tables, count(*) filter (n >= 2) as checked, count(*) filter (n >= 2 and k % 5 = 0) as untrusted from (select l_orderkey as k, count(*) as n from lineitem group by 1)), c as (select * from o, t),
  f as (select 'untranscribed_pages' as finding, case when untranscribed_pages > 0 then 'error' end as level from c union all select 'parse_failures', case when cast(failed as double) / files > 0.05 then 'error' when failed > 0 then 'warn' end from c
  union all select 'validation_rate', case when checked > 0 and cast(checked - untrusted as double) / checked < 0.7 then case when checked >= 5 or checked = tables then 'error' else 'info' end end from c union all select 'untrusted_tables', case when untrusted > 0 and cast(checked - untrusted as double) / checked >= 0.7 then 'warn' end from c
  union all select 'unchecked_tables', case when tables > checked then 'info' end from c)"""


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the files, and the checks of tables made of orders' lines."""
    from folioquarry.operators import validate
    from folioquarry.plans.table_queries import _with_totals

    o = table(spark, sf_dir, "ingest_outcomes").where("scanned_pages_untranscribed >= 0")
    a = o.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "parse_failed").alias("failed"), F.coalesce(F.sum("scanned_pages_untranscribed"), F.lit(0)).alias("untranscribed_pages"))
    t = validate.flat_totals(_with_totals(spark, sf_dir), "table_name").agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.col("passed").isNotNull()).alias("checked"), F.count_if(~F.col("passed")).alias("untrusted"))
    return a.join(F.broadcast(t))  # one row each


@query(f"{_HEALTH} select finding, level from f where level is not null")
def health_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.findings(_counters(spark, sf_dir))


@query(f"{_HEALTH} select count(*) filter (level = 'error') as errors, count(*) filter (level = 'warn') as warnings, case when count(*) filter (level = 'error') > 0 then 'blocked' when count(*) filter (level = 'warn') > 0 then 'degraded' else 'ok' end as grade from f")
def health_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.grade(health.findings(_counters(spark, sf_dir)))


@query("select n_linestatus as line_status, round(cast(checked - untrusted as double) / checked, 6) as rate from (select l_linestatus as n_linestatus, count(*) filter (n >= 2) as checked, count(*) filter (n >= 2 and k % 5 = 0) as untrusted from (select l_orderkey as k, min(l_linestatus) as l_linestatus, count(*) as n from lineitem group by 1) group by 1)")
def validation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of checked tables that hold, by the line status of their order."""
    from folioquarry.operators import validate
    from folioquarry.plans.table_queries import _with_totals

    t = validate.flat_totals(_with_totals(spark, sf_dir), "table_name")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_name")).agg(F.min("l_linestatus").alias("line_status"))
    g = t.join(s, "table_name").groupBy("line_status").agg(F.count_if(F.col("passed").isNotNull()).alias("c"), F.count_if(~F.col("passed")).alias("u"))
    return g.select("line_status", F.round(health.validation_rate(F.col("c"), F.col("u")), 6).alias("rate"))


QUERIES, ORACLE = R.queries, R.oracle
