"""Queries of evaluation reports, built tables and expanded containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.operators import build, evalstats, graph, reports
from folioquarry.plans.lifecycle_queries import ORACLE as LIFECYCLE
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table
from folioquarry.sources import grids

R = Registry()
query = R.query

_KEY = """regexp_replace(regexp_replace(lower(translate(coalesce({0}, ''), '☐☑☒✓✗_', '      ')), '\\s+', ' ', 'g'), '^[ .!`*"''\\t\\n]+|[ .!`*"''\\t\\n]+$', '', 'g')"""
_NEGATIVE = "(select regexp_matches({0}, '^(no|n/a|na|not applicable||none|nil|unknown|blank|leave blank|not reached|not specified|needs review|not found([ :].*)?)$'))"
_ITEMS = f"""items as (select result_id, expect, tier, agrees as correct, answer, golden, {_KEY.format('answer')} as ak, {_KEY.format('golden')} as gk from (select distinct result_id, expect, tier, agrees, answer, golden from field_results)),
  x as (select *, coalesce(expect = 'absent', false) as absent, {_NEGATIVE.format('ak')} as neg, {_NEGATIVE.format('gk')} as gneg, coalesce(correct, false) as ok, coalesce(tier = 'high', false) as hi from items),
  s as (select count(*) as n, count(*) filter (ok) as correct, count(*) filter (absent) as absent_items, count(*) filter (not absent) as value_items, count(*) filter (absent and not neg and trim(coalesce(answer, '')) <> '' and not ok) as confident_wrong, count(*) filter (not absent and neg) as abstained,
    count(*) filter (not ok) as misses, count(*) filter (not ok and not hi) as reviewed, count(*) filter (hi) as accepted, count(*) filter (hi and ok) as accepted_correct, count(*) filter (trim(coalesce(golden, '')) <> '' and not gneg) as substantive_items, count(*) filter (trim(coalesce(golden, '')) <> '' and not gneg and ok) as substantive_correct from x)"""
_RATES = """n, correct, round(correct / n, 6) as accuracy, absent_items, value_items, confident_wrong, round(confident_wrong / absent_items, 6) as false_positive_rate, round(abstained / value_items, 6) as abstain_rate,
  round(reviewed / misses, 6) as review_recall, round(accepted / n, 6) as auto_accept_rate, round(accepted_correct / accepted, 6) as accepted_accuracy"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "field_results").select("result_id", "expect", "tier", F.col("agrees").alias("correct"), "answer", "golden").distinct()


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in d.dtypes])


@query(f"with {_ITEMS} select {_RATES} from s")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.summary(_items(spark, sf_dir))).drop("low", "high")


@query(f"with {_ITEMS} select {_RATES}, substantive_items, substantive_correct, correct / n >= 0.5 and confident_wrong / absent_items <= 0.6 and accepted_correct / accepted >= 0.5 as passed from s")
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.regression(_items(spark, sf_dir), 0.5, 0.6, 0.5)).drop("low", "high")


_STATE = """st as (select result_id, expect, coalesce(agrees, false) as correct, result_id % 23 = 0 as marked, case when result_id % 11 = 0 then 'recovered' when result_id % 13 = 0 then 'error' when result_id % 29 <> 0 then 'final' end as status, case when result_id % 2 = 0 then 'IngestError' else 'TimeoutError' end as error_type,
    golden, result_id % 19 = 0 as same, result_id % 17 = 0 as blocked, result_id % 3 <> 0 as recorded, case when result_id % 4 = 0 then result_id % 7 end as doc, case when result_id % 6 = 1 then result_id % 5 end as page, result_id % 5 <> 0 as seen from (select distinct result_id, expect, agrees, golden from field_results)),
  c as (select *, case when correct then 'ok' when marked then 'gold' when status = 'error' and error_type = 'IngestError' then 'ingest' when status = 'recovered' then 'budget' when coalesce(status <> 'final', true) then 'execution' when same and trim(coalesce(golden, ''), ' .') <> '' then 'format' when blocked then 'ingest'
    when recorded and doc is not null and doc <> result_id % 3 then 'retrieval' when recorded and page is not null and page <> 2 and not seen then 'retrieval' when recorded and page is null and not seen then 'retrieval' else 'reasoning' end as cause from st)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored results with states made of their ids: what a run leaves behind."""
    d = table(spark, sf_dir, "field_results").select("result_id", "expect", F.col("agrees").alias("correct"), "golden").distinct()
    k = F.col("result_id")
    return d.select(
        "result_id", "expect", "correct", (k % 23 == 0).alias("gold_marked_wrong"), F.when(k % 11 == 0, "recovered").when(k % 13 == 0, "error").when(k % 29 != 0, "final").alias("status"), F.when(k % 2 == 0, "IngestError").otherwise("TimeoutError").alias("error_type"), F.lit("fair").alias("health"),
        F.when(k % 19 == 0, F.concat(F.lit("Answer: "), F.col("golden"))).alias("predicted"), F.col("golden").alias("gold"), (k % 17 == 0).alias("gold_blocked"), (k % 3 != 0).alias("recorded"), F.when(k % 4 == 0, F.concat(F.lit("doc"), (k % 7).cast("string"))).alias("gold_doc"),
        F.array(F.concat(F.lit("doc"), (k % 3).cast("string"))).alias("seen_docs"), F.when(k % 6 == 1, (k % 5).cast("int")).alias("gold_page"), F.array(F.lit(2)).alias("seen_pages"), (k % 5 != 0).alias("gold_seen"),
    )


@query(f"with {_STATE} select result_id, cause from c")
def miss_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    return s.select("result_id", reports.miss_cause(s).alias("cause"))


@query(f"with {_STATE} select expect, cause, count(*) as misses, items, round(count(*) / items, 6) as loss from (select *, count(*) over (partition by expect) as items from c) where cause <> 'ok' group by expect, cause, items")
def loss_by_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.ledger(_states(spark, sf_dir).fillna("", ["expect"]), "expect")).withColumn("expect", F.nullif(F.col("expect"), F.lit("")))


_L = "(select user_id % 50 as run, event_type as a, case when value > 90 then 'click' else event_type end as b from events)"


@query(f"""with g as (select run, a as label, count(*) as n from {_L} group by 1, 2), p as (select run, b as label, count(*) as m from {_L} group by 1, 2), j as (select run, label, coalesce(n, 0) as n, coalesce(m, 0) as m from g full join p using (run, label)),
  r as (select *, row_number() over (partition by run order by n desc, label) as x, row_number() over (partition by run order by m desc, label) as y from j), t as (select run, count(*) as items, count(*) filter (a = b) as "right" from {_L} group by 1)
  select run, bool_and(n = m) as counts_exact, bool_and(x = y) as ranking_kept, cast(sum(abs(n - m)) as bigint) as count_error, items, "right" from r join t using (run) group by run, items, "right" """)
def label_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labels: whether relabelling the great ones kept the counts and the order of labels."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_type").alias("a"), F.when(F.col("value") > 90, "click").otherwise(F.col("event_type")).alias("b"))
    return reports.label_diagnostics(e, "a", "b", "run")


_ARMS = """arms as (select arm, event_id as qid, ok as correct from (select event_id, value > 50 as base, event_type in ('click', 'view') as words, value > 48 as near from events where value is not null) unpivot (ok for arm in (base, words, near)))"""


@query(f"""with {_ARMS}, b as (select qid, correct as b from arms where arm = 'base'), d as (select arm, count(*) as shared, count(*) filter (correct and not b) as a_only, count(*) filter (b and not correct) as b_only from arms join b using (qid) group by 1),
  m as (select *, a_only + b_only as m, least(a_only, b_only) as k from d), t as (select arm, shared, a_only, b_only, case when m = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))))) end as p from m)
  select arm, count(*) as n, count(*) filter (correct) as correct, shared, a_only, b_only, round((a_only - b_only) / shared, 6) as diff, round(p, 6) as p_value from arms join t using (arm) group by arm, shared, a_only, b_only, p""")
def arms_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arms over the same items: accuracy and paired tests against one of them."""
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", F.explode(F.create_map(F.lit("base"), F.col("value") > 50, F.lit("words"), F.col("event_type").isin("click", "view"), F.lit("near"), F.col("value") > 48)).alias("arm", "correct"))
    return _rounded(reports.arms(e.withColumnRenamed("event_id", "qid"), "base")).drop("accuracy", "low", "high")


@query("""with r as (select distinct result_id, agrees as v, case result_id % 4 when 0 then 'right' when 1 then 'wrong' when 2 then 'gold' end as mark from field_results where agrees is not null)
  select count(mark) as reviewed, count(*) filter ((mark = 'right') = v) as agreed, count(*) filter (v and mark = 'wrong') as overturned_right, count(*) filter (not v and mark = 'right') as overturned_wrong, count(*) filter (mark = 'gold') as gold_errors, round(count(*) filter ((mark = 'right') = v) / count(mark), 6) as agreement from r""")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("result_id") % 4
    d = table(spark, sf_dir, "field_results").where("agrees is not null").select("result_id", F.col("agrees").alias("verdict")).distinct()
    return _rounded(reports.review_scores(d.withColumn("mark", F.when(k == 0, "right").when(k == 1, "wrong").when(k == 2, "gold"))))


@query(f"""with t as ({LIFECYCLE['graph_components'].strip().rstrip(';')}), s as (select component, count(*) as size from t group by 1 order by 2 desc, 1 limit 10), k as (select *, row_number() over (order by size desc, component) as rank from s)
  select cast(rank as integer) as rank, component, size, cast(nth as integer) as nth, node from (select k.*, node, row_number() over (partition by component order by node) as nth from t join k using (component)) where nth <= 5""")
def graph_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest conversations, largest first, with their first messages: a top-k report."""
    return reports.ranked_communities(graph.components(table(spark, sf_dir, "documents").select("doc_id", "parent_doc_id"), "doc_id", "parent_doc_id"))


@query("""with p as (select l_suppkey as query_id, l_partkey as item, sum(l_quantity) as q, sum(cast(l_extendedprice as decimal(18,2))) as v from lineitem group by 1, 2), r as (select query_id, item, row_number() over (partition by query_id order by q desc, item) as a, row_number() over (partition by query_id order by v desc, item) as b from p),
  e as (select query_id, item, a as rank from r where a <= 20 union all select query_id, item, b from r where b <= 20), s as (select query_id, item, round(sum(1.0::double / (60 + rank)), 9) as score, count(*) as lists from e group by 1, 2)
  select query_id, item, score, lists, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, item) as rank from s) where rank <= 10""")
def fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's parts by quantity and by value, both lists as one by reciprocal ranks."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    ranked = [p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "item"))).where("rank <= 20") for c in ("q", "v")]
    return reports.fused(ranked)


@query("""with r as (select result_id as run_id, field_id as qid, agrees, md5(answer) as d from (select distinct result_id, field_id, agrees, answer from field_results) where result_id % 7 <> 0 and agrees) select min(run_id) as run_id, qid from r group by qid, coalesce(d, cast(run_id as varchar))""")
def kept_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and right runs, those with the same answer to a question once."""
    d = table(spark, sf_dir, "field_results").select("result_id", "field_id", "agrees", "answer").distinct()
    runs = d.select(F.col("result_id").alias("run_id"), F.col("field_id").alias("qid"), F.when(F.col("result_id") % 7 == 0, "error").otherwise("final").alias("status"), F.col("agrees").cast("double").alias("score"), F.md5("answer").alias("digest"))
    return reports.kept_trajectories(runs).select("run_id", "qid")


@query("""select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where ts >= timestamp '2024-01-10') where r <= 3""")
def recent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent(table(spark, sf_dir, "events"), "user_id", "ts", 3, "2024-01-10", tie="event_id").select("event_id", "user_id")


_W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""with a as (select word, count(*) as in_a from (select distinct chunk_id, unnest({_W.format('text')}) as word from chunks) group by 1), b as (select word, count(*) as in_b from (select distinct item_id, unnest({_W.format('passage')}) as word from eval_items) group by 1) select word, in_a, in_b from a join b using (word)""")
def shared_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that chunks and test passages share, and in how many of each they stand."""
    return reports.shared_vocabulary(table(spark, sf_dir, "chunks").select("text"), table(spark, sf_dir, "eval_items").select(F.col("passage").alias("text")))


@query("""select 'c' || p_partkey as contract_id, case when p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_partkey % 11 = 0 then null else round(p_retailprice / p_size, 6) end as result, case when p_partkey % 5 = 0 then 'formula' when p_partkey % 7 = 0 then 'label' when p_partkey % 11 = 0 then 'unit or period' end as refusal from part""")
def metric_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio of two cells by contract for each part; some contracts lack a formula, name another label or another unit."""
    p = table(spark, sf_dir, "part")
    k, cid = F.col("p_partkey"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("contract_id")
    contracts = p.select(cid, F.when(k % 5 != 0, "direct_ratio").alias("formula"), F.lit("USD").alias("unit"), F.lit("2024").alias("period"))
    role = F.explode(F.array(F.struct(F.lit("numerator").alias("role"), F.lit("price").alias("col_name")), F.struct(F.lit("denominator").alias("role"), F.lit("size").alias("col_name")))).alias("r")
    sources = p.select(cid, role, F.lit("part").alias("table_name"), k.alias("row_idx"), F.lit("name").alias("label_col"), F.when(k % 7 == 0, "another").otherwise(F.col("p_name")).alias("label"))
    sources = sources.select("contract_id", "r.role", "table_name", "row_idx", "r.col_name", "label_col", "label")
    three = F.explode(F.array(*[F.struct(F.lit(n).alias("col_name"), F.col(c).cast("string").alias("raw"), v.cast("double").alias("num_value")) for n, c, v in (("name", "p_name", F.lit(None)), ("price", "p_retailprice", F.col("p_retailprice")), ("size", "p_size", F.col("p_size")))])).alias("c")
    cells = p.select(F.lit("part").alias("table_name"), k.alias("row_idx"), three, F.when(k % 11 == 0, "EUR").otherwise("USD").alias("unit"), F.lit("2024").alias("period")).select("table_name", "row_idx", "c.*", "unit", "period")
    out = reports.contract_results(contracts, sources, cells)
    return out.select("contract_id", F.round(F.col("result").cast("double"), 6).alias("result"), "refusal")


@query("""with h as (select distinct result_id, expect, agrees, answer from field_results where agrees is not null and expect is not null), k as (select *, """ + _KEY.format("answer") + """ as ak from h), x as (select *, """ + _NEGATIVE.format("ak") + """ as neg from k)
  select round(count(*) filter (expect = 'absent' and not neg and not agrees) / count(*) filter (expect = 'absent'), 6) as false_positive_rate, round(count(*) filter (expect <> 'absent' and neg) / count(*) filter (expect <> 'absent'), 6) as abstain_rate from x""")
def absence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive rate over absent items, abstain rate over value items."""
    from folioquarry.plans.evaluation_queries import absence

    return _rounded(absence(spark, sf_dir))


@query("""with e as (select event_type as name, user_id % 3 as shard, value, row_number() over (partition by event_type, user_id % 3 order by value) as r, count(*) over (partition by event_type, user_id % 3) as n from events where value is not null)
  select name, shard, count(*) as observations, max(value) filter (r = greatest(ceil(n * 0.5), 1)) as p50, max(value) filter (r = greatest(ceil(n * 0.95), 1)) as p95, max(value) as most, round(sum(value), 4) as total from e group by 1, 2""")
def meter_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as observations by kind and shard."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("shard"), "value")
    return reports.meter(e, "shard").withColumn("total", F.round("total", 4))


@query(f"with {_STATE} select result_id as qid, case when same then 'Answer: ' || golden end as predicted, golden as gold, cause, 'doc' || (result_id % 3) as seen_docs from c")
def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a reviewer gets of every result."""
    return reports.audit_rows(_states(spark, sf_dir).withColumnRenamed("result_id", "qid")).drop("mark")


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relational tables as grids of text with a header row: what a parser of files delivers."""
    out = None
    for name, key, cols in (("part", "p_partkey", ("p_name", "p_size", "p_retailprice", "p_brand")), ("customer", "c_custkey", ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))):
        d = table(spark, sf_dir, name)
        cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("col_idx", "raw")
        body = d.select((F.col(key) + 1).cast("int").alias("row_idx"), cells)
        head = spark.createDataFrame([(0, j, c) for j, c in enumerate(cols)], "row_idx int, col_idx int, raw string")
        g = body.unionByName(head).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(name).alias("table_name"), F.lit(name).alias("caption"), "row_idx", "col_idx", "raw", F.lit(False).alias("flagged"))
        out = g if out is None else out.unionByName(g)
    return out


_COLS = (("part", "p_name", 0), ("part", "p_size", 1), ("part", "p_retailprice", 2), ("part", "p_brand", 3), ("customer", "c_name", 0), ("customer", "c_nationkey", 1), ("customer", "c_acctbal", 2), ("customer", "c_mktsegment", 3))


@query(" union all ".join(f"select '{t}' as table_name, cast({j} as integer) as col_idx, '{c}' as name, case when count(try_cast(cast({c} as varchar) as double)) < count(*) then 'TEXT' when bool_and(try_cast(cast({c} as varchar) as double) = floor(try_cast(cast({c} as varchar) as double))) then 'INTEGER' else 'REAL' end as sql_type, count({c}) as n_values, round(sum(try_cast(cast({c} as varchar) as double)), 2) as total from {t}" for t, c, j in _COLS))
def built_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the columns of grids, with the number of their values and the sum of their cells."""
    columns, cells = build.built(_grids(spark, sf_dir))
    total = cells.groupBy("table_name", "col_idx").agg(F.round(F.sum("num_value"), 2).alias("total"))
    return columns.join(total, ["table_name", "col_idx"], "left").select("table_name", "col_idx", "name", "sql_type", "n_values", "total")


@query(" union all ".join(f"select '{t}' as table_name, cast({k} + 1 as integer) as row_idx, '{c}' as col_name, cast({c} as varchar) as raw, cast(case when '{c}' in ('p_size', 'p_retailprice', 'c_nationkey', 'c_acctbal') then try_cast(cast({c} as varchar) as double) end as double) as num_value from {t}" for t, k, c in (("part" if c.startswith("p_") else "customer", "p_partkey" if c.startswith("p_") else "c_custkey", c) for _, c, _ in _COLS)))
def built_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the grids with its raw text, its number and its place."""
    return build.built(_grids(spark, sf_dir))[1].select("table_name", "row_idx", "col_name", "raw", "num_value")


@query("""with d as (select doc_id, 'm' || doc_id || '.eml' as p, coalesce(title, 'none') as t, 'k,v' || chr(10) || 'a,' || doc_id || chr(10) as c, regexp_replace(coalesce(text, ''), '^\\n+|\\n+$', '', 'g') as b from documents)
  select p as path, cast(null as varchar) as parent, 'eml' as parser, t || chr(10) || 'From: a@b.example' || chr(10) || replace(b, E'\\r', '') || chr(10) || '[attachment: t.csv]' as text, 0 as n_grids from d union all select p || '::t.csv', p, 'csv', c, 1 from d""")
def expanded_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with a table attached, made of all documents and taken apart: the mail, and the attachment under its parent with its grid."""
    d = table(spark, sf_dir, "documents")
    part = lambda kind, extra, body: F.concat(F.lit(f"--x\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: base64\n{extra}\n"), F.base64(F.encode(body, "utf-8")), F.lit("\n"))
    raw = F.concat(
        F.lit("From: a@b.example\nSubject: "), F.coalesce("title", F.lit("none")), F.lit('\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="x"\n\n'), part("text/plain", "", F.coalesce("text", F.lit(""))),
        part("text/csv", 'Content-Disposition: attachment; filename="t.csv"\n', F.concat(F.lit("k,v\na,"), F.col("doc_id").cast("string"), F.lit("\n"))), F.lit("--x--\n"),
    )
    files = d.select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".eml")).alias("path"), F.encode(raw, "utf-8").alias("content"))
    return grids.expand(files).where("error is null").select("path", "parent", "parser", "text", F.size("grids").alias("n_grids"))


QUERIES, ORACLE = R.queries, R.oracle
