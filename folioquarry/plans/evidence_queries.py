"""Queries of quotations, bindings and certified aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import text as T
from folioquarry.operators import certify, evidence
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table

R = Registry()
query = R.query

_FOLD = "trim(regexp_replace(lower(translate({0}, '‐‑‒–—―−﹘﹣－‘’‚‛´`“”„‟«»', '----------''''''''''''\"\"\"\"\"\"')), '\\s+', ' ', 'g'))"


@query(f"""with q as (select item_id as quote_id, {_FOLD.format("string_split(passage, '. ')[1]")} as needle from eval_items), d as (select doc_id, {_FOLD.format('text')} as hay from documents where text is not null)
  select quote_id, doc_id from q join d on contains(hay, needle) where needle <> ''""")
def verify_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences of the held-out passages found as quotations in the documents."""
    q = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("quote_id"), F.substring_index("passage", ". ", 1).alias("quote"))
    return evidence.verify_quotes(q, table(spark, sf_dir, "documents")).select("quote_id", "doc_id")


@query("""with f as (select i.item_id, bool_or(contains(d.text, string_split(passage, '. ')[1])) as hit from eval_items i, (select text from documents where text is not null) d group by 1) select dataset as answer_id, count(*) as quotes, cast(sum(cast(hit as int)) as bigint) as found, sum(cast(hit as int)) = count(*) as passed from f join eval_items using (item_id) group by 1""")
def quotes_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets as answers that quote all their items: all must be found."""
    i = table(spark, sf_dir, "eval_items")
    q = i.select(F.col("item_id").alias("quote_id"), F.substring_index("passage", ". ", 1).alias("quote"))
    found = evidence.verify_quotes(q, table(spark, sf_dir, "documents"))
    exact = found.join(q, "quote_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where(F.contains("text", "quote"))
    return evidence.passed(i.select(F.col("dataset").alias("answer_id"), F.col("item_id").alias("quote_id")), exact)


@query(f"select doc_id, sha256({_FOLD.format('text')}) as folded from documents where text is not null")
def quote_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(T.quote_key(F.col("text")), 256).alias("folded"))


@query("""with h as (select chunk_id, doc_id, page from chunks), t as (select doc_id, 't_' || cast(page as varchar) as table_name, case when page % 3 = 0 then null else page end as page_start, case when page % 2 = 0 then page + 1 end as page_end from (select distinct doc_id, page from doc_text))
  select chunk_id, h.doc_id, h.page, table_name from h join t on h.doc_id = t.doc_id and (page_start is null or h.page between page_start and coalesce(page_end, page_start))""")
def table_page_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits bound to the tables whose page interval holds them, open and null ends included."""
    t = table(spark, sf_dir, "doc_text").select("doc_id", "page").distinct()
    t = t.select("doc_id", F.concat(F.lit("t_"), F.col("page").cast("string")).alias("table_name"), F.when(F.col("page") % 3 != 0, F.col("page")).alias("page_start"), F.when(F.col("page") % 2 == 0, F.col("page") + 1).alias("page_end"))
    hits = table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "page")
    return evidence.bind_tables(hits, t).select("chunk_id", "doc_id", "page", "table_name")


@query("""with l as (select doc_id, i, trim(l[i]) as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, E'\\n') as l from documents)) ), w as (select distinct doc_id, trim(string_split(text, E'\\n')[1]) as line from documents where text is not null), j as (select w.doc_id, count(i) as n, min(i) as i from w left join l using (doc_id, line) group by w.doc_id)
  select doc_id as row_id, doc_id, case when n = 1 then 'line' else 'page_only' end as precision, case when n = 1 then cast(i as integer) end as line_no from j""")
def exact_row_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line looked for as a table row: exact where it stands once."""
    d = table(spark, sf_dir, "documents")
    rows = d.where("text is not null").select(F.col("doc_id").alias("row_id"), "doc_id", F.element_at(F.split("text", "\n"), 1).alias("line"))
    return evidence.exact_rows(rows, d)


@query()
def source_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of a phrase's first hit in each chunk, kept within its section."""
    from folioquarry.operators.layout import snippets

    c = table(spark, sf_dir, "chunks").dropDuplicates(["doc_id", "char_start"])
    at = F.instr("text", "harbour project")
    hits = c.where(at > 0).select("doc_id", F.col("chunk_id").alias("hit_id"), (F.col("char_start") + at - 1).alias("char_start"), (F.col("char_start") + at + 14).alias("char_end"))
    return snippets(hits, table(spark, sf_dir, "documents").where("text is not null"), c)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders")
    return d.select(F.col("o_orderpriority"), F.col("o_orderstatus").alias("table_name"), F.col("o_orderkey").alias("row_idx"), "o_totalprice")


for _op, _sql in (("sum", "sum(v)"), ("count", "count(*)"), ("mean", "cast(sum(v) as double) / count(*)"), ("min", "min(v)"), ("max", "max(v)")):

    def _certified(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        c = certify.certified(_rows(spark, sf_dir), op, "o_totalprice", "o_orderpriority").drop("digest")
        return c.select("o_orderpriority", F.round(F.col("result").cast("double"), 2).alias("result"), "n_rows", "n_tables", F.col("least").cast("double").alias("least"), F.col("greatest").cast("double").alias("greatest"))

    query(
        f"select o_orderpriority, round(cast({_sql} as double), 2) as result, count(*) as n_rows, count(distinct o_orderstatus) as n_tables, cast(min(v) as double) as least, cast(max(v) as double) as greatest from (select *, cast(o_totalprice as decimal(18,4)) as v from orders) group by 1",
        name=f"certified_{_op}",
    )(_certified)


@query("select o_orderpriority from orders where o_orderpriority = '1-URGENT' group by 1")
def certificate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose certificate fails once one of their rows has changed."""
    rows = _rows(spark, sf_dir)
    old = certify.certified(rows, "sum", "o_totalprice", "o_orderpriority")
    first = rows.where("o_orderpriority = '1-URGENT'").agg(F.min("row_idx").alias("m"))
    changed = rows.join(F.broadcast(first)).withColumn("o_totalprice", F.when((F.col("row_idx") == F.col("m")), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).drop("m")  # ``first`` is one row
    return certify.replay(old, changed, "sum", "o_totalprice", "o_orderpriority").select("o_orderpriority")


@query("""with c as (select o_custkey, sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) else 0 end) as f, sum(cast(o_totalprice as decimal(18,2))) as t, count(*) as n from orders group by 1) select o_custkey, round(cast(f as double) / cast(t as double) * 100, 3) as share_percent, cast(t - f as double) as open_sum, round(cast(t as double) / n + 1e-9, 4) as mean_total from c where t <> 0""")
def calc_ratio_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_totalprice").cast("decimal(18,2)")
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", v).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("f"), F.sum(v).alias("t"), F.count(F.lit(1)).alias("n")).where("t <> 0")
    share = certify.calculate("percent", certify.calculate("divide", F.col("f"), F.col("t")))
    mean = certify.calculate("divide", F.col("t"), F.col("n"))
    return c.select("o_custkey", F.round(share.cast("double"), 3).alias("share_percent"), certify.calculate("subtract", F.col("t"), F.col("f")).cast("double").alias("open_sum"), F.round(mean.cast("double") + 1e-9, 4).alias("mean_total"))


@query("""select p_partkey, round(p_retailprice - p_size, 4) as working_capital, round((p_size + p_retailprice) / (p_size + 1), 4) as quick_ratio, round(p_size / p_retailprice * 100 + 1e-9, 3) as gross_margin, round(p_retailprice / ((p_size + (p_size + 3)) / 2.0), 4) as inventory_turnover from (select p_partkey, cast(p_size as double) as p_size, round(p_retailprice, 2) as p_retailprice from part)""")
def financial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named metrics by explicit conventions over columns that stand in for the roles."""
    p = table(spark, sf_dir, "part")
    a, b = F.round("p_retailprice", 2), F.col("p_size")
    m = certify.metric
    out = {
        "working_capital": m("working_capital", "total", {"current_assets": a, "current_liabilities": b}),
        "quick_ratio": m("quick_ratio", "cash_receivables", {"cash": b, "receivables": a, "current_liabilities": b + 1}),
        "gross_margin": m("gross_margin", "gross_profit_over_revenue", {"gross_profit": b, "revenue": a}),
        "inventory_turnover": m("inventory_turnover", "average", {"cost_of_sales": a, "beginning_inventory": b, "ending_inventory": b + 3}),
    }
    return p.select("p_partkey", *[F.round(c.cast("double"), 3 if n == "gross_margin" else 4).alias(n) for n, c in out.items()])


_DAG = """g as (select o_custkey as k, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as t, sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) else 0 end) as f from orders where o_custkey is not null group by 1),
  e as (select 'open:' || k as id, cast(t - f as double) as value, 1 as depth, cast(null as varchar) as refusal from g union all select 'share:' || k, case when t <> f then cast(f as double) / cast(t - f as double) end, 2, case when t = f then 'no value' end from g
    union all select 'percent:' || k, case when t <> f then cast(f as double) / cast(t - f as double) * 100 end, 3, case when t = f then 'refused' end from g union all select 'odd:' || k, null, 1, 'operand' from g)"""


def _dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sums of every customer as facts, and four steps on them: what is open, closed by open, in percent, and one that asks for what isn't there."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    g = table(spark, sf_dir, "orders").where("o_custkey is not null").groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.sum(v).alias("t"), F.sum(F.when(F.col("o_orderstatus") == "F", v).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("f"))
    name = lambda p: F.concat(F.lit(p), F.col("k"))
    facts = g.select(F.explode(F.array(F.struct(name("total:").alias("id"), F.col("t").cast("string").alias("value")), F.struct(name("closed:").alias("id"), F.col("f").cast("string").alias("value")))).alias("x")).select("x.*")
    step = lambda p, op, *on: F.struct(name(p).alias("id"), F.lit(op).alias("op"), F.array(*[name(o) for o in on]).alias("operands"))
    steps = g.select(F.explode(F.array(step("open:", "subtract", "total:", "closed:"), step("share:", "divide", "closed:", "open:"), step("percent:", "percent", "share:"), step("odd:", "sum", "total:", "none:"))).alias("x")).select("x.*")
    return facts, steps


@query(f"with {_DAG} select id, round(value, 6) as value, depth, refusal from e")
def evidence_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = certify.evaluated(*_dag(spark, sf_dir)).where("id not like 'total:%' and id not like 'closed:%'")
    return out.select("id", F.round(F.col("value").cast("double"), 6).alias("value"), "depth", "refusal")


@query("""select id from (select 'closed:' || k as id, k, f, t from (select o_custkey as k, sum(cast(o_totalprice as decimal(18,2))) as t, sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) else 0 end) as f from orders where o_custkey is not null group by 1)) where k % 100 = 7
  union all select p || k from (select distinct o_custkey as k from orders where o_custkey % 100 = 7), (values ('open:'), ('share:'), ('percent:')) v(p)""")
def evidence_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no longer holds once the closed sums of some customers have grown by one."""
    facts, steps = _dag(spark, sf_dir)
    grown = F.col("id").startswith("closed:") & (F.substring_index("id", ":", -1).cast("int") % 100 == 7)
    return certify.stale(certify.evaluated(facts, steps), facts.withColumn("value", F.when(grown, (F.col("value").cast("decimal(18,2)") + 1).cast("string")).otherwise(F.col("value"))), steps)


QUERIES, ORACLE = R.queries, R.oracle
