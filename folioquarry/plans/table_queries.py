"""Queries over tables and cells: typing, zone maps, totals, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import numeric as N
from folioquarry.operators import tables, validate
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table
from folioquarry.sources import delimited

R = Registry()
query = R.query

_CELLS = """select 'supplier' as table_name, s_suppkey as row_idx, col_name, text_value, num_value from (
  select s_suppkey, unnest([{'col_name': 's_suppkey', 'text_value': cast(s_suppkey as varchar), 'num_value': cast(s_suppkey as double)}, {'col_name': 's_name', 'text_value': lower(s_name), 'num_value': cast(null as double)},
  {'col_name': 's_nationkey', 'text_value': cast(s_nationkey as varchar), 'num_value': cast(s_nationkey as double)}], recursive := true) from supplier)"""


@query(_CELLS)
def cells_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_cells(table(spark, sf_dir, "supplier").drop("s_acctbal"), "supplier", "s_suppkey")


@query("""with c as (select 'l_quantity' as col_name, cast(l_quantity as double) as v, cast(null as varchar) as t, l_returnflag as f from lineitem union all select 'l_shipmode_flag', null, lower(nullif(l_returnflag, 'N')), l_returnflag from lineitem union all select 'l_discount', nullif(l_discount, 0.0), null, l_returnflag from lineitem)
  select col_name, count(*) as n_rows, count(*) - count(coalesce(t, cast(v as varchar))) as n_null, min(v) as min_value, max(v) as max_value, count(distinct t) as n_distinct, min(t) as least_text, max(t) as greatest_text from c group by col_name""")
def zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column statistics over all line items, with nulls made of zeros and of one flag."""
    d = table(spark, sf_dir, "lineitem")
    stack = d.select(F.explode(F.array(
        F.struct(F.lit("l_quantity").alias("col_name"), F.col("l_quantity").alias("num_value"), F.lit(None).cast("string").alias("text_value")),
        F.struct(F.lit("l_shipmode_flag").alias("col_name"), F.lit(None).cast("double").alias("num_value"), F.lower(F.nullif("l_returnflag", F.lit("N"))).alias("text_value")),
        F.struct(F.lit("l_discount").alias("col_name"), F.nullif("l_discount", F.lit(0.0)).alias("num_value"), F.lit(None).cast("string").alias("text_value")),
    )).alias("c")).select("c.*")
    z = tables.zone_maps(stack, "col_name")
    nulls = stack.groupBy("col_name").agg(F.count_if(F.coalesce(F.col("text_value"), F.col("num_value").cast("string")).isNull()).alias("n_null"))
    return z.drop("n_null").join(nulls, "col_name")


# Money as text in nine spellings, by the order key; the number it stands for is known.
_CENTS = "cast(round(o_totalprice * 100) as bigint)"


def _spelt(d: DataFrame) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    us = F.concat(grouped, F.lit("."), part)
    k = F.col("o_orderkey") % 9
    raw = (
        F.when(k == 0, us).when(k == 1, F.concat(F.lit("("), us, F.lit(")"))).when(k == 2, F.concat(F.lit("$"), us)).when(k == 3, F.concat(F.lit("$-"), us)).when(k == 4, F.concat(us, F.lit("(1)")))
        .when(k == 5, F.lit("n/a")).when(k == 6, F.concat(us, F.lit("%"))).when(k == 7, F.concat(F.lit("−"), us)).otherwise(F.concat(F.lit(" "), us, F.lit("k ")))
    )
    return d.select("o_orderkey", k.alias("spelling"), raw.alias("raw"))


@query(f"""select o_orderkey, case o_orderkey % 9 when 5 then null when 1 then -v when 3 then -v when 7 then -v when 8 then round(v * 1000, 2) else v end as value from (select o_orderkey, cast({_CENTS} as double) / 100.0 as v from orders)""")
def coerce_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order total spelt as text and read back."""
    s = _spelt(table(spark, sf_dir, "orders"))
    return s.select("o_orderkey", F.round(N.coerce_cell(F.col("raw")), 2).alias("value"))


@query("""select o_orderpriority as table_name, col_name, count(*) as n_values, style, case col_name when 'mixed' then round(sum(case when o_orderkey % 4 = 0 then 0.0 else 1.0 end) / count(*), 6) else 1.0 end as coverage, sql_type from orders,
  (values ('us', 'us', 'REAL'), ('eu', 'eu', 'REAL'), ('whole', 'us', 'INTEGER'), ('mixed', 'us', 'TEXT')) t(col_name, style, sql_type) group by 1, 2, style, sql_type""")
def coerce_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of four columns of one content: US, EU, whole numbers, and with a quarter of words."""
    d = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    grouped, part = F.format_number(F.floor(cents / 100), 0), F.lpad((cents % 100).cast("string"), 2, "0")
    us = F.concat(grouped, F.lit("."), part)
    eu = F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), part)
    cells = d.select(F.col("o_orderpriority").alias("table_name"), F.explode(F.array(
        F.struct(F.lit("us").alias("col_name"), us.alias("raw")), F.struct(F.lit("eu").alias("col_name"), eu.alias("raw")),
        F.struct(F.lit("whole").alias("col_name"), grouped.alias("raw")), F.struct(F.lit("mixed").alias("col_name"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("see note")).otherwise(us).alias("raw")),
    )).alias("c")).select("table_name", "c.*")
    return tables.column_types(cells, "table_name", "col_name").withColumn("coverage", F.round("coverage", 6))


@query("select o_orderpriority, cast(sum(case when o_orderkey % 3 < 2 and o_totalprice >= 1000 then 1 else 0 end) as bigint) as us_votes, cast(sum(case when o_orderkey % 3 = 2 and o_totalprice >= 1000 then 1 else 0 end) as bigint) as eu_votes, case when sum(case when o_orderkey % 3 = 2 and o_totalprice >= 1000 then 1 else 0 end) > sum(case when o_orderkey % 3 < 2 and o_totalprice >= 1000 then 1 else 0 end) then 'eu' else 'us' end as style from orders group by 1")
def detect_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of columns that mix both styles; only grouped cells count."""
    d = table(spark, sf_dir, "orders")
    whole = F.format_number(F.floor("o_totalprice"), 0)
    raw = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(",5"))).otherwise(F.concat(whole, F.lit(".50")))
    raw = F.when(F.col("o_totalprice") >= 1000, raw).otherwise(F.lit("12"))
    us, eu = N.style_votes(F.col("raw"))
    g = d.select("o_orderpriority", raw.alias("raw")).groupBy("o_orderpriority").agg(us.alias("us_votes"), eu.alias("eu_votes"))
    return g.withColumn("style", N.pick_style(F.col("us_votes"), F.col("eu_votes")))


@query("""select k.label, k.others, count(*) as n, case when k.label in ('Total', 'Grand total', 'Total:', 'Sum of fees', 'Order total') then 'total' when k.label in ('Subtotal', 'Sub-total fees') then 'subtotal' when k.label in ('(1) restated', '* see note') and k.others = 0 then 'footnote' when k.others = 0 then 'section' else 'data' end as row_kind
  from part, (values (0,'Total',1),(1,'Grand total',1),(2,'Total:',2),(3,'Subtotal',1),(4,'Sub-total fees',1),(5,'(1) restated',0),(6,'* see note',0),(7,'Fees',0),(8,'Fees',2),(9,'The total is due',1),(10,'Net income',1),(11,'Sum of fees',1),(12,'Order total',3)) k(i, label, others) where k.i = p_partkey % 13 group by all""")
def row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = [("Total", 1), ("Grand total", 1), ("Total:", 2), ("Subtotal", 1), ("Sub-total fees", 1), ("(1) restated", 0), ("* see note", 0), ("Fees", 0), ("Fees", 2), ("The total is due", 1), ("Net income", 1), ("Sum of fees", 1), ("Order total", 3)]
    d = table(spark, sf_dir, "part")
    pick = F.element_at(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("others")) for a, b in labels]), (F.col("p_partkey") % 13 + 1).cast("int"))
    rows = d.select(pick.alias("r")).select("r.*")
    return rows.withColumn("row_kind", tables.row_kind(F.col("label"), F.col("others"))).groupBy("label", "others", "row_kind").agg(F.count(F.lit(1)).alias("n"))


def _with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each order and a total row made of them, a fifth of them spoilt."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    items = d.select(F.col("l_orderkey").alias("table_name"), F.lit("data").alias("row_kind"), F.col("v").cast("double").alias("num_value"))
    s = d.groupBy("l_orderkey").agg(F.sum("v").alias("s"))
    total = s.select(F.col("l_orderkey").alias("table_name"), F.lit("total").alias("row_kind"), (F.col("s") + F.when(F.col("l_orderkey") % 5 == 0, F.col("s") * 0.02 + 5).otherwise(0.4)).cast("double").alias("num_value"))
    return items.unionByName(total)


@query("""with s as (select l_orderkey as k, sum(cast(l_extendedprice as decimal(18,2))) as s, count(*) as n from lineitem group by 1) select k as table_name, n as items, cast(s as double) as item_sum, case when n >= 2 then k % 5 <> 0 end as passed from s""")
def checksum_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.flat_totals(_with_totals(spark, sf_dir), "table_name").drop("total")


@query("""with o as (select o_custkey, o_orderstatus as s, cast(o_totalprice as decimal(18,2)) as v from orders where o_custkey is not null), g as (select o_custkey, s, count(*) as n, cast(sum(v) as double) as t from o group by 1, 2),
  r as (select *, sum(n + 2) over (partition by o_custkey order by s) as row_idx from g) select o_custkey as table_name, cast(row_idx as bigint) as row_idx, 'subtotal' as kind, round(case when o_custkey % 7 = 0 then t * 1.5 else t end + 1e-4, 2) as found, round(t, 2) as expected, o_custkey % 7 <> 0 or abs(t * 0.5) <= greatest(0.005 * t, 1.0) as passed from r where n >= 2""")
def nested_section_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as sections with subtotals and a grand total: all pass but those spoilt."""
    o = table(spark, sf_dir, "orders").where("o_custkey is not null")
    c = F.col("o_totalprice").cast("decimal(18,2)").cast("double")
    items = o.select("o_custkey", F.col("o_orderstatus").alias("s"), F.lit(1).alias("step"), F.col("o_orderkey").alias("k"), F.lit("data").alias("row_kind"), F.lit("order").alias("label"), c.alias("num_value"))
    heads = o.select("o_custkey", F.col("o_orderstatus").alias("s")).distinct().select("o_custkey", "s", F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("k"), F.lit("section").alias("row_kind"), F.col("s").alias("label"), F.lit(None).cast("double").alias("num_value"))
    subs = o.groupBy("o_custkey", F.col("o_orderstatus").alias("s")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    subs = subs.select("o_custkey", "s", F.lit(2).alias("step"), F.lit(0).cast("bigint").alias("k"), F.lit("subtotal").alias("row_kind"), F.lit("Subtotal").alias("label"), F.when(F.col("o_custkey") % 7 == 0, F.col("v") * 1.5).otherwise(F.col("v")).alias("num_value"))
    from pyspark.sql import Window

    rows = items.unionByName(heads).unionByName(subs)
    rows = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("o_custkey").orderBy("s", "step", "k")).cast("bigint"))
    return validate.nested_totals(rows.withColumnRenamed("o_custkey", "table_name")).withColumn("expected", F.round("expected", 2)).withColumn("found", F.round(F.col("found") + 1e-4, 2))


@query("""with r as (select row_key, table_name, delimiter as d, len(header) as n, string_split(coalesce(raw_line, ''), '"') as q from raw_rows join raw_tables using (table_name)),
  p as (select row_key, table_name, n, d, unnest(q) as part, generate_subscripts(q, 1) as i from r), l as (select row_key, table_name, 1 + sum(case when i % 2 = 1 then len(string_split(part, d)) - 1 else 0 end) as w, max(n) as n from p group by 1, 2)
  select table_name, max(w) <= max(n) as grid_width from l group by 1""")
def structural_grid_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any delivered row is wider than its table's header, delimiters between quotes aside."""
    t = table(spark, sf_dir, "raw_tables")
    cells = delimited.split_rows(table(spark, sf_dir, "raw_rows"), t).select("table_name", F.col("row_key").alias("row_idx"), F.posexplode("fields").alias("col_idx", "raw"))
    return validate.structural(t, cells).join(cells.select("table_name").distinct(), "table_name", "left_semi").select("table_name", "grid_width")


@query("""with e as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by event_id) as p from events) select user_id, coalesce(bool_and(p is null or p <= ts), true) or coalesce(bool_and(p is null or p >= ts), true) as monotonic, count(*) as n from e group by 1""")
def monotonic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.monotonic(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")


@query("""with s as (select l_orderkey as k, count(*) as n from lineitem group by 1), g as (select k, case when n >= 2 then case when k % 5 <> 0 then 1.0 else 0.0 end end as a, 1.0 as st from s),
  c as (select k, a, case when a is null then 1.0 else (a * 0.5 + 0.3) / 0.8 end as conf from g) select k as table_name, round(conf, 6) as confidence, case when a is null then 'unchecked' when conf < 0.7 then 'untrusted' else 'trusted' end as status from c""")
def table_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = validate.flat_totals(_with_totals(spark, sf_dir), "table_name")
    conf = validate.confidence(F.col("passed").cast("double"), F.lit(1.0))
    return t.select("table_name", F.round(conf, 6).alias("confidence"), validate.table_status(F.lit(False), F.col("passed").isNotNull(), conf).alias("status"))


@query("""with p as (select doc_id, page, lead(page) over (partition by doc_id order by page) as nx, lag(page) over (partition by doc_id order by page) as pv from (select distinct doc_id, page from doc_text)) select doc_id, page, cast(sum(case when pv is not null and pv + 1 = page and doc_id % 2 = 0 then 0 else 1 end) over (partition by doc_id order by page) as bigint) as table_no from p""")
def multipage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table part on each page; those of even documents carry one caption, some with ``continued``."""
    p = table(spark, sf_dir, "doc_text").select("doc_id", "page").distinct()
    parts = p.select("doc_id", F.lit(0).alias("part"), "page", F.lit(3).alias("n_cols"), F.lit("a|b|c").alias("header"), F.when(F.col("doc_id") % 2 == 0, F.when(F.col("page") > 1, F.lit("Fees (continued)")).otherwise(F.lit("Fees"))).alias("caption"))
    return tables.merge_multipage(parts).select("doc_id", "page", "table_no")


@query("""with a as (select table_name, raw_line, count(*) as n1 from raw_rows group by all), b as (select table_name, raw_line, count(*) as n2 from raw_rows where row_key % 10 <> 0 group by all)
  select table_name, cast(sum(least(n1, coalesce(n2, 0))) as bigint) as shared, round(sum(least(n1, coalesce(n2, 0))) / greatest(sum(n1), sum(coalesce(n2, 0))), 6) as overlap from a left join b on a.table_name = b.table_name and a.raw_line is not distinct from b.raw_line group by all""".replace("select table_name, cast", "select a.table_name, cast"))
def multiset_table_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivered table against an extraction that missed a tenth of its rows."""
    r = table(spark, sf_dir, "raw_rows").select("row_key", "table_name", F.coalesce("raw_line", F.lit("")).alias("raw"))
    return tables.multiset_overlap(r, r.where("row_key % 10 <> 0")).withColumn("overlap", F.round("overlap", 6))


_NAMING, _QUOTIENTS = (str(sorted(x)) for x in (tables.NAMING, tables.QUOTIENTS))


@query(f"""with h as (select table_name, name, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}%]+') as w from (select table_name, unnest(header) as name from raw_tables))
  select table_name, name, (len(w) > 0 and list_has_all({_NAMING}, w)) or list_has_any({_QUOTIENTS}, w) or list_contains(w, 'per') or (list_has_any(['balance', 'balances'], w) and list_has_any({sorted(tables.MOMENTS)}, w)) or list_has_all(w, ['unit', 'price']) or (list_contains(w, 'purchased') and list_has_any(['yet', 'still'], w)) as non_additive from h""")
def non_additive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "raw_tables").select("table_name", F.explode("header").alias("name"))
    return h.withColumn("non_additive", tables.non_additive(F.col("name")))


@query("""with s as (select l_orderkey as k, count(*) as n from lineitem group by 1) select k as table_name, case when k % 2 = 0 then 'eu' else 'us' end as kept_style, true as passed from s where n >= 2""")
def style_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose few grouped cells vote for the wrong style: the total check brings them back."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_extendedprice").cast("bigint").alias("v"))
    spelt = lambda v, k: F.when(k % 2 == 0, F.concat(v.cast("string"), F.lit(",00"))).otherwise(F.concat(v.cast("string"), F.lit(".00")))
    items = d.select(F.col("l_orderkey").alias("table_name"), F.lit("data").alias("row_kind"), spelt(F.col("v"), F.col("l_orderkey")).alias("raw"))
    t = d.groupBy("l_orderkey").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    total = t.select(F.col("l_orderkey").alias("table_name"), F.lit("total").alias("row_kind"), spelt(F.col("v"), F.col("l_orderkey")).alias("raw"))
    cells = items.join(t.select(F.col("l_orderkey").alias("table_name")), "table_name", "left_semi").unionByName(total)
    return validate.style_rollback(cells, "table_name").select("table_name", "kept_style", "passed")


QUERIES, ORACLE = R.queries, R.oracle
