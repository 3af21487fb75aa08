"""Relational shapes that questions need: thresholds, arg-max, anti-joins, as-of lookups, windows over time, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquarry.operators import temporal
from folioquarry.operators.graph import shared_pairs
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table
from folioquarry.streaming import ingest as stream

R = Registry()
query = R.query
_MONEY = "cast(l_extendedprice as decimal(18,2))"


@query("""select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_base_price, round(cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double), 4) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
  from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    p, disc = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    return d.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(p).cast("double").alias("sum_base_price"), F.round(F.sum(p * (1 - disc)).cast("double"), 4).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )


@query("select n_name, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 2) as revenue, count(distinct c_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' group by 1")
def agg_filtered_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"), F.count_distinct("c_custkey").alias("customers"))


@query("select o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders) where rn = 1")
def agg_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders")
    return d.groupBy("o_orderpriority").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("r")).select("o_orderpriority", "r.*")


@query("select o_custkey, count(*) as orders from orders group by 1 having count(*) > 12")
def agg_count_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")).where("orders > 12")


@query("select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_orderkey) as orders from lineitem group by 1")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def set_unpaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without any line: the shape of ``not paid``."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return table(spark, sf_dir, "orders").join(l, "o_orderkey", "left_anti").select("o_orderkey")


@query("""select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) - coalesce(sum(p), 0) as double) as outstanding from orders left join (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as p from lineitem where l_shipdate <= timestamp '1996-01-01' group by 1) on l_orderkey = o_orderkey where o_orderdate <= timestamp '1996-01-01' group by 1""")
def outstanding_as_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer owed on a day: orders by then less lines shipped by then."""
    paid = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1996-01-01 00:00:00'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("p"))
    o = table(spark, sf_dir, "orders").where("o_orderdate <= timestamp_ntz'1996-01-01 00:00:00'").join(paid, "o_orderkey", "left")
    return o.groupBy("o_custkey").agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) - F.coalesce(F.sum("p"), F.lit(0))).cast("double").alias("outstanding"))


@query("""with f as (select event_id, user_id, ts from events where event_id % 5 <> 0), r as (select user_id, ts as since, event_id as rate from events where event_id % 5 = 0)
  select event_id, user_id, rate as in_force from (select f.event_id, f.user_id, r.rate, row_number() over (partition by f.event_id order by r.since desc, r.rate desc) as rn from f left join r on r.user_id = f.user_id and r.since <= f.ts) where rn = 1""")
def effective_dated_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the rate of its user in force at its time."""
    e = table(spark, sf_dir, "events")
    return temporal.effective(e.where("event_id % 5 <> 0").select("event_id", "user_id", "ts"), e.where("event_id % 5 = 0").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("rate")), "user_id", "ts", "since", "rate").select("event_id", "user_id", "in_force")


@query("select event_id, user_id, (select count(*) from events p where p.user_id = e.user_id and epoch(p.ts) // 1 between epoch(e.ts) // 1 - 86400 and epoch(e.ts) // 1) as in_window from events e")
def rpm_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the day up to each event."""
    return temporal.sliding_count(table(spark, sf_dir, "events"), "user_id", "ts", 86400).select("event_id", "user_id", "in_window")


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with s as (select user_id, ts, case when epoch(ts) // 1 - lag(epoch(ts) // 1) over (partition by user_id order by ts) <= 21600 then 0 else 1 end as n from events), g as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as session from s)
  select user_id, cast(session as bigint) as session, min(ts) as started, max(ts) as ended, count(*) as events from g group by 1, 2""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 21600)


@query("""with u as (select distinct l_orderkey as k, l_partkey as p from lineitem) select a.p as x, b.p as y, count(*) as shared from u a join u b on a.k = b.k and a.p < b.p group by 1, 2 having count(*) >= 2""")
def pairs_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand together in two orders or more: pairs by equi-join on the order, with an order on the parts."""
    return shared_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("""with f as (select event_id, user_id, ts from events where event_id % 5 <> 0), r as (select user_id, ts as since, event_id as rate from events where event_id % 5 = 0)
  select event_id, user_id, rate as in_force from (select f.event_id, f.user_id, r.rate, row_number() over (partition by f.event_id order by r.since desc, r.rate desc) as rn from f left join r on r.user_id = f.user_id and r.since <= f.ts) where rn = 1""")
def effective_dated_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the rate of its user in force at its time."""
    e = table(spark, sf_dir, "events")
    return temporal.effective(e.where("event_id % 5 <> 0").select("event_id", "user_id", "ts"), e.where("event_id % 5 = 0").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("rate")), "user_id", "ts", "since", "rate").select("event_id", "user_id", "in_force")


@query("select event_id, user_id, (select count(*) from events p where p.user_id = e.user_id and epoch(p.ts) // 1 between epoch(e.ts) // 1 - 86400 and epoch(e.ts) // 1) as in_window from events e")
def rpm_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the day up to each event."""
    return temporal.sliding_count(table(spark, sf_dir, "events"), "user_id", "ts", 86400).select("event_id", "user_id", "in_window")


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with s as (select user_id, ts, case when epoch(ts) // 1 - lag(epoch(ts) // 1) over (partition by user_id order by ts) <= 21600 then 0 else 1 end as n from events), g as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as session from s)
  select user_id, cast(session as bigint) as session, min(ts) as started, max(ts) as ended, count(*) as events from g group by 1, 2""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 21600)


@query("""with u as (select distinct user_id, event_type from events where value > 90) select a.user_id as a, b.user_id as b, count(*) as shared from u a join u b on a.event_type = b.event_type and a.user_id < b.user_id group by 1, 2 having count(*) >= 5""")
def pairs_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that share all of five kinds of great events: pairs by equi-join on the kind, with an order on the users."""
    u = table(spark, sf_dir, "events").where("value > 90").select("user_id", "event_type").distinct()
    a, b = u.alias("a"), u.alias("b")
    j = a.join(b, (F.col("a.event_type") == F.col("b.event_type")) & (F.col("a.user_id") < F.col("b.user_id")))
    return j.groupBy(F.col("a.user_id").alias("a"), F.col("b.user_id").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where("shared >= 5")


@query("""with f as (select event_id, user_id, event_type, value, row_number() over (partition by user_id, event_type, cast(floor(value) as bigint) order by event_id) as rn from events where value is not null) select event_id, user_id, event_type from f where rn = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged queries without repeats, the first of each kept."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy("user_id", "event_type", F.floor("value").alias("v")).agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("select c_mktsegment, n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by cube (c_mktsegment, n_name)")
def cube_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets, an addition to the passthrough surface."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.cube("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("select p_partkey, abs(p_size - 25) as a, round(p_retailprice, 1) as r, upper(p_brand) as u, length(p_name) as n, substring(p_name, 2, 3) as s, coalesce(nullif(p_brand, 'Brand#11'), 'none') as c, strpos(p_type, 'STEEL') as i, least(p_size, 10) as lo, greatest(p_size, 40) as hi, p_type ilike '%steel%' as l from part")
def sql_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions that predicates may use, through SQL."""
    table(spark, sf_dir, "part").createOrReplaceTempView("fq_part")
    return spark.sql("select p_partkey, abs(p_size - 25) as a, round(p_retailprice, 1) as r, upper(p_brand) as u, length(p_name) as n, substring(p_name, 2, 3) as s, coalesce(nullif(p_brand, 'Brand#11'), 'none') as c, instr(p_type, 'STEEL') as i, least(p_size, 10) as lo, greatest(p_size, 40) as hi, p_type ilike '%steel%' as l from fq_part")


@query("select l_orderkey, l_partkey from lineitem where l_quantity > 45 and l_discount >= 0.05")
def certified_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of rows by one checked SQL statement over registered views."""
    from folioquarry.operators.sqlgate import select

    return select(spark, {"lineitem": table(spark, sf_dir, "lineitem")}, "select l_orderkey, l_partkey from lineitem where l_quantity > 45 and l_discount >= 0.05", 2)


@query("select o_orderkey from orders where o_totalprice > 100000 and lower(o_orderpriority) like '1%'")
def predicate_sandbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.operators.sqlgate import where

    return where(table(spark, sf_dir, "orders"), "o_totalprice > 100000 and lower(o_orderpriority) like '1%'").select("o_orderkey")


QUERIES, ORACLE = R.queries, R.oracle
