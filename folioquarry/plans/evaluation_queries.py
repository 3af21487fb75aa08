"""Queries of votes, labels, scoring and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import numeric as N
from folioquarry.functions import text as T
from folioquarry.operators import evalstats, labels
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import table

R = Registry()
query = R.query

def _types(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""with v as (select unnest(list_concat((select list(distinct event_type) from events), ['never_seen'])) as label) select label, coalesce(n, 0) as n from v left join (select event_type as label, count(*) as n from events group by 1) using (label)""")
def label_counts_closed_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a closed vocabulary: the event types and one that never occurs."""
    e = _types(spark, sf_dir)
    known = e.select(F.col("event_type").alias("label")).distinct().unionByName(spark.createDataFrame([("never_seen",)], "label string"))
    return labels.closed_counts(e, known, "event_type")


@query("""with v as (select unnest(list_concat((select list(distinct event_type) from events), ['never_seen'])) as label), c as (select label, coalesce(n, 0) as n from v left join (select event_type as label, count(*) as n from events group by 1) using (label))
  select 'most' as "end", label, n from c where n = (select max(n) from c) union all select 'least', label, n from c where n = (select min(n) from c)""")
def label_extremes_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.extremes(label_counts_closed_vocab(spark, sf_dir))


@query("""with v as (select user_id, event_type as label, event_id as vote_idx from events), g as (select user_id, label, count(*) as n, min(vote_idx) as f from v group by 1, 2)
  select user_id, label as winner, n as best, votes from (select *, cast(sum(n) over (partition by user_id) as bigint) as votes, row_number() over (partition by user_id order by n desc, f) as rn from g) where rn = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as votes of their users: plurality, a tie to the earliest."""
    v = _types(spark, sf_dir).select("user_id", F.col("event_type").alias("label"), F.col("event_id").alias("vote_idx"))
    return labels.majority(v, "user_id")


@query("""with v as (select event_id // 3 as item, event_type as label, event_id as vote_idx from events), g as (select item, label, count(*) as n, min(vote_idx) as f from v group by 1, 2), r as (select *, cast(sum(n) over (partition by item) as bigint) as votes, row_number() over (partition by item order by n desc, f) as rn from g)
  select item, case when votes = 3 and n > 1 then label end as winner, n as best, votes from r where rn = 1""")
def majority_vote_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _types(spark, sf_dir).select(F.floor(F.col("event_id") / 3).alias("item"), F.col("event_type").alias("label"), F.col("event_id").alias("vote_idx"))
    return labels.majority(v, "item", expected=3)


@query("""with a as (select event_id // 3 as item, case when event_id % 11 = 0 then '' else event_type end as answer from events), k as (select item, answer, count(*) as n from a where answer <> '' group by 1, 2), b as (select item, max(n) as best from k group by 1), e as (select distinct item from a)
  select item, coalesce(best, 0) as best, case when coalesce(best, 0) = 3 then 'unanimous' when 2 * coalesce(best, 0) > 3 then 'majority' else 'split' end as resolution, round(coalesce(best, 0) / 3.0, 6) as agreement from e left join b using (item)""")
def consensus_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _types(spark, sf_dir).select(F.floor(F.col("event_id") / 3).alias("item"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("answer"))
    return labels.resolutions(a, "item", passes=3).withColumn("agreement", F.round("agreement", 6))


@query("select doc_id, case when text is null then null when length(text) > 2000 then 'long' else 'short' end as label, case when text is null then 0 else 1 end as attempts from documents")
def annotate_injected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label pass with a rule for a labeler."""
    return labels.annotate(table(spark, sf_dir, "documents"), "doc_id", "text", lambda ts: ["LONG" if len(t) > 2000 else "short" for t in ts], ["long", "short"])


@query("""select field_id, max_by(result_id, result_id) as result_id, arg_max(answer, result_id) as answer from field_results where answer is not null group by 1""")
def latest_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each form field."""
    d = table(spark, sf_dir, "field_results").where("answer is not null").select("field_id", "result_id", "answer").distinct()
    return labels.latest_log(d, "field_id", order="result_id")


_PLAIN = "regexp_replace(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
_SCALAR = "^[$](?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:[.][0-9]+)?$"


@query(f"""select result_id, coalesce({_PLAIN.format('answer')} <> '' and {_PLAIN.format('golden')} <> '' and ({_PLAIN.format('answer')} = {_PLAIN.format('golden')}
  or (regexp_matches(trim(answer), '{_SCALAR.format()}') and regexp_matches(trim(golden), '{_SCALAR.format()}') and try_cast(replace(replace(trim(answer), ',', ''), '$', '') as decimal(18,6)) = try_cast(replace(replace(trim(golden), ',', ''), '$', '') as decimal(18,6)))), false) as correct from (select distinct result_id, answer, golden from field_results)""")
def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against golden values: equal text or equal scalars of one unit."""
    d = table(spark, sf_dir, "field_results").select("result_id", "answer", "golden").distinct()
    return d.select("result_id", N.score_answer(F.col("answer"), F.col("golden")).alias("correct"))


@query()
def normalised_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that agree with the golden value but for presentation."""
    d = table(spark, sf_dir, "field_results").select("result_id", "answer", "golden").distinct()
    return d.select("result_id", N.normalised_match(F.col("answer"), F.col("golden")).alias("matches"))


@query()
def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-level agreement and misses of form only."""
    d = table(spark, sf_dir, "field_results").select("result_id", "answer", "golden").distinct()
    return d.select("result_id", evalstats.string_agrees(F.col("golden"), F.col("answer")).alias("agrees_as_text"), evalstats.format_only(F.col("answer"), F.col("golden")).alias("form_only"))


_W = """round(greatest(0.0, (p + 3.841458881296 / (2 * n) - 1.959964 * sqrt(p * (1 - p) / n + 3.841458881296 / (4.0 * n * n))) / (1 + 3.841458881296 / n)), 6) as low, round(least(1.0, (p + 3.841458881296 / (2 * n) + 1.959964 * sqrt(p * (1 - p) / n + 3.841458881296 / (4.0 * n * n))) / (1 + 3.841458881296 / n)), 6) as high"""


@query(f"select tier, n, correct, round(p, 6) as accuracy, {_W} from (select tier, count(*) as n, cast(sum(cast(agrees as int)) as bigint) as correct, sum(cast(agrees as int)) / count(*) as p from (select distinct result_id, tier, agrees from field_results) where agrees is not null group by 1)")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by tier with its Wilson interval."""
    d = table(spark, sf_dir, "field_results").select("result_id", "tier", "agrees").distinct().where("agrees is not null")
    g = d.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("agrees").cast("int")).alias("correct"))
    low, high = evalstats.wilson(F.col("correct"), F.col("n"))
    return g.select("tier", "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""with d as (select distinct result_id, expect, tier, scored_by, agrees, answer from field_results where agrees is not null), k as (select *, lower(trim(answer)) in ('', 'none', 'nil', 'unknown', 'no', 'n/a', 'not stated', 'not specified') as neg from d)
  select expect, count(*) as n, round(sum(cast(agrees as int)) / count(*), 6) as accuracy, count(distinct scored_by) as scorers, cast(sum(case when not agrees then 1 else 0 end) as bigint) as misses from k group by 1""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "field_results").select("result_id", "expect", "tier", "scored_by", "agrees", "answer").distinct().where("agrees is not null")
    return d.groupBy("expect").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("agrees").cast("int")), 6).alias("accuracy"), F.count_distinct("scored_by").alias("scorers"), F.count_if(~F.col("agrees")).alias("misses"))


@query("""with d as (select distinct result_id, expect, agrees, answer from field_results where agrees is not null and expect is not null), s as (select expect, agrees, regexp_matches(lower(trim(coalesce(answer, ''))), '^(yes|)$') as x, count(*) as n from d group by all) select (select cast(sum(n) as bigint) from s where expect = 'absent') as absent_items, (select cast(sum(n) as bigint) from s where expect <> 'absent') as value_items""")
def absence_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by whether absence is expected: denominators of the false-positive and abstain rates."""
    d = table(spark, sf_dir, "field_results").select("result_id", "expect", "agrees", "answer").distinct().where("agrees is not null and expect is not null")
    return d.agg(F.count_if(F.col("expect") == "absent").alias("absent_items"), F.count_if(F.col("expect") != "absent").alias("value_items"))


def absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive rate over absent items, abstain rate over value items; 0 for no items."""
    d = table(spark, sf_dir, "field_results").select("result_id", "expect", "agrees", "answer").distinct().where("agrees is not null and expect is not null")
    absent, neg = F.col("expect") == "absent", T.is_negative(F.col("answer"))
    g = d.agg(F.count_if(absent).alias("a"), F.count_if(absent & ~neg & ~F.col("agrees")).alias("fp"), F.count_if(~absent).alias("v"), F.count_if(~absent & neg).alias("ab"))
    return g.select(F.when(F.col("a") > 0, F.col("fp") / F.col("a")).otherwise(F.lit(0.0)).alias("false_positive_rate"), F.when(F.col("v") > 0, F.col("ab") / F.col("v")).otherwise(F.lit(0.0)).alias("abstain_rate"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _types(spark, sf_dir)
    a = evalstats.quantile(e, "value", 0.5, "event_type").select("event_type", F.round("value", 6).alias("p50"))
    return a.join(evalstats.quantile(e, "value", 0.95, "event_type").select("event_type", F.round("value", 6).alias("p95")), "event_type")


@query("select event_type, value from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null) where r = greatest(cast(ceil(n * 0.95) as bigint), 1)")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.nearest_rank(_types(spark, sf_dir), "value", 0.95, "event_type")


_TWO = "(select distinct result_id, tier, agrees as a, judge_verdict as b from field_results where agrees is not null and judge_verdict is not null)"


@query(f"select tier, n, round(po, 6) as po, round(pa, 6) as pa, round(pb, 6) as pb, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) as kappa from (select tier, count(*) as n, avg(cast(a = b as int)) as po, avg(cast(a as int)) as pa, avg(cast(b as int)) as pb from {_TWO} group by 1)")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the final verdict and the judges' last, beyond chance."""
    d = table(spark, sf_dir, "field_results").select("result_id", "tier", F.col("agrees").alias("a"), F.col("judge_verdict").alias("b")).where("a is not null and b is not null").distinct()
    k = evalstats.kappa(d, "a", "b", "tier")
    return k.select("tier", "n", *[F.round(c, 6).alias(c) for c in ("po", "pa", "pb", "kappa")])


_V = "(select user_id, event_id, value > 50 as a, event_type in ('click', 'view') as b from events where value is not null)"


@query(f"""with c as (select count(*) as n, cast(sum(cast(a and not b as int)) as bigint) as a_only, cast(sum(cast(b and not a as int)) as bigint) as b_only, round(cast(sum(cast(a as int)) - sum(cast(b as int)) as double) / count(*), 6) as diff from {_V}), m as (select *, a_only + b_only as m, least(a_only, b_only) as k from c)
  select n, a_only, b_only, diff, round(least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))))), 6) as p_value from m""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _types(spark, sf_dir).where("value is not null").select((F.col("value") > 50).alias("a"), F.col("event_type").isin("click", "view").alias("b"))
    return evalstats.mcnemar(d, "a", "b").select("n", "a_only", "b_only", F.round("diff", 6).alias("diff"), F.round("p_value", 6).alias("p_value"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two verdicts' accuracies by paired resampling."""
    d = table(spark, sf_dir, "field_results").select("result_id", F.col("agrees").alias("a"), F.col("judge_verdict").alias("b")).where("a is not null and b is not null").distinct()
    return evalstats.bootstrap_diff(d, "result_id", "a", "b")


@query("select tier, cast(count(*) filter (judge_status = 'accepted') as bigint) as accepted, cast(count(*) filter (judge_status = 'rejected') as bigint) as rejected, cast(count(*) filter (judge_status is null) as bigint) as missing from (select distinct result_id, tier, judge_status from field_results) group by 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "field_results").select("result_id", "tier", "judge_status").distinct()
    return evalstats.confusion(d, "tier", "judge_status", ["accepted", "rejected"]).select("tier", "accepted", "rejected", "missing")


@query("""with h as (select result_id, unnest(judge_history, recursive := true) from (select distinct result_id, judge_history from field_results)), d as (select distinct result_id, lower(trim(judge)) as judge, verdict from h where verdict is not null), v as (select result_id, judge, sum(case when verdict then 1 else 0 end) * 2 > count(*) as yes from d group by 1, 2)
  select result_id, count(*) as judges, case when bool_and(yes) then 'accepted' when not bool_or(yes) then 'rejected' else 'disputed' end as outcome from v group by 1""")
def judge_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each judge's own majority, and whether all agree."""
    d = table(spark, sf_dir, "field_results").select("result_id", F.explode("judge_history").alias("h")).select("result_id", F.lower(F.trim("h.judge")).alias("judge"), F.col("h.verdict").alias("verdict")).where("verdict is not null").distinct()
    v = d.groupBy("result_id", "judge").agg((F.count_if(F.col("verdict")) * 2 > F.count(F.lit(1))).alias("yes"))
    return v.groupBy("result_id").agg(F.count(F.lit(1)).alias("judges"), F.when(F.bool_and("yes"), "accepted").when(~F.bool_or("yes"), "rejected").otherwise("disputed").alias("outcome"))


@query("""with m as (select distinct result_id, expect, case when scored_by is null then 'unclassified' else scored_by end as cause from field_results where not agrees) select expect, cause, count(*) as n from m group by 1, 2""")
def loss_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "field_results").where("not agrees").select("result_id", "expect", F.coalesce("scored_by", F.lit("unclassified")).alias("cause")).distinct()
    return d.groupBy("expect", "cause").agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select matter_code, tier, cast(sum(cast(agrees as int)) as bigint) as c from (select distinct result_id, matter_code, tier, agrees from field_results where agrees is not null) group by 1, 2) select tier, count(*) as repeats, min(c) as least, round(avg(c), 6) as mean, max(c) as most from r group by 1""")
def repeat_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "field_results").where("agrees is not null").select("result_id", "matter_code", "tier", "agrees").distinct()
    c = d.groupBy("matter_code", "tier").agg(F.sum(F.col("agrees").cast("int")).alias("c"))
    return evalstats.repeat_range(c, "tier", "c").withColumn("mean", F.round("mean", 6))


@query()
def stratified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of ten items of each task class: a sampling operator."""
    return evalstats.stratified(table(spark, sf_dir, "eval_items"), "task_class", "item_id", 10).select("item_id", "task_class")


@query(r"""with t as (select item_id, regexp_extract_all(lower(question), '[a-z][a-z0-9_-]{2,}|\b[0-9]+(?:[,.][0-9]+)*\b') as w from eval_items), b as (select distinct item_id, w[i] || ' ' || w[i + 1] as pair from (select item_id, w, unnest(range(1, len(w))) as i from t) where w[i] not in ('the','and','for','was','were','with','what','which','how','many','much','does','did') and w[i + 1] not in ('the','and','for','was','were','with','what','which','how','many','much','does','did')),
  d as (select pair, count(*) as df from b group by 1), n as (select count(*) as n from eval_items) select item_id, pair from b join d using (pair), n where df - 1 <= (n - 1) // 2""")
def negative_audit_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs of each question that at most half of the others have: the probes of an audit of negative answers."""
    w = F.transform(T.extract_all(F.col("question"), T.TOKEN), lambda t: F.lower(t))
    i = table(spark, sf_dir, "eval_items").select("item_id", w.alias("w")).where("size(w) > 1")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    b = i.select("item_id", F.explode(pairs).alias("p")).where(~F.col("p.a").isin(*T.STOP_WORDS) & ~F.col("p.b").isin(*T.STOP_WORDS)).select("item_id", F.concat_ws(" ", "p.a", "p.b").alias("pair")).distinct()
    df = b.groupBy("pair").agg(F.count(F.lit(1)).alias("df"))
    n = table(spark, sf_dir, "eval_items").agg(F.count(F.lit(1)).alias("n"))
    return b.join(df, "pair").join(F.broadcast(n)).where(F.col("df") - 1 <= F.floor((F.col("n") - 1) / 2)).select("item_id", "pair")  # ``n`` is one row


QUERIES, ORACLE = R.queries, R.oracle
