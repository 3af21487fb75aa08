"""Reports over evaluation results: summaries, gates, causes of misses, label diagnostics, arms, reviews.

Results are rows of (qid, task_class, correct, ...); every report is a few aggregations over them, and one row or one row
a class comes out. Rows delivered twice are the caller's to make distinct. Empty results give rates of 0, not nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import is_negative
from folioquarry.operators.evalstats import format_only, mcnemar, wilson


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def summary(results: DataFrame) -> DataFrame:
    """One row over results (correct, expect, answer, tier, cause): accuracy with its interval, false positives over items that expect absence, abstentions over the others, misses that a review of low tiers would meet, items accepted without one.

    ``high`` is the tier that is accepted; any other, a missing one too, is reviewed.
    """
    absent, negative, correct = F.col("expect") == "absent", is_negative(F.col("answer")), F.coalesce("correct", F.lit(False))
    absent, blank = F.coalesce(absent, F.lit(False)), F.trim(F.coalesce("answer", F.lit(""))) == ""
    high = F.coalesce(F.col("tier") == "high", F.lit(False))
    g = results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("correct"), F.count_if(absent).alias("absent_items"), F.count_if(~absent).alias("value_items"),
        F.count_if(absent & ~negative & ~blank & ~correct).alias("confident_wrong"), F.count_if(~absent & negative).alias("abstained"), F.count_if(~correct).alias("misses"),
        F.count_if(~correct & ~high).alias("reviewed_misses"), F.count_if(high).alias("accepted"), F.count_if(high & correct).alias("accepted_correct"),
    )
    low, up = wilson(F.col("correct"), F.col("n"))
    return g.select(
        "n", "correct", share(F.col("correct"), F.col("n")).alias("accuracy"), low.alias("low"), up.alias("high"), "absent_items", "value_items", "confident_wrong",
        share(F.col("confident_wrong"), F.col("absent_items")).alias("false_positive_rate"), share(F.col("abstained"), F.col("value_items")).alias("abstain_rate"),
        share(F.col("reviewed_misses"), F.col("misses"), 1.0).alias("review_recall"), share(F.col("accepted"), F.col("n")).alias("auto_accept_rate"), share(F.col("accepted_correct"), F.col("accepted"), 1.0).alias("accepted_accuracy"),
    )


def by_class(results: DataFrame, *keys: str) -> DataFrame:
    """Items, accuracy and its interval of each class."""
    g = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"))
    low, up = wilson(F.col("correct"), F.col("n"))
    return g.select(*keys, "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), low.alias("low"), up.alias("high"))


def regression(results: DataFrame, min_accuracy: float = 0.0, max_false_positive_rate: float = 1.0, min_accepted_accuracy: float = 0.0) -> DataFrame:
    """A run held against its limits: the summary, accuracy over fields whose golden value says something, and whether it passes."""
    s = summary(results)
    real = results.where((F.trim(F.coalesce("golden", F.lit(""))) != "") & ~is_negative(F.col("golden")))
    real = real.agg(F.count(F.lit(1)).alias("substantive_items"), F.count_if(F.coalesce("correct", F.lit(False))).alias("substantive_correct"))
    ok = (F.col("accuracy") >= min_accuracy) & (F.col("false_positive_rate") <= max_false_positive_rate) & (F.col("accepted_accuracy") >= min_accepted_accuracy)
    return s.join(F.broadcast(real)).withColumn("passed", ok)  # one row each


#: What a run's state tells of the cause of a miss.
PREPARATION = ("CorpusHealthError", "IngestError", "TableValidationError")
CAUSES = ("ok", "gold", "ingest", "budget", "execution", "format", "retrieval", "reasoning")


def miss_cause(results: DataFrame) -> Column:
    """The first cause that holds of a result's state: one of ``CAUSES``.

    Columns, null where unknown: correct, gold_marked_wrong, status, error_type, health, predicted, gold, gold_blocked (the
    gold's document or table was not usable), gold_doc, seen_docs, gold_page, seen_pages, gold_seen (its text was in what
    was found), recorded (the run left records).
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    status, recorded = F.col("status"), yes(F.col("recorded"))
    blocked = (status == "error") & (yes(F.col("error_type").isin(*PREPARATION)) | yes(F.col("health") == "blocked"))
    named = F.exists(F.coalesce("seen_docs", F.array().cast("array<string>")), lambda d: F.contains(d, F.col("gold_doc")) | F.contains(F.col("gold_doc"), d))
    unseen_doc = recorded & F.col("gold_doc").isNotNull() & ~yes(named)
    paged = recorded & F.col("gold_page").isNotNull()
    unseen_page = paged & ~yes(F.array_contains("seen_pages", F.col("gold_page"))) & ~yes(F.col("gold_seen"))
    unseen_text = recorded & ~paged & ~yes(F.col("gold_seen"))
    return (
        F.when(yes(F.col("correct")), "ok").when(yes(F.col("gold_marked_wrong")), "gold").when(yes(blocked), "ingest").when(yes(status.isin("budget_exhausted", "recovered")), "budget").when(~yes(status == "final"), "execution")
        .when(format_only(F.col("predicted"), F.col("gold")), "format").when(yes(F.col("gold_blocked")), "ingest").when(unseen_doc | unseen_page | unseen_text, "retrieval").otherwise("reasoning")
    )


def ledger(results: DataFrame, *keys: str) -> DataFrame:
    """Misses by cause, within ``keys``, with their share of all items there."""
    r = results.withColumn("cause", miss_cause(results))
    n = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"))
    m = r.where("cause <> 'ok'").groupBy(*keys, "cause").agg(F.count(F.lit(1)).alias("misses"))
    return m.join(n, list(keys)).withColumn("loss", F.col("misses") / F.col("items")) if keys else m.join(F.broadcast(n)).withColumn("loss", F.col("misses") / F.col("items"))  # one row


def label_diagnostics(pairs: DataFrame, gold: str, got: str, *keys: str) -> DataFrame:
    """Whether labelling kept what is counted: every label's count, and the order of labels by count (ties by label); with the share of items labelled right."""
    g = pairs.groupBy(*keys, F.col(gold).alias("label")).agg(F.count(F.lit(1)).alias("a"))
    p = pairs.groupBy(*keys, F.col(got).alias("label")).agg(F.count(F.lit(1)).alias("b"))
    j = g.join(p, [*keys, "label"], "full").fillna(0, ["a", "b"]).where("label is not null")
    w = Window.partitionBy(*keys)  # a vocabulary
    j = j.withColumn("ra", F.row_number().over(w.orderBy(F.desc("a"), "label"))).withColumn("rb", F.row_number().over(w.orderBy(F.desc("b"), "label")))
    per = j.groupBy(*keys).agg(F.bool_and(F.col("a") == F.col("b")).alias("counts_exact"), F.bool_and(F.col("ra") == F.col("rb")).alias("ranking_kept"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("count_error"))
    right = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce(F.col(gold) == F.col(got), F.lit(False))).alias("right"))
    return per.join(right, list(keys)) if keys else per.join(F.broadcast(right))  # one row


def arms(results: DataFrame, base: str) -> DataFrame:
    """Each arm (arm, qid, correct): accuracy, and on the items it shares with the base the discordant pairs and the exact p-value."""
    acc = by_class(results, "arm")
    b = results.where(F.col("arm") == base).select("qid", F.col("correct").alias("b"))
    out = None
    for name in [r.arm for r in results.select("arm").distinct().where("arm is not null").orderBy("arm").collect()]:  # the arms of a comparison
        m = mcnemar(results.where(F.col("arm") == name).select("qid", F.col("correct").alias("a")).join(b, "qid"), "a", "b").withColumn("arm", F.lit(name))
        out = m if out is None else out.unionByName(m)
    if out is None:
        return acc
    return acc.join(out.select("arm", F.col("n").alias("shared"), "a_only", "b_only", "diff", "p_value"), "arm")


def review_scores(rows: DataFrame) -> DataFrame:
    """Reviewers' marks (qid, verdict, mark: 'right', 'wrong' or 'gold') held against the automatic verdict: agreement, and how often each is overturned."""
    g = rows.agg(
        F.count("mark").alias("reviewed"), F.count_if((F.col("mark") == "right") == F.col("verdict")).alias("agreed"), F.count_if(F.col("verdict") & (F.col("mark") == "wrong")).alias("overturned_right"),
        F.count_if(~F.col("verdict") & (F.col("mark") == "right")).alias("overturned_wrong"), F.count_if(F.col("mark") == "gold").alias("gold_errors"),
    )
    return g.withColumn("agreement", share(F.col("agreed"), F.col("reviewed")))


def ranked_communities(components: DataFrame, k: int = 10, per: int = 5) -> DataFrame:
    """The ``k`` largest components (node, component), largest first, ties to the least; of each the first ``per`` nodes."""
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(k)
    top = size.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))  # ``k`` rows
    m = components.join(F.broadcast(top), "component")
    rn = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    # A node's place within its component is at most ``per``: the least nodes are found before any is ranked.
    return m.withColumn("nth", rn).where(F.col("nth") <= per).select("rank", "component", "size", "nth", "node")


def fused(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Ranked lists (query_id, item, rank) as one by reciprocal ranks: the sum over lists of 1 / (constant + rank), the best ``k`` of each query, ties to the least item."""
    every = lists[0].select("query_id", "item", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "item", "rank"))
    s = every.groupBy("query_id", "item").agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("lists"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))
    return s.withColumn("rank", rn).where(F.col("rank") <= k)


def kept_trajectories(runs: DataFrame, least_score: float = 1.0) -> DataFrame:
    """Runs (run_id, qid, status, score, digest) worth keeping: finished, scored high enough, and of runs with one digest the first."""
    ok = runs.where((F.col("status") == "final") & (F.col("score") >= least_score))
    keep = ok.groupBy("qid", F.coalesce("digest", F.col("run_id").cast("string")).alias("_d")).agg(F.min("run_id").alias("run_id"))
    return ok.join(keep.select("run_id"), "run_id", "left_semi")


def recent(rows: DataFrame, key: str, at: str, n: int, since: str | None = None, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows of each key, not before ``since``: candidates by recency; of rows of one time those with the greatest ``tie``."""
    d = rows.where(F.col(at).isNotNull())
    d = d if since is None else d.where(F.col(at) >= F.lit(since).cast("timestamp"))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *([F.desc(tie)] if tie else [])))).where(F.col("_r") <= n).drop("_r")


def shared_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words (word) that two sets of texts (text) both have, with the number of texts of each."""
    from folioquarry.functions.text import words

    count = lambda d, n: d.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias(n))
    return count(a, "in_a").join(count(b, "in_b"), "word")


FORMULAS = {"direct_ratio": ("numerator", "denominator"), "coverage": ("earnings", "depreciation", "rent", "interest")}


def contract_results(contracts: DataFrame, sources: DataFrame, cells: DataFrame) -> DataFrame:
    """Metrics by contracts that say exactly where each number stands: ``contract_id``, ``result`` and ``refusal``.

    ``contracts``: contract_id, formula (one of ``FORMULAS``), unit, period; ``sources``: contract_id, role, table_name,
    row_idx, col_name, label_col, label; ``cells``: table_name, row_idx, col_name, raw, num_value, unit, period. A contract is
    refused, with the first reason, where its formula is unknown or null, its roles are not exactly the formula's, a number
    isn't where it says or its row has another label, unit or period differ, or the division has no value.
    """
    from folioquarry.operators.certify import calculate_exact

    at = cells.select("table_name", "row_idx", "col_name", F.col("num_value").cast("string").alias("value"), F.col("unit").alias("_u"), F.col("period").alias("_p"))
    names = cells.select("table_name", "row_idx", F.col("col_name").alias("label_col"), F.col("raw").alias("_label"))
    s = sources.join(at, ["table_name", "row_idx", "col_name"], "left").join(names, ["table_name", "row_idx", "label_col"], "left")
    per = s.join(contracts.select("contract_id", "unit", "period"), "contract_id").groupBy("contract_id").agg(
        F.array_sort(F.collect_list("role")).alias("roles"), F.map_from_entries(F.collect_set(F.struct("role", "value"))).alias("values"),  # a formula's roles
        F.bool_and(F.col("value").isNotNull()).alias("found"), F.bool_and(F.col("_label").eqNullSafe(F.col("label"))).alias("labelled"), F.bool_and(F.col("_u").eqNullSafe(F.col("unit")) & F.col("_p").eqNullSafe(F.col("period"))).alias("fits"),
    )
    j = contracts.join(per, "contract_id", "left")
    need = F.create_map(*[x for f, roles in FORMULAS.items() for x in (F.lit(f), F.array(*[F.lit(r) for r in sorted(roles)]))])
    refusal = (
        F.when(F.col("formula").isNull() | ~F.map_contains_key(need, F.coalesce("formula", F.lit(""))), "formula").when(~F.coalesce("roles", F.array().cast("array<string>")).eqNullSafe(need[F.col("formula")]), "roles")
        .when(~F.col("found"), "source").when(~F.col("labelled"), "label").when(~F.col("fits"), "unit or period")
    )
    v = lambda role: F.col("values")[role]
    top = calculate_exact("subtract", calculate_exact("subtract", v("earnings"), v("depreciation")), v("rent"))
    j = j.withColumn("refusal", refusal).withColumn("_top", F.when(F.col("formula") == "coverage", top).otherwise(v("numerator"))).withColumn("_below", F.when(F.col("formula") == "coverage", v("interest")).otherwise(v("denominator")))
    j = j.withColumn("result", calculate_exact("divide", F.col("_top"), F.col("_below")))
    j = j.withColumn("refusal", F.coalesce("refusal", F.when(F.col("result").isNull(), "no value")))
    return j.select("contract_id", F.when(F.col("refusal").isNull(), F.col("result")).alias("result"), "refusal")


def meter(log: DataFrame, *labels: str) -> DataFrame:
    """Of a log of observations (name, value, and labels): how many, their 50th and 95th percentile by nearest rank, the greatest and the sum, of each name and labels. All are kept: none is dropped beyond some number."""
    from folioquarry.operators.evalstats import at_ranks

    keys = ("name", *labels)
    rank = lambda q: F.greatest(F.ceil(F.col("n") * q), F.lit(1))
    p = at_ranks(log, "value", {"p50": rank(0.5), "p95": rank(0.95)}, *keys)
    s = log.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("value").alias("most"), F.sum("value").alias("total"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    for c in on[1:]:
        on[0] = on[0] & c
    return p.join(s, on[0]).select(*keys, F.col("n").alias("observations"), "p50", "p95", "most", "total")


def audit_rows(results: DataFrame) -> DataFrame:
    """What a reviewer gets of each result (the columns of ``miss_cause`` and ``qid``): prediction, gold, cause, what was seen, and an empty mark; misses first."""
    seen = lambda c: F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))), ", ")
    cause = miss_cause(results)
    return results.select("qid", "predicted", "gold", cause.alias("cause"), seen("seen_docs").alias("seen_docs"), F.lit(None).cast("string").alias("mark"), (cause == "ok").alias("_ok")).orderBy("_ok", "qid").drop("_ok")
