"""Statistics of evaluation runs, as aggregations over result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959964


def wilson(correct: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 0) for no trials."""
    p = correct / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / denom
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0)), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(0.0))


def kappa(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Cohen's kappa of two boolean columns; null where chance agreement is whole or there are no pairs."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    g = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = (g.groupBy(*keys) if keys else g.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.withColumn("kappa", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts, difference of accuracies and the exact two-sided p-value; the tail is summed by logarithms over at most the discordant pairs."""
    x, y = F.col(a), F.col(b)
    g = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"))
    m, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")

    def lfact(c: Column) -> Column:  # log factorial: exact sums for small numbers, Stirling's series beyond
        c = c.cast("double")
        small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(c, F.lit(64.0)), F.lit(1.0)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
        z = F.greatest(c, F.lit(65.0))
        return F.when(c <= 64, small).otherwise(z * F.log(z) - z + 0.5 * F.log(2 * math.pi * z) + 1 / (12 * z) - 1 / (360 * z * z * z))

    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(lfact(m) - lfact(i) - lfact(m - i) - m * math.log(2)))
    return g.select("n", "a_only", "b_only", F.try_divide(F.col("a_only") - F.col("b_only"), "n").alias("diff"), F.when(m == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def bootstrap_diff(pairs: DataFrame, key: str, a: str, b: str, iterations: int = 200, seed: int = 11, level: float = 0.95) -> DataFrame:
    """Percentile interval of the difference of accuracies, items drawn with replacement: each item's number of draws is a Poisson number from a hash of its key and the iteration, so the draws need no shuffle of items."""
    d = pairs.select(F.col(key).alias("k"), (F.col(a).cast("int") - F.col(b).cast("int")).alias("d"))
    i = d.select("k", "d", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("i"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "k", "i"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    steps, total = [], 0.0
    for n in range(12):
        total += math.exp(-1) / math.factorial(n)
        steps.append(total)
    draws = sum((F.when(u > F.lit(s), 1).otherwise(0) for s in steps), F.lit(0))
    per = i.withColumn("n", draws).groupBy("i").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("diff"))
    return per.agg(F.percentile("diff", F.lit((1 - level) / 2)).alias("low"), F.percentile("diff", F.lit((1 + level) / 2)).alias("high"))


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Column], *keys: str, slots: int = 1024) -> DataFrame:
    """Values at given ranks (from 1, expressions of the group's size ``n``) of each group, exactly: ``keys``, ``n`` and a column per rank.

    No group is sorted whole: values fall into ``slots`` equal parts of their range, the counts of the parts tell in
    which one a rank lies, and only that part is sorted. Nulls and NaN don't count; groups without values have no row.
    """
    key = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("bigint")
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, key.alias("_g"), F.col(value).alias("_v"))
    group = ["_g", *keys]
    b = d.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("n"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in group]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    j = d.alias("d").join(b.alias("b"), cond).select(*[F.col(f"d.{k}").alias(k) for k in group], "_v", "n", F.coalesce(F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)) * slots), F.lit(0)).alias("_s"))
    c = j.groupBy(*group, "n", "_s").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    held = [(r > F.col("_before")) & (r <= F.col("_before") + F.col("_c")) for r in ranks.values()]
    some = held[0]
    for h in held[1:]:
        some = some | h
    c = c.where(some).select(*[F.col(k).alias(f"c{k}") for k in group], F.col("_s").alias("_cs"), "_before")
    on = F.col("_s") == F.col("_cs")
    for k in group:
        on = on & F.col(k).eqNullSafe(F.col(f"c{k}"))
    rows = j.join(c, on).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_s").orderBy("_v")))
    out = rows.groupBy(*group, "n").agg(*[F.max(F.when(F.col("_r") == r, F.col("_v"))).alias(name) for name, r in ranks.items()])
    return out.drop("_g")


def nearest_rank(df: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """The value at rank ceil(q n) of each group, at least the first."""
    return at_ranks(df, value, {"value": F.greatest(F.ceil(F.col("n") * q), F.lit(1))}, *keys).select(*keys, "value")


def quantile(df: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """The quantile of each group with linear interpolation at rank (n - 1) q."""
    at = (F.col("n") - 1) * q
    r = at_ranks(df, value, {"_a": F.floor(at) + 1, "_b": F.ceil(at) + 1}, *keys)
    return r.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("value"))


def confusion(pairs: DataFrame, gold: str, got: str, classes: list[str]) -> DataFrame:
    """Counts of each gold label by what was given for it; a gold label without answers counts under ``missing``."""
    p = pairs.withColumn("_g", F.coalesce(F.col(got), F.lit("missing")))
    return p.groupBy(gold).pivot("_g", [*classes, "missing"]).agg(F.count(F.lit(1))).na.fill(0)


def repeat_range(counts: DataFrame, arm: str, correct: str) -> DataFrame:
    return counts.groupBy(arm).agg(F.count(F.lit(1)).alias("repeats"), F.min(correct).alias("least"), F.avg(correct).alias("mean"), F.max(correct).alias("most"))


def stratified(items: DataFrame, stratum: str, key: str, n: int, seed: int = 11) -> DataFrame:
    """Up to ``n`` items of each stratum in order of a hash of their key: a seeded sample that needs no generator."""
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)))
    return items.withColumn("rn", rn).where(F.col("rn") <= n).drop("rn")


def format_only(predicted: Column, gold: Column) -> Column:
    """Whether a miss is one of form: equal without a leading label word, one of the gold's listed parts, or one set of parts within the other."""
    from folioquarry.functions.text import plain_answer

    strip = lambda c: plain_answer(F.regexp_replace(c, r"(?i)^\s*(?:answer|label|value)\s*:\s*", ""))
    parts = lambda c: F.filter(F.transform(F.split(c, r"\s*(?:,|;|/|\band\b|\bor\b)\s*"), plain_answer), lambda x: x != "")
    p, g = strip(predicted), strip(gold)
    pp, gp = parts(p), parts(g)
    inside = (F.size(pp) > 0) & (F.size(gp) > 0) & ((F.size(F.array_except(pp, gp)) == 0) | (F.size(F.array_except(gp, pp)) == 0))
    return F.coalesce((p != "") & (g != "") & ((p == g) | ((F.size(gp) > 1) & F.array_contains(gp, p)) | inside), F.lit(False))


def string_agrees(golden: Column, answer: Column) -> Column:
    """Agreement of a field before any judge: equal, both negative, yes/no against the option's text, or one within the other (4 characters and more)."""
    from folioquarry.functions.text import comparison_key, is_negative

    g, a = comparison_key(golden), comparison_key(answer)
    blank = F.trim(F.coalesce(golden, F.lit(""))) == ""
    neg_g = is_negative(golden) | g.startswith("leave blank") | g.startswith("not reached")
    mark_g, mark_a = F.regexp_extract(g, r"[-:]\s*(yes|no)$", 1), F.regexp_extract(a, r"[-:]\s*(yes|no)$", 1)
    yes = ((mark_g != "") & (a == mark_g)) | ((mark_a != "") & (g == mark_a))
    within = ((F.length(g) >= 4) & (F.length(g) <= F.length(a)) & F.contains(a, g)) | ((F.length(a) >= 4) & (F.length(a) < F.length(g)) & F.contains(g, a))
    return F.when(blank, is_negative(answer)).when(g == a, True).when(neg_g, is_negative(answer)).otherwise(yes | within)


def run_identity(config: dict) -> str:
    """Digest of a run's configuration, its keys in order: a run is resumed only where it is equal."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def extraction_score(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Labelled tables (doc, table_idx, headers, n_data_rows, must_pass) held against extracted ones (doc, table_idx, headers, n_data_rows): checks that apply and whether all hold.

    A label without an expectation passes that check; a table that wasn't extracted fails.
    """
    m = manifest.select("doc", "table_idx", F.col("headers").alias("_h"), F.col("n_data_rows").alias("_n"), F.lit(True).alias("_x"))
    j = labels.join(m, ["doc", "table_idx"], "left")
    low = lambda c: F.transform(c, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""))
    extracted = F.col("_x").isNotNull()
    headers = F.coalesce(F.size(F.array_except(low(F.col("headers")), low(F.col("_h")))) == 0, F.col("headers").isNull())
    rows = F.coalesce(F.col("n_data_rows") == F.col("_n"), F.col("n_data_rows").isNull())
    return j.select("doc", "table_idx", "must_pass", extracted.alias("extracted"), (extracted & headers).alias("headers_ok"), (extracted & rows).alias("rows_ok"), (extracted & headers & rows).alias("passed"))


def pass_rate(scores: DataFrame) -> DataFrame:
    """Share of the labels that must pass and do; 1 where none must."""
    g = scores.agg(F.count_if(F.coalesce("must_pass", F.lit(True))).alias("required"), F.count_if(F.coalesce("must_pass", F.lit(True)) & F.col("passed")).alias("passed"))
    return g.withColumn("rate", F.when(F.col("required") > 0, F.col("passed") / F.col("required")).otherwise(F.lit(1.0)))
