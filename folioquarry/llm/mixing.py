"""Mixing sources to target shares (p7).

Each source gets ``target_share`` x the size of all documents, in tokens. Whole passes over a source come first, at most
``max_repeats``; what is left of the budget is filled by weighted sampling without replacement after Efraimidis and
Spirakis: every document draws an exponential key ``-ln(u) / weight``, and documents are taken in order of their keys
while the prefix sum of their tokens stays within the budget.

The prefix sum is distributed: keys map monotonically to slots, token sums per (source, slot) are pre-aggregated, a window
over the slots of a source finds the slot in which the budget ends, and only the documents of that slot are sorted. A
slot is 1/``buckets`` of a doubling of the key, in which at most a quarter of a source is expected whatever its weights
(the logarithm of an exponential key has no denser place, and a mixture of weights only spreads it), so a slot holds
about 0.025 % of its source, and no source is sorted in one task.

Defined cases: null and empty texts have 0 tokens and are never taken by the fractional pass; documents of a null or
unlisted source count in the whole and are not mixed in; repeated rows are documents of their own; ties in the key are
ordered by ``doc_id``; a listed source without documents is reported with 0 tokens; with no documents at all every
share is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.llm.tokens import count_tokens, vocabulary
from folioquarry.plans.runtime import cut, spread


def sized(docs: DataFrame, tokenizers: str) -> DataFrame:
    """``doc_id``, ``source``, ``tokens`` and a quality ``weight`` in (0, 1] per document.

    The weight is characters per token over 4, at most 1 (garbled text takes many tokens for few characters), and a
    quarter of that for documents recorded as duplicates.
    """

    words = vocabulary(tokenizers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", "source", "copied"]].copy()
            out["chars"] = pdf["text"].str.len()
            out["tokens"] = count_tokens(pdf["text"].tolist(), words)
            yield out

    copied = F.col("duplicate_of").isNotNull() if "duplicate_of" in docs.columns else F.lit(False)
    kind = dict(docs.dtypes)["doc_id"]  # ids pass Python as strings: with nulls they would become floats there
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.coalesce("text", F.lit("")).alias("text"), copied.alias("copied"))
    out = spread(texts, "doc_id").mapInPandas(
        run, "doc_id string, source string, copied boolean, chars bigint, tokens bigint"
    )
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("chars") / (F.col("tokens") * 4)))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "tokens", F.when(F.col("tokens") > 0, weight * F.when(F.col("copied"), 0.25).otherwise(1.0)).otherwise(F.lit(0.05)).alias("weight"))


def plan(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """Per listed source: own tokens, budget, complete epochs, tokens left for the fractional pass, and whether the cap on repeats keeps it below its share."""
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count(F.lit(1)).alias("documents"))
    whole = per.agg(F.sum("own_tokens").alias("all_tokens"))
    out = weights.join(per, "source", "left").join(F.broadcast(whole))  # ``whole`` is one row
    own, budget = F.coalesce("own_tokens", F.lit(0)), F.col("target_share") * F.col("all_tokens")
    epochs = F.when(own > 0, F.least(F.floor(budget / own), F.col("max_repeats").cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    out = out.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), own.alias("own_tokens"), "all_tokens", budget.alias("budget"), epochs.alias("epochs"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("own_tokens")).otherwise(F.lit(0.0))
    return out.withColumn("fraction_tokens", rest).withColumn("capped", F.col("budget") > F.col("max_repeats") * F.col("own_tokens"))


def mix(sizes: DataFrame, weights: DataFrame, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """``source``, ``doc_id``, ``tokens`` and ``copies`` (0 or more) of each document of the listed sources."""
    p = plan(sizes, weights).select("source", "epochs", "fraction_tokens")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    keyed = sizes.withColumn("_key", -F.log(u) / F.col("weight")).withColumn("_slot", F.floor(F.log2(F.col("_key")) * buckets).cast("int"))
    slots = keyed.groupBy("source", "_slot").agg(F.sum("tokens").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumn("_before", before).join(p, "source").withColumn("_left", F.col("fraction_tokens") - F.col("_before"))
    slots = slots.withColumn("_state", F.when(F.col("_left") >= F.col("_held"), "in").when(F.col("_left") > 0, "edge").otherwise("out"))
    rows = keyed.join(slots.select("source", "_slot", "_left", "_state", "epochs"), ["source", "_slot"])
    edge = rows.where("_state = 'edge'").withColumn("_run", F.sum("tokens").over(Window.partitionBy("source", "_slot").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    taken = rows.where("_state <> 'edge'").withColumn("_in", F.col("_state") == "in").unionByName(edge.withColumn("_in", F.col("_run") <= F.col("_left")).drop("_run"))
    return taken.select("source", "doc_id", "tokens", (F.col("epochs") + F.when(F.col("_in") & (F.col("tokens") > 0), 1).otherwise(0)).alias("copies"))


def report(sizes: DataFrame, weights: DataFrame, seed: int = 17) -> DataFrame:
    """The plan of each source with the tokens mixed in and the share reached."""
    got = mix(sizes, weights, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    out = plan(sizes, weights).join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = out.agg(F.sum("mixed_tokens").alias("_total"))
    return out.join(F.broadcast(total)).withColumn("reached_share", F.try_divide("mixed_tokens", "_total")).drop("_total")  # ``total`` is one row


def mixed(docs: DataFrame, tokenizers: str) -> DataFrame:
    """Sizes once, written to the shared checkpoint folder for the passes that follow."""
    return cut(sized(docs, tokenizers))
