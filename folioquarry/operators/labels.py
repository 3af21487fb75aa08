"""Votes, label counts and label passes with an injected labeler."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import comparison_key


def majority(votes: DataFrame, *keys: str, label: str = "label", order: str = "vote_idx", expected: int | None = None) -> DataFrame:
    """Plurality label per group, a tie going to the label of the earliest vote; strict with ``expected``: all votes there and more than half agree, else null."""
    g = votes.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    out = g.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("winner"), F.max("n").alias("best"), F.sum("n").alias("votes"))
    if expected is not None:
        strict = (F.col("votes") == expected) & (F.col("best") > expected // 2)
        out = out.withColumn("winner", F.when(strict, F.col("winner")))
    return out


def resolutions(answers: DataFrame, *keys: str, passes: int, answer: str = "answer") -> DataFrame:
    """unanimous, majority or split by comparison keys; blank answers don't vote but count among the passes."""
    a = answers.withColumn("_k", comparison_key(F.col(answer))).where("_k <> ''")
    best = a.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("best"))
    every = answers.select(*keys).distinct().join(best, list(keys), "left").withColumn("best", F.coalesce("best", F.lit(0)))
    return every.withColumn("resolution", F.when(F.col("best") == passes, "unanimous").when(2 * F.col("best") > passes, "majority").otherwise("split")).withColumn("agreement", F.col("best") / passes)


def closed_counts(labels: DataFrame, vocabulary: list[str] | DataFrame, label: str = "label") -> DataFrame:
    """Counts over a closed vocabulary (a list, or a table with a column ``label`` of any size), zeros included; labels outside it, null among them, raise when the counts are used."""
    v = vocabulary.select("label").where("label is not null").distinct() if isinstance(vocabulary, DataFrame) else labels.sparkSession.createDataFrame([(x,) for x in sorted(set(vocabulary))], "label string")
    got = labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    j = v.withColumn("_known", F.lit(True)).join(got, "label", "full")
    odd = F.raise_error(F.concat(F.lit("label outside the vocabulary: "), F.coalesce("label", F.lit("null"))))
    return j.select("label", F.when(F.col("_known").isNull(), odd.cast("bigint")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))


def extremes(counts: DataFrame) -> DataFrame:
    """Most and least frequent labels with all ties; labels never seen take part in the least. The vocabulary is small: one window over it."""
    w = Window.partitionBy(F.lit(1))
    c = counts.withColumn("_hi", F.max("n").over(w)).withColumn("_lo", F.min("n").over(w))
    return c.where("n = _hi").select(F.lit("most").alias("end"), "label", "n").unionByName(c.where("n = _lo").select(F.lit("least").alias("end"), "label", "n"))


def annotate(rows: DataFrame, key: str, text: str, labeler: Callable[[list[str]], list[str]], vocabulary: list[str] | None = None, batch_rows: int = 40, batch_chars: int = 200_000) -> DataFrame:
    """(key, label, attempts): labels by an injected function over batches of rows and characters.

    A batch whose reply has the wrong length or, with a closed vocabulary, words outside it, is asked once more, strictly;
    what is wrong then is null. Null texts get no label and aren't asked about.
    """
    kind = dict(rows.dtypes)[key]
    allowed = None if vocabulary is None else {v.lower(): v for v in vocabulary}

    def ask(texts: list[str]) -> tuple[list, int]:
        for attempt in (1, 2):
            got = list(labeler(texts))
            if len(got) == len(texts):
                clean = got if allowed is None else [allowed.get(str(g).strip().lower()) for g in got]
                if attempt == 2 or all(c is not None for c in clean):
                    return clean, attempt
        return [None] * len(texts), 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, texts, chars, out = [], [], 0, []

            def flush() -> None:
                if keys:
                    got, n = ask(texts)
                    out.extend((k, g, n) for k, g in zip(keys, got))
                    keys.clear()
                    texts.clear()

            for k, t in zip(pdf[key], pdf[text]):
                if not isinstance(t, str):
                    out.append((k, None, 0))
                    continue
                if keys and (len(keys) >= batch_rows or chars + len(t) > batch_chars):
                    flush()
                    chars = 0
                keys.append(k)
                texts.append(t)
                chars += len(t)
            flush()
            yield pd.DataFrame(out, columns=[key, "label", "attempts"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, label string, attempts int")


def new_passes(wanted: DataFrame, log: DataFrame, key: str = "digest") -> DataFrame:
    """Label passes that the log doesn't have yet: running one again does nothing."""
    return wanted.join(log.select(key), key, "left_anti")


def latest_log(log: DataFrame, *keys: str, order: str = "id") -> DataFrame:
    """The last log row of each group."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
