"""The classifier of p8 is trained on all documents, by the same steps on the driver and in Spark."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioquarry.llm import truncation


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(7)).capitalize() + "." for _ in range(n))


def test_documents_beyond_the_first_sixteen_thousand_train(spark):
    """The model follows the texts of every document, those with the highest hashes of their ids too."""
    rng = random.Random(8)
    n = 17_000
    rows = [(i, "a", _sentences(rng, rng.randrange(2, 20)) if i % 50 == 0 else f"Item {i % 97} was sent.") for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    last = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) >= int(16_000 / n * (1 << 30))
    other = d.withColumn("text", F.when(last, "Zebras graze\nQuietly zx").otherwise(F.col("text")))
    assert d.where(last).count() > 500
    limits = spark.createDataFrame([], "source_key string, limit int")
    a, b = truncation.train(d, limits), truncation.train(other, limits)
    assert np.abs(a.weights - b.weights).max() > 0.01


def test_training_in_spark_is_the_same(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), _sentences(rng, rng.randrange(2, 12))[: 300 if i % 3 == 0 else None]) for i in range(400)]
    d = spark.createDataFrame(rows + [(400, "a", None), (401, None, " ")], "doc_id bigint, source string, text string").repartition(5)
    limits = truncation.find_limits(d)
    here, there = (truncation.Rows(truncation.training_rows(d, limits), n) for n in (10_000, 0))
    assert here.count == there.count > 800 and here.blocks is not None and there.blocks is None
    assert here.tally()[:, [0, 2]].sum() == 400 and (here.tally() == there.tally()).all()
    on = ~np.eye(truncation.FOLDS, dtype=bool)
    for p, q in zip(truncation.fit(here, on, rounds=4), truncation.fit(there, on, rounds=4)):
        assert np.abs(p.weights).max() > 0.1 and np.allclose(p.weights, q.weights, atol=1e-6) and np.isclose(p.bias, q.bias, atol=1e-6)
    for r in (here, there):
        r.relabelled(lambda x, y, fold: np.where((y == 0) & (x[:, -1] % 2 == 0), 3, y))
    assert (here.tally() == there.tally()).all() and here.tally()[:, 3].any() and here.tally().sum() == here.count
    assert there.total(lambda x, y, fold: truncation.binned(x[:, 0] / 4096.0)).reshape(2, -1)[1].sum() == here.count


def test_prior_from_bins_is_that_of_the_scores():
    z = np.random.default_rng(4).normal(-2, 3, 20_000)
    s, n = truncation.binned(z).reshape(2, -1)
    assert abs(truncation.prevalence_shift(s / np.maximum(1, n), n) - truncation.prevalence_shift(z, np.ones(len(z)))) < 1e-4
