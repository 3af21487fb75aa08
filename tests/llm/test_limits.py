"""Every limit of a source is found, and values without a source are held against all."""

import random

from folioquarry.llm import truncation


def _text(rng: random.Random, n: int) -> str:
    out = ""
    while len(out) < n:
        out += " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(8)).capitalize() + ". "
    return out[: n - 1] + "x"


def test_second_limits_stand_out(spark):
    rng = random.Random(5)
    sizes = [("a", rng.randrange(100, 3000)) for _ in range(2000)] + [("a", 1000)] * 120 + [("a", 2000)] * 25 + [("a", 1998)] * 9
    sizes += [("b", rng.randrange(20, 60)) for _ in range(1500)] + [("b", 750)] * 8 + [(None, 1000)] * 3 + [(None, 640), (None, 90)]
    d = spark.createDataFrame([(i, s, _text(rng, n)) for i, (s, n) in enumerate(sizes)], "doc_id bigint, source string, text string")
    limits = truncation.find_limits(d)
    found = {(r.source_key, r.limit) for r in limits.collect()}
    assert {("a", 1000), ("a", 2000), ("b", 750)} <= found and not {x for x in found if x[0] == "a"} - {("a", 1000), ("a", 2000)}
    assert all(k == 750 or s != "b" or 20 <= k < 60 for s, k in found)
    sets = {r.source_key: r.limits for r in truncation.limit_sets(limits).collect()}
    assert sets[""] == sorted({k for _, k in found}, reverse=True) and sets["a"] == [2000, 1000]
    assert truncation.limit_of("word", 1000, 0, sets["a"]) == 1000 and truncation.limit_of("word", 1999, 0, sets[""]) == 2000 and truncation.limit_of("word", 9, 0, []) == 0


def test_boundaries_by_rank():
    from folioquarry.llm import chunking

    chinese = "这是一个很长的句子没有空格也没有换行。" * 200
    spans = chunking.cuts(chinese)
    assert all(e - s <= 1500 for s, e in spans) and all(chinese[e - 1] == "。" for _, e in spans) and len(spans) > 2
    quoted = "他说：“好的。”" * 400
    assert all(quoted[e - 1] in "”" for _, e in chunking.cuts(quoted))
    para = "".join(f"Sentence {i} stands in this paragraph. And so does another one here.\n" + ("\n" if i % 4 == 3 else "") for i in range(120))
    ends = [para[e - 2 : e] for _, e in chunking.cuts(para)[:-1]]
    assert sum(x == "\n\n" for x in ends) >= 0.7 * len(ends)
    assert chunking.cuts("\r\n" * 1000)[-1][1] == 2000 and chunking.cuts("\n" * 1501)[0][1] <= 1500


def test_no_slot_of_a_mix_is_hot(spark):
    """Whatever the weights, documents spread over the slots: here most are duplicates of low weight."""
    from pyspark.sql import functions as F

    d = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, 0.05).otherwise(0.25).alias("w"))
    u = (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    slots = d.groupBy(F.floor(F.log2(-F.log(u) / F.col("w")) * 1024).alias("s")).count()
    assert slots.agg(F.max("count")).first()[0] < 200_000 * 0.0025  # 0.025 % are expected, 50 documents


def test_large_buckets_are_compared_in_blocks(spark):
    from folioquarry.llm import neardup

    texts = [(i, " ".join(f"w{k}" for k in range(60)) + f" x{i} y{i}") for i in range(50)]
    j = neardup.PathJoin(spark.createDataFrame(texts, "doc_id bigint, text string"), k=3, threshold=(7, 10), bucket=4, max_depth=2)
    assert j.found().count() == 50 * 49 // 2


def test_runs_are_repeated_until_the_target_recall(spark):
    """Single runs of thin paths miss much: the estimate tells, and runs are added until it is the target's."""
    import random

    from folioquarry.llm import neardup

    rng = random.Random(21)
    texts = []
    for g in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(2):
            texts.append((len(texts), " ".join(w if rng.random() > 0.03 else f"e{rng.randrange(10**6)}" for w in base)))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(3)])) for _, t in texts]
    want = {(a, a + 1) for a in range(0, 240, 2) if 10 * len(sets[a] & sets[a + 1]) >= 7 * len(sets[a] | sets[a + 1])}
    j = neardup.PathJoin(spark.createDataFrame(texts, "doc_id bigint, text string"), k=3, threshold=(7, 10), branch=1.0, runs=1, recall=0.98)
    got = {(r.a, r.b) for r in j.found().collect()}
    assert j.turns > 1 and j.estimate >= 0.98 and not got - want and len(got) >= 0.95 * len(want) and len(want) > 60
