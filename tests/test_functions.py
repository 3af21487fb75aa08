import hashlib

import pytest
from pyspark.sql import functions as F

from folioquarry.functions import numeric as N
from folioquarry.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("cell", "style", "scale", "value"),
    [
        ("(1,234)", "us", 1, -1234), ("$-5", "us", 1, -5), ("1,234(1)", "us", 1, 1234), ("3mm", "us", 1, 3e6), ("45%", "us", 1000, 45), ("1.2.3", "us", 1, None), ("n/a", "us", 1, None), ("—", "us", 1, None), ("", "us", 1, None), (None, "us", 1, None),
        ("1.234,56", "eu", 1, 1234.56), ("−7", "us", 1, -7), ("-(5)", "us", 1, None), ("(-5)", "us", 1, -5), ("2bn", "us", 1, 2e9), ("1,234m", "us", 1, None), ("5", "us", 1000, 5000), ("abc", "us", 1, None), ("12*", "us", 1, 12), ("£ 1,000.5", "us", 1, 1000.5), ("(12", "us", 1, None),
    ],
)
def test_coerce_cell(spark, cell, style, scale, value):
    assert one(spark, N.coerce_cell(F.col("c"), style, scale), c=cell) == value


@pytest.mark.parametrize(("a", "b", "same"), [("$1,200", "$1200.00", True), ("50 bps", "0.5%", True), ("5", "5%", False), ("(3)", "-3", True), ("(-3)", "3", False), ("Yes.", "yes", True), ("", "", False), (None, "x", False), ("1 million", "1000000", True), ("0", "0.0", True), ("$5", "€5", False)])
def test_score_answer(spark, a, b, same):
    assert one(spark, N.score_answer(F.col("a"), F.col("b")), a=a, b=b) is same


@pytest.mark.parametrize(("a", "b", "same"), [("77.78", "77.78%", True), ("0.0142", "1.42%", True), ("$2,100", "$2.1 billion", True), ("45", "45 days", True), ("5.4", "5.00", False), ("-0.02", "-1.42%", False), ("5", "-5", False), ("none", "5", False), (None, "5", False)])
def test_normalised_match(spark, a, b, same):
    assert one(spark, N.normalised_match(F.col("a"), F.col("b")), a=a, b=b) is same


def test_present(spark):
    got = spark.sql("select 2.50001 a, 2.00005 b, 3.0 c, -0.00001 d").select(*[N.present(F.col(c)).alias(c) for c in "abcd"]).first()
    assert tuple(got) == ("2.5", "2", "3", "0")


def test_terms(spark):
    assert one(spark, T.terms(F.col("q")), q="What was the total for a_b in 2024 and 2024, 3,400?") == ["total", "a_b", "2024", "3,400"]
    assert one(spark, T.terms(F.col("q")), q=None) is None
    long = " ".join(f"word{chr(97 + i)}" for i in range(20)) + " 77"
    assert one(spark, T.terms(F.col("q")), q=long)[-1] == "77"


def test_quote_keys(spark):
    assert one(spark, T.quote_key(F.col("q")), q="  “A”–b  C\n") == '"a"-b c'
    assert one(spark, T.quote_key_full(F.col("q")), q="ﬁne Straße ") == "fine strasse"


def test_answer_kind(spark):
    kinds = {"Yes": "affirmative", "no": "negative", "N/A": "not_applicable", "☐ unknown": "absent", "Not found: x": "absent", "5": "value", None: "absent", "not founded": "value"}
    for v, k in kinds.items():
        assert one(spark, T.answer_kind(F.col("v")), v=v) == k


def test_simhash(spark):
    toks = ["ab", "cd", "ab", "ef"]
    got = spark.createDataFrame([(toks,), ([],), (None,)], "t array<string>").select(T.simhash64("t").alias("x")).collect()
    assert [r.x for r in got] == [T.simhash_md5(toks), 0, 0]
    h = int.from_bytes(hashlib.md5(b"ab").digest()[:8], "little")
    assert T.simhash_md5(["ab"]) & (2**64 - 1) == h


def test_redacted(spark):
    assert one(spark, T.redacted(F.col("v")), v="abc").startswith("[redacted 3 ")
    assert one(spark, T.redacted(F.col("v")), v=None) is None
    with pytest.raises(ValueError):
        T.redacted(F.lit("x"), "other")
