"""Inputs that are merely unusual: extreme numbers, layouts with gaps, long chains, hot keys."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquarry.functions import numeric as N
from folioquarry.operators import certify, dedup, graph, labels, layout, lifecycle, pipeline, search, tables
from folioquarry.sources import delimited

LAYOUT = "table_name string, header array<string>, col_types array<string>, delimiter string, date_format string, decimal_mark string"


@settings(max_examples=200, deadline=None)
@given(st.decimals(allow_nan=False, allow_infinity=False, places=None, min_value=-(10**45), max_value=10**45))
def test_numbers_are_exact_or_null(x):
    got = delimited.exact_number(format(x, "f"))
    fits = abs(x) < 10**28 and x == x.quantize(Decimal("1e-10"), context=__import__("decimal").Context(prec=80))
    assert got == (x if fits else None)


def test_extreme_values_and_layouts_end_no_load(spark):
    lay = [("t", ["a", "b"], ["integer", "amount"], ",", None, "."), ("nodate", ["a"], ["date"], ",", None, "."), ("nomark", ["a"], ["amount"], ",", "yyyy-MM-dd", None), ("nodelim", ["a"], ["text"], None, "d", "."), ("text", ["a"], ["text"], ",", None, None), ("short", ["a"], ["text", "text"], ",", None, None), ("odd", ["a"], ["colour"], ",", None, None), ("none", None, None, ",", None, None)]
    rows = [(1, "t", "9" * 40 + ",1"), (2, "t", "1,0.123456789"), (3, "t", "1,0.12345678901"), (4, "t", "x,1"), (5, "nodate", "2024-01-01"), (6, "nomark", "1"), (7, "nodelim", "a"), (8, "text", "a"), (9, "short", "a,b"), (10, "odd", "a"), (11, "none", "a"), (12, None, "a"), (13, "t", None)]
    r = spark.createDataFrame(rows, "row_key bigint, table_name string, raw_line string")
    got = {x.row_key: x for x in delimited.load_rows(r, spark.createDataFrame(lay, LAYOUT), keep=()).collect()}
    assert {k: x.reason for k, x in got.items()} == {1: None, 2: None, 3: None, 4: "value", 5: "layout", 6: "layout", 7: "layout", 8: None, 9: "layout", 10: "layout", 11: "layout", 12: "layout", 13: "column_count"}
    assert got[1].cells[0].number is None and got[1].cells[0].text == "9" * 40
    assert got[2].cells[1].number == Decimal("0.123456789") and got[3].cells[1].number is None


def test_certified_sums_are_exact(spark):
    d = spark.createDataFrame([("t", 1, 0.00004, Decimal("0.00004"), 2 * 10**14, "1e30"), ("t", 2, 0.00004, Decimal("0.00004"), 2 * 10**14, "x")], "table_name string, row_idx int, d double, e decimal(20,5), n bigint, s string")
    assert certify.certified(d, "sum", "d").first().result == Decimal("0.00008") and certify.certified(d, "sum", "e").first().result == Decimal("0.00008")
    assert certify.certified(d, "sum", "n").first().result == 4 * 10**14 and certify.certified(d, "mean", "n").first().result == 2 * 10**14
    assert certify.certified(d, "sum", "s").first().result is None
    big = spark.createDataFrame([("t", i, Decimal("9" * 38), 1e-12) for i in range(3)], "table_name string, row_idx int, v decimal(38,0), w double")
    r = certify.certified(big, "sum", "v").first()
    assert r.result is None and r.reason == "overflow" and r.n_rows == 3
    r = certify.certified(big, "sum", "w").first()
    assert r.result is None and r.reason == "value" and r.refused == 3
    r = certify.certified(d.limit(0), "sum", "d").first()
    assert r.result is None and r.reason is None and r.n_rows == 0


@pytest.mark.parametrize(("op", "xs", "want"), [("divide", ("1", "0.00001"), "100000"), ("multiply", ("2e10", "1"), "20000000000"), ("multiply", ("0.00004", "0.00004"), "0.0000000016"), ("divide", ("1", "0"), None), ("divide", ("1e-9", "1e18"), "0"), ("sum", ("1e30", "1"), None), ("mean", ("1", None), None), ("percent", ("0.5",), "50"), ("subtract", ("1e27", "1e-9"), "999999999999999999999999999.999999999"), ("divide", ("2", "3"), "0.6666666667")])
def test_calculate_over_extremes(spark, op, xs, want):
    d = spark.createDataFrame([xs], ", ".join(f"c{i} string" for i in range(len(xs))))
    got = d.select(certify.calculate(op, *[F.col(c) for c in d.columns]).alias("x")).first().x
    assert got == (None if want is None else Decimal(want))


def test_exact_arithmetic_as_text(spark):
    d = spark.createDataFrame([("1e30", "1e-9")], "a string, b string")
    assert Decimal(d.select(certify.calculate_exact("multiply", F.col("a"), F.col("b")).alias("x")).first().x) == Decimal("1e21")
    with pytest.raises(ValueError):
        certify.calculate("divide", F.col("a"))


def test_long_chains_end(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src bigint, dst bigint")
    assert graph.components(chain).groupBy("component").count().collect() == [(0, n + 1)]
    down = spark.createDataFrame([(i + 1, i) for i in range(40)], "id bigint, parent bigint")
    assert lifecycle.descendants(down, spark.createDataFrame([(0,)], "id bigint")).count() == 41
    # Each print is near the next one only: leaders are every second one.
    prints = spark.createDataFrame([(i, ((1 << (2 * i)) - 1) if i < 8 else 0) for i in range(8)], "doc_id bigint, simhash bigint")
    assert {(r.doc_id, r.leader) for r in dedup.greedy_leaders(prints).collect()} == {(i, i - 1) for i in (1, 3, 5, 7)}


def test_closed_counts_by_table(spark):
    e = spark.createDataFrame([("a",), ("a",), ("b",)], "label string")
    v = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "label string")
    assert {(r.label, r.n) for r in labels.closed_counts(e, v).collect()} == {("a", 2), ("b", 1), ("c", 0)}
    with pytest.raises(Exception, match="outside the vocabulary"):
        labels.closed_counts(e.unionByName(spark.createDataFrame([(None,)], "label string")), v).collect()


def test_windows_equal_slices(spark):
    rows = [(i, ("ab🙂\n" * 2000)[:n]) for i, n in enumerate((0, 1, 9, 10, 11, 19, 20, 5000))] + [(99, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.chunk_no): (r.char_start, r.char_end, r.text) for r in layout.window_rows(d, "doc_id", size=10, overlap=3).collect()}
    want = {}
    for i, t in rows:
        for k, s in enumerate(range(0, max(1, len(t) - 3), 7) if t else ()):
            want[(i, k)] = (s, min(s + 10, len(t)), t[s : s + 10])
    assert got == want


def test_grep_carries_no_document_into_the_sort(spark):
    d = spark.createDataFrame([(1, "a\nhit\nb\nc\nhit"), (2, None), (3, "hit")], "doc_id bigint, text string")
    out = search.grep_context(d, "hit", 1, max_hits=2)
    assert [(r.doc_id, r.hit_line, r.line_no, r.text, r.is_hit) for r in out.orderBy("doc_id", "hit_line", "line_no").collect()] == [(1, 2, 1, "a", False), (1, 2, 2, "hit", True), (1, 2, 3, "b", False), (1, 5, 4, "c", False), (1, 5, 5, "hit", True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sort = plan[: plan.index("Generate")]
    assert "Sort" in plan and "split(" not in sort


def test_knn_ties_and_pool(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)] + [(99, None), (98, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [r.vec_id for r in search.knn(v.repartition(3), q, 5).orderBy("rank").collect()] == [0, 3, 6, 9, 12]
    assert [r.vec_id for r in search.knn(v.repartition(3), q, 5, pool=7).orderBy("rank").collect()] == [0, 3, 6, 9, 12]
    assert search.knn(v, q.limit(0), 5).count() == 0


def test_routes_meet_on_terms(spark):
    m = spark.createDataFrame([("t1", ["Unit price"], None, "trusted"), ("t2", ["amount"], "Prices", "untrusted"), ("t3", ["x"], "the price list", "unchecked")], "table_name string, columns array<string>, caption string, status string")
    q = spark.createDataFrame([(1, ["PRICE"], []), (2, [], [5.0]), (3, ["none", ""], []), (4, None, None)], "query_id int, terms array<string>, numbers array<double>")
    assert {tuple(r) for r in search.route_tables(m, q).collect()} == {(1, "t1"), (1, "t3"), (2, "t1"), (2, "t3")}


def test_header_words(spark):
    h = ["Invoice no.", "Average price", "Price per share", "Opening balance", "Balance", "Amount", "Year", "Unit price", "Total", None, "Account"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "i int, h string").select("i", tables.non_additive(F.col("h")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [True, True, True, True, False, False, True, True, False, False, True]
    k = spark.createDataFrame([("Total", 2), ("Total assets are due", 2), ("Subtotal", 1), ("* note", 0), ("Section", 0), ("Item", 1)], "label string, n int").select(tables.row_kind(F.col("label"), F.col("n")).alias("k")).collect()
    assert [r.k for r in k] == ["total", "data", "subtotal", "footnote", "section", "data"]


def test_leading_values_and_captions(spark):
    a = ["about $1,234.50 million", "(5.5%)", "12 percentage points", "3x", "7 bn", "12th", "no", None, "approximately 3 k"]
    got = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(a)], "i int, a string").orderBy("i").select(N.leading_value(F.col("a")).alias("v")).collect()]
    assert [None if v is None else (v.value, v.unit) for v in got] == [(1234.5e6, "money"), (-5.5, "pct"), (12.0, "pct"), (3.0, ""), (7e9, ""), None, None, None, (3000.0, "")]
    c = spark.createDataFrame([("Figures in  thousands",), ("($m)",), ("in billions of yen",), ("000s",), ("plain",), (None,)], "c string").select(N.caption_scale(F.col("c")).alias("s")).collect()
    assert [r.s for r in c] == [1e3, 1e6, 1e9, 1e3, 1.0, 1.0]


def test_headers_by_contrast(spark):
    grids = {"a": [["Name", "Amount"], ["x", "1"], ["y", "2"]], "b": [["x", "y"], ["u", "v"]], "c": [["x", "5"], ["y", "6"]], "d": [["Wert", "Wert"], ["1", "2"]]}
    rows = [(t, i, j, v, False) for t, g in grids.items() for i, r in enumerate(g) for j, v in enumerate(r)]
    got = pipeline.infer_headers(spark.createDataFrame(rows, "table_name string, row_idx int, col_idx int, raw string, flagged boolean"))
    assert {r.table_name: r.n_header for r in got.collect()} == {"a": 1, "b": 0, "c": 0, "d": 1}
