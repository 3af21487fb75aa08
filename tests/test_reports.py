"""Evidence steps and reports on small cases."""

import pytest

from folioquarry.operators import certify, reports
from folioquarry.sources import grids, workbook


def test_steps_and_refusals(spark):
    facts = spark.createDataFrame([("a", "1e30"), ("b", "3"), ("n", None), ("d", "1"), ("d", "2"), ("z", "0")], "id string, value string")
    steps = [("s", "sum", ["a", "b"]), ("t", "divide", ["b", "z"]), ("u", "percent", ["t"]), ("x", "sum", ["y"]), ("y", "sum", ["x"]), ("v", "sum", ["d", "a"]), ("w", "divide", ["a"]), ("q", "mean", ["s", "s", "b"]), ("m", "sum", ["n"]), ("o", "sum", ["gone"]), ("e", "sum", []), ("i", None, ["a"])]
    st = spark.createDataFrame(steps, "id string, op string, operands array<string>")
    got = {r.id: r for r in certify.evaluated(facts, st).collect()}
    assert {k: r.refusal for k, r in got.items() if k not in "abz"} == {"n": "no value", "d": "duplicate", "s": None, "t": "no value", "u": "refused", "x": "cycle", "y": "cycle", "v": "refused", "w": "arguments", "q": None, "m": "refused", "o": "operand", "e": "arguments", "i": "arguments"}
    assert got["s"].value == "1000000000000000000000000000003" and got["q"].depth == 2
    assert certify.evaluated(facts.limit(0), st.limit(0)).count() == 0
    now = facts.replace("3", "4", "value")
    assert {r.id for r in certify.stale(certify.evaluated(facts, st), now, st).collect()} == {"b", "s", "q"}


def test_causes_in_order(spark):
    schema = "qid int, correct boolean, gold_marked_wrong boolean, status string, error_type string, health string, predicted string, gold string, gold_blocked boolean, gold_doc string, seen_docs array<string>, gold_page int, seen_pages array<int>, gold_seen boolean, recorded boolean"
    base = dict(correct=False, gold_marked_wrong=None, status="final", error_type=None, health=None, predicted="x", gold="y", gold_blocked=None, gold_doc=None, seen_docs=None, gold_page=None, seen_pages=None, gold_seen=None, recorded=None)
    cases = [({"correct": True}, "ok"), ({"gold_marked_wrong": True, "status": "error"}, "gold"), ({"status": "error", "error_type": "IngestError"}, "ingest"), ({"status": "error", "health": "blocked"}, "ingest"), ({"status": "recovered"}, "budget"), ({"status": "error"}, "execution"), ({"status": None}, "execution"), ({"predicted": "Answer: y"}, "format"), ({"gold_blocked": True}, "ingest"), ({"recorded": True, "gold_doc": "d1", "seen_docs": ["d2"], "gold_seen": True}, "retrieval"), ({"recorded": True, "gold_doc": "d1", "seen_docs": ["d1.pdf"], "gold_seen": True}, "reasoning"), ({"recorded": True, "gold_page": 3, "seen_pages": [1]}, "retrieval"), ({"recorded": True, "gold_page": 3, "seen_pages": [3]}, "reasoning"), ({"recorded": True}, "retrieval"), ({}, "reasoning")]
    d = spark.createDataFrame([tuple({"qid": i, **base, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    got = [r.c for r in d.select("qid", reports.miss_cause(d).alias("c")).orderBy("qid").collect()]
    assert got == [w for _, w in cases]
    assert {(r.cause, r.misses) for r in reports.ledger(d).collect()} == {("gold", 1), ("ingest", 3), ("budget", 1), ("execution", 2), ("format", 1), ("retrieval", 3), ("reasoning", 3)}


def test_reports_of_nothing(spark):
    r = spark.createDataFrame([], "qid int, arm string, correct boolean, expect string, answer string, tier string, golden string")
    s = reports.summary(r).first()
    assert (s.n, s.accuracy, s.false_positive_rate, s.review_recall) == (0, 0.0, 0.0, 1.0)
    assert reports.regression(r, 0.5).first().passed is False and reports.arms(r, "a").count() == 0
    odd = spark.createDataFrame([(1, "a", None, None, None, None, None)], r.schema)
    assert reports.summary(odd).first().n == 1 and reports.by_class(odd, "tier").first().correct == 0


def test_contracts(spark):
    cells = spark.createDataFrame([("t", i, c, raw, v, "USD", "2024") for i, row in enumerate([("Revenue", 10.0), ("Cost", 4.0), ("Zero", 0.0)]) for c, raw, v in (("label", row[0], None), ("amount", str(row[1]), row[1]))], "table_name string, row_idx int, col_name string, raw string, num_value double, unit string, period string")
    say = lambda cid, role, i, label, col="amount": (cid, role, "t", i, col, "label", label)
    sources = [say("ok", "numerator", 0, "Revenue"), say("ok", "denominator", 1, "Cost"), say("zero", "numerator", 0, "Revenue"), say("zero", "denominator", 2, "Zero"), say("lab", "numerator", 0, "Sales"), say("lab", "denominator", 1, "Cost"), say("gone", "numerator", 9, "Revenue"), say("gone", "denominator", 1, "Cost"), say("half", "numerator", 0, "Revenue"), say("unit", "numerator", 0, "Revenue"), say("unit", "denominator", 1, "Cost"), *[say("cov", r, i, n) for r, i, n in (("earnings", 0, "Revenue"), ("depreciation", 1, "Cost"), ("rent", 1, "Cost"), ("interest", 1, "Cost"))]]
    contracts = [("ok", "direct_ratio", "USD", "2024"), ("zero", "direct_ratio", "USD", "2024"), ("lab", "direct_ratio", "USD", "2024"), ("gone", "direct_ratio", "USD", "2024"), ("half", "direct_ratio", "USD", "2024"), ("unit", "direct_ratio", "EUR", "2024"), ("none", None, "USD", "2024"), ("bad", "guess", "USD", "2024"), ("cov", "coverage", "USD", "2024")]
    got = {r.contract_id: (r.result, r.refusal) for r in reports.contract_results(spark.createDataFrame(contracts, "contract_id string, formula string, unit string, period string"), spark.createDataFrame(sources, "contract_id string, role string, table_name string, row_idx int, col_name string, label_col string, label string"), cells).collect()}
    assert got == {"ok": ("2.5", None), "zero": (None, "no value"), "lab": (None, "label"), "gone": (None, "source"), "half": (None, "roles"), "unit": (None, "unit or period"), "none": (None, "formula"), "bad": (None, "formula"), "cov": ("0.5", None)}


def test_workbooks_are_read_back(spark, tmp_path):
    a = spark.createDataFrame([(1, "x < y & \x01", 2.5, True), (None, None, float("nan"), None), (10**17, " lead", 1e300, False)], "n bigint, t string, d double, b boolean")
    b = a.select(*[a.n.alias(f"c{i}") for i in range(30)]).limit(1)
    path = str(tmp_path / "r.xlsx")
    workbook.write_workbook({"One & two": a, "B": b}, path)
    _, got = grids.workbook(open(path, "rb").read())
    assert got[0] == ("One & two", [["n", "t", "d", "b"], ["1", "x < y & \ufffd", "2.5", "1"], [str(10**17), " lead", "1e+300", "0"]])
    assert got[1][1][0][-1] == "c29" and len(got[1][1][1]) == 30
    for sheets, rows in (({"A": a}, 2), ({"a/b": a}, 9), ({}, 9), ({"x": spark.createDataFrame([("y" * 40_000,)], "t string")}, 9)):
        with pytest.raises(ValueError):
            workbook.workbook(sheets, rows)
    with pytest.raises(Exception):
        workbook.write_workbook({"A": a}, path)


def test_meter(spark):
    d = spark.createDataFrame([("a", None, float(i)) for i in range(1, 11)] + [("a", "x", 5.0), ("b", "x", None), (None, None, 1.0)], "name string, tag string, value double")
    got = {(r.name, r.tag): tuple(r)[2:] for r in reports.meter(d, "tag").collect()}
    assert got == {("a", None): (10, 5.0, 10.0, 10.0, 55.0), ("a", "x"): (1, 5.0, 5.0, 5.0, 5.0), (None, None): (1, 1.0, 1.0, 1.0, 1.0)}
