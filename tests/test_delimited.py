import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquarry.sources import delimited as D

TYPES = ["date", "text", "amount", "integer"]


def reasons(lines, types=TYPES, delimiter=",", date_format="yyyy-MM-dd", mark="."):
    return list(D.judge_lines(lines, types, delimiter, date_format, mark)[0])


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("2024-02-29,x,1.5,3", None), ("2023-02-29,x,1.5,3", "value"), ('"2024-01-01","a, b","1,234.50",-3', None), ('2024-01-01,"a""b",(5),n/a', None),
        ('2024-01-01,a"b,1,2', "quoting"), ('2024-01-01,"ab" x,1,2', "quoting"), ('2024-01-01, "ab",1,2', "quoting"), ('2024-01-01,"ab,1,2', "quoting"), ('2024-01-01,"a"b"c",1,2', "quoting"),
        ("2024-01-01,x,1", "column_count"), ("2024-01-01,x,1,2,", "column_count"), ("", "column_count"), (" , - , NIL ,N/A", None), ("2024-01-01,x,1.2.3,4", "value"), ("2024-01-01,x,12,34.5", "value"),
        ("2024-01-01,x,-$1234,4", None), ("2024-01-01,x,$-1234,4", "value"), ("2024-01-01,x,(-5),4", "value"), ('2024-01-01,x,"12,34",4', "value"), ('2024-01-01,"line\nbreak",1,4', None), ("2024-1-01,x,1,4", "value"),
        ('"",,,', None), ('""a"",x,1,2', "quoting"), ('2024-01-01,"",1,2', None), ('2024-01-01,""",1,2', "quoting"),
    ],
)
def test_first_reason(line, reason):
    assert reasons([line]) == [reason]


def test_reasons_do_not_leak_over_records():
    assert reasons(['2024-01-01,"open,1,2', "2024-01-01,x,1,2", 'a"', "2024-01-01,x,1,2"]) == ["quoting", None, "quoting", None]


def test_formats():
    assert reasons(["1 Feb 2024|1.234,5"], ["date", "amount"], "|", "d MMM yyyy", ",") == [None]
    assert reasons(["1 feb 2024|1.234,5"], ["date", "amount"], "|", "d MMM yyyy", ",") == ["value"]
    assert reasons(["02/30/2024\t1"], ["date", "integer"], "\t", "MM/dd/yyyy", ".") == ["value"]
    assert reasons(["x§y"], ["text", "text"], "§", "", ".") == [None]


def plain_reason(line, n, delimiter=","):
    """Brute force: a character machine over one record."""
    fields, i, bad = [], 0, False
    inside, field = False, ""
    for c in line:
        if c == '"':
            inside = not inside
        if c == delimiter and not inside:
            fields.append(field)
            field = ""
        else:
            field += c
    fields.append(field)
    for f in fields:
        if '"' in f:
            body = f[1:-1]
            if len(f) < 2 or f[0] != '"' or f[-1] != '"' or '"' in body.replace('""', ""):
                bad = True
    if inside or bad:
        return "quoting"
    return None if len(fields) == n else "column_count"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n é', max_size=12), min_size=1, max_size=6))
def test_structure_equals_character_machine(lines):
    assert reasons(lines, ["text"] * 3) == [plain_reason(x, 3) for x in lines]


def test_load_rows(spark):
    layout = spark.createDataFrame([("t", ["Day", "Who", "Sum"], ["date", "text", "amount"], ";", "dd/MM/yyyy", ",", "x")], "table_name string, header array<string>, col_types array<string>, delimiter string, date_format string, decimal_mark string, reason string")
    rows = spark.createDataFrame(
        [(1, "t", 1, 1, 0, "01/02/2024;Ann;(1.234,5)", "r"), (2, "t", 1, 1, 0, "01/02/2024;Ann;(1.234,5)", "r"), (3, "nope", 1, 1, 1, "x", None), (4, "t", None, None, None, None, None), (5, None, 1, 1, 1, "x", None), (6, "t", 1, 1, 1, "-;;nil", None)],
        "row_key bigint, table_name string, doc_id bigint, page int, row_idx int, raw_line string, reason string",
    )
    got = {r.row_key: r for r in D.load_rows(rows, layout).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: None, 3: "layout", 4: "column_count", 5: "layout", 6: None}
    c = got[1].cells
    assert (c[0].day, c[1].text, c[2].number) == (dt.date(2024, 2, 1), "Ann", Decimal("-1234.500000"))
    assert [x.text for x in got[6].cells] == [None, None, None]
    assert D.load_rows(rows.limit(0), layout).count() == 0


def test_outcomes(spark):
    o = spark.createDataFrame(
        [("a", "parsed", 1, None, 2, 0), ("a", "parsed", 1, None, 2, 0), ("b", "parsed", 1, None, 2, 3), ("c", "parse_failed", None, "bad", 0, 0), ("d", "parse_failed", 1, "bad", 0, 0), ("e", None, 1, None, 0, 0), ("f", "parsed", 1, None, None, 0), ("g", "parsed", 1, None, 1, -1)],
        "outcome_id string, status string, doc_id bigint, error string, scanned_pages_total int, scanned_pages_untranscribed int",
    )
    assert {r.outcome_id for r in D.judge_outcomes(o).where("reason is not null").collect()} == {"b", "d", "e", "f", "g"}
    assert D.judge_outcomes(o).count() == 7
