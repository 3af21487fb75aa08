"""Queries do the whole job: no matter, row, term or document is left aside."""

from collections import Counter
from itertools import combinations

import __spark_entry__


def run(spark, folder, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return __spark_entry__.queries()[name](spark, str(folder))


def test_relation_pairs_keep_the_largest_matter(spark, tmp_path):
    hot = [("M", f"a{i:03}") for i in range(600)]  # more than two blocks of authors
    rest = [(f"m{i % 7}", f"a{i:03}") for i in range(0, 600, 5)] + [("M", "a001"), ("m0", None), (None, "a002"), ("m0", "b"), ("m1", "b")]
    got = run(spark, tmp_path, "relation_pairs", documents=(hot + rest, "matter_code string, author string")).collect()
    by: dict[str, set] = {}
    for m, a in hot + rest:
        if m and a:
            by.setdefault(m, set()).add(a)
    want = Counter(p for members in by.values() for p in combinations(sorted(members), 2))
    assert {(r.x, r.y): r.matters for r in got} == {p: n for p, n in want.items() if n > 1}
    assert len(got) == len({(r.x, r.y) for r in got})


def test_grid_width_counts_quoted_rows(spark, tmp_path):
    tables = [("fits", ["a", "b"], ","), ("wide", ["a", "b"], ";"), ("plain", ["a"], "|"), ("empty", ["a"], ","), ("none", ["a"], ",")]
    lines = [("fits", '"x, y",2'), ("fits", '"say ""a,b""",'), ("wide", "1;2"), ("wide", '"1;2";3;4'), ("plain", "1|2"), ("empty", None), ("unknown", "1,2")]
    rows = [(i, t, x) for i, (t, x) in enumerate(lines)]
    got = run(spark, tmp_path, "structural_grid_width", raw_tables=(tables, "table_name string, header array<string>, delimiter string"), raw_rows=(rows, "row_key bigint, table_name string, raw_line string"))

    def width(line: str, delimiter: str) -> int:
        n, quoted = 1, False
        for c in line:
            quoted ^= c == '"'
            n += c == delimiter and not quoted
        return n

    want = {name: max(width(x or "", d) for t, x in lines if t == name) <= len(h) for name, h, d in tables if name != "none"}
    assert want == {"fits": True, "wide": False, "plain": False, "empty": True}
    assert {r.table_name: r.grid_width for r in got.collect()} == want


def test_split_rows_give_every_field(spark):
    from folioquarry.sources import delimited

    tables = spark.createDataFrame([("t", ",")], "table_name string, delimiter string")
    r = spark.createDataFrame([(1, "t", '"a, ""b""",c'), (2, "t", 'x"y,z'), (3, "t", None), (4, "t", "é,,ü")], "row_key bigint, table_name string, raw_line string")
    assert {x.row_key: x.fields for x in delimited.split_rows(r, tables).collect()} == {1: ['a, "b"', "c"], 2: ['x"y,z'], 3: [""], 4: ["é", "", "ü"]}


def test_fts_postings_hold_every_term(spark, tmp_path):
    texts = [(1, "The invoice, the Invoice"), (2, "Straße ÉTÉ x_1 the"), (3, None), (4, "..."), (5, "clause 12.50 the")]
    got = run(spark, tmp_path, "fts_postings", chunks=(texts, "chunk_id bigint, text string")).collect()
    words = {1: ["the", "invoice", "the", "invoice"], 2: ["straße", "été", "x_1", "the"], 5: ["clause", "12", "50", "the"]}
    assert {(r.term, r.chunk_id): (r.length, r.tf) for r in got} == {(t, k): (len(w), n) for k, w in words.items() for t, n in Counter(w).items()}
    assert len(got) == sum(len(set(w)) for w in words.values())


def test_parsers_meet_every_document(spark, tmp_path):
    docs = [(i, p, f"Über {p} <{i}>", f"first & <b> of {p}\n\nlast  line é") for i, p in enumerate(("docx", "html", "text", "eml", "docling", "csv", None))]
    docs += [(7, "xlsx", None, "only text"), (8, "eml", "no text", None), (9, "docling", "long", "word " * 20_000)]
    table = (docs, "doc_id bigint, parser string, title string, text string")
    tidy = lambda x: " ".join(x.split())
    md = [tuple(r) for r in run(spark, tmp_path, "markdown_elements", documents=table).collect()]
    want = [(k, i, "text" if i else "heading", tidy(x), None if i else 1) for k, _, t, s in docs if s for i, x in enumerate([t or "untitled", *s.split("\n\n")])]
    assert sorted((k, i, kind, tidy(x), level) for k, i, kind, x, level in md) == sorted(want)
    html = {r.doc_id: r.visible for r in run(spark, tmp_path, "html_visible_text").collect()}
    assert html == {k: "\n".join(y for y in map(tidy, [t or "", *s.split("\n")]) if y) for k, _, t, s in docs if s}
    mail = {r.doc_id: (r.subject, r.body) for r in run(spark, tmp_path, "eml_bytes_parse").collect()}
    assert mail == {k: (t or "none", s or "") for k, _, t, s in docs}


def test_schema_proposals_hold_all_tables(spark, tmp_path):
    heads = {"t_a": ["Amount", "Date", "Date", "x"], "t_k": ["amounts", "mount", "Dates", "", None], "t_z": ["Xmount", "date", "account no", ""], "u": ["account-no", "updated"]}
    rows = run(spark, tmp_path, "schema_proposals", raw_tables=(list(heads.items()), "table_name string, header array<string>")).collect()

    def edits(p: str, q: str) -> int:
        row = list(range(len(q) + 1))
        for i, c in enumerate(p, 1):
            last, row = row, [i]
            for j, e in enumerate(q, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    want = {}
    for s, t in combinations(sorted(heads), 2):
        for p in filter(lambda n: n is not None, heads[s]):
            near = sorted((round(edits(p.lower(), q.lower()) / max(len(p), len(q), 1), 6), q) for q in heads[t] if q is not None)
            if near and near[0][0] <= 0.34:
                want[s, p, t] = near[0][::-1]
    assert {(r.table_a, r.a, r.table_b): (r.b, r.distance) for r in rows} == want and len(rows) == len(want)
    assert want["t_a", "Amount", "t_z"] == ("Xmount", round(1 / 6, 6))  # another first letter
