import zipfile
import io

import pytest
from pyspark.sql import functions as F

from folioquarry.operators import certify, dedup, evalstats, evidence, forms, graph, labels, layout, lifecycle, search, sqlgate, tables, temporal, validate
from folioquarry.sources import grids, textlike


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_windows_cover_texts(spark):
    d = spark.createDataFrame([(1, "x" * 1500), (2, "y" * 1501), (3, ""), (4, None), (5, "é" * 4000)], "doc_id int, text string")
    w = layout.window_rows(d, "doc_id").collect()
    by = {}
    for r in w:
        by.setdefault(r.doc_id, []).append((r.char_start, r.char_end))
    assert by == {1: [(0, 1500)], 2: [(0, 1500), (1300, 1501)], 5: [(0, 1500), (1300, 2800), (2600, 4000)]}


def test_heading_paths(spark):
    e = spark.createDataFrame([(1, 1, None, "intro"), (1, 2, 1, "A"), (1, 3, 2, "B"), (1, 4, None, "x"), (1, 5, 2, "C"), (1, 6, 1, "D"), (1, 7, 3, "E")], "doc_id int, seq int, level int, text string")
    got = [r.heading_path for r in layout.heading_paths(e).orderBy("seq").collect()]
    assert got == [None, "A", "A > B", "A > B", "A > C", "D", "D > E"]
    assert layout.heading_paths(e.limit(0)).count() == 0


def test_markdown_and_html(spark):
    md = "# T #\ntext\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```\ncode # x\n```\n## U"
    got = spark.createDataFrame([(md,), (None,)], "t string").select(textlike.markdown_elements("t").alias("e")).collect()
    assert [(x.kind, x.text, x.level) for x in got[0].e] == [("heading", "T", 1), ("text", "text more", None), ("table", "| a | b |\n| 1 | 2 |", None), ("code", "code # x", None), ("heading", "U", 2)]
    assert got[1].e is None
    assert textlike.visible("<head><title>t</title></head><p>a &amp; b<br>c</p><script>x</script><div> d  e</div>") == "a & b\nc\nd e"


def test_archives_and_files(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr(".hidden", "no")
    f = spark.createDataFrame([("x.zip", bytearray(buf.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in grids.expand(f).collect()}
    assert got["x.zip::a.txt"] == ("hello", None) and got["bad.zip"][1].startswith("BadZipFile") and len(got) == 3
    (tmp_path / "m.eml").write_bytes(b"Subject: S\nFrom: a@b.c\nTo: d@e.f\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n\nbody\n")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "t.txt").write_bytes("é\r\nb".encode())
    p = {r.path.rsplit("/", 1)[1]: r for r in grids.expand(textlike.read_files(spark, str(tmp_path))).collect()}
    assert p["t.txt"].text == "é\nb" and p["p.pdf"].error == "parser pdf must be injected" and p["m.eml"].text.startswith("S\nFrom: a@b.c")


def test_section_checks():
    f = validate.section_checks
    assert f([("data", "a", 1.0), ("data", "b", 2.0), ("total", "Total", 3.0)]) == [(2, "total", 3.0, 3.0, True)]
    nested = [("section", "S", None), ("data", "a", 10.0), ("data", "b", 20.0), ("subtotal", "Subtotal", 30.0), ("section", "T", None), ("data", "c", 5.0), ("data", "d", 7.0), ("subtotal", "Subtotal", 50.0), ("total", "Grand total", 80.0)]
    assert [(k, ok) for k, _, _, _, ok in f(nested)] == [(3, True), (7, False), (8, True)]
    assert f([("data", "a", 1.0), ("total", "Total", 1.0)]) == []
    assert f([]) == []


def test_cells_and_types(spark):
    d = spark.createDataFrame([(1, "A", 2.5), (2, None, None)], "id bigint, name string, v double")
    c = tables.to_cells(d, "t", "id")
    assert rows(c, "row_idx", "col_name", "text_value") == [(1, "id", "1"), (1, "name", "a"), (1, "v", "2.5"), (2, "id", "2")]
    raw = spark.createDataFrame([("t", "a", "1,5"), ("t", "a", "1.234,5"), ("t", "b", None), ("t", "b", "-"), ("t", "c", "x")], "table_name string, col string, raw string")
    got = {r.col: (r.sql_type, r.style) for r in tables.column_types(raw, "table_name", "col").collect()}
    assert got == {"a": ("REAL", "eu"), "b": ("TEXT", "us"), "c": ("TEXT", "us")}
    hit = search.cell_hits(c, ["A"], [2.5])
    assert rows(hit, "row_idx") == [(1,)] and search.cell_hits(c, [], []).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1), (5, 4)], "src bigint, dst bigint")
    assert rows(graph.components(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src bigint, dst bigint")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert graph.components(e.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(6)]
    prints = [(i, base[i % 6] ^ sum(1 << rng.randrange(62) for _ in range(i % 4))) for i in range(40)]
    df = spark.createDataFrame(prints, "doc_id bigint, simhash bigint")
    want = {a: sum(1 for b, y in prints if b != a and (x ^ y).bit_count() <= 3) for a, x in prints}
    assert {r.doc_id: r.links for r in dedup.near_links(df).collect()} == want
    leaders, follow = [], {}
    for a, x in prints:
        near = [b for b, y in leaders if (x ^ y).bit_count() <= 3]
        if near:
            follow[a] = near[0]
        else:
            leaders.append((a, x))
    assert {r.doc_id: r.leader for r in dedup.greedy_leaders(df).collect()} == follow


def test_verify_quotes(spark):
    d = spark.createDataFrame([(1, "The “Fee” was  ﬁve."), (2, None), (3, ""), (4, "aaaaaaaaaaaa")], "doc_id int, text string")
    q = spark.createDataFrame([(1, 'the "fee" was five'), (2, ""), (3, None), (4, "aa"), (5, "zz")], "quote_id int, quote string")
    assert rows(evidence.verify_quotes(q, d), "quote_id", "doc_id", "matches", "truncated") == [(1, 1, 1, False), (4, 4, 8, True)]
    assert evidence.verify_quotes(q.limit(0), d).count() == 0


def test_certified(spark):
    r = spark.createDataFrame([("t", 1, 1.5), ("t", 1, 1.5), ("t", 2, None), ("u", 1, 2.0)], "table_name string, row_idx int, v double")
    c = certify.certified(r, "sum", "v").first()
    assert float(c.result) == 3.5 and c.n_rows == 2 and c.n_tables == 2
    assert certify.certified(r, "count", "v").first().n_rows == 3
    assert certify.replay(certify.certified(r, "sum", "v"), r, "sum", "v").count() == 0
    with pytest.raises(ValueError):
        certify.certified(r, "median", "v")
    assert certify.exact("divide", ["1", "3"]).startswith("0.33333333333333333333333333333333333333333333333333") and certify.exact("divide", ["1", "0"]) is None
    assert certify.render("Total: {a} of {b}.", {"a": "5", "b": "6"}) == "Total: 5 of 6."
    for bad in ("Total 5", "{a}x"):
        with pytest.raises(ValueError):
            certify.render(bad, {"a": "5"})


def test_labels(spark):
    v = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "b", 2), (2, "b", 1), (2, "a", 0), (3, None, 0)], "item int, label string, vote_idx int")
    assert rows(labels.majority(v, "item"), "item", "winner") == [(1, "b"), (2, "a")]
    got = {r.item: r.winner for r in labels.majority(v, "item", expected=3).collect()}
    assert got == {1: "b", 2: None}
    with pytest.raises(Exception, match="outside the vocabulary"):
        labels.closed_counts(v, ["a"]).collect()
    d = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "k int, t string")
    replies = lambda ts: ["bad"] * len(ts)
    assert {r.k: (r.label, r.attempts) for r in labels.annotate(d, "k", "t", replies, ["a"]).collect()} == {1: (None, 2), 2: (None, 0), 3: (None, 2)}


def test_statistics(spark):
    p = spark.createDataFrame([(i, i % 3 != 0, i % 4 != 0) for i in range(48)], "k int, a boolean, b boolean")
    m = evalstats.mcnemar(p, "a", "b").first()
    from math import comb

    n, k = m.a_only + m.b_only, min(m.a_only, m.b_only)
    assert abs(m.p_value - min(1, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)) < 1e-9
    b = evalstats.bootstrap_diff(p, "k", "a", "b").first()
    assert b.low <= m["diff"] <= b.high
    assert evalstats.kappa(p.limit(0), "a", "b").first().kappa is None


def test_knn_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None)], "vec_id bigint, embedding array<float>")
    q = df.where("vec_id in (0, 1, 2)").select(F.col("vec_id").alias("query_id"), "embedding")
    u = v.astype(np.float32).astype(float)
    u = np.divide(u, np.linalg.norm(u, axis=1, keepdims=True), out=u.copy(), where=np.linalg.norm(u, axis=1, keepdims=True) > 0)
    for r in search.knn(df, q, 5).collect():
        order = sorted(range(60), key=lambda j: (-round(float(u[r.query_id] @ u[j]), 6), j))
        assert order[r["rank"] - 1] == r.vec_id
    assert search.knn(df, q, 5, pool=20).count() == 15
    with pytest.raises(ValueError):
        search.knn(df, q, 1001)


def test_ladder(spark):
    empty = spark.createDataFrame([], "a int")
    some = spark.createDataFrame([(1,)], "a int")
    calls = []

    def rung(n, df):
        return lambda q, k: (calls.append(n), df)[1]

    ladder = search.Ladder({0: rung(0, empty), 1: rung(1, some), 2: rung(2, some)}, lambda: 10)
    assert ladder.search("x")[0] == 1 and calls == [0, 1]
    assert ladder.search("x", 0) == (-1, [])
    none = search.Ladder({0: rung(0, empty), 4: rung(4, empty)}, lambda: 2000)
    assert none.search("x") == (4, [{"kind": "estimate", "batches": 32}])
    assert search.Ladder({0: rung(0, empty)}, lambda: 41).search("x") == (5, [{"kind": "estimate", "batches": 3}])


def test_lifecycle(spark, tmp_path):
    e = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (5, 4), (6, None)], "id int, parent int")
    r = spark.createDataFrame([(1,), (4,), (9,)], "id int")
    assert rows(lifecycle.descendants(e, r), "root", "id") == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (9, 9)]
    corpus = lifecycle.Corpus(spark, str(tmp_path / "c"))
    assert corpus.current() is None
    corpus.publish({"documents": spark.range(3).withColumnRenamed("id", "doc_id")})
    corpus.migrate({"documents": lambda d: d.where("doc_id > 0")}, ["documents"])
    assert corpus.versions() == [1, 2] and corpus.table("documents").count() == 2 and corpus.table("documents", 1).count() == 3


def test_streaming_append(spark, tmp_path):
    from folioquarry.streaming.ingest import append_stream, tumbling

    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    schema = "doc_id bigint, sha256 string, content_sha256 string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None)], schema).coalesce(1).write.parquet(src)
    append_stream(spark, src, spark.read.parquet(src).schema, dst, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(4, "a", "q"), (5, "d", "z")], schema).coalesce(1).write.mode("append").parquet(src)
    append_stream(spark, src, spark.read.parquet(src).schema, dst, str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(dst), "doc_id") == [(1,), (3,), (5,)]
    assert tumbling(spark.createDataFrame([], "ts timestamp, event_type string, value double")).count() == 0


def test_forms_and_temporal(spark):
    f = spark.createDataFrame([("a", "For the buyer — Ann Lee. Tick one\n\nMUTUALLY EXCLUSIVE GROUP \"g\" (which?) FIELD TYPE: Checkbox"), ("b", None)], "field_id string, notes string")
    got = {r.field_id: r for r in forms.parse_fields(f).collect()}
    assert got["a"].subject == "Ann Lee" and got["a"].group == "g" and got["a"].field_type == "checkbox" and got["b"].group is None
    facts = spark.createDataFrame([("k", 5), ("k", 1), ("z", 1)], "k string, t int")
    rates = spark.createDataFrame([("k", 2, 10), ("k", 5, 20)], "k string, s int, v int")
    assert rows(temporal.effective(facts, rates, "k", "t", "s", "v", width=2).fillna(-1), "k", "t", "in_force") == [("k", 1, -1), ("k", 5, 20), ("z", 1, -1)]
    ev = spark.sql("select cast(id % 2 as string) k, timestamp'2024-01-01' + make_dt_interval(0, 0, cast(pmod(id * id * 7, 4000) as int), 0) at from range(60)")
    want = sorted(tuple(r) for r in temporal.sessions(ev, "k", "at", 1800).collect())
    assert want == sorted(tuple(r) for r in temporal.sessions(ev, "k", "at", 1800, width=3_600_000_000).collect())
    n = spark.createDataFrame([(None, 5), ("a", 70000), ("a", 3), ("a", 9)], "b string, o bigint")
    assert rows(temporal.numbered(n, "b", "o").fillna("-"), "b", "o", "n") == [("-", 5, 1), ("a", 3, 1), ("a", 9, 2), ("a", 70000, 3)]
    assert rows(temporal.effective(facts, rates, "k", "t", "s", "v").fillna(-1), "k", "t", "in_force") == [("k", 1, -1), ("k", 5, 20), ("z", 1, -1)]


def test_sql_gate(spark):
    d = spark.createDataFrame([(1, "select x")], "a int, b string")
    assert sqlgate.where(d, "b = 'select x' and abs(a) = 1").count() == 1
    for bad in ("a in (select 1)", "a = 1; drop table x", "java_method('x', 'y') = 1", "", "a = 1 -- c"):
        with pytest.raises(ValueError):
            sqlgate.where(d, bad)
    assert sqlgate.select(spark, {"d": d}, "with q as (select a from d) select a from q", 1).count() == 1
    for bad in ("select * from other", "select * from parquet.`/x`", "delete from d", "select a from d"):
        with pytest.raises(ValueError):
            sqlgate.select(spark, {"d": d}, bad, 2)


def test_row_kinds(spark):
    cases = [("Total", 1, "total"), ("Subtotal", 1, "subtotal"), ("Net income", 1, "data"), ("The total is due", 1, "data"), ("(1) note", 0, "footnote"), ("Fees", 0, "section"), (None, 0, "data"), ("Order total:", 2, "total")]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b int")
    got = [r.k for r in d.orderBy("i").select(tables.row_kind(F.col("a"), F.col("b")).alias("k")).collect()]
    assert got == [c for _, _, c in cases]


def test_pipeline(spark, tmp_path):
    from folioquarry.operators import pipeline

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("alpha " * 400)
    (src / "b.md").write_text("# B\ntext")
    (src / "copy.txt").write_text("alpha " * 400)
    (src / "x.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(src / "z.zip", "w") as z:
        z.writestr("in/c.txt", "inside")
    c = str(tmp_path / "corpus")
    assert pipeline.ingest(spark, str(src), c) == 1
    corpus = lifecycle.Corpus(spark, c)
    assert corpus.table("documents").count() == 4 and corpus.table("chunks").count() == 4  # the archive is a document too: its member's parent
    status = {r.source_path.rsplit("/", 1)[1]: r.status for r in corpus.table("ingest_outcomes").collect()}
    assert status["x.pdf"] == "parse_failed" and status["c.txt"] == "parsed"
    (src / "d.txt").write_text("delta")
    assert pipeline.ingest(spark, str(src), c, injected={"pdf": lambda b: "from pdf"}) == 2
    assert {r.text for r in corpus.table("documents").collect()} >= {"delta", "from pdf"} and corpus.table("documents").count() == 6
    assert {r.status for r in lifecycle.latest_outcomes(corpus.table("ingest_outcomes")).collect()} == {"parsed"}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError):
        pipeline.ingest(spark, str(bad), str(tmp_path / "none"))
    n, first = pipeline.compact(corpus.table("documents"), 2)
    assert n == 6 and len(first) == 2


def test_image_rows(spark):
    f = spark.createDataFrame([("a/b.PNG",), ("c.txt",)], "path string")
    assert rows(textlike.image_rows(f), "path", "needs_transcription") == [("a/b.PNG", True)]


def test_ranks_equal_sorting(spark):
    import random

    rng = random.Random(1)
    data = [("a", rng.choice([1.0, 2.0, rng.random() * 100])) for _ in range(200)] + [("b", 5.0)] * 7 + [("c", 1.0), (None, 3.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    import math

    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.value for r in evalstats.nearest_rank(df, "v", q, "k").collect()}
        assert got == {k: sorted(v)[max(math.ceil(len(v) * q), 1) - 1] for k, v in groups.items()}
        cont = {r.k: r.value for r in evalstats.quantile(df, "v", q, "k").collect()}
        for k, v in groups.items():
            xs, at = sorted(v), (len(v) - 1) * q
            lo, hi = math.floor(at), math.ceil(at)
            assert abs(cont[k] - (xs[lo] + (xs[hi] - xs[lo]) * (at - lo))) < 1e-9
    assert evalstats.quantile(df, "v", 0.5).first().value is not None and evalstats.quantile(df.limit(0), "v", 0.5).count() == 0


def test_monotonic(spark):
    d = spark.createDataFrame([("u", 1, 1), ("u", 70000, 2), ("u", 2, 1), ("d", 1, 9), ("d", 70000, 3), ("x", 1, 1), ("x", 2, 3), ("x", 70000, 2), ("n", 1, None)], "k string, o int, v int")
    assert rows(validate.monotonic(d, "k", "o", "v"), "k", "monotonic") == [("d", True), ("u", True), ("x", False)]


def test_bm25_paths_agree(spark):
    import math

    texts = ["red fence red", "blue fence", "red", None, "", "green " * 300 + "fence"]
    c = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id int, text string")
    q = spark.createDataFrame([(1, ["Red", "fence", "red"]), (2, ["absent"]), (3, [])], "query_id int, terms array<string>")
    a = search.bm25(c, q, k=3)
    b = search.bm25(c, q, k=3, few_terms=0)
    assert rows(a, "query_id", "chunk_id", "score", "rank") == rows(b, "query_id", "chunk_id", "score", "rank")
    docs = {i: t.split() for i, t in enumerate(texts) if t is not None}
    avg = sum(map(len, docs.values())) / len(docs)
    score = {}
    for term in ("red", "fence"):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            tf = d.count(term)
            if tf:
                score[i] = score.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    best = sorted(score, key=lambda i: (-round(score[i], 6), i))[:3]
    assert [r.chunk_id for r in a.orderBy("rank").collect()] == best
    assert search.bm25(c.limit(0), q).count() == 0


def test_headline_and_text_numbers(spark):
    cases = [("Revenue was $1,234.5 in 2022.", "1234.5"), ("In 2022 there were 3 segments.", "3"), ("0: no such item.", None), ("None", None), ("It rose 5% from 10.", "5"), (None, None), ("FY2016 only", None), ("June 30, then 4.5", "4.5")]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.x for r in d.orderBy("i").select(certify.headline_number(F.col("t")).alias("x")).collect()]
    assert got == [w for _, w in cases]
    t = spark.createDataFrame([("total 1,234 due",), ("total 11,234 due",), ("total 1,234.5 due",), ("x1,234",)], "t string")
    assert [r.x for r in t.select(certify.text_number(F.col("t"), "1,234").alias("x")).collect()] == [True, False, False, False]


def test_final_verdict_and_scores(spark, tmp_path):
    d = spark.createDataFrame([("5", []), ("no", None), ("5", ["q"]), ("5", ["a", "b", "c", "d"]), ("5", ["x" * 5000]), ("5", [None, " "])], "a string, q array<string>")
    assert [r.v for r in d.select(evidence.final_verdict(F.col("a"), F.col("q")).alias("v")).collect()] == ["needs_quotes", "exempt", "ok", "too_many_quotes", "quote_too_long", "needs_quotes"]
    labels_ = spark.createDataFrame([("a", 0, ["X y"], 3, True), ("b", 0, None, None, True), ("c", 0, ["z"], 1, False)], "doc string, table_idx int, headers array<string>, n_data_rows int, must_pass boolean")
    m = spark.createDataFrame([("a", 0, ["x_y", "w"], 3), ("b", 0, ["q"], 9)], "doc string, table_idx int, headers array<string>, n_data_rows int")
    s = evalstats.extraction_score(labels_, m)
    assert rows(s, "doc", "passed") == [("a", True), ("b", True), ("c", False)] and evalstats.pass_rate(s).first().rate == 1.0
    lifecycle.export(labels_, str(tmp_path / "x"), "csv")
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "x")).count() == 3
