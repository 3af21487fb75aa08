"""Grids from files, containers, typed tables and the corpus they are published in."""

import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from folioquarry.operators import build, lifecycle, pipeline
from folioquarry.sources import grids


def archive(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in members.items():
            z.writestr(n, b)
    return out.getvalue()


def sheet_book() -> bytes:
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Amount</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>12.5</v></c></row><row r="3"/>'
    return archive({
        "xl/workbook.xml": '<workbook xmlns:r="x"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><r><t>B</t></r><r><t>ob</t></r></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    })


def test_grids_of_files():
    assert grids.csv_grid("a;b\n\"x;y\";1,5\n\n;\n") == [(None, [["a", "b"], ["x;y", "1,5"]])] and grids.csv_grid("") == []
    assert grids.markdown_grids("# T\n| a | b |\n|---|---|\n| 1 |") == [("T", [["a", "b"], ["1", None]])]
    html = "<table><caption>C</caption><tr><th colspan=2>h<td>k</tr><tr><td>1<table><tr><td>in</td></tr></table></td><td>2</td></tr></table>"
    assert grids.html_grids(html)[0] == (None, [["in"]]) and ("C" in [c for c, _ in grids.html_grids(html)])
    text, got = grids.workbook(sheet_book())
    assert got == [("One", [["Name", None, "Amount"], ["Bob", None, "12.5"]])] and "Bob" in text
    word = archive({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Fees</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert grids.document(word) == ("Fees\na\t", [("Fees", [["a", ""]])])


def test_containers_to_any_depth(spark):
    mail = EmailMessage()
    mail["Subject"], mail["From"] = "S", "a@b.example"
    mail.set_content("body")
    mail.add_attachment(b"x,y\n1,2\n", maintype="text", subtype="csv", filename="t.csv")
    inner = archive({"deep.txt": "deep", "m.eml": mail.as_bytes(), "bad.zip": b"no", ".hidden": b"", "a.bin": b"?"})
    outer = archive({"in.zip": inner, "top.txt": "top"})
    d = spark.createDataFrame([("o.zip", outer), ("n.zip", None), ("e.zip", b"")], "path string, content binary")
    got = {r.path: r for r in grids.expand(d).collect()}
    assert {p for p, r in got.items() if r.error is None} == {"o.zip", "o.zip::in.zip", "o.zip::top.txt", "o.zip::in.zip::deep.txt", "o.zip::in.zip::m.eml", "o.zip::in.zip::m.eml::t.csv"}
    assert {p for p, r in got.items() if r.error} == {"e.zip", "o.zip::in.zip::bad.zip", "o.zip::in.zip::a.bin"}
    assert got["o.zip::in.zip::m.eml::t.csv"].parent == "o.zip::in.zip::m.eml" and got["o.zip::in.zip::m.eml::t.csv"].grids[0].rows == [["x", "y"], ["1", "2"]]
    limited = {r.path: r.error for r in grids.expand(d.limit(1), max_depth=1, max_members=1).collect()}
    assert limited["o.zip::top.txt"] == "too many members" and limited["o.zip::in.zip::deep.txt"] == "too deep"


def test_built_tables(spark):
    g = {"t1": [["Item", "Amount (EUR)", "Amount (EUR)", "Note"], ["A", "1.234,50", "1", None], ["B", "(2,5)", "2", "-"], ["Total", "1.232,00", "3", ""], ["* note", None, None, None]], "t2": [["x", "y"], ["u", "v"]]}
    rows = [(7, t, "c", i, j, v, False) for t, grid in g.items() for i, r in enumerate(grid) for j, v in enumerate(r)]
    grid = spark.createDataFrame(rows, "doc_id bigint, table_name string, caption string, row_idx int, col_idx int, raw string, flagged boolean")
    columns, cells = build.built(grid)
    got = {(r.table_name, r.col_idx): r for r in columns.collect()}
    assert [got["t1", j].name for j in range(4)] == ["item", "amount_eur", "amount_eur_2", "note"] and [got["t1", j].sql_type for j in range(4)] == ["TEXT", "REAL", "INTEGER", "TEXT"]
    assert got["t2", 0].name == "col_1" and got["t1", 1].style == "eu" and got["t1", 1].additive and not got["t1", 0].additive
    c = {(r.table_name, r.row_idx, r.col_name): r for r in cells.collect()}
    assert c["t1", 1, "amount_eur"].num_value == 1234.5 and c["t1", 2, "amount_eur"].num_value == -2.5 and c["t1", 3, "amount_eur"].row_kind == "total"
    assert c["t1", 4, "item"].row_kind == "footnote" and ("t1", 2, "note") not in c and c["t2", 0, "col_1"].raw == "x"
    assert {r.table_name: (r.grid_rows, len(r.columns)) for r in build.manifest(grid, columns).collect()} == {"t1": (5, 4), "t2": (2, 2)}
    assert build.built(grid.limit(0))[1].count() == 0


def test_ingest_of_tables_and_families(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.csv").write_text("Name,Amount\nx,1\ny,2\n")
    (src / "n.md").write_text("intro\n# A\nunder a\n## B\nunder b\n# C\n")
    (src / "o.zip").write_bytes(archive({"in.zip": archive({"deep.csv": "k;v\na;1\n"}), "e.txt": "same"}))
    (src / "p.zip").write_bytes(archive({"f.txt": "same"}))
    corpus = lifecycle.Corpus(spark, str(tmp_path / "c"))
    pipeline.ingest(spark, str(src), corpus.path)
    docs = {r.source_path.rsplit("/", 1)[1]: r for r in corpus.table("documents").collect()}
    assert docs["o.zip::in.zip::deep.csv"].parent_doc_id == docs["o.zip::in.zip"].doc_id and docs["o.zip::in.zip"].parent_doc_id == docs["o.zip"].doc_id and "p.zip" in docs
    edges = corpus.table("documents").select(F.col("doc_id").alias("id"), F.col("parent_doc_id").alias("parent"))
    assert lifecycle.descendants(edges, edges.where(F.col("id") == docs["o.zip"].doc_id).select("id")).count() in (3, 4)
    assert {(r.col_name, r.num_value) for r in corpus.table("cells").where("num_value is not null").collect()} == {("amount", 1.0), ("amount", 2.0), ("v", 1.0)}
    assert corpus.table("tables").count() == 2
    sections = [(r.heading_path, r.char_start, r.char_end) for r in corpus.table("sections").where(F.col("doc_id") == docs["n.md"].doc_id).orderBy("char_start").collect()]
    assert sections == [(None, 0, 6), ("A", 6, 18), ("A > B", 18, 31), ("C", 31, 35)]
    # An append writes the new rows only, and a reader of an older version still sees it.
    (src / "new.txt").write_text("new words")
    v = pipeline.ingest(spark, str(src), corpus.path)
    n = corpus.table("documents").count()
    assert v == 2 and len(corpus.parts()["documents"]) == 2 and spark.read.parquet(f"{corpus.path}/v=2/documents").count() == 1
    assert corpus.table("documents", 1).count() == n - 1
    assert corpus.compact() == 3 and len(corpus.parts()["documents"]) == 1 and corpus.table("documents").count() == n


def test_versions_are_whole_or_absent(spark, tmp_path):
    corpus = lifecycle.Corpus(spark, str(tmp_path / "c"))
    ids = spark.range(3).withColumnRenamed("id", "doc_id")
    corpus.publish({"documents": ids, "chunks": ids})
    with pytest.raises(Exception):
        corpus.publish({"documents": ids, "chunks": ids.select(F.raise_error(F.lit("no")).alias("x"))})
    assert corpus.current() == 1 and corpus.versions() == [1, 2]  # the folder of the failed write is named by no list
    corpus.publish({"chunks": ids.limit(1)}, keep=True)
    assert corpus.current() == 3 and corpus.table("documents").count() == 3 and corpus.table("chunks").count() == 1
    with pytest.raises(FileNotFoundError):
        corpus.table("documents", 2)
    with pytest.raises(KeyError):
        corpus.table("nothing")
