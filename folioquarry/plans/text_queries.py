"""Queries over retained text: sources, parsers, chunks, pages, sections, scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import text as T
from folioquarry.operators import layout
from folioquarry.plans.registry import Registry
from folioquarry.plans.runtime import spread, table
from folioquarry.sources import textlike

R = Registry()
query = R.query


@query("""select parser, count(*) as documents, count(text) as with_text, coalesce(sum(length(text)), 0) as chars, count(distinct source) as sources,
  sum(case when length(trim(coalesce(text, ''))) < 50 then 1 else 0 end) as scans from documents group by parser""")
def scan_documents_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("parser").agg(
        F.count(F.lit(1)).alias("documents"), F.count("text").alias("with_text"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
        F.count_distinct("source").alias("sources"), F.sum(textlike.needs_scan(F.col("text")).cast("int")).alias("scans"),
    )


@query("""select case when s in ('txt','log','text') then 'text' when s in ('md','markdown') then 'markdown' when s in ('html','htm','xhtml') then 'html' when s = 'eml' then 'eml' when s = 'msg' then 'msg' when s = 'zip' then 'zip'
  when s in ('csv','tsv') then 'csv' when s in ('docx','doc','pptx','ppt','xlsx','xls','odt','ods','odp','rtf','epub') then 'office' when s = 'pdf' then 'pdf' when s in ('png','jpg','jpeg','tif','tiff','bmp','gif','webp') then 'image' when s in ('json','jsonl') then 'json' end as parser_name,
  count(*) as files from (select lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1)) as s from ingest_outcomes) group by 1""")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "ingest_outcomes")
    return d.groupBy(textlike.parser_for(F.col("source_path")).alias("parser_name")).agg(F.count(F.lit(1)).alias("files"))


@query(r"""select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as seq, text from (
  select doc_id, i, regexp_replace(p[i], '^\s+|\s+$', '', 'g') as text from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, regexp_split_to_array(text, '\n\s*\n') as p from documents))) where text <> ''""")
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textlike.paragraph_rows(table(spark, sf_dir, "documents"))


@query("select doc_id, cast(i as integer) as line_no, l[i] as text from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, E'\\n') as l from documents)) where trim(l[i]) <> ''")
def text_lines_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textlike.line_rows(table(spark, sf_dir, "documents"))


@query("""select doc_id, cast(i as integer) as chunk_no, cast(i * 1300 as integer) as char_start, cast(least(i * 1300 + 1500, length(text)) as integer) as char_end, md5(substring(text, i * 1300 + 1, 1500)) as digest
  from (select doc_id, text, unnest(range(0, case when length(text) <= 1500 then 1 else cast(1 + ceil((length(text) - 1500) / 1300.0) as bigint) end)) as i from documents where length(text) > 0)""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = layout.window_rows(table(spark, sf_dir, "documents"), "doc_id")
    return w.select("doc_id", "chunk_no", "char_start", "char_end", F.md5("text").alias("digest"))


@query("""with p as (select distinct doc_id, page, char_start as s, char_end as e from doc_text),
  w as (select chunk_id, doc_id, heading_path, i, c.char_start + i * 1300 as a, c.char_start + least(i * 1300 + 1500, length(text)) as b
    from (select *, unnest(range(0, case when length(text) <= 1500 then 1 else cast(1 + ceil((length(text) - 1500) / 1300.0) as bigint) end)) as i from chunks where trim(text) <> '') c)
  select chunk_id, w.doc_id, heading_path, cast(i as integer) as chunk_no, cast(a as integer) as char_start, cast(b as integer) as char_end, page from w left join p on p.doc_id = w.doc_id and a >= s and a < e""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.split_sections(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "doc_text")).drop("text")


@query("""with o as (select doc_id, page, any_value(length(text)) as n, any_value(char_start) as s, any_value(char_end) as e from doc_text group by 1, 2)
  select doc_id, page, cast(sum(n) over w - n as integer) as char_start, cast(sum(n) over w as integer) as char_end, (sum(n) over w - n = s and sum(n) over w = e) as agrees from o window w as (partition by doc_id order by page)""")
def chunk_page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "doc_text").groupBy("doc_id", "page").agg(F.first("char_start").alias("s"), F.first("char_end").alias("e"))
    got = layout.page_offsets(table(spark, sf_dir, "doc_text")).drop("text")
    return got.join(given, ["doc_id", "page"]).select("doc_id", "page", "char_start", "char_end", ((F.col("char_start") == F.col("s")) & (F.col("char_end") == F.col("e"))).alias("agrees"))


@query("select doc_id, length(text) as chars, true as whole from documents where length(text) > 0")
def pages_rebuild_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages joined give each document's text: the retained text is complete."""
    whole = layout.assemble(table(spark, sf_dir, "doc_text")).withColumnRenamed("text", "_t")
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    return d.join(whole, "doc_id", "left").select("doc_id", F.length("text").cast("bigint").alias("chars"), F.col("text").eqNullSafe(F.col("_t")).alias("whole"))


_ELEMENTS = "select doc_id, chunk_id, row_number() over (partition by doc_id order by char_start, chunk_id) as seq, case when heading_path is not null then len(string_split(heading_path, ' > ')) end as level, string_split(heading_path, ' > ')[-1] as title from chunks"


@query(f"""with e as ({_ELEMENTS}), p as (select a.doc_id, a.seq, b.level, max(b.seq) as at from e a join e b on a.doc_id = b.doc_id and b.seq <= a.seq and b.level is not null group by 1, 2, 3),
  alive as (select p.*, coalesce((select max(q.at) from p q where q.doc_id = p.doc_id and q.seq = p.seq and q.level < p.level), -1) as above from p),
  path as (select alive.doc_id, alive.seq, string_agg(e.title, ' > ' order by alive.level) as heading_path from alive join e on e.doc_id = alive.doc_id and e.seq = alive.at where alive.at > above group by 1, 2)
  select e.doc_id, e.chunk_id, heading_path from e left join path using (doc_id, seq)""")
def heading_stack_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths folded from the headings of a document's sections, in order."""
    c = table(spark, sf_dir, "chunks")
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start", "chunk_id"))
    e = c.select("doc_id", "chunk_id", seq.alias("seq"), F.size(F.split("heading_path", " > ")).alias("level"), F.element_at(F.split("heading_path", " > "), -1).alias("text"))
    e = e.withColumn("level", F.when(F.col("text").isNotNull(), F.col("level")))
    return layout.heading_paths(e).select("doc_id", "chunk_id", "heading_path")


@query("""with o as (select *, row_number() over (partition by doc_id order by char_start, chunk_id) as rn from chunks), f as (select *, case when rn > 1 and lag(heading_path) over w is not distinct from heading_path then 0 else 1 end as fresh from o window w as (partition by doc_id order by rn)),
  i as (select *, sum(fresh) over (partition by doc_id order by rn) as island from f) select doc_id, cast(island as bigint) as island, heading_path, min(char_start) as char_start, max(char_end) as char_end, count(*) as sections from i group by 1, 2, 3""")
def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "chunks")
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start", "chunk_id")))
    runs = layout.islands(c, "doc_id", "rn", "heading_path")
    return runs.groupBy("doc_id", "island", "heading_path").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count(F.lit(1)).alias("sections"))


@query("""with p as (select distinct doc_id, page, char_start as s, char_end as e from doc_text) select chunk_id, c.doc_id, p.page as page from (select chunk_id, doc_id, char_start, char_end from chunks) c join p on p.doc_id = c.doc_id and s < char_end and e > char_start""")
def span_page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "char_start", "char_end")
    pages = table(spark, sf_dir, "doc_text").select("doc_id", "page", "char_start", "char_end").distinct()
    return layout.pages_of_spans(spans, pages).select("chunk_id", "doc_id", "page")


@query("""with h as (select doc_id, '<html><head><title>x</title><style>p {}</style></head><body><h1>' || coalesce(title, '') || '</h1><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), E'\\n', '</p><p>') || '</p><script>var a = 1;</script></body></html>' as html, title, text from documents where text is not null),
  l as (select doc_id, i, trim(regexp_replace(l[i], '[ \\t\\r\\f\\v]+', ' ', 'g')) as x from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(coalesce(title, '') || E'\\n' || text, E'\\n') as l from h)))
  select doc_id, string_agg(x, E'\\n' order by i) as visible from l where x <> '' group by doc_id""")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages made of each document's title and text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<html><head><title>x</title><style>p {}</style></head><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), body, F.lit("</p><script>var a = 1;</script></body></html>"))
    return d.select("doc_id", textlike.visible_text(html).alias("visible"))


@query("""select doc_id, string_split(text, E'\\n')[1] as subject, l[2][7:] as sender, l[3][5:] as recipient, case when l[4] like 'Cc: %' then l[4][5:] end as cc, case when l[4] like 'Cc: %' then l[5][7:] else l[4][7:] end as sent
  from (select doc_id, text, string_split(text, E'\\n') as l from documents where parser = 'eml' and text is not null) where l[2] like 'From: %' and l[3] like 'To: %' and (l[4] like 'Date: %' or l[5] like 'Date: %')""")
def email_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("parser = 'eml' and text is not null")
    h = d.select("doc_id", *[c.alias(n) for n, c in textlike.mail_headers(F.col("text")).items()])
    return h.where("sender is not null and recipient is not null and sent is not null")


@query("select doc_id, subject, replace(body, E'\\r', '') as body from (select doc_id, coalesce(title, 'none') as subject, regexp_replace(coalesce(text, ''), '^\\n+|\\n+$', '', 'g') as body from documents)")
def eml_bytes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 822 bytes built from all documents and parsed back: subject and body come out whole."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(
        F.lit("From: a@b.example\nTo: c@d.example\nSubject: "), F.coalesce("title", F.lit("none")),
        F.lit("\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(F.coalesce("text", F.lit("")), "utf-8")),
    )
    return d.select("doc_id", textlike.mail_parts(F.encode(raw, "utf-8")).alias("m")).select("doc_id", "m.subject", "m.body")


@query("""with b as (select doc_id, left(regexp_replace(regexp_replace(lower(coalesce(title, 'untitled')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) as base from documents), n as (select *, row_number() over (partition by base order by doc_id) as rn from b)
  select doc_id, base, base || case when rn = 1 then '' else '_' || rn end as doc_uid from n""")
def unique_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.slug(F.coalesce("title", F.lit("untitled"))).alias("base"))
    return textlike.unique_ids(d, "base", "doc_id")


@query("select source_path, doc_id, length(text) as size, len(string_split(text, E'\\n')) as lines from documents where text is not null")
def files_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("source_path", "doc_id", F.length("text").cast("bigint").alias("size"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


@query("select doc_id, cast(i as integer) as line_no, l[i] as text from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, E'\\n') as l from documents)) where i between 3 and 8")
def read_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 8 of every file, as ``read`` gives them."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).where("p between 2 and 7").select("doc_id", (F.col("p") + 1).alias("line_no"), "text")


@query("""with l as (select doc_id, i, l[i] as text from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, E'\\n') as l from documents))), h as (select doc_id, i from l where regexp_matches(text, '\\b[0-9]+ copies\\b'))
  select h.doc_id, cast(h.i as integer) as hit_line, cast(l.i as integer) as line_no, l.text, (h.i = l.i) as is_hit from h join l on l.doc_id = h.doc_id and l.i between h.i - 1 and h.i + 1""")
def grep_line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match, each with one line of context before and after."""
    from folioquarry.operators.search import grep_context

    return grep_context(table(spark, sf_dir, "documents"), r"\b[0-9]+ copies\b", 1)


@query("""select doc_id, cast(i as integer) as hit_line, cast(i as integer) as line_no, l[i] as text, true as is_hit from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, E'\\n') as l from documents)) where regexp_matches(l[i], '\\bclause [0-9]+\\.[0-9]+\\b') order by 1, 2 limit 200""")
def grep_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 matching lines by document and line: a search with a cap on its hits."""
    from folioquarry.operators.search import grep_context

    return grep_context(table(spark, sf_dir, "documents"), r"\bclause [0-9]+\.[0-9]+\b", 0, 200)


@query("""select item_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ' | ') as terms from (select item_id, list_concat(g[1:12], list_filter(g, lambda x: regexp_matches(x, '^[0-9]'))) as f from
  (select item_id, list_filter(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]{2,}|\\b[0-9]+(?:[,.][0-9]+)*\\b'), lambda x: lower(x) not in ('the','and','for','was','were','with','what','which','how','many','much','does','did')) as g from eval_items))""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", F.array_join(T.terms(F.col("question")), " | ").alias("terms"))


@query("select item_id, cast(i - 1 as integer) as pos, cast(replace(n[i], ',', '') as double) as number from (select item_id, n, unnest(range(1, len(n) + 1)) as i from (select item_id, regexp_extract_all(passage, '-?[0-9][0-9,]*(?:\\.[0-9]+)?') as n from eval_items))")
def query_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", F.posexplode(T.numbers(F.col("passage"))).alias("pos", "number"))


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) as tok from documents where text is not null), n as (select doc_id, tok, count(*) as n from t group by 1, 2),
  h as (select tok, md5(tok) as m from (select distinct tok from t)), b as (select tok, k, cast(('0x' || substring(m, 1 + 2 * cast(k / 8 as integer), 2)) as integer) as byte from (select tok, m, unnest(range(0, 64)) as k from h) where k // 8 = k / 8 or true),
  v as (select doc_id, b.k, sum(case when (b.byte >> (b.k % 8)) & 1 = 1 then n.n else -n.n end) as votes from n join (select tok, k, cast(('0x' || substring(m, 1 + 2 * (k // 8), 2)) as integer) as byte from (select tok, m, unnest(range(0, 64)) as k from h)) b using (tok) group by 1, 2),
  s as (select doc_id, sum(case when votes >= 0 then cast(1 as hugeint) << k else 0 end) as u from v group by 1)
  select d.doc_id, cast(case when u is null then 0 when u >= 9223372036854775808 then u - 18446744073709551616 else u end as bigint) as simhash from (select doc_id from documents where text is not null) d left join s using (doc_id)""")
def simhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", T.simhash64(T.dedup_tokens(F.col("text"))).alias("simhash"))


_KEY = "regexp_replace(regexp_replace(lower(replace(translate(coalesce({0}, ''), '☐☑☒✓✗', '     '), '_', ' ')), '\\s+', ' ', 'g'), '^[ .!`*\"''\\t\\n]+|[ .!`*\"''\\t\\n]+$', '', 'g')"


@query(f"""with k as (select result_id, {_KEY.format('answer')} as key from field_results) select result_id, key as label_key, case when key = 'yes' then 'affirmative' when key = 'no' then 'negative' when key in ('n/a','na','not applicable') then 'not_applicable'
  when key in ('','none','nil','unknown','blank','leave blank','not reached','not specified','needs review') or key = 'not found' or key like 'not found %' or key like 'not found:%' then 'absent' else 'value' end as answer_kind from k""")
def answer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "field_results").select("result_id", T.label_key(F.col("answer")).alias("label_key"), T.answer_kind(F.col("answer")).alias("answer_kind"))


@query("select doc_id, case when title is not null then '[redacted ' || length(title) || ' ' || substring(sha256(title), 1, 12) || ']' end as title_redacted, sha256(concat_ws('|', source_path, cast(n_chars as varchar), strftime(modified_at, '%Y-%m-%d %H:%M:%S'))) as identity, sha256(text) as digest from documents")
def redaction_and_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.redacted(F.col("title")).alias("title_redacted"), T.stat_identity(F.col("source_path"), F.col("n_chars"), F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss")).alias("identity"), F.sha2("text", 256).alias("digest"))


@query("""with h as (select table_name, header[i] as raw, i from (select *, unnest(range(1, len(header) + 1)) as i from raw_tables)), b as (select *, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s from h),
  c as (select *, case when s is null or s = '' then 'column' when regexp_matches(s, '^[0-9]') then 'c_' || s else s end as base from b) select table_name, cast(i - 1 as integer) as col_idx, raw, base || case when rn = 1 then '' else '_' || rn end as name from (select *, row_number() over (partition by table_name, base order by i) as rn from c)""")
def column_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.operators.tables import column_names

    h = table(spark, sf_dir, "raw_tables").select("table_name", F.posexplode("header").alias("col_idx", "raw"))
    return column_names(h)


QUERIES, ORACLE = R.queries, R.oracle
