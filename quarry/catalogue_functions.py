"""Registered queries of URL, text, answer and source functions, with their SQL twins.

Inputs that the driver's tables lack (links, robots files, result pages, model answers) are
built from them by the same rule in both languages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import catalogue
from quarry.functions import answers, text, urls
from quarry.operators import chunking, lines, results
from quarry.plans.ingest import best_candidates
from quarry.registry import query, table
from quarry.sources import files

# URLs ---------------------------------------------------------------------------------

_PATH = "'/crawl/' || CASE page_id % 4 WHEN 0 THEN '-' || {id} || '_x.HTML' WHEN 1 THEN 'page.' || {id} || '.htm' WHEN 2 THEN 'about.html' ELSE 'note.txt' END"


@query(f"""
WITH f AS (SELECT {_PATH.format(id="CAST(page_id AS VARCHAR)")} AS path, html FROM pages),
s AS (SELECT path, html, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM f WHERE regexp_matches(lower(path), '\\.html?$')),
d AS (SELECT path, html, coalesce(nullif(regexp_extract(stem, '(-?\\d+)', 1), ''), stem) AS doc_id FROM s)
SELECT path, doc_id, 'https://docs.example.org/docs/' || doc_id AS url, md5(html) AS html FROM d""")
def html_folder_rows(spark, sf_dir):
    path = F.expr(_PATH.format(id="CAST(page_id AS STRING)"))
    found = table(spark, sf_dir, "pages").select(path.alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.html_files(found).select("path", "doc_id", "url", F.md5("html").alias("html"))


@query("""
SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'http://www.docs.example.org:8080' WHEN 4 THEN 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ELSE 'https://www.docs.example.org' END AS base FROM pages""")
def base_urls(spark, sf_dir):
    given = F.expr("CASE page_id % 5 WHEN 1 THEN '  docs.example.org/ ' WHEN 2 THEN 'http://docs.example.org:8080//' WHEN 3 THEN 'https://www.docs.example.org' WHEN 4 THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END")
    return table(spark, sf_dir, "pages").select("page_id", urls.base_url(given).alias("base"))


@query("""
WITH p AS (SELECT page_id, 'https://docs.example.org/uz/docs/' || page_id AS base FROM pages)
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://docs.example.org/uz/a/b?x=1/../2' WHEN 1 THEN 'https://docs.example.org/docs/7#f' WHEN 2 THEN 'https://docs.example.org/z' WHEN 3 THEN base || '?q=1'
  WHEN 4 THEN base || '#top' WHEN 5 THEN 'http://other.org/x/../y' WHEN 6 THEN 'https://docs.example.org/uz/docs/next' WHEN 7 THEN 'https://docs.example.org/' ELSE base END AS url FROM p""")
def url_join(spark, sf_dir):
    base = F.expr("'https://docs.example.org/uz/docs/' || CAST(page_id AS STRING)")
    href = F.expr("element_at(array('../a/./b?x=1/../2', '/docs/7#f', '//www.docs.example.org/z', '?q=1', '#top', 'http://other.org/x/../y', 'next', '../../../..', ''), CAST(page_id % 9 AS INT) + 1)")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(base, href).alias("url"))


@query("""
WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/uz' ELSE '' END AS l, CASE WHEN page_id % 3 = 0 THEN '-' ELSE '' END || page_id AS i, CASE WHEN page_id % 3 = 0 THEN '' ELSE '-' END || page_id AS j FROM pages),
f AS (SELECT *, list_transform([i, j], lambda k: ['https://docs.example.org' || l || '/docs/' || k, 'https://www.docs.example.org' || l || '/docs/' || k, 'https://docs.example.org' || CASE WHEN l = '' THEN '/uz' ELSE '' END || '/docs/' || k]) AS forms FROM p)
SELECT page_id, array_to_string(flatten(forms), ' ') AS forms FROM f""")
def url_variants(spark, sf_dir):
    u = F.expr("'https://docs.example.org' || CASE WHEN page_id % 2 = 0 THEN '/uz' ELSE '' END || '/docs/' || CASE WHEN page_id % 3 = 0 THEN '-' ELSE '' END || page_id || '#part'")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.variants(u), " ").alias("forms"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])ref=[^&]*&?', '\\1', 'g'), '[?&]$', '') AS u FROM pages)
SELECT page_id, u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'ref=new' AS url FROM p""")
def url_with_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.with_query(F.col("url"), ref="new").alias("url"))


@query("""
WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '-' ELSE '' END || page_id AS i, CAST(page_id AS VARCHAR) AS k FROM pages),
d AS (SELECT page_id, k, list_distinct([i, k, '-' || k]) AS _, CASE WHEN i = k THEN [k, '-' || k] ELSE [i, k] END AS ids FROM p)
SELECT page_id, 'https://docs.example.org/x/' || k || '.pdf ' || array_to_string(flatten(list_transform(['https://docs.example.org', 'https://www.docs.example.org'], lambda r: flatten(list_transform(ids, lambda i: [r || '/pdffile/' || i, r || '/pdfs/' || i])))), ' ') AS found FROM d""")
def pdf_links(spark, sf_dir):
    page = F.expr("'<p><a class=\"f\" href=\"/x/' || page_id || '.pdf\">f</a><object data=\"/x/' || page_id || '.pdf\"></object><a href=\"/other\">o</a>'")
    url = F.expr("'https://docs.example.org/docs/' || CASE WHEN page_id % 2 = 0 THEN '-' ELSE '' END || page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.pdf_candidates(page, url), " ").alias("found"))


_DOC_URL = "CASE page_id % 5 WHEN 0 THEN 'https://docs.example.org/docs/' || {id} WHEN 1 THEN 'https://www.docs.example.org/uz/' WHEN 2 THEN 'https://DOCS.example.org/uz/docs/-' || {id} WHEN 3 THEN 'https://x' || {id} || '.gov.uz/a' ELSE url END"


@query(f"""
WITH p AS (SELECT page_id, {_DOC_URL.format(id="page_id")} AS u FROM pages)
SELECT page_id, contains(lower(u), 'docs.example.org') AND contains(lower(u), '/docs/') AS is_document, page_id % 5 = 1 AS is_index,
  CASE page_id % 5 WHEN 0 THEN 'Document #' || page_id WHEN 2 THEN 'Document #-' || page_id ELSE 'Document' END AS title,
  CAST(CASE page_id % 5 WHEN 3 THEN 0.2 WHEN 4 THEN 0.0 ELSE 0.35 END AS DOUBLE) AS bonus FROM p""")
def page_predicates(spark, sf_dir):
    u = F.col("u")
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_DOC_URL.format(id="CAST(page_id AS STRING)")).alias("u"))
    return p.select("page_id", urls.is_document(u).alias("is_document"), urls.is_index(u).alias("is_index"), urls.document_title(u).alias("title"), urls.bonus(u).alias("bonus"))


@query(f"""
WITH p AS (SELECT CAST(page_id % 3 AS BIGINT) AS query_id, page_id, {_DOC_URL.format(id="page_id")} AS url FROM pages)
SELECT query_id, url, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS INTEGER) AS pos FROM p WHERE page_id % 5 IN (0, 2)""")
def documents_only(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("query_id"), F.col("page_id").alias("pos"), F.expr(_DOC_URL.format(id="CAST(page_id AS STRING)")).alias("url"))
    return results.documents_only(p).select("query_id", "url", "pos")


@query("SELECT page_id, url AS target FROM pages")
def redirect_targets(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//s.org/l/?kh=1&uddg="), F.url_encode("url"), F.lit("&rut=9"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.redirect_target(u).alias("target"))


# Sources ------------------------------------------------------------------------------


@query("""
SELECT CAST(i AS INTEGER) AS pos, strftime(DATE '2024-03-02' - CAST(i AS INTEGER), '%Y-%m-%d') AS day,
'https://e.org/calendar?date=' || strftime(DATE '2024-03-02' - CAST(i AS INTEGER), '%d.%m.%Y') || '&lang=uz' AS url FROM generate_series(0, 6) AS g(i)""")
def calendar_days(spark, sf_dir):
    return files.calendar_pages(spark, "https://e.org", "2024-03-02", 7).select("pos", F.col("day").cast("string").alias("day"), "url")


@query("""
WITH h AS (SELECT DATE '2024-01-01' + CAST(page_id % 9 AS INTEGER) AS day, page_id % 20 AS a, page_id % 7 AS b FROM pages),
l AS (SELECT day, 'https://e.org/docs/' || a AS url, CAST(a AS VARCHAR) AS doc_id FROM h UNION ALL SELECT day, 'https://e.org/uz/docs/-' || b, '-' || b FROM h)
SELECT url, strftime(max(day), '%Y-%m-%d') AS day, doc_id FROM l GROUP BY url, doc_id""")
def discovered_documents(spark, sf_dir):
    page = F.expr("""'<a href="/docs/' || (page_id % 20) || '#x">a</a> <a href="/other">o</a><a class="c" href=\\'https://e.org/uz/docs/-' || (page_id % 7) || '\\'>b</a><a href="/docs/none">n</a>'""")
    pages = table(spark, sf_dir, "pages").select(F.expr("date_add(DATE'2024-01-01', CAST(page_id % 9 AS INT))").alias("day"), page.alias("html"))
    return files.document_links(pages, "https://e.org").select("url", F.col("day").cast("string").alias("day"), "doc_id")


@query("""
SELECT CASE WHEN doc_id % 4 = 0 THEN 'u' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS doc_id, 'u' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE md5(text) END AS text FROM documents""")
def json_documents(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(
        F.expr("CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id AS STRING) END").alias("doc_id"), F.expr("'u' || doc_id").alias("url"),
        F.expr("CASE WHEN doc_id % 3 <> 0 THEN lang END").alias("title"), F.expr("CASE WHEN doc_id % 5 <> 0 THEN md5(text) END").alias("text"),
    )
    return files.filled_documents(raw)


@query("SELECT page_id, page_id % 4 IN (0, 1) AS pdf FROM pages")
def pdf_sniff(spark, sf_dir):
    content = F.when(F.col("page_id") % 4 == 0, F.lit(b"%PDF-1.4")).when(F.col("page_id") % 4 != 3, F.encode("html", "UTF-8"))
    kind = F.when(F.col("page_id") % 4 == 1, "Application/PDF; x").when(F.col("page_id") % 4 == 2, "text/html")
    return table(spark, sf_dir, "pages").select("page_id", files.is_pdf(content, kind).alias("pdf"))


@query("SELECT page_id, CAST(CASE page_id % 5 WHEN 0 THEN page_id % 7 + 0.5 WHEN 1 THEN 3 WHEN 4 THEN 2 END AS DOUBLE) AS crawl_delay FROM pages")
def robots_delays(spark, sf_dir):
    robots = F.expr(r"""CASE page_id % 5 WHEN 0 THEN '# c\nUser-agent: a\nCrawl-delay: 9\nUSER-AGENT: *\n\nDisallow: /\nCrawl-delay: ' || (page_id % 7) || '.5\nCrawl-delay: 8'
        WHEN 1 THEN 'User-agent:*\r\nUser-agent: b\r\nCrawl-delay: 1\r\nUser-agent: *\r\ncrawl-DELAY : 4\r\ncrawl-delay:3' WHEN 2 THEN 'User-agent: *\nCrawl-delay: soon\nCrawl-delay: 2' WHEN 3 THEN 'User-agent: c\nCrawl-delay: 2'
        ELSE '  User-agent: * \n  Crawl-delay: 2' END""")
    return files.robots(table(spark, sf_dir, "pages").select("page_id", robots.alias("robots"))).select("page_id", "crawl_delay")


@query("""
WITH p AS (SELECT page_id, page_id % 4 AS k FROM pages)
SELECT page_id, CAST(1 AS INTEGER) AS pos, 'https://a.org/' || page_id AS url, CASE WHEN k = 2 THEN 'A b' ELSE 'One & t' END AS title, CASE k WHEN 0 THEN 'first snippet' WHEN 1 THEN 'its own' ELSE '' END AS snippet FROM p WHERE k < 3
UNION ALL SELECT page_id, 2, 'https://b.org/?q=1&r=2', 'Two', CASE WHEN k = 0 THEN 'second' ELSE '' END FROM p WHERE k < 2""")
def result_pages(spark, sf_dir):
    page = F.expr(r"""CASE page_id % 4 WHEN 0 THEN '<div class="result"><a rel="n" class="x result__a" href="https://a.org/' || page_id || '">One <b>&amp;</b> t</a><a class="result__snippet" href="#">first <b>snippet</b></a></div><a href="https://c.org">c</a>'
          || '<a href="//s.org/l/?uddg=https%3A%2F%2Fb.org%2F%3Fq%3D1%26r%3D2&amp;rut=1" class="result__a">Two</a><div class="result__snippet">second</div><a class="result__a" href="https://a.org/' || page_id || '">again</a>'
        WHEN 1 THEN '<p><a class="result__url" href="https://a.org/' || page_id || '">One &amp; t</a><span class="result__snippet">its own</span><a class="result__url" href="https://b.org/?q=1&amp;r=2">Two</a>'
        WHEN 2 THEN '<a href="https://c.org">c</a><div class="results"><a href="/l/?uddg=https%3A%2F%2Fa.org%2F' || page_id || '">A <i>b</i></a></div>' ELSE '<p>none</p>' END""")
    rows = files.parse_results(table(spark, sf_dir, "pages").select("page_id", page.alias("html")), "page_id")
    return rows.select("page_id", "pos", "url", "title", "snippet")


@query("""
WITH f AS (SELECT CAST(page_id % 3 AS BIGINT) AS query_id, page_id, 'https://docs.example.org/docs/' || (page_id % 40) AS url, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN NULL ELSE left(html, 400) END AS title, CASE WHEN page_id % 5 <> 0 THEN html END AS snippet FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY page_id) AS r FROM f)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS INTEGER) AS pos, url, md5(coalesce(nullif(left(coalesce(title, ''), 140), ''), 'Document #' || regexp_extract(url, '(\\d+)$', 1))) AS title, md5(left(coalesce(snippet, ''), 220)) AS snippet, 'example' AS label FROM r WHERE r = 1""")
def search_results(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 3).alias("query_id"), F.col("page_id").alias("pos"), F.expr("'https://docs.example.org/docs/' || (page_id % 40)").alias("url"),
        F.expr("CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 > 1 THEN left(html, 400) END").alias("title"), F.expr("CASE WHEN page_id % 5 <> 0 THEN html END").alias("snippet"),
    )
    return files.search_results(p).select("query_id", "pos", "url", F.md5("title").alias("title"), F.md5("snippet").alias("snippet"), "label")


# Text ---------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CAST(CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS n FROM events""")
def json_fields(spark, sf_dir):
    said = F.expr(r"""CASE event_id % 4 WHEN 0 THEN '```json\n' || props || '\n```' WHEN 1 THEN 'Here it is: ' || props || ' done.' WHEN 2 THEN replace(props, '}', ', "b": "x y"}') ELSE 'no object [1, 2]' END""")
    m = table(spark, sf_dir, "events").select("event_id", text.json_fields(said).alias("m"))
    return m.select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n"))


@query("""
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 5 ELSE 7 END AS INTEGER) AS number, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS flag FROM events""")
def safe_values(spark, sf_dir):
    number = F.expr("CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN ' 5 ' WHEN 2 THEN 'x1' END")
    flag = F.expr("CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'ON' WHEN 3 THEN '' END")
    return table(spark, sf_dir, "events").select("event_id", text.safe_int(number, 7).alias("number"), text.safe_bool(flag, True).alias("flag"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, CAST(CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 7200000000 WHEN 2 THEN epoch_us(date_trunc('day', ts)) END AS BIGINT) AS parsed_us FROM events""")
def iso_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", text.iso(F.col("ts")).alias("iso"))
    given = F.expr("CASE event_id % 4 WHEN 0 THEN replace(iso, '+00:00', 'Z') WHEN 1 THEN replace(iso, '+00:00', '+02:00') WHEN 2 THEN left(iso, 10) ELSE 'yesterday' END")
    return e.select("event_id", "iso", F.unix_micros(text.parse_iso(given)).alias("parsed_us"))


@query("""
SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN regexp_replace(left(text, 100), ' [^ ]*$', '') || ' …' ELSE text END) AS short, md5(left(text, 140)) AS title FROM documents""")
def text_cuts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.shorten(F.col("text"), 100)).alias("short"), F.md5(F.left("text", F.lit(140))).alias("title"))


_PAGED = "replace(text, '. ', '.' || chr(12))"


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, trim(regexp_replace(unnest(ls), '[ \\t]+', ' ', 'g')) AS line FROM (SELECT doc_id, regexp_split_to_array({_PAGED}, '[\\n\\f]') AS ls FROM documents)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS k, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS r FROM l WHERE line <> '' AND NOT regexp_matches(line, '^\\d{{1,4}}$')),
o AS (SELECT doc_id, pos, line FROM n WHERE NOT (k >= 6 AND length(line) <= 220 AND contains(lower(line), 'apache')) OR r = 1),
d AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM o)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS clean FROM d WHERE before IS NULL OR before <> line GROUP BY doc_id""")
def ocr_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PAGED).alias("text"))
    return lines.clean_pdf(d, head="apache", ocr=True).select("doc_id", F.md5("clean_text").alias("clean"))


@query("""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\\bThe\\b') AS heads, regexp_split_to_array(text, '\\bThe\\b') AS bodies, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS whole, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT doc_id, i - 1 AS i, heads[i] AS label, trim(heads[i] || ' ' || bodies[i + 1], ' ' || chr(9) || chr(10) || chr(13)) AS block FROM (SELECT doc_id, heads, bodies, unnest(generate_series(1, len(heads))) AS i FROM t WHERE len(heads) >= 2)),
p AS (SELECT doc_id, i, NULL AS label, CASE WHEN len(ws) <= 150 THEN whole ELSE array_to_string(list_slice(ws, i * 130 + 1, i * 130 + 150), ' ') END AS block
      FROM (SELECT doc_id, whole, ws, unnest(generate_series(0, CASE WHEN len(ws) <= 150 THEN 0 ELSE CAST(ceil((len(ws) - 150) / 130.0) AS BIGINT) END)) AS i FROM t WHERE len(heads) < 2 AND whole <> ''))
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, label, md5(block) AS block FROM (SELECT * FROM b UNION ALL SELECT * FROM p)""")
def chunk_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_documents(d, r"\bThe\b").select("doc_id", "chunk_index", "label", F.md5("chunk_text").alias("block"))


#: Candidate texts of a document: a cut one, the whole, and a recognised one.
_CANDIDATES = """SELECT doc_id * 4 + r AS doc_id, doc_id AS doc, CAST(r AS INTEGER) AS source_rank, CASE r WHEN 0 THEN 'html' WHEN 1 THEN 'print' ELSE 'pdf+ocr' END AS source,
  CASE r WHEN 0 THEN left(text, 700) WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'Main page RSS' || text ELSE left(text, 1500) END ELSE text END AS text FROM documents, (VALUES (0), (1), (2)) AS v(r)"""


def _best_sql() -> str:
    sized = catalogue._QUALITY.replace("FROM documents", "FROM cand").lstrip().removeprefix("WITH")
    return f"""
WITH cand AS ({_CANDIDATES}), {sized},
j AS (SELECT c.doc, c.source, c.source_rank, q.n_words, ok, sc FROM cand c JOIN quality q USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok THEN source_rank END, sc DESC, source_rank) AS r FROM j)
SELECT doc AS doc_id, source, ok OR (source = 'pdf+ocr' AND n_words >= 80) AS usable FROM o WHERE r = 1"""


@query(_best_sql())
def best_candidate(spark, sf_dir):
    rank = F.explode(F.array(*map(F.lit, range(3))))
    c = table(spark, sf_dir, "documents").select("doc_id", "text", rank.alias("source_rank"))
    source = F.expr("CASE source_rank WHEN 0 THEN 'html' WHEN 1 THEN 'print' ELSE 'pdf+ocr' END")
    t = F.expr("CASE source_rank WHEN 0 THEN left(text, 700) WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'Main page RSS' || text ELSE left(text, 1500) END ELSE text END")
    return best_candidates(c.select("doc_id", "source_rank", source.alias("source"), t.alias("text"))).select("doc_id", "source", "usable")


# Answers ------------------------------------------------------------------------------

_SAID = "FROM conversations WHERE role = 'assistant'"


def _said(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'")


_TWO = catalogue._TWO


@query(_TWO + ", k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS r FROM blocks WHERE n >= 10) SELECT conv_id, turn, CAST(r AS INTEGER) AS i, text, array_to_string(list_sort(list_transform(ids, lambda x: CAST(x AS INTEGER))), ',') AS ids FROM k")
def legacy_answer_blocks(spark, sf_dir):
    ids = F.array(*[F.lit(str(i)) for i in range(1, 4)])
    rows = catalogue._answered(spark, sf_dir).select("conv_id", "turn", F.posexplode(answers.legacy_blocks(F.col("answer"), ids)).alias("i", "b"))
    return rows.select("conv_id", "turn", "i", "b.text", F.array_join(F.transform("b.sourceIds", lambda x: x.cast("string")), ",").alias("ids"))


_SENTENCES = "list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: length(x) > 0)"


@query(f"""
WITH l AS (SELECT conv_id, turn, {_SENTENCES} AS ls {_SAID})
SELECT conv_id, turn, array_to_string(list_slice(list_transform(list_filter(ls, lambda x: length(x) > 1), lambda x: x || '?'), 1, 5), '|') AS questions FROM l""")
def generated_questions(spark, sf_dir):
    ls = F.filter(F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\."), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    # Each line has nine characters more, and one asks nothing.
    made = F.concat(F.array(F.lit("Here are some:")), F.transform(ls, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x, F.lit("? (ok) ab"))))
    return _said(spark, sf_dir).select("conv_id", "turn", F.array_join(answers.generated_questions(F.array_join(made, "\n")), "|").alias("questions"))


@query(f"""
WITH l AS (SELECT conv_id, turn, {_SENTENCES} AS ls {_SAID})
SELECT conv_id, turn, array_to_string(list_slice(list_transform(list_filter(ls, lambda x: length(x) >= 4), lambda x: 'site:e.org ' || x), 1, 5), '|') AS queries, coalesce(ls[1], 'the question') AS single FROM l""")
def answer_queries(spark, sf_dir):
    ls = F.filter(F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\."), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    quoted = F.array_join(F.transform(ls, lambda x: F.concat(F.lit(' "'), x, F.lit('?"'))), "\n")
    one = F.array_join(F.transform(ls, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), "\n")
    return _said(spark, sf_dir).select("conv_id", "turn", F.array_join(answers.query_list(quoted, "site:e.org"), "|").alias("queries"), answers.single_query(one, F.lit("the question")).alias("single"))


@query(f"""
WITH q AS (SELECT conv_id, turn, 'soliq ' || conv_id AS question {_SAID})
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Clean ' || turn WHEN 1 THEN 'Clean ' || turn ELSE question END AS clean_question, CASE conv_id % 4 WHEN 0 THEN 'find ' || turn WHEN 1 THEN 'Clean ' || turn ELSE question END AS search_query, CASE conv_id % 4 WHEN 0 THEN 'ru' ELSE 'uz' END AS answer_language FROM q""")
def question_rewrites(spark, sf_dir):
    said = F.expr(r"""CASE conv_id % 4 WHEN 0 THEN '```json\n{"clean_question": " Clean ' || turn || '", "search_query": "find ' || turn || ' ", "answer_language": " RU"}\n```' WHEN 1 THEN 'So {"clean_question": "Clean ' || turn || '", "answer_language": "xx"}' WHEN 2 THEN 'no json' END""")
    r = _said(spark, sf_dir).select("conv_id", "turn", answers.rewrite(said, F.expr("'soliq ' || conv_id")).alias("r"))
    return r.select("conv_id", "turn", "r.clean_question", "r.search_query", "r.answer_language")


_RESULTS = "SELECT CAST(page_id % 5 AS BIGINT) AS query_id, CAST(row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) AS INTEGER) AS pos, url, 't' || page_id AS title, 's' || page_id AS snippet FROM pages"


def _results(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query_id"), F.col("page_id"), "url", F.expr("'t' || page_id").alias("title"), F.expr("'s' || page_id").alias("snippet"))
    return results.renumber(p, "page_id").drop("page_id")


@query(f"""
WITH r AS ({_RESULTS})
SELECT query_id, string_agg(pos || '=' || title || url || snippet, ' ' ORDER BY CASE WHEN pos IN (2, 4, 7) THEN 0 ELSE 1 END, pos) AS sources FROM r GROUP BY query_id""")
def source_maps(spark, sf_dir):
    m = answers.source_map(_results(spark, sf_dir), F.array(*map(F.lit, ("4", "2", "7"))))
    shown = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["title"], e["value"]["url"], e["value"]["snippet"]))
    return m.select("query_id", F.array_join(shown, " ").alias("sources"))


@query(f"""
WITH r AS ({_RESULTS})
SELECT query_id, string_agg('[' || pos || '] ' || title || ' - ' || url, chr(10) ORDER BY pos) AS source_list FROM r WHERE CASE WHEN query_id % 2 = 0 THEN pos IN (1, 3) ELSE pos <= 25 END GROUP BY query_id""")
def source_lists(spark, sf_dir):
    cited = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("3"), F.lit("1"))).otherwise(F.array().cast("array<string>"))
    return answers.source_list(_results(spark, sf_dir), cited)


@query(f"""
WITH r AS ({_RESULTS}), g AS (SELECT query_id, pos, CASE WHEN pos % 6 = 0 THEN '' ELSE 'https://g.org/' || (pos % 10) END AS url, title FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY pos) AS r FROM g WHERE url <> '')
SELECT query_id, url, title, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS pos FROM f WHERE r = 1""")
def grounding_sources(spark, sf_dir):
    u = F.expr("CASE WHEN pos % 6 = 0 THEN '' ELSE 'https://g.org/' || (pos % 10) END")
    return answers.grounding_sources(_results(spark, sf_dir).withColumn("url", u)).select("query_id", "url", "title", "pos")


@query(f"""
WITH r AS ({_RESULTS})
SELECT query_id, string_agg(pos || '. ' || title || chr(10) || snippet || chr(10) || url, chr(10) || chr(10) ORDER BY pos) AS answer FROM r WHERE pos <= 5 GROUP BY query_id""")
def fallback_answers(spark, sf_dir):
    return answers.fallback_answer(_results(spark, sf_dir))


@query(f"SELECT conv_id, turn, md5(CASE WHEN conv_id % 3 = 0 THEN trim(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) WHEN conv_id % 3 = 1 THEN 'second' END) AS answer {_SAID}")
def provider_order(spark, sf_dir):
    first = F.when(F.col("conv_id") % 3 == 0, F.col("text")).when(F.col("conv_id") % 3 == 1, " \n ")
    second = F.when(F.col("conv_id") % 3 == 1, " second ")
    return _said(spark, sf_dir).select("conv_id", "turn", F.md5(answers.first_provider(first, second)).alias("answer"))


@query(f"SELECT conv_id, turn, md5(CASE conv_id % 5 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text || ' and more' WHEN 3 THEN 'plain' ELSE '' END) AS answer {_SAID}")
def response_texts(spark, sf_dir):
    t = F.to_json(F.struct(F.col("text").alias("text")))
    quoted = F.regexp_extract(t, r'(?s)^\{"text":(.*)\}$', 1)
    body = (
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit('{"choices": [{"message": {"role": "assistant", "content": '), quoted, F.lit("}}]}")))
        .when(F.col("conv_id") % 5 == 1, F.concat(F.lit('{"output": [{"type": "x"}, {"content": [{"type": "output_text", "text": '), quoted, F.lit("}]}]}")))
        .when(F.col("conv_id") % 5 == 2, F.concat(F.lit('{"candidates": [{"content": {"parts": [{"text": '), quoted, F.lit('}, {"text": " and more"}]}}]}')))
        .when(F.col("conv_id") % 5 == 3, '{"text": "plain"}').otherwise('{"error": {"code": 429}}')
    )
    return _said(spark, sf_dir).select("conv_id", "turn", F.md5(answers.response_text(body)).alias("answer"))
