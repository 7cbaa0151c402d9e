"""Sources: HTML folders, JSON documents, tables, link discovery; providers for the rest.

Fetching, PDF text, recognition and search are providers: functions over batches of rows
(``mapInPandas``), so that a plan doesn't depend on what is installed.  The offline
defaults return nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import html, urls
from quarry.operators.chunking import windows
from quarry.functions.text import normalize_search, once, words
from quarry.operators.results import first_of


def html_folder(spark: SparkSession, root: str, url_template: str = "https://docs.example.org/docs/{id}") -> DataFrame:
    """path, doc_id, url and html of the .html and .htm files under root."""
    return html_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), url_template)


def html_files(found: DataFrame, url_template: str = "https://docs.example.org/docs/{id}") -> DataFrame:
    """``html_folder`` for files (path, content) of any kind."""
    files = found.filter(F.lower("path").rlike(r"\.html?$"))
    doc = urls.path_id(F.col("path"))
    before, after = url_template.split("{id}")
    return files.select("path", doc.alias("doc_id"), F.concat(F.lit(before), doc, F.lit(after)).alias("url"), F.decode("content", "UTF-8").alias("html"))


def index_rows(pages: DataFrame, size: int = 350, overlap: int = 60) -> DataFrame:
    """doc_id, url, title, chunk_index and text for the keyword index; empty pages give none."""
    got = html.extracted(pages, "index", key="doc_id").join(pages.select("doc_id", "url"), "doc_id")
    clean = got.select("doc_id", "url", normalize_search(F.col("title")).alias("title"), normalize_search(F.col("text")).alias("t"))
    return clean.select("doc_id", "url", "title", F.posexplode(windows(words(F.col("t")), size, overlap)).alias("chunk_index", "text"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON array; missing fields are empty and the URL stands in for the id."""
    return filled_documents(spark.read.schema("doc_id string, url string, title string, text string").json(path, multiLine=True))


def filled_documents(raw: DataFrame) -> DataFrame:
    """raw with empty texts for missing fields and the URL for a missing id."""
    filled = {c: F.coalesce(c, F.lit("")) for c in ("url", "title", "text")}
    return raw.withColumns(filled).withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), "url"))


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def calendar_pages(spark: SparkSession, base: str, last_day: str, days: int, language: str = "uz") -> DataFrame:
    """day and url of the calendar pages of the last days, newest first by pos."""
    rows = spark.sql(f"SELECT posexplode(sequence(DATE'{last_day}', date_sub(DATE'{last_day}', {days - 1}), INTERVAL -1 DAY)) AS (pos, day)")
    return rows.withColumn("url", urls.calendar_url(F.lit(base), F.col("day"), language))


def document_links(pages: DataFrame, base: str) -> DataFrame:
    """url and day of the documents that calendar pages (day, html) link, the newest day of each."""
    hrefs = pages.select("day", F.posexplode(F.regexp_extract_all("html", F.lit(r"""<a [^>]*href=["']([^"']*)["']"""), 1)).alias("pos", "href"))
    found = hrefs.filter(F.contains(F.col("href"), F.lit("/docs/"))).withColumn("url", urls.without_fragment(urls.canonical(F.lit(base), F.col("href"))))
    found = found.filter(urls.doc_id(F.col("url")).isNotNull())
    one = Window.partitionBy("url").orderBy(F.desc("day"), "pos")
    return found.withColumn("r", F.row_number().over(one)).filter("r = 1").select("url", "day", urls.doc_id(F.col("url")).alias("doc_id"))


def is_pdf(content: Column, content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("application/pdf")), F.lit(False)) | F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def provided(rows: DataFrame, provider: Callable | None, schema: str) -> DataFrame:
    """rows through a provider (an iterator of pandas frames to one); without one, nulls."""
    from pyspark.sql.types import StructType

    if provider is not None:
        return rows.mapInPandas(provider, schema)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def search_results(found: DataFrame, cap: int | None = None, title: int = 140, snippet: int = 220) -> DataFrame:
    """Results of a search provider as a list: each URL once, titles and snippets cut.

    All results stay unless ``cap`` says how many of a query are wanted.
    """
    clean = found.withColumn("url", urls.redirect_target(F.col("url"))).filter("url <> ''")
    named = first_of(clean, "url")
    named = named.filter(F.col("pos") <= cap) if cap else named
    heading = F.coalesce(F.nullif(F.left(F.coalesce("title", F.lit("")), F.lit(title)), F.lit("")), urls.document_title(F.col("url")))
    return named.withColumns({"title": heading, "snippet": F.left(F.coalesce("snippet", F.lit("")), F.lit(snippet)), "label": urls.label(F.col("url"))})


def parse_results(pages: DataFrame, query: str = "query_id") -> DataFrame:
    """query_id, pos, url, title and snippet from search result pages (query_id, html).

    Links of class result__a (or result__url) with the snippet that follows; without any,
    redirecting links of a class for results; without any, all redirecting links.  Each URL
    counts where it is first.
    """
    # A part begins with an anchor's attributes and ends before the next anchor.
    parts = F.slice(F.split("html", r"(?i)<a(?=\s)"), 2, 1 << 30)

    def link(part: Column, i: Column, all_: Column) -> Column:
        attributes = F.regexp_extract(part, "^([^>]*)>", 1)

        def attribute(name: str) -> Column:
            return F.regexp_extract(attributes, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)

        own = F.regexp_extract(part, r"(?s)result__snippet[^>]*>(.*?)</", 1)
        later = F.coalesce(F.get(all_, i + 1), F.lit(""))
        after = F.when(F.contains(F.regexp_extract(later, "^([^>]*)>", 1), F.lit("result__snippet")), F.regexp_extract(later, r"(?s)^[^>]*>(.*?)</a>", 1)).otherwise("")
        return F.struct(
            F.trim(attribute("href")).alias("url"), attribute("class").alias("class"),
            F.regexp_extract(part, r"(?s)^[^>]*>(.*?)</a>", 1).alias("title"), F.when(own != "", own).otherwise(after).alias("snippet"),
        )

    def found(all_: Column) -> Column:
        return F.filter(F.transform(all_, lambda p, i: link(p, i, all_)), lambda x: x["url"] != "")

    def chosen(x: Column) -> Column:
        named = F.filter(x, lambda e: F.array_contains(F.split(e["class"], r"\s+"), "result__a") | F.array_contains(F.split(e["class"], r"\s+"), "result__url"))
        redirects = F.filter(x, lambda e: F.contains(e["url"], F.lit("uddg=")))
        classed = F.filter(redirects, lambda e: F.contains(e["class"], F.lit("result")))
        return F.when(F.size(named) > 0, named).when(F.size(classed) > 0, classed).otherwise(redirects)

    rows = pages.select(query, F.posexplode(once(once(parts, found), chosen)).alias("pos", "r"))
    plain = rows.select(
        query, "pos", urls.redirect_target(F.regexp_replace("r.url", "&amp;", "&")).alias("url"),
        html.unescaped(html.strip_tags(F.col("r.title"), ())).alias("title"), html.unescaped(html.strip_tags(F.col("r.snippet"), ())).alias("snippet"),
    )
    return first_of(plain, "url", query=query)


def page_texts(pages: DataFrame, most: int | None = None, page: str = "html") -> DataFrame:
    """pages with their text in one line, whole unless ``most`` is given."""
    t = html.strip_tags(F.col(page))
    return pages.withColumn("text", F.left(t, F.lit(most)) if most else t)


def robots(rows: DataFrame, column: str = "robots") -> DataFrame:
    """rows with crawl_delay of their robots.txt."""
    return rows.withColumn("crawl_delay", html.crawl_delay_of(F.col(column)))

