"""Answers of a language model: blocks with sources, questions, queries, rewrites.

Models themselves are providers: functions from text columns to text columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import detect_language, json_fields, once, strip

#: Headings after which an answer has questions or sources.
QUESTION_HEADS = ("Tegishli savollar:", "Related questions:", "Savollar:")
SOURCE_HEADS = ("Manbalar:", "Sources:", "Manba:")
MORE_QUESTION_HEADS = (*QUESTION_HEADS, "Qo'shimcha savollar:")
BULLET = r"^[-•*\d.)\]]+\s*"
CITATION = r"\[(\d+)\]"
TAIL_QUESTIONS = r"(?s)\n\s*1\.\s+[^\n]*\?\s*(?:\d+\.\s+[^\n]*\?\s*)+$"


def citations(c: Column) -> Column:
    """Numbers cited in a text, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CITATION), 1))


def cited_numbers(c: Column) -> Column:
    return F.array_sort(F.transform(citations(c), lambda x: x.cast("int")))


def without_citations(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\s*\[\d+\]\s*", " "), r"\s+", " "))


def body(c: Column) -> Column:
    """An answer up to its questions and sources."""
    for head in (*QUESTION_HEADS, *SOURCE_HEADS):
        c = F.substring_index(c, head, 1)
    return F.regexp_replace(c, TAIL_QUESTIONS, "")


def paragraphs(c: Column) -> Column:
    """Paragraphs of a text; of one with none, its lines of over 20 characters."""
    def trimmed(sep: str) -> Column:
        return F.filter(F.transform(F.split(c, sep), strip), lambda p: p != "")

    return once(trimmed("\n\n"), lambda ps: F.when(F.size(ps) > 1, ps).otherwise(F.filter(trimmed("\n"), lambda p: F.length(p) > 20)))


def blocks(c: Column, sources: Column) -> Column:
    """Structs (text, anchorSources) of an answer; sources: ids in order, as strings.

    A paragraph's sources are those it cites; one that cites none gets its share of all by
    position.  Paragraphs under 10 characters are left out, and an answer without any left
    is one block.
    """
    def made(x: Column) -> Column:
        ps, src = x["ps"], x["src"]
        share = F.greatest(F.lit(1), F.floor(F.size(src) / F.greatest(F.lit(1), F.size(ps)))).cast("int")

        def one(p: Column, i: Column) -> Column:
            named = F.array_intersect(citations(p), src)
            placed = F.when(i * share < F.size(src), F.slice(src, i * share + 1, share)).when(F.size(src) > 0, F.slice(src, -1, 1)).otherwise(src)
            anchors = F.when(F.size(named) > 0, named).otherwise(placed)
            return F.struct(without_citations(p).alias("text"), anchors.alias("anchorSources"), F.length(p).alias("n"))

        got = F.filter(F.transform(ps, one), lambda b: (b["n"] >= 10) & (b["text"] != ""))
        return F.transform(got, lambda b: F.struct(b["text"], b["anchorSources"]))

    def whole(t: Column, src: Column) -> Column:
        named = F.array_intersect(citations(t), src)
        anchors = F.when(F.size(named) > 0, named).otherwise(F.slice(src, 1, 3))
        return F.when(strip(t) != "", F.array(F.struct(without_citations(t).alias("text"), anchors.alias("anchorSources"))))

    def choose(t: Column) -> Column:
        src = F.coalesce(sources, F.array().cast("array<string>"))
        parts = once(F.struct(paragraphs(t).alias("ps"), src.alias("src")), made)
        return once(parts, lambda b: F.when(F.size(b) > 0, b).otherwise(F.coalesce(whole(t, src), b)))

    return once(body(F.coalesce(c, F.lit(""))), choose)


def legacy_blocks(c: Column, sources: Column) -> Column:
    """Structs (text, sourceIds) with the ids as numbers in order of size."""
    return F.transform(blocks(c, sources), lambda b: F.struct(b["text"].alias("text"), F.array_sort(F.transform(b["anchorSources"], lambda x: x.cast("int"))).alias("sourceIds")))


def _plain_lines(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.transform(lines, lambda x: strip(F.replace(strip(F.regexp_replace(x, BULLET, "")), F.lit("**"), F.lit(""))))


def related_questions(c: Column, most: int = 6) -> Column:
    """Questions of an answer's section of them."""
    section = F.lit(None).cast("string")
    for head in reversed(MORE_QUESTION_HEADS):
        at = F.locate(head.lower(), F.lower(c))
        section = F.when(at > 0, F.substr(c, at + len(head))).otherwise(section)
    found = F.filter(_plain_lines(F.coalesce(section, F.lit(""))), lambda q: (F.length(q) > 5) & q.endswith("?"))
    return F.slice(found, 1, most)


def generated_questions(c: Column, most: int = 5) -> Column:
    """Questions of a model's list, each up to its last question mark."""
    found = F.filter(_plain_lines(c), lambda q: (F.length(q) > 10) & F.contains(q, F.lit("?")))
    return F.slice(F.transform(found, lambda q: F.regexp_replace(q, r"\?[^?]*$", "?")), 1, most)


def query_list(c: Column, site_prefix: str = "", most: int = 5) -> Column:
    """Search queries of a model's lines without quotes and question marks."""
    bare = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(strip(F.regexp_replace(strip(x), r"""^["']+|["']+$""", "")), r"[?؟\s]+$", "")))
    good = F.filter(bare, lambda x: F.length(x) >= 4)
    if site_prefix:
        good = F.transform(good, lambda x: F.when(F.contains(x, F.lit(site_prefix)), x).otherwise(F.concat(F.lit(site_prefix + " "), x)))
    return F.slice(good, 1, most)


def single_query(c: Column, fallback: Column) -> Column:
    """The first line of a rewrite without quotes; the question if nothing is left."""
    first = strip(F.regexp_replace(strip(F.substring_index(strip(c), "\n", 1)), r"""^["']+|["']+$""", ""))
    return F.coalesce(F.nullif(first, F.lit("")), fallback)


def rewrite(answer: Column, question: Column) -> Column:
    """Struct (clean_question, search_query, answer_language) of a model's JSON, or a guess."""
    def made(m: Column) -> Column:
        clean = F.trim(F.coalesce(F.nullif(m["clean_question"], F.lit("")), question))
        query = F.trim(F.coalesce(F.nullif(m["search_query"], F.lit("")), clean))
        lang = F.lower(F.trim(m["answer_language"]))
        return F.struct(clean.alias("clean_question"), query.alias("search_query"), F.when(lang.isin("uz", "ru", "en"), lang).otherwise(detect_language(question)).alias("answer_language"))

    return once(json_fields(F.coalesce(answer, F.lit(""))), made)


def source_map(rows: DataFrame, cited: Column) -> DataFrame:
    """query_id and sources: a map from id to its fields, the cited ones first.

    rows: query_id, pos, url, title, snippet; cited: an array of ids as strings.
    """
    key = F.col("pos").cast("string")
    at = F.when(F.array_contains(cited, key), 0).otherwise(1)
    entry = F.struct(at.alias("late"), F.col("pos").alias("pos"), key.alias("id"), F.struct("url", "title", "snippet").alias("v"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        "query_id", F.map_from_entries(F.transform("e", lambda e: F.struct(e["id"], e["v"]))).alias("sources")
    )


def source_list(rows: DataFrame, cited: Column, most: int = 25) -> DataFrame:
    """query_id and a numbered list of the cited sources, or of the first ``most``."""
    use = F.when(F.size(cited) > 0, F.array_contains(cited, F.col("pos").cast("string"))).otherwise(F.col("pos") <= most)
    line = F.format_string("[%d] %s - %s", F.col("pos").cast("int"), "title", "url")
    return rows.filter(use).withColumn("line", line).groupBy("query_id").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY pos)").alias("source_list"))


def grounding_sources(rows: DataFrame) -> DataFrame:
    """Grounding chunks with each URL once, numbered from 1 in their order."""
    from quarry.operators.results import first_of

    return first_of(rows.filter("url <> ''"), "url")


def fallback_answer(rows: DataFrame, most: int = 5) -> DataFrame:
    """query_id and an answer made of the first results' titles and snippets."""
    line = F.concat_ws("\n", F.concat(F.col("pos").cast("string"), F.lit(". "), F.col("title")), F.col("snippet"), F.col("url"))
    return rows.filter(F.col("pos") <= most).withColumn("line", line).groupBy("query_id").agg(F.expr("listagg(line, '\\n\\n') WITHIN GROUP (ORDER BY pos)").alias("answer"))


def last_message(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The last turn of each conversation."""
    return turns.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))).filter("r = 1").drop("r")


def first_provider(*answers: Column) -> Column:
    """The first provider's answer that isn't empty."""
    return F.coalesce(*[F.nullif(strip(a), F.lit("")) for a in answers])


#: Shapes of a language model's JSON response that hold its text.
RESPONSE = "text string, output_text string, choices array<struct<text:string,message:struct<content:string>>>, output array<struct<content:array<struct<text:string>>>>, candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"


def response_text(body: Column) -> Column:
    """The text of a model's JSON response: the first shape that has one; empty without any."""

    def joined(parts: Column) -> Column:
        return F.array_join(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x.isNotNull()), "")

    r = F.from_json(body, RESPONSE)
    first = F.get(r["choices"], F.lit(0))
    outputs = F.flatten(F.filter(F.transform(r["output"], lambda o: F.transform(o["content"], lambda c: c["text"])), lambda x: x.isNotNull()))
    parts = F.transform(F.get(r["candidates"], F.lit(0))["content"]["parts"], lambda p: p["text"])
    shapes = (first["message"]["content"], first["text"], r["output_text"], joined(outputs), joined(parts), r["text"])
    return F.coalesce(*[F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit("")) for x in shapes], F.lit(""))
