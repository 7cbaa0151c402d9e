"""Retrieval plans: dense search with caps, and the two-stage hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import urls
from quarry.operators import ranking
from quarry.operators.chunking import chunk_documents
from quarry.operators.search import bm25_lite
from quarry.operators.vectors import cosine, embed, hashing_embedder, top_k


def dense(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Chunks for each question: the top k, then at most per_document of a document.

    vectors are active ones with vec_id; what is joined to chunks is only the hits.
    """
    hits = top_k(questions, vectors, s.top_k, metric="ip")
    rows = chunks.join(hits, "vec_id").join(documents.select("doc_id", "title", "url"), "doc_id")  # k rows a question
    few = rows.withColumn("g", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("pos"))).filter(F.col("g") <= s.per_document).drop("g")
    return few.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def stage1(questions: DataFrame, results: DataFrame, s: Settings = Settings(), make=hashing_embedder) -> DataFrame:
    """The best documents of a result list by title, snippet and URL."""
    docs = results.filter(F.col("url").startswith("http") & urls.is_document(F.col("url"), s))
    text = F.concat_ws(" ", "title", "snippet", "url")
    return _scored(questions, docs.withColumn("item_id", F.col("pos").cast("long")).withColumn("text", text), s, make, s.stage1_docs)


def stage2(questions: DataFrame, pages: DataFrame, marker: str, s: Settings = Settings(), make=hashing_embedder) -> DataFrame:
    """Chunks of the chosen pages by hybrid score, diversified, capped and cut to final_n."""
    chunks = chunk_documents(pages.select("query_id", "url", "title", "snippet", F.col("page_text").alias("text")), marker, s.passage_words, s.passage_overlap)
    order = Window.partitionBy("query_id").orderBy("url", "chunk_index")
    rows = chunks.withColumn("item_id", F.row_number().over(order).cast("long")).withColumn("text", F.concat_ws(" ", "title", "snippet", "chunk_text"))
    pool = _scored(questions, rows, s, make, max(s.final_n, 8, 15), keep_vector=True)
    chosen = ranking.mmr(pool.select("query_id", "item_id", F.col("cos").alias("score"), "embedding"), s.mmr_output, s.mmr_lambda, s.mmr_pool)
    got = pool.drop("pos", "embedding").join(chosen, ["query_id", "item_id"])
    few = got.withColumn("g", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("pos"))).filter(F.col("g") <= s.final_per_document).drop("g")
    return few.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("pos") <= s.final_n)


def full_documents(questions: DataFrame, pages: DataFrame, s: Settings = Settings(), make=hashing_embedder) -> DataFrame:
    """Whole pages by hybrid score with at most per_domain of a host."""
    rows = pages.withColumn("item_id", F.col("pos").cast("long")).withColumn("text", F.concat_ws(" ", "title", "snippet", "page_text"))
    ranked = _scored(questions, rows, s, make, None)
    few = ranked.withColumn("g", F.row_number().over(Window.partitionBy("query_id", urls.host(F.col("url"))).orderBy("pos"))).filter(F.col("g") <= s.per_domain).drop("g")
    return few.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("pos") <= s.final_n)


def _scored(questions: DataFrame, rows: DataFrame, s: Settings, make, k: int | None, keep_vector: bool = False) -> DataFrame:
    lite = bm25_lite(questions, rows.select("query_id", "item_id", "text"))
    q = embed(questions, "query", prefix="", make=make).select("query_id", F.col("embedding").alias("qv"))
    both = embed(rows, "text", prefix="", make=make, most=s.embed_chars).join(lite, ["query_id", "item_id"]).join(q, "query_id")
    scored = both.withColumn("cos", cosine(F.col("embedding"), F.col("qv"), 1e-9))
    scored = scored.withColumn("score", F.round(ranking.hybrid(F.col("cos"), F.col("bm25"), urls.bonus(F.col("url"), s), s.alpha), 6)).drop("qv", *([] if keep_vector else ["embedding"]))
    out = scored.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")))
    return out.filter(F.col("pos") <= k) if k else out
