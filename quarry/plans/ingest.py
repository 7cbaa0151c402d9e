"""From fetched pages to documents, chunks and vectors: one plan for a whole batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import html
from quarry.functions.text import acceptable, normalize_ws, quality, weak_but_usable
from quarry.operators import lines, state
from quarry.operators.chunking import windows
from quarry.functions.text import words
from quarry.operators.vectors import embed

DOCUMENTS = "doc_id string, url string, title string, lang string, source_date date, first_seen_at timestamp, last_seen_at timestamp, last_fetched_at timestamp, last_changed_at timestamp, content_hash string, etag string, status string, last_error string, next_recheck_at timestamp, clean_text string"
CHUNKS = "doc_id string, chunk_index int, text string, text_hash string, active int, created_at timestamp"


@dataclass
class Snapshot:
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None


def clean_pages(pages: DataFrame, key: str = "doc_id", references: html.References | None = None) -> DataFrame:
    """key, title and text of HTML pages, by tree and line rules; references as in ``html.parse``."""
    raw = html.extracted(pages, "lines", key=key, references=references)
    clean = lines.joined(lines.collapse_adjacent(lines.without_controls(lines.lines(F.col("text")))))
    return raw.select(key, normalize_ws(F.col("title")).alias("title"), F.coalesce(clean, F.lit("")).alias("text"))


def best_candidates(candidates: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One text a document from candidates (doc_id, source_rank, source, text).

    Sources are tried in rank order: the first acceptable text ends the search, otherwise
    the highest score wins, the earlier source of equals.
    """
    scored = candidates.withColumn("q", quality(F.col("text")))
    ok = acceptable(F.col("q"), s)
    rank = F.struct(F.when(ok, 1).otherwise(0).alias("ok"), F.when(ok, -F.col("source_rank")).alias("first"), F.col("q.score").alias("score"), (-F.col("source_rank")).alias("rank"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("source", "text", "q"), rank).alias("b"))
    out = best.select("doc_id", "b.source", "b.text", "b.q")
    return out.withColumn("usable", acceptable(F.col("q"), s) | weak_but_usable(F.col("source"), F.col("q"), s))


def ingest(snapshot: Snapshot, fetched: DataFrame, now: Column, s: Settings = Settings(), embedder=None) -> tuple[Snapshot, DataFrame]:
    """The next snapshot, and doc_id and outcome of each fetched row.

    fetched: doc_id, url, title, text, error and etag, one row a document; text is null where the
    fetch failed or nothing changed at the source (then error is null too).  Unchanged texts
    are found by hash before anything is chunked or embedded.
    """
    judged = fetched.withColumn("q", quality(F.col("text")))
    plain = judged.withColumn(
        "outcome0",
        F.when(F.col("error").isNotNull(), "error").when(F.col("text").isNull(), "unchanged").when(~acceptable(F.col("q"), s), "skipped"),
    )
    known = state.changed(snapshot.documents, plain.drop("q"))
    outcome = F.coalesce("outcome0", "change")
    results = known.withColumn("outcome", outcome).drop("outcome0", "change")
    fresh = results.filter(F.col("outcome").isin("new", "updated"))

    seen = results.select("doc_id", "url", "title", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("date").alias("source_date"), now.alias("now"))
    documents = state.placeholders(snapshot.documents, seen)
    is_fresh = F.col("outcome").isin("new", "updated")
    record = results.select(
        "doc_id", F.when(F.col("outcome") == "skipped", "text too weak").otherwise(F.col("error")).alias("error"), (F.col("outcome") == "skipped").alias("skipped"),
        is_fresh.alias("changed"), F.when(is_fresh, F.col("new_hash")).alias("content_hash"), "etag", now.alias("now"),
    )
    documents = state.record_fetch(documents, record, s)
    texts = fresh.select("doc_id", F.col("text").alias("new_text"))
    documents = documents.join(texts, "doc_id", "left").withColumn("clean_text", F.coalesce("new_text", "clean_text")).drop("new_text")

    retired = state.deactivate(snapshot.chunks, fresh)
    made = fresh.select("doc_id", F.posexplode(windows(words(normalize_ws(F.col("text"))), s.chunk_words, s.chunk_overlap)).alias("chunk_index", "text"))
    made = made.select("doc_id", "chunk_index", "text", F.sha2("text", 256).alias("text_hash"), F.lit(1).alias("active"), now.alias("created_at"))
    vectors = snapshot.vectors
    if embedder is not None and vectors is not None:
        new = embed(made, "text", make=embedder).select("doc_id", "chunk_index", "text_hash", "embedding", "active")
        vectors = state.deactivate(vectors, fresh).unionByName(new)
    return Snapshot(documents, retired.unionByName(made), vectors), results.select("doc_id", "outcome")


def outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
