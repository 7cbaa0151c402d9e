"""Sinks: index, embeddings, vectors and the exported corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import iso, normalize_search, searchable
from quarry.operators.search import index_stats, listed, merged, units
from quarry.config import Settings
from quarry.sources import files
from quarry.storage import released, written


def search_index(chunks: DataFrame, documents: DataFrame, path: str, s: Settings = Settings()) -> None:
    """Write the keyword index: rows, postings sorted by term, and its statistics.

    Only active chunks with text are indexed.  Sorted postings let a scan for a term skip
    the row groups without it; ``search.stored_hits`` reads them.  Each step reads what the one
    before has written, so texts are joined and tokens cut once; only postings are shuffled,
    and those of a term in most rows are dealt over tasks by their keys.
    """
    spark, keys = chunks.sparkSession, ["doc_id", "chunk_index"]
    rows = (
        chunks.filter((F.col("active") == 1) & searchable(F.col("text"))).join(documents.select("doc_id", "url", "title"), "doc_id")
        .select("doc_id", "url", normalize_search(F.coalesce("title", F.lit(""))).alias("title"), "chunk_index", normalize_search(F.col("text")).alias("text"))
    )
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    counted = written(units(kept, keys, {"title": s.title_weight, "text": s.text_weight}))
    f = listed(counted, keys)
    if counted.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        f = merged(f, keys)
    f.repartitionByRange("term", *keys).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index_stats(counted).write.mode("overwrite").parquet(f"{path}/stats")
    released(counted)


def index_folder(spark: SparkSession, root: str, path: str, s: Settings = Settings()) -> DataFrame:
    """Write the keyword index of a folder of HTML files; returns meta: files, documents and chunks by key.

    Files without text are counted and have no rows; of files with one id all chunks stay.
    """
    pages = files.html_folder(spark, root)
    rows = written(files.index_rows(pages, s.chunk_words, s.chunk_overlap))
    documents = rows.groupBy("doc_id").agg(F.min("url").alias("url"), F.min("title").alias("title"))
    search_index(rows.select("doc_id", "chunk_index", "text", F.lit(1).alias("active")), documents, path, s)
    counts = {"files": pages.select("path").count(), "documents": documents.count(), "chunks": rows.count()}
    meta = spark.createDataFrame([(k, str(v)) for k, v in counts.items()], "key string, value string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return meta


def embeddings(rows: DataFrame, path: str) -> None:
    """Replace the table of chunk embeddings."""
    rows.write.mode("overwrite").parquet(path)


def vectors(rows: DataFrame, path: str) -> None:
    rows.select("vector_id", "embedding").write.mode("overwrite").parquet(path)


def manifest(documents: DataFrame, since: str) -> DataFrame:
    """What an export has: a row for each document with a text that was fetched since then."""
    some = documents.filter((F.col("last_fetched_at") >= F.lit(since).cast("timestamp")) & F.col("clean_text").isNotNull() & (F.col("clean_text") != ""))
    return some.select("doc_id", "url", "title", iso(F.col("last_changed_at")).alias("last_changed_at"), iso(F.col("last_fetched_at")).alias("last_fetched_at"), F.concat("doc_id", F.lit(".txt")).alias("file"))


def corpus(documents: DataFrame, path: str, since: str) -> DataFrame:
    """Write texts and manifest of the documents fetched since then; returns the manifest.

    Texts are Parquet rows (file, value) sorted by file, so that one is found by its
    statistics: a file or folder for each document would not hold up.  ``text_files`` makes
    plain files of some.  The manifest is newest first.
    """
    listed = manifest(documents, since)
    texts = documents.join(listed.select("doc_id", "file"), "doc_id").select("file", F.col("clean_text").alias("value"))
    texts.repartitionByRange("file").sortWithinPartitions("file").write.mode("overwrite").parquet(f"{path}/texts")
    listed.orderBy(F.desc("last_fetched_at"), "doc_id").write.mode("overwrite").json(f"{path}/manifest")
    return listed


def text_files(spark: SparkSession, path: str, doc_ids: list[str], out: str) -> None:
    """Exported texts of the documents named, each in its folder under out, as plain text."""
    some = spark.read.parquet(f"{path}/texts").filter(F.col("file").isin([f"{d}.txt" for d in doc_ids]))
    some.repartition("file").write.mode("overwrite").partitionBy("file").text(out)
