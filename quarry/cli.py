"""Command line over a snapshot folder: runs, documents, rechecks, search, questions, export, checks."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import search, state
from quarry.plans import answer
from quarry.plans.ingest import Snapshot
from quarry.sources import sinks
from quarry.storage import RunLock
from quarry.streaming.ingest import merge_batch, read_queue, read_snapshot, stream, write_queue, write_snapshot


def list_documents(documents: DataFrame, status: str | None, limit: int) -> DataFrame:
    some = documents.filter(F.col("status") == status) if status else documents
    return some.select("doc_id", "status", "title", "url", "last_seen_at").orderBy(F.desc("last_seen_at"), "doc_id").limit(limit)


def find_documents(documents: DataFrame, text: str) -> DataFrame:
    pattern = "%" + text + "%"
    return documents.filter(F.col("doc_id").ilike(pattern) | F.col("url").ilike(pattern) | F.col("title").ilike(pattern))


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def doctor(spark: SparkSession) -> dict[str, bool]:
    """What the environment offers; missing providers only switch off their sources."""
    import importlib.util

    found = {m: importlib.util.find_spec(m) is not None for m in ("pyarrow", "pandas", "numpy", "fitz", "pypdf", "pytesseract", "sentence_transformers")}
    return found | {"adaptive": spark.conf.get("spark.sql.adaptive.enabled") == "true", "utc": spark.conf.get("spark.sql.session.timeZone") == "UTC"}


def chunk_counts(snapshot: Snapshot) -> DataFrame:
    """doc_id and its number of active chunks, most first."""
    active = snapshot.chunks.filter("active = 1").select("doc_id", "chunk_index")
    return snapshot.documents.select("doc_id").join(active, "doc_id", "left").groupBy("doc_id").agg(F.count("chunk_index").alias("chunks")).orderBy(F.desc("chunks"), "doc_id")


def rebuild_index(snapshot: Snapshot, path: str) -> None:
    """The keyword index anew, from active chunks."""
    sinks.search_index(snapshot.chunks, snapshot.documents, f"{path}/index")


def keyword_search(spark: SparkSession, path: str, question: str, s: Settings = Settings()) -> DataFrame:
    """pos, doc_id, chunk_index, title, url, rank and snippet of the best chunks in the stored index."""
    asked = spark.createDataFrame([(1, question)], "query_id int, query string")
    keys = ["doc_id", "chunk_index"]
    documents = read_snapshot(spark, path).documents
    hits = search.with_recency(search.stored_hits(spark, f"{path}/index", search.terms(asked), keys), documents, s)
    top = search.capped(hits, "rank", "doc_id", s.fts_per_document, s.fts_k, s.fts_candidates, tie=keys)
    wanted = F.array(*[F.lit(r.term) for r in search.terms(asked).select("term").distinct().collect()]) if question.strip() else F.array().cast("array<string>")
    rows = spark.read.parquet(f"{path}/index/rows").join(top, keys)
    return rows.select("query_id", "pos", *keys, "title", "url", "rank", search.snippet(F.col("text"), wanted).alias("snippet")).orderBy("pos")


def ask(spark: SparkSession, path: str, request: str, providers: list[answer.Provider] | None = None, s: Settings = Settings()) -> dict:
    """The answer to a JSON request (question, history, structured), as the API gives it."""
    asked = answer.parsed(spark.createDataFrame([(1, request)], "query_id int, request string"))
    first = asked.first()
    if first.error:
        return {"error": first.error}
    found = keyword_search(spark, path, first.question, s).select("query_id", "pos", "url", "title", "snippet")
    got = answer.ask(asked, found, providers or [], s).first().asDict(recursive=True)
    names = ("question", "structured", "responder", "blocks", "sources", "relatedQuestions") if got["structured"] else ("question", "answer", "responder")
    return {n: got[n] for n in names}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--path", default="snapshot", help="folder of the snapshots")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("doctor", "stats", "chunk-counts", "schema", "rebuild-index"):
        sub.add_parser(name)
    x = sub.add_parser("list-docs")
    x.add_argument("--status")
    x.add_argument("--limit", type=int, default=50)
    x = sub.add_parser("show-doc")
    x.add_argument("text")
    x = sub.add_parser("force-recheck", help="write a version in which documents are due now")
    x.add_argument("--doc-id")
    x.add_argument("--status", default="error")
    x.add_argument("--limit", type=int)
    x = sub.add_parser("run-once", help="ingest fetched pages (Parquet) as the next version")
    x.add_argument("pages")
    x.add_argument("--batch", type=int, required=True)
    x = sub.add_parser("ingest-stream", help="ingest a folder of fetched pages until none is left")
    x.add_argument("pages")
    x.add_argument("--checkpoint", required=True)
    x = sub.add_parser("export-corpus")
    x.add_argument("out")
    x.add_argument("--since", default="1970-01-01")
    x = sub.add_parser("index-folder", help="write the keyword index of a folder of HTML files")
    x.add_argument("root")
    x = sub.add_parser("backfill", help="queue the calendar pages of a range of days")
    x.add_argument("start")
    x.add_argument("end")
    x.add_argument("--base", default="https://docs.example.org")
    x = sub.add_parser("search")
    x.add_argument("question")
    x = sub.add_parser("ask")
    x.add_argument("question")
    x.add_argument("--structured", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"{a.path}/work")
    now = F.current_timestamp()
    if a.command == "doctor":
        for k, v in doctor(spark).items():
            print(f"{k}: {'yes' if v else 'no'}")
        return 0
    if a.command in ("run-once", "force-recheck", "rebuild-index", "backfill"):
        with RunLock(spark, f"{a.path}/lock"):
            if a.command == "run-once":
                merge_batch(spark.read.parquet(a.pages), a.batch, a.path)
            elif a.command == "rebuild-index":
                rebuild_index(read_snapshot(spark, a.path), a.path)
            elif a.command == "backfill":
                queue = state.backfill(read_queue(spark, f"{a.path}/queue"), a.start, a.end, a.base, now, int(time.time() * 1e6))
                print("queue version", write_queue(spark, f"{a.path}/queue", queue))
            else:
                old = read_snapshot(spark, a.path)
                due = state.force_recheck(old.documents, now, doc_id=a.doc_id, status=a.status, limit=a.limit)
                print("version", write_snapshot(spark, a.path, Snapshot(due, old.chunks)))
        return 0
    if a.command == "ingest-stream":
        schema = spark.read.parquet(a.pages).schema
        stream(spark.readStream.schema(schema).parquet(a.pages), a.path, a.checkpoint).awaitTermination()
        return 0
    if a.command == "index-folder":
        sinks.index_folder(spark, a.root, f"{a.path}/index").show()
        return 0
    if a.command == "search":
        keyword_search(spark, a.path, a.question).show(truncate=False)
        return 0
    if a.command == "ask":
        print(json.dumps(ask(spark, a.path, json.dumps({"question": a.question, "structured": a.structured})), ensure_ascii=False, indent=1))
        return 0
    snapshot = read_snapshot(spark, a.path)
    if a.command == "stats":
        none = spark.createDataFrame([], "active int")
        state.stats(snapshot.documents, read_queue(spark, f"{a.path}/queue"), snapshot.chunks, snapshot.vectors if snapshot.vectors is not None else none).show()
    elif a.command == "chunk-counts":
        chunk_counts(snapshot).show(50, truncate=False)
    elif a.command == "schema":
        for name, df in (("documents", snapshot.documents), ("chunks", snapshot.chunks)):
            print(name, *[f"{c} {t}" for c, t in schema_of(df)], sep="\n  ")
    elif a.command == "list-docs":
        list_documents(snapshot.documents, a.status, a.limit).show(a.limit, truncate=80)
    elif a.command == "show-doc":
        find_documents(snapshot.documents, a.text).show(5, truncate=False, vertical=True)
    elif a.command == "export-corpus":
        print(sinks.corpus(snapshot.documents, a.out, a.since).count(), "documents")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
