"""Ingest as a stream: micro-batches merge into versioned snapshots.

A snapshot's tables are cut into buckets by a hash of the key.  A batch reads and writes the
buckets that it touches; a version's manifest says in which version each bucket was written
last.  Its marker is written at the end, so a version is there whole or not at all.  The last
versions are kept, and buckets that none of them names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.config import Settings
from quarry.operators import state
from quarry.plans.ingest import CHUNKS, DOCUMENTS, Snapshot, ingest
from quarry.storage import place

BUCKETS, KEPT = 64, 3


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions under path, oldest first."""
    at, files = place(spark, path)
    if not files.exists(at):
        return []
    names = [x.getPath().getName() for x in files.listStatus(at)]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if files.exists(place(spark, f"{path}/v{v}/_DONE/_SUCCESS")[0]))


def _manifest(spark: SparkSession, path: str, before: int | None) -> dict:
    """The last complete version's manifest, earlier than ``before`` if given."""
    done = [v for v in versions(spark, path) if before is None or v < before]
    if not done:
        return {"buckets": None, "tables": {}}
    return json.loads(spark.read.text(f"{path}/v{done[-1]}/_DONE").first().value)


def _read(spark: SparkSession, path: str, manifest: dict, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """A table of a version, or some of its buckets."""
    held = manifest["tables"].get(name, {})
    some = [f"{path}/v{v}/{name}/bucket={b}" for b, v in held.items() if only is None or int(b) in only]
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(empty.schema).parquet(*some) if some else empty


def _write(spark: SparkSession, path: str, batch: int, manifest: dict, tables: dict[str, tuple[DataFrame, str]], touched: list[int], buckets: int, kept: int) -> None:
    """Version ``batch``: new files for the touched buckets, and where the others are."""
    after = {"batch": batch, "buckets": buckets, "tables": {}}
    for name, (df, key) in tables.items():
        df.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{batch}/{name}")
        at, files = place(spark, f"{path}/v{batch}/{name}")
        new = {x.getPath().getName().removeprefix("bucket=") for x in files.listStatus(at) if x.isDirectory()}
        old = {b: v for b, v in manifest["tables"].get(name, {}).items() if int(b) not in touched}
        after["tables"][name] = old | {b: batch for b in new}
    spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/v{batch}/_DONE")
    _expire(spark, path, kept)


def _expire(spark: SparkSession, path: str, kept: int) -> None:
    """Remove what the last ``kept`` versions don't name."""
    done = versions(spark, path)
    live = {v for v in done[-kept:]}
    used = {(n, b, v) for last in live for n, held in json.loads(spark.read.text(f"{path}/v{last}/_DONE").first().value)["tables"].items() for b, v in held.items()}
    for v in (x for x in done if x not in live):
        named = {(n, b) for n, b, w in used if w == v}
        root, files = place(spark, f"{path}/v{v}")
        if not named:
            files.delete(root, True)
            continue
        for folder in [x.getPath() for x in files.listStatus(root) if x.isDirectory() and x.getPath().getName() != "_DONE"]:
            for b in [x.getPath() for x in files.listStatus(folder) if x.isDirectory()]:
                if (folder.getName(), b.getName().removeprefix("bucket=")) not in named:
                    files.delete(b, True)


def read_snapshot(spark: SparkSession, path: str, before: int | None = None) -> Snapshot:
    m = _manifest(spark, path, before)
    return Snapshot(_read(spark, path, m, "documents", DOCUMENTS), _read(spark, path, m, "chunks", CHUNKS))


def write_snapshot(spark: SparkSession, path: str, snapshot: Snapshot, buckets: int = BUCKETS, kept: int = KEPT) -> int:
    """The snapshot as a whole new version, and its number."""
    done = versions(spark, path)
    m = _manifest(spark, path, None)
    n, batch = m["buckets"] or buckets, (done[-1] if done else -1) + 1
    _write(spark, path, batch, {"tables": {}}, {"documents": (snapshot.documents, "doc_id"), "chunks": (snapshot.chunks, "doc_id")}, list(range(n)), n, kept)
    return batch


#: What is sent for a document: see ``messages``.
Notify = Callable[[DataFrame], None]


def messages(results: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, outcome and message of the documents that are new or updated in a batch."""
    some = results.filter(F.col("outcome").isin("new", "updated")).select("doc_id", "outcome")
    n = chunks.filter("active = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = some.join(pages.select("doc_id", "title", "url"), "doc_id").join(n, "doc_id", "left")
    head = F.when(F.col("outcome") == "new", "New document").otherwise("Updated document")
    text = F.concat_ws("\n", head, F.coalesce(F.nullif("title", F.lit("")), F.lit("(no title)")), "url", F.concat(F.lit("chunks: "), F.coalesce("n", F.lit(0)).cast("string")))
    return rows.select("doc_id", "outcome", text.alias("message"))


def merge_batch(
    pages: DataFrame, batch: int, path: str, s: Settings = Settings(), now: str | None = None, notify: Notify | None = None, buckets: int = BUCKETS, kept: int = KEPT
) -> None:
    """Write version ``batch`` of the snapshot with a batch of fetched pages merged in.

    A batch that is run again starts from the version before it and writes the same
    version, so a restart after a failure changes nothing.  notify gets the messages of
    documents that are new or updated once the version is there, again if it is run again.
    """
    spark = pages.sparkSession
    m = _manifest(spark, path, batch)
    n = m["buckets"] or buckets
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    one = pages.dropDuplicates(["doc_id"])
    # Numbers below ``buckets`` reach the driver.
    touched = [r.b for r in one.select(bucket_of(F.col("doc_id"), n).alias("b")).distinct().collect()]
    before = Snapshot(_read(spark, path, m, "documents", DOCUMENTS, touched), _read(spark, path, m, "chunks", CHUNKS, touched))
    after, results = ingest(before, one, at, s)
    results.write.mode("overwrite").parquet(f"{path}/v{batch}/results")
    _write(spark, path, batch, m, {"documents": (after.documents, "doc_id"), "chunks": (after.chunks, "doc_id")}, touched, n, kept)
    if notify:
        new = _read(spark, path, _manifest(spark, path, batch + 1), "chunks", CHUNKS, touched)
        notify(messages(spark.read.parquet(f"{path}/v{batch}/results"), one, new))


def stream(pages: DataFrame, path: str, checkpoint: str, s: Settings = Settings(), now: str | None = None, notify: Notify | None = None) -> StreamingQuery:
    """Start a query that ingests a stream of fetched pages until none is left."""
    return (
        pages.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, path, s, now, notify))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_queue(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    return _read(spark, path, _manifest(spark, path, before), "queue", state.QUEUE)


def write_queue(spark: SparkSession, path: str, queue: DataFrame, buckets: int = BUCKETS, kept: int = KEPT) -> int:
    """The queue as a whole new version, and its number."""
    done = versions(spark, path)
    n, batch = _manifest(spark, path, None)["buckets"] or buckets, (done[-1] if done else -1) + 1
    _write(spark, path, batch, {"tables": {}}, {"queue": (queue, "url")}, list(range(n)), n, kept)
    return batch


def merge_queue(new: DataFrame, batch: int, path: str, buckets: int = BUCKETS, kept: int = KEPT) -> None:
    """Write version ``batch`` of the queue with a batch of enqueue rows merged in."""
    spark = new.sparkSession
    m = _manifest(spark, path, batch)
    n = m["buckets"] or buckets
    touched = [r.b for r in new.select(bucket_of(F.col("url"), n).alias("b")).distinct().collect()]
    _write(spark, path, batch, m, {"queue": (state.enqueue(_read(spark, path, m, "queue", state.QUEUE, touched), new), "url")}, touched, n, kept)


def stream_queue(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that merges a stream of enqueue rows into a queue snapshot."""
    return events.writeStream.foreachBatch(lambda df, i: merge_queue(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


