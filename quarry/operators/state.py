"""Queue, documents and chunks as snapshots: each operator gives the next snapshot.

Plain Parquet has no MERGE, so an upsert is a union (or full outer join) of the old snapshot
and the changes, resolved by key.  Changes carry ``seq``, their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import PRIORITY, Settings
from quarry.functions.text import content_hash
from quarry.storage import written

QUEUE = "url string, doc_id string, reason string, priority int, scheduled_at timestamp, attempts int, last_error string, created_at timestamp, updated_at timestamp, seq long"


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by url: newest reason, highest priority, earliest time, last known doc_id.

    attempts, last_error and created_at of a known url stay.  new: url, doc_id, reason,
    priority, scheduled_at, now, seq.  The partial aggregation runs before the shuffle.
    """
    fresh = new.select(
        "url", "doc_id", "reason", F.col("priority").cast("int").alias("priority"), "scheduled_at", F.lit(None).cast("int").alias("attempts"),
        F.lit(None).cast("string").alias("last_error"), F.col("now").alias("created_at"), F.col("now").alias("updated_at"), "seq",
    )
    both = queue.select(*fresh.columns).unionByName(fresh)
    known = F.when(F.col("doc_id").isNotNull(), F.col("seq"))
    return both.groupBy("url").agg(
        F.max_by("doc_id", known).alias("doc_id"), F.max_by("reason", "seq").alias("reason"), F.max("priority").alias("priority"),
        F.min("scheduled_at").alias("scheduled_at"), F.coalesce(F.max("attempts"), F.lit(0)).alias("attempts"), F.max("last_error").alias("last_error"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max("seq").alias("seq"),
    )


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that with the greatest ``order``: merges must not multiply rows.

    The partial aggregation runs before the shuffle; of rows equal in order one stays.
    """
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*").select(*rows.columns)


def dequeue(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due rows, highest priority first, then earliest; nothing is locked or changed."""
    return queue.filter(F.col("scheduled_at") <= now).orderBy(F.desc("priority"), "scheduled_at", "url").limit(limit)


def mark_attempt(queue: DataFrame, failed: DataFrame, now: Column, backoff_days: int = 1) -> DataFrame:
    """One attempt more, with its error, for the urls of failed (url, error).

    A url that failed several times in a run counts once, with the last error by name.  The
    row is due again after a pause that doubles, so a drain of due rows ends.
    """
    once_ = failed.groupBy("url").agg(F.max("error").alias("e"), F.lit(True).alias("hit"))
    joined = queue.join(once_, "url", "left")
    later = F.timestamp_add("DAY", (F.lit(backoff_days) * F.pow(F.lit(2), F.least("attempts", F.lit(10)))).cast("int"), now)
    hit = F.coalesce("hit", F.lit(False))
    return joined.withColumns(
        {
            "scheduled_at": F.when(hit, later).otherwise(F.col("scheduled_at")),
            "attempts": F.col("attempts") + hit.cast("int"),
            "last_error": F.when(hit, F.col("e")).otherwise(F.col("last_error")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).drop("e", "hit")


def remove(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("url"), "url", "left_anti")


def placeholders(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents with rows for the ids seen: new url, known fields never lost to nulls.

    seen: doc_id, url, title, lang, source_date, now; of a document's rows the latest counts.
    """
    s = latest(seen.select("doc_id", "url", "title", "lang", "source_date", "now"), "doc_id", "now").select("doc_id", *[F.col(c).alias(f"n_{c}") for c in ("url", "title", "lang", "source_date", "now")])
    joined = documents.join(s, "doc_id", "full_outer")
    out = {c: F.coalesce(f"n_{c}", c) for c in ("url", "title", "lang", "source_date")}
    out |= {"first_seen_at": F.coalesce("first_seen_at", "n_now"), "last_seen_at": F.coalesce("n_now", "last_seen_at"), "status": F.coalesce("status", F.lit("new"))}
    return joined.withColumns(out).select(*documents.columns)


def recheck_due(documents: DataFrame, now: Column, limit: int) -> DataFrame:
    """Documents whose next check has come; those never fetched have none."""
    return documents.filter(F.col("next_recheck_at").isNotNull() & (F.col("next_recheck_at") <= now)).orderBy("next_recheck_at", "doc_id").limit(limit)


def schedule_rechecks(queue: DataFrame, documents: DataFrame, now: Column, limit: int, seq: int) -> DataFrame:
    due = recheck_due(documents, now, limit)
    return enqueue(queue, due.select("url", "doc_id", F.lit("recheck").alias("reason"), F.lit(PRIORITY["recheck"]).alias("priority"), now.alias("scheduled_at"), now.alias("now"), F.lit(seq).cast("long").alias("seq")))


def record_fetch(documents: DataFrame, results: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Documents after fetches: results has doc_id, error, skipped, changed, content_hash, etag, now.

    An error is kept (2000 characters) and retried soon; a skipped page waits as long as
    a good one and says so; a hash or tag that didn't come stays as it was.  Of a document's
    results the latest counts.
    """
    one = latest(results.select("doc_id", "error", "skipped", "changed", "content_hash", "etag", "now"), "doc_id", "now")
    r = one.select("doc_id", *[F.col(c).alias(f"n_{c}") for c in ("error", "skipped", "changed", "content_hash", "etag", "now")])
    j = documents.join(r, "doc_id", "left")
    hit, bad = F.col("n_now").isNotNull(), F.col("n_error").isNotNull()
    skipped = F.coalesce("n_skipped", F.lit(False))

    def after(days: int) -> Column:
        return F.timestamp_add("DAY", F.lit(days), F.col("n_now"))

    wait = F.when(bad & ~skipped, after(max(1, s.error_retry_days))).otherwise(after(s.recheck_days))
    put = {
        "status": F.when(skipped, "skipped").when(bad, "error").otherwise("ok"),
        "last_error": F.left("n_error", F.lit(2000)),
        "last_fetched_at": F.col("n_now"),
        "next_recheck_at": wait,
        "last_changed_at": F.when(~bad & F.coalesce("n_changed", F.lit(False)), F.col("n_now")).otherwise(F.col("last_changed_at")),
        "content_hash": F.coalesce("n_content_hash", "content_hash"),
        "etag": F.coalesce("n_etag", "etag"),
    }
    return j.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}).select(*documents.columns)


def deactivate(rows: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (chunks or vectors) with active 0 where key is in docs."""
    hit = docs.select(key).distinct().withColumn("hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("active", F.when(F.col("hit"), 0).otherwise(F.col("active"))).drop("hit")


def changed(documents: DataFrame, pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with new_hash and change: new, updated or unchanged.

    New means that no hash was known, so a placeholder doesn't make a page an update.
    """
    old = documents.select("doc_id", F.col("content_hash").alias("old_hash"))
    j = pages.withColumn("new_hash", content_hash(F.col(text))).join(old, "doc_id", "left")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return j.withColumn("change", state).drop("old_hash")


def force_recheck(documents: DataFrame, now: Column, *, doc_id: str | None = None, status: str | None = "error", limit: int | None = None) -> DataFrame:
    """Documents with next_recheck_at now: one, all of a status, or its top n by last_seen_at."""
    if doc_id is not None:
        return documents.withColumn("next_recheck_at", F.when(F.col("doc_id") == doc_id, now).otherwise(F.col("next_recheck_at")))
    some = documents.filter(F.col("status") == status) if status else documents
    if limit is not None:
        some = some.orderBy(F.desc("last_seen_at"), "doc_id").limit(limit)
    hit = some.select("doc_id").withColumn("hit", F.lit(True))
    return documents.join(hit, "doc_id", "left").withColumn("next_recheck_at", F.when(F.col("hit"), now).otherwise(F.col("next_recheck_at"))).drop("hit")


def repair(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents in error without a message but with active chunks are ok."""
    have = chunks.filter("active = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    fix = (F.col("status") == "error") & (F.coalesce("last_error", F.lit("")) == "") & F.coalesce("hit", F.lit(False))
    return documents.join(have, "doc_id", "left").withColumn("status", F.when(fix, "ok").otherwise(F.col("status"))).drop("hit")


def meta_set(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Key and value with the last value of each key; both have seq."""
    return meta.unionByName(new).groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def stats(documents: DataFrame, queue: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of the four tables in one row."""
    out = documents.agg(F.count(F.lit(1)).alias("documents"))
    for name, t in (("queue", queue), ("active_chunks", chunks.filter("active = 1")), ("active_vectors", vectors.filter("active = 1"))):
        out = out.crossJoin(t.agg(F.count(F.lit(1)).alias(name)))  # single rows
    return out


def plan_run(queue: DataFrame, documents: DataFrame, found: DataFrame, now: Column, s: Settings = Settings(), seq: int = 0) -> tuple[DataFrame, DataFrame]:
    """(queue, batch) of a run: what discovery found and what is due again are queued, then the first are taken.

    found: url, doc_id.  Calendar pages come before backfill, and both before rechecks.
    """
    new = found.select("url", "doc_id", F.lit("calendar").alias("reason"), F.lit(PRIORITY["calendar"]).alias("priority"), now.alias("scheduled_at"), now.alias("now"), F.lit(seq).cast("long").alias("seq"))
    queued = schedule_rechecks(enqueue(queue, new), documents, now, s.rechecks_per_run, seq)
    return queued, dequeue(queued, now, s.docs_per_run)


def finish_run(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after a run: urls without error go, the others wait (url, error)."""
    return mark_attempt(remove(queue, outcomes.filter("error IS NULL")), outcomes.filter("error IS NOT NULL"), now)


def drain(queue: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: Column, *, batch: int = 20, rounds: int = 1000) -> DataFrame:
    """The queue after due rows have been fetched ``batch`` at a time, until none is due.

    fetch gives url and error (null if well) of a batch.  Failed rows wait, so each is tried
    once, and ``rounds`` bounds the loop whatever fetch does.
    """
    queue = written(queue)
    for _ in range(rounds):
        due = written(dequeue(queue, now, batch))
        if not due.limit(1).count():
            break
        outcomes = written(fetch(due).select("url", "error"))
        silent = due.join(outcomes, "url", "left_anti").select("url", F.lit("no result").alias("error"))
        queue = written(finish_run(queue, outcomes.unionByName(silent), now))
    return queue


def backfill(queue: DataFrame, start: str, end: str, base: str, now: Column, seq: int, language: str = "uz") -> DataFrame:
    """The queue with calendar pages from start to end, both included, in either order."""
    from quarry.functions.urls import calendar_url

    a, b = sorted((start, end))
    days = queue.sparkSession.sql(f"SELECT explode(sequence(DATE'{a}', DATE'{b}')) AS day")
    new = days.select(calendar_url(F.lit(base), F.col("day"), language).alias("url"), F.lit(None).cast("string").alias("doc_id"), F.lit("backfill").alias("reason"), F.lit(PRIORITY["backfill"]).alias("priority"), now.alias("scheduled_at"), now.alias("now"), F.lit(seq).cast("long").alias("seq"))
    return enqueue(queue, new)
