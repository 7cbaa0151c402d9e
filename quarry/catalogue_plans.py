"""Registered queries of state, index, vector and retrieval plans, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import catalogue
from quarry.operators import chunking, ranking, results, search, state, vectors
from quarry.plans import answer, ingest, retrieve
from quarry.registry import SQL, query, table
from quarry.sources import sinks
from quarry.storage import place, shared_dir, written

# State --------------------------------------------------------------------------------

_AT = "TIMESTAMP '2024-02-01 00:00:00'"
_QUEUED = f"""
SELECT 'u' || user_id AS url, max(CASE WHEN user_id % 3 = 0 THEN 'd' || user_id END) AS doc_id, CAST(user_id % 4 AS INTEGER) AS priority, CAST(user_id % 5 AS INTEGER) AS attempts,
  CASE WHEN user_id % 5 > 0 THEN 'old' END AS last_error, min(ts) AS scheduled_at, max(ts) AS updated_at FROM events GROUP BY user_id"""


def _queue(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("scheduled_at"), F.max("ts").cast("timestamp").alias("updated_at"), F.max("event_id").alias("seq")).select(
        F.expr("'u' || user_id").alias("url"), F.expr("CASE WHEN user_id % 3 = 0 THEN 'd' || user_id END").alias("doc_id"), F.lit("calendar").alias("reason"), (u % 4).cast("int").alias("priority"),
        "scheduled_at", (u % 5).cast("int").alias("attempts"), F.when(u % 5 > 0, "old").alias("last_error"), F.col("scheduled_at").alias("created_at"), "updated_at", "seq",
    )


def _at():
    return F.expr(_AT.replace("TIMESTAMP ", "TIMESTAMP"))


@query(f"""
WITH q AS ({_QUEUED}), f AS (SELECT 'u' || user_id AS url, max(event_type) AS e FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id)
SELECT url, CAST(attempts + CASE WHEN e IS NULL THEN 0 ELSE 1 END AS INTEGER) AS attempts, coalesce(e, last_error) AS last_error,
  CAST(epoch_us(CASE WHEN e IS NULL THEN scheduled_at ELSE {_AT} + to_days(CAST(pow(2, attempts) AS INTEGER)) END) AS BIGINT) AS due_us, CAST(epoch_us(CASE WHEN e IS NULL THEN updated_at ELSE {_AT} END) AS BIGINT) AS updated_us FROM q LEFT JOIN f USING (url)""")
def mark_attempts(spark, sf_dir):
    failed = table(spark, sf_dir, "events").filter("event_type IN ('error', 'click')").select(F.expr("'u' || user_id").alias("url"), F.col("event_type").alias("error"))
    out = state.mark_attempt(_queue(spark, sf_dir), failed, _at())
    return out.select("url", "attempts", "last_error", F.unix_micros("scheduled_at").alias("due_us"), F.unix_micros("updated_at").alias("updated_us"))


@query(f"WITH q AS ({_QUEUED}) SELECT url, doc_id, priority FROM q WHERE url NOT IN (SELECT 'u' || user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 1)")
def queue_removed(spark, sf_dir):
    done = table(spark, sf_dir, "events").filter("event_type = 'signup' AND user_id % 3 = 1").select(F.expr("'u' || user_id").alias("url"))
    return state.remove(_queue(spark, sf_dir), done).select("url", "doc_id", "priority")


@query("""
WITH old AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'http://old/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'title ' || doc_id END AS title, lang FROM documents),
seen AS (SELECT CAST(user_id * 3 AS VARCHAR) AS doc_id, 'https://new/' || max_by(event_id, ts) AS url, CASE WHEN user_id % 2 = 1 THEN max_by(event_type, ts) END AS title, max(ts) AS now FROM events GROUP BY user_id)
SELECT doc_id, coalesce(s.url, o.url) AS url, coalesce(s.title, o.title) AS title, o.lang AS lang, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE 'ok' END AS status,
  CAST(epoch_us(CASE WHEN o.doc_id IS NULL THEN now ELSE TIMESTAMP '2023-01-01 00:00:00' END) AS BIGINT) AS first_us, CAST(epoch_us(coalesce(now, TIMESTAMP '2023-01-01 00:00:00')) AS BIGINT) AS last_us
FROM old o FULL JOIN seen s USING (doc_id)""")
def placeholder_upsert(spark, sf_dir):
    then = F.expr("TIMESTAMP'2023-01-01 00:00:00'")
    old = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.expr("'http://old/' || doc_id").alias("url"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'title ' || doc_id END").alias("title"), "lang",
        F.lit(None).cast("date").alias("source_date"), then.alias("first_seen_at"), then.alias("last_seen_at"), F.lit("ok").alias("status"),
    )
    seen = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 3).cast("string").alias("doc_id"), F.expr("'https://new/' || event_id").alias("url"), F.expr("CASE WHEN user_id % 2 = 1 THEN event_type END").alias("title"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("date").alias("source_date"), F.col("ts").cast("timestamp").alias("now"),
    )
    out = state.placeholders(old, seen)
    return out.select("doc_id", "url", "title", "lang", "status", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"))


#: Documents with a check due by their last event; calendar pages found for some.
_DUE = "SELECT 'd' || user_id AS doc_id, 'v' || user_id AS url, max(ts) AS next_recheck_at FROM events GROUP BY user_id"


@query(f"""
WITH q AS ({_QUEUED}), soon AS (SELECT url, doc_id FROM ({_DUE}) WHERE next_recheck_at <= {_AT} ORDER BY next_recheck_at, doc_id LIMIT 6),
found AS (SELECT 'u' || user_id AS url, 'n' || user_id AS doc_id FROM events WHERE user_id % 10 = 1 GROUP BY user_id),
x AS (SELECT url, coalesce(f.doc_id, q.doc_id) AS doc_id, CAST(greatest(coalesce(q.priority, 0), CASE WHEN f.url IS NULL THEN 0 ELSE 3 END) AS INTEGER) AS priority, least(coalesce(scheduled_at, {_AT}), {_AT}) AS due, CAST(coalesce(attempts, 0) AS INTEGER) AS attempts FROM q FULL JOIN found f USING (url)),
y AS (SELECT * FROM x UNION ALL SELECT url, doc_id, 1, {_AT}, 0 FROM soon)
SELECT url, doc_id, priority, attempts FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, due, url) AS r FROM y WHERE due <= {_AT}) WHERE r <= 15""")
def run_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    documents = e.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("next_recheck_at")).select(F.expr("'d' || user_id").alias("doc_id"), F.expr("'v' || user_id").alias("url"), "next_recheck_at")
    found = e.filter("user_id % 10 = 1").select(F.expr("'u' || user_id").alias("url"), F.expr("'n' || user_id").alias("doc_id")).distinct()
    _, batch = state.plan_run(_queue(spark, sf_dir), documents, found, _at(), seq=1 << 40)
    return batch.select("url", "doc_id", "priority", "attempts")


@query(f"""
WITH q AS ({_QUEUED}), soon AS (SELECT url, doc_id FROM ({_DUE}) WHERE next_recheck_at <= {_AT} ORDER BY next_recheck_at, doc_id LIMIT 9)
SELECT url, doc_id, 'calendar' AS reason, priority FROM q UNION ALL SELECT url, doc_id, 'recheck', 1 FROM soon""")
def scheduled_rechecks(spark, sf_dir):
    documents = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("next_recheck_at")).select(F.expr("'d' || user_id").alias("doc_id"), F.expr("'v' || user_id").alias("url"), "next_recheck_at")
    return state.schedule_rechecks(_queue(spark, sf_dir), documents, _at(), 9, 1 << 40).select("url", "doc_id", "reason", "priority")


@query(f"""
WITH d AS (SELECT DATE '2023-12-20' + CAST(i AS INTEGER) AS day FROM generate_series(0, 44) AS g(i))
SELECT 'https://e.org/calendar?date=' || strftime(day, '%d.%m.%Y') || '&lang=uz' AS url, 1 AS attempts, 'timeout' AS last_error, 2 AS priority, CAST(epoch_us({_AT} + INTERVAL 1 DAY) AS BIGINT) AS due_us FROM d WHERE day(day) % 7 = 0""")
def backfill_drain(spark, sf_dir):
    queue = state.backfill(spark.createDataFrame([], state.QUEUE), "2024-02-02", "2023-12-20", "https://e.org", _at(), 1)
    failing = F.regexp_extract("url", r"date=(\d\d)", 1).cast("int") % 7 == 0
    left = state.drain(queue, lambda due: due.select("url", F.when(failing, "timeout").alias("error")), _at())
    return left.select("url", "attempts", "last_error", "priority", F.unix_micros("scheduled_at").alias("due_us"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'u' || doc_id AS url, lang AS title, CASE WHEN doc_id % 4 <> 0 THEN strftime(TIMESTAMP '2024-01-01 06:00:00' + to_hours(CAST(doc_id % 48 AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00') END AS last_changed_at,
  strftime(TIMESTAMP '2024-01-01 06:00:00' + to_hours(CAST(doc_id % 48 AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00') AS last_fetched_at, doc_id || '.txt' AS file FROM documents WHERE doc_id % 48 >= 18 AND doc_id % 5 > 1""")
def corpus_manifest(spark, sf_dir):
    at = F.expr("timestampadd(HOUR, CAST(doc_id % 48 AS INT), TIMESTAMP'2024-01-01 06:00:00')")
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.expr("'u' || doc_id").alias("url"), F.col("lang").alias("title"), F.when(F.col("doc_id") % 4 != 0, at).alias("last_changed_at"),
        at.alias("last_fetched_at"), F.expr("CASE WHEN doc_id % 5 > 1 THEN text WHEN doc_id % 5 = 1 THEN '' END").alias("clean_text"),
    )
    return sinks.manifest(d, "2024-01-02 00:00:00")


# Index --------------------------------------------------------------------------------

_WINDOWS = """
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(generate_series(0, CASE WHEN len(ws) <= 350 THEN 0 ELSE CAST(ceil((len(ws) - 350) / 290.0) AS BIGINT) END)) AS i FROM w WHERE len(ws) > 0),
chunks AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(list_slice(ws, i * 290 + 1, i * 290 + 350), ' ') AS text FROM c)"""
_FOLDED = "regexp_extract_all(translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+')"
_WEIGHT = "CASE WHEN ln((rows_all - df + 0.5) / (df + 0.5)) > 0 THEN ln((rows_all - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg_d))"


@query(f"""
WITH {_WINDOWS}, rows AS (SELECT doc_id, chunk_index, CASE WHEN doc_id % 2 = 0 THEN 'the ' || coalesce(lang, '') ELSE 'aux ' || doc_id END AS title, c.text FROM chunks c JOIN documents d USING (doc_id) WHERE doc_id % 5 <> 4),
tok AS (SELECT doc_id, chunk_index, 6.0 AS w, unnest({_FOLDED.format(c="title")}) AS term FROM rows UNION ALL SELECT doc_id, chunk_index, 1.0, unnest({_FOLDED.format(c="text")}) FROM rows),
sizes AS (SELECT doc_id, chunk_index, count(*) AS d FROM tok GROUP BY 1, 2), st AS (SELECT count(*) AS rows_all, avg(d) AS avg_d FROM sizes),
q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'with'), (2, 'aux'), (2, 'nicht')) AS q(query_id, term)),
f AS (SELECT term, doc_id, chunk_index, CAST(sum(w) AS DOUBLE) AS f FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT query_id, doc_id, chunk_index, round(-sum({_WEIGHT}), 6) + 0.0 AS bm25 FROM q JOIN f USING (term) JOIN df USING (term) JOIN sizes USING (doc_id, chunk_index), st GROUP BY ALL""")
def stored_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = chunking.chunk_words(d.select("doc_id", "text")).select("doc_id", "chunk_index", F.col("chunk_text").alias("text"), F.when(F.col("doc_id") % 5 != 4, 1).otherwise(0).alias("active"))
    named = d.select("doc_id", F.expr("'u' || doc_id").alias("url"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'the ' || coalesce(lang, '') ELSE 'aux ' || doc_id END").alias("title"))
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    sinks.search_index(rows, named, path)
    at, store = place(spark, path)
    store.deleteOnExit(at)
    asked = spark.createDataFrame([(1, "the with"), (2, "aux Nicht")], "query_id int, query string")
    return search.stored_hits(spark, path, search.terms(asked), ["doc_id", "chunk_index"])


@query("""
WITH h AS (SELECT doc_id, -CAST(doc_id % 13 AS DOUBLE) AS bm25 FROM documents)
SELECT doc_id, bm25 + 0.0 AS bm25, round(CAST(bm25 - CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (year(DATE '2012-01-01' + CAST(doc_id * 7 % 4000 AS INTEGER)) - 2020) * 0.3 END AS DOUBLE), 6) + 0.0 AS rank FROM h""")
def recency_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = d.select("doc_id", (-(F.col("doc_id") % 13)).cast("double").alias("bm25"))
    days = d.filter("doc_id % 3 > 0 OR doc_id % 2 = 0").select("doc_id", F.expr("CASE WHEN doc_id % 3 > 0 THEN date_add(DATE'2012-01-01', CAST(doc_id * 7 % 4000 AS INT)) END").alias("source_date"))
    return search.with_recency(hits, days).select("doc_id", (F.col("bm25") + 0.0).alias("bm25"), (F.round("rank", 6) + 0.0).alias("rank"))


# Vectors ------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, i, x, pow(2.0, greatest(floor(log2(greatest(abs(x), pow(2.0, -24)))), -14) - 10) AS step FROM v)
SELECT vec_id, CAST(i AS INTEGER) AS i, round_even(x / step, 0) * step + 0.0 AS x FROM s""")
def half_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.half_precision(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", "i", (F.col("x").cast("double") + 0.0).alias("x"))


#: Vectors of chunks: some retired, some of retired chunks, some of another dimension.
_VECTORS = "SELECT vec_id AS vector_id, vec_id AS chunk_id, vec_id // 3 AS doc_id, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 1 END AS active, CASE WHEN vec_id % 13 = 0 THEN 0 ELSE 1 END AS chunk_active, CASE WHEN vec_id % 17 = 0 THEN 32 ELSE 64 END AS dim FROM embeddings"


def _indexed(spark, sf_dir):
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(i.alias("vector_id"), i.alias("chunk_id"), F.floor(i / 3).alias("doc_id"), F.when(i % 11 == 0, 0).otherwise(1).alias("active"), F.when(i % 13 == 0, 0).otherwise(1).alias("chunk_active"), F.when(i % 17 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return e.drop("chunk_active", "doc_id"), e.select("chunk_id", "doc_id", F.col("chunk_active").alias("active"))


@query(f"""
WITH v AS ({_VECTORS}), built AS (SELECT vector_id FROM v WHERE active = 1 AND chunk_active = 1 AND dim = 64 AND vector_id % 7 <> 2)
SELECT vector_id, CAST(CASE WHEN vector_id % 7 = 3 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS norm FROM built UNION SELECT vector_id, 0.0 FROM v WHERE vector_id % 7 = 3""")
def vector_index_upkeep(spark, sf_dir):
    v, c = _indexed(spark, sf_dir)
    index = vectors.removed(vectors.rebuilt(v, c, 64), v.filter("vector_id % 7 = 2"))
    new = v.filter("vector_id % 7 = 3").select("vector_id", F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"))
    return vectors.appended(index, new, 64).select("vector_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


@query(f"WITH v AS ({_VECTORS}) SELECT vector_id, doc_id FROM v WHERE active = 1 AND chunk_active = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def retired_vectors(spark, sf_dir):
    v, c = _indexed(spark, sf_dir)
    return vectors.vectors_of(c, v, table(spark, sf_dir, "labels").filter("quality = 0"))


#: The hashing embedder in SQL: signed counts of words by a hash, normalised in 32 bits.
_EMBED = """
{n}_w AS (SELECT {key}, unnest(regexp_extract_all(lower({prefix}{text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {table}),
{n}_h AS (SELECT {key}, CAST('0x' || left(md5(w), 8) AS BIGINT) AS h FROM {n}_w),
{n}_d AS (SELECT {key}, h % 64 AS i, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS FLOAT) AS x FROM {n}_h GROUP BY ALL),
{n}_n AS (SELECT {key}, CAST(sqrt(sum(x * x)) AS FLOAT) AS n FROM {n}_d GROUP BY ALL),
{n} AS (SELECT {key}, i, CAST(CAST(x AS DOUBLE) / n AS FLOAT) AS x FROM {n}_d JOIN {n}_n USING ({key}) WHERE x <> 0)"""


def _embed_sql(name: str, key: str, text: str, source: str, prefix: str = "") -> str:
    return _EMBED.format(n=name, key=key, text=text, table=source, prefix=f"'{prefix}' || " if prefix else "")


@query("WITH " + _embed_sql("e", "doc_id", "text", "documents", "passage: ") + " SELECT doc_id, CAST(i AS INTEGER) AS i, round(CAST(x AS DOUBLE), 6) AS x FROM e")
def passage_embeddings(spark, sf_dir):
    e = vectors.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.posexplode("embedding").alias("i", "x")).filter("x <> 0").select("doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS c FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM r WHERE c <= 90 AND vec_id % 5 > 1)
SELECT query_id, vec_id, CAST(pos AS INTEGER) AS pos FROM a WHERE pos <= 15""")
def over_fetched_hits(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = vectors.top_k(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 200, metric="ip")
    return search.over_fetched(hits.drop("pos"), v.filter("vec_id % 5 > 1"), 15, "score", "vec_id").select("query_id", "vec_id", "pos")


# Result lists and ranking -------------------------------------------------------------


@query("""
WITH l AS (SELECT CAST(page_id % 4 AS BIGINT) AS query_id, page_id AS ord, url, CAST(len(html) // 500 AS INTEGER) AS n_words FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_words DESC, ord) AS pos FROM l)
SELECT query_id, url, n_words, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 10""")
def longest_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("query_id"), F.col("page_id").alias("pos"), "url", F.floor(F.length("html") / 500).cast("int").alias("n_words"))
    return results.longest(p).select("query_id", "url", "n_words", "pos")


@query("""
WITH c AS (SELECT CAST(doc_id % 23 AS BIGINT) AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 23 ORDER BY doc_id) AS ord, length(left(text, 4000)) - doc_id % 50 AS s, count(*) OVER (PARTITION BY doc_id % 23) AS n FROM documents WHERE doc_id % 23 < 22 OR doc_id < 100)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 5 THEN s END DESC NULLS LAST, ord) AS INTEGER) AS pos FROM c""")
def reranked(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 23 < 22 OR doc_id < 100").select((F.col("doc_id") % 23).alias("query_id"), "doc_id", F.col("text").alias("chunk_text"), (F.col("doc_id") % 50).alias("question"))
    rows = results.renumber(d, "doc_id")
    return ranking.rerank(rows, lambda q, p: F.length(p) - q, 5).select("query_id", "doc_id", "pos")


_STAGE = """
WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0),
rows AS (SELECT query_id, CAST(page_id AS BIGINT) AS item_id, {text} AS text, {url} AS url FROM q, pages {where}),
""" + (_embed_sql("eq", "query_id", "query", "q") + "," + _embed_sql("er", "query_id, item_id", "text", "rows")).replace("{", "{{").replace("}", "}}") + """,
dots AS (SELECT r.query_id, r.item_id, sum(CAST(r.x AS DOUBLE) * CAST(e.x AS DOUBLE)) AS dot FROM er r JOIN eq e ON e.query_id = r.query_id AND e.i = r.i GROUP BY ALL),
nr AS (SELECT query_id, item_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM er GROUP BY ALL), nq AS (SELECT query_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM eq GROUP BY ALL),
cs AS (SELECT r.query_id, r.item_id, coalesce(dot, 0.0) / (coalesce(nr.n, 0.0) * nq.n + 1e-9) AS cos FROM rows r JOIN nq USING (query_id) LEFT JOIN nr USING (query_id, item_id) LEFT JOIN dots USING (query_id, item_id)),
qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]{{2,}}'))) AS term FROM q),
tf AS (SELECT query_id, item_id, term, count(*) AS tf FROM (SELECT query_id, item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{2,}}')) AS term FROM rows) JOIN qt USING (query_id, term) GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT query_id, count(*) AS n_all FROM rows GROUP BY 1),
b0 AS (SELECT query_id, item_id, sum(ln((n_all - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2)) AS s FROM tf JOIN df USING (query_id, term) JOIN n USING (query_id) GROUP BY ALL),
b AS (SELECT r.query_id, r.item_id, r.url, round(coalesce(s, 0.0), 6) AS bm25 FROM rows r LEFT JOIN b0 USING (query_id, item_id)),
h AS (SELECT b.*, round(CAST(0.7 * (cos + 1) / 2 + 0.3 * (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w + 1e-9) + CASE WHEN contains(url, 'docs.example.org') THEN 0.35 ELSE 0.0 END AS DOUBLE), 6) AS score FROM b JOIN cs USING (query_id, item_id) WINDOW w AS (PARTITION BY query_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM h)
"""
_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[ >].*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
_SITE_URL = "CASE WHEN page_id % 3 = 0 THEN 'https://docs.example.org/docs/' || page_id ELSE url END"


def _asked_pages(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[ >].*?</(script|style)>", " "), "<[^>]*>", " ")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.expr(_SITE_URL.replace("|| page_id", "|| CAST(page_id AS STRING)")).alias("url"), F.expr("'t' || page_id").alias("title"), F.trim(F.regexp_replace(plain, "[ \t\n\r]+", " ")).alias("page_text"))
    return q, p.crossJoin(F.broadcast(q.select("query_id")))  # the stated queries


@query(_STAGE.format(text=f"'t' || page_id || ' ' || left({_STRIPPED}, 220) || ' ' || {_SITE_URL}", url=_SITE_URL, where="WHERE page_id % 3 = 0") + "SELECT query_id, item_id, CAST(r AS INTEGER) AS pos FROM o WHERE r <= 10")
def stage1_documents(spark, sf_dir):
    q, p = _asked_pages(spark, sf_dir)
    return retrieve.stage1(q, p.withColumn("snippet", F.left("page_text", F.lit(220)))).select("query_id", "item_id", "pos")


@query(_STAGE.format(text=f"'t' || page_id || ' s ' || {_STRIPPED}", url=_SITE_URL, where="") + """, g AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ORDER BY r) AS g FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS pos FROM g WHERE g <= 2)
SELECT query_id, url, CAST(pos AS INTEGER) AS pos FROM f WHERE pos <= 5""")
def full_document_search(spark, sf_dir):
    q, p = _asked_pages(spark, sf_dir)
    return retrieve.full_documents(q, p.withColumn("snippet", F.lit("s"))).select("query_id", "url", "pos")


def _two_stage_sql() -> str:
    """The scored stage over chunks of pages, then diversity and caps."""
    body = catalogue._STRIP.format(c="html")
    rows = f"""
WITH q AS (SELECT query_id, 'the ' || w || ' and' AS query FROM (VALUES (0, 'with'), (1, 'que'), (2, 'nicht'), (3, 'para'), (4, 'from')) AS v(query_id, w)),
pg AS (SELECT page_id % 5 AS query_id, url, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title, {body} AS text FROM pages),
t AS (SELECT query_id, url, title, left(text, 220) AS snippet, text, regexp_extract_all(text, '\\bThe\\b') AS heads, regexp_split_to_array(text, '\\bThe\\b') AS bodies, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM pg),
blocks AS (SELECT query_id, url, title, snippet, i - 1 AS i, trim(heads[i] || ' ' || bodies[i + 1]) AS block FROM (SELECT *, unnest(generate_series(1, len(heads))) AS i FROM t WHERE len(heads) >= 2)
  UNION ALL SELECT query_id, url, title, snippet, i, CASE WHEN len(ws) <= 150 THEN text ELSE array_to_string(list_slice(ws, i * 130 + 1, i * 130 + 150), ' ') END
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN len(ws) <= 150 THEN 0 ELSE CAST(ceil((len(ws) - 150) / 130.0) AS BIGINT) END)) AS i FROM t WHERE len(heads) < 2 AND text <> '')),
rows AS (SELECT query_id, url, CAST(i AS INTEGER) AS chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY url, i) AS item_id, title || ' ' || snippet || ' ' || block AS text FROM blocks),
"""
    stage = _STAGE.split("{where}),\n", 1)[1].format().replace("h AS (SELECT b.*,", "h AS (SELECT b.*, cos,")
    vector = "SELECT query_id, item_id, list(coalesce(x, 0.0) ORDER BY g.i) AS v FROM (SELECT query_id, item_id, i FROM o, generate_series(0, 63) AS k(i) WHERE r <= 15) g LEFT JOIN er USING (query_id, item_id, i) GROUP BY ALL"
    unit = "CASE WHEN list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) > 0 THEN list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))) ELSE CAST(v AS DOUBLE[]) END"
    pool = f"SELECT query_id, item_id, cos AS score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item_id) AS r, {unit} AS u FROM o JOIN vs USING (query_id, item_id) WHERE o.r <= 15"
    return rows + stage + f", vs AS ({vector}), " + catalogue._mmr_sql(pool) + """,
g AS (SELECT query_id, m.pos, url, chunk_index, score, row_number() OVER (PARTITION BY query_id, url ORDER BY m.pos) AS g FROM mmr m JOIN o USING (query_id, item_id) JOIN (SELECT query_id, item_id, chunk_index FROM rows) USING (query_id, item_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM g WHERE g <= 2)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(p AS INTEGER) AS pos, url, chunk_index, score FROM f WHERE p <= 5"""


SQL["hybrid_two_stage"] = _two_stage_sql()


@query("""
WITH c AS (SELECT conv_id AS query_id, max(CASE WHEN role = 'user' THEN text END) AS q, max_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT query_id, CASE WHEN regexp_replace(coalesce(q, ''), '^\\s+', '') = '' THEN 'question is missing' END AS error, CASE WHEN regexp_replace(coalesce(q, ''), '^\\s+', '') = '' THEN NULL WHEN query_id % 3 = 0 THEN 'first' WHEN a IS NOT NULL THEN 'second' ELSE 'results' END AS responder FROM c""")
def answered_requests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("q"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"),
    )
    requests = c.select("query_id", F.to_json(F.struct(F.col("q").alias("question"), F.lit(True).alias("structured"))).alias("request"))
    found = requests.select("query_id", F.lit(1).alias("pos"), F.lit("https://docs.example.org/docs/1").alias("url"), F.lit("t").alias("title"), F.lit("s").alias("snippet"))
    said = written(c.select("query_id", "a"))
    first = answer.Provider("first", lambda rows: rows.select("query_id", F.when(F.col("query_id") % 3 == 0, F.lit("A first answer of ten characters.")).alias("answer")))
    second = answer.Provider("second", lambda rows: rows.select("query_id").join(said.select("query_id", F.col("a").alias("answer")), "query_id", "left"))
    return answer.ask(answer.parsed(requests), found, [first, second]).select("query_id", "error", "responder")
