"""Search, ranking, state, ingest and streaming against plain versions."""

import datetime
import random
import sqlite3

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import lines, ranking, results, search, state, vectors
from quarry.plans import ingest
from quarry.sources import files
from quarry.streaming import ingest as streaming

def now():
    return F.expr("TIMESTAMP'2024-03-01 00:00:00'")



def test_bm25_equals_sqlite(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(i, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, body)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT id, bm25(f, 0, 6.0, 1.0) FROM f WHERE f MATCH 'alpha OR zeta'").fetchall())
    df = spark.createDataFrame(rows, "id int, title string, body string")
    f, d = search.postings(df, ["id"], {"title": 6.0, "body": 1.0})
    q = search.terms(spark.createDataFrame([(1, "alpha zeta")], "query_id int, query string"))
    got = {r.id: r.bm25 for r in search.bm25(f, d, q, ["id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_snippet(spark):
    t = " ".join(f"w{i}" for i in range(40)) + " Hit é hit"
    got = spark.range(1).select(search.snippet(F.lit(t), F.array(F.lit("hit")), 5)).first()[0]
    assert got == "…w38 w39 [Hit] é [hit]"


def test_mmr_is_greedy():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(10, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v[0]
    chosen = [int(np.argmax(sim))]
    while len(chosen) < 5:
        score = {i: 0.7 * sim[i] - 0.3 * max(v[i] @ v[j] for j in chosen) for i in range(10) if i not in chosen}
        chosen.append(max(score, key=lambda i: (score[i], -i)))
    assert ranking.mmr_order(sim, v, 5, 0.7) == chosen


def test_top_k_zero_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.top_k(q, v, 2).orderBy("pos").collect()] == [(1, 2, 1.0, 1), (1, 3, 1.0, 2)]


def test_top_k_in_blocks_of_queries(spark):
    x = np.random.default_rng(2).normal(size=(50, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.pos): r.vec_id for r in vectors.top_k(q, v, 4, metric="ip", at_once=3).collect()}
    best = np.argsort(-(x[:7].astype(np.float64) @ x.T.astype(np.float64)), axis=1, kind="stable")[:, :4]
    assert got == {(i, j + 1): best[i, j] for i in range(7) for j in range(4)}
    assert vectors.top_k(q.limit(0), v, 4).count() == 0


def test_context_budget(spark):
    rows = [(1, i, "x" * 30) for i in range(1, 6)]
    got = ranking.context_lines(spark.createDataFrame(rows, "query_id int, pos int, line string"), 100).orderBy("pos").collect()
    assert [len(r.line) for r in got] == [30, 30, 30, 4]


def test_results_lists(spark):
    rows = [(1, 1, "https://docs.example.org/docs/5?x"), (1, 2, "https://docs.example.org/docs/-5"), (1, 3, "https://old.docs.example.org/docs/6"), (1, 4, "https://docs.example.org/uz/docs/7"), (1, 5, "https://docs.example.org/")]
    df = spark.createDataFrame(rows, "query_id int, pos int, url string")
    got = [(r.pos, r.url) for r in results.one_per_document(df).orderBy("pos").collect()]
    assert got == [(1, rows[1][2]), (2, rows[3][2]), (3, rows[4][2])]
    assert results.documents_only(df).count() == 4


def test_enqueue_order_and_repeat(spark):
    t = [datetime.datetime(2024, 1, d) for d in range(1, 5)]
    new = "url string, doc_id string, reason string, priority int, scheduled_at timestamp, now timestamp, seq long"
    rows = [("a", None, "recheck", 1, t[2], t[0], 1), ("a", "9", "calendar", 3, t[1], t[1], 2), ("b", None, "backfill", 2, t[0], t[2], 3), ("a", None, "backfill", 2, t[3], t[3], 4)]
    empty = spark.createDataFrame([], state.QUEUE)
    whole = state.enqueue(empty, spark.createDataFrame(rows, new))
    parts = empty
    for r in rows:
        parts = state.enqueue(parts, spark.createDataFrame([r], new))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    a = whole.filter("url = 'a'").first()
    assert (a.doc_id, a.reason, a.priority, a.scheduled_at, a.created_at) == ("9", "backfill", 3, t[1], t[0])
    failed = state.mark_attempt(whole, spark.createDataFrame([("a", "x")], "url string, error string"), now())
    assert state.dequeue(failed, now(), 5).select("url").collect()[0].url == "b"


def _fetched(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, url string, title string, text string, error string, etag string")


def _text(seed, n=200):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_ingest_states(spark):
    empty = ingest.Snapshot(spark.createDataFrame([], ingest.DOCUMENTS), spark.createDataFrame([], ingest.CHUNKS), None)
    rows = [("1", "u1", None, _text(1), None, None), ("2", "u2", None, _text(2, 500), None, "e"), ("3", "u3", None, "weak", None, None), ("4", "u4", None, None, "timeout", None)]
    s1, r1 = ingest.ingest(empty, _fetched(spark, rows), now())
    assert dict(map(tuple, r1.collect())) == {"1": "new", "2": "new", "3": "skipped", "4": "error"}
    assert {(r.doc_id, r.status) for r in s1.documents.collect()} == {("1", "ok"), ("2", "ok"), ("3", "skipped"), ("4", "error")}
    rows = [("1", "u1", None, "  " + _text(1), None, None), ("2", "u2", None, _text(3, 500), None, None)]
    s2, r2 = ingest.ingest(s1, _fetched(spark, rows), now())
    assert dict(map(tuple, r2.collect())) == {"1": "unchanged", "2": "updated"}
    active = s2.chunks.groupBy("doc_id", "active").count().collect()
    assert {tuple(r) for r in active} == {("1", 1, 1), ("2", 0, 2), ("2", 1, 2)}


def test_best_candidate(spark):
    rows = [("1", 0, "html", _text(1, 130)), ("1", 1, "pdf", _text(2, 900)), ("2", 0, "html", "x"), ("2", 1, "pdf+ocr", _text(3, 90))]
    got = ingest.best_candidates(spark.createDataFrame(rows, "doc_id string, source_rank int, source string, text string"))
    assert {(r.doc_id, r.source, r.usable) for r in got.collect()} == {("1", "html", True), ("2", "pdf+ocr", True)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), f"u{i}", None, _text(i), None, None) for i in range(9)]
    schema = _fetched(spark, rows).schema
    for k in range(3):
        _fetched(spark, rows[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.stream(source, str(tmp_path / "out"), str(tmp_path / "ck"), now="2024-03-01 00:00:00").awaitTermination()
    got = streaming.read_snapshot(spark, str(tmp_path / "out"))
    whole, _ = ingest.ingest(ingest.Snapshot(spark.createDataFrame([], ingest.DOCUMENTS), spark.createDataFrame([], ingest.CHUNKS)), _fetched(spark, rows), now())
    for a, b in ((got.documents, whole.documents), (got.chunks, whole.chunks)):
        assert a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0


def test_lines(spark):
    t = "\n".join(["QMMB 1", "page 3/9", "12", "body", "body"] * 6)
    got = lines.clean_pdf(spark.createDataFrame([(1, t)], "doc_id int, text string")).first().clean_text
    assert got == "QMMB 1\nbody"


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/-12.HTML").write_text("<title>t</title><body><p>some words here</p>")
    (tmp_path / "x.txt").write_text("no")
    rows = files.index_rows(files.html_folder(spark, str(tmp_path))).collect()
    assert [(r.doc_id, r.title, r.chunk_index, r.text) for r in rows] == [("-12", "t", 0, "some words here")]
    (tmp_path / "d.json").write_text('[{"url": "u", "text": "x"}, {"doc_id": "2", "title": "t"}]')
    assert [tuple(r) for r in files.json_documents(spark, str(tmp_path / "d.json")).collect()] == [("u", "u", "", "x"), ("2", "", "t", "")]
    days = files.calendar_pages(spark, "https://e.org", "2024-03-01", 2).orderBy("pos").collect()
    assert [r.url for r in days] == ["https://e.org/calendar?date=01.03.2024&lang=uz", "https://e.org/calendar?date=29.02.2024&lang=uz"]
    page = spark.createDataFrame([(datetime.date(2024, 3, 1), '<a class="x" href="/docs/5#a">a</a><a href="/other">'), (datetime.date(2024, 2, 29), "<a href='/docs/5'>")], "day date, html string")
    assert [tuple(r) for r in files.document_links(page, "https://e.org").collect()] == [("https://e.org/docs/5", datetime.date(2024, 3, 1), "5")]


def test_snapshot_buckets_and_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(str(i), f"u{i}", f"t{i}", _text(i), None, None) for i in range(12)]
    said = []
    for batch, part in enumerate((rows[:6], rows[6:9], [("1", "u1", "t1", _text(50), None, None)], rows[9:], rows[:2])):
        streaming.merge_batch(_fetched(spark, part), batch, path, now="2024-03-01 00:00:00", notify=lambda df: said.append({r.doc_id: r.message for r in df.collect()}), buckets=4, kept=2)
    assert streaming.versions(spark, path)[-2:] == [3, 4]
    got = streaming.read_snapshot(spark, path)
    assert sorted(r.doc_id for r in got.documents.collect()) == sorted(str(i) for i in range(12))
    assert got.documents.count() == 12 and got.chunks.filter("active = 1").count() == 12
    assert said[0]["2"] == "New document\nt2\nu2\nchunks: 1" and list(said[2]) == ["1"] and said[2]["1"].startswith("Updated document")
    # The fourth batch put the first text back; a batch run again changes nothing.
    before = sorted(map(str, got.documents.collect()))
    streaming.merge_batch(_fetched(spark, rows[:2]), 4, path, now="2024-03-01 00:00:00", buckets=4, kept=2)
    assert sorted(map(str, streaming.read_snapshot(spark, path).documents.collect())) == before


def test_one_row_a_key(spark):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    docs = spark.createDataFrame([("1", "ok", t[0])], "doc_id string, status string, next_recheck_at timestamp")
    full = docs.select("doc_id", "status", "next_recheck_at", *[F.lit(None).cast(k).alias(c) for c, k in (("last_error", "string"), ("last_fetched_at", "timestamp"), ("last_changed_at", "timestamp"), ("content_hash", "string"), ("etag", "string"))])
    seen = spark.createDataFrame([("1", None, False, True, "a", None, t[1]), ("1", "late", False, False, None, None, t[2])], "doc_id string, error string, skipped boolean, changed boolean, content_hash string, etag string, now timestamp")
    assert [(r.status, r.last_error) for r in state.record_fetch(full, seen).collect()] == [("error", "late")]
    queue = state.enqueue(spark.createDataFrame([], state.QUEUE), spark.createDataFrame([("a", None, "x", 1, t[0], t[0], 1)], "url string, doc_id string, reason string, priority int, scheduled_at timestamp, now timestamp, seq long"))
    failed = spark.createDataFrame([("a", "e1"), ("a", "e2")], "url string, error string")
    assert [(r.attempts, r.last_error) for r in state.mark_attempt(queue, failed, now()).collect()] == [(1, "e2")]


def test_fetching(spark):
    from quarry.sources.http import FETCHED, Fetcher

    asked, slept = [], []

    def get(url, headers, timeout):
        asked.append((url, headers.get("If-None-Match")))
        if url == "b" and len([u for u, _ in asked if u == "b"]) < 3:
            raise TimeoutError("slow")
        return {"a": (200, {"content-type": "text/html", "etag": "1"}, b"<p>"), "b": (200, {}, b"x"), "c": (304, {}, b""), "d": (503, {}, b""), "e": (403, {}, b"")}[url]

    f = Fetcher(get=get, sleep=slept.append)
    assert f.fetch("a") == ("a", 200, "text/html", "1", None, b"<p>", None)
    assert f.fetch("b")[5] == b"x" and f.fetch("c", "tag")[1:2] == (304,) and ("c", "tag") in asked
    assert f.fetch("d")[-1] == "HTTP 503" and [u for u, _ in asked].count("d") == 3
    assert f.fetch("e")[-1] == "HTTP 403" and [u for u, _ in asked].count("e") == 1
    assert {1.0, 2.5, 4.0} <= set(slept)
    rows = files.provided(spark.createDataFrame([("a",)], "url string"), None, FETCHED)
    assert rows.first().asDict()["content"] is None


def test_pdf_texts():
    import zlib

    from quarry.sources import pdf

    def file(body, flate):
        data = zlib.compress(body) if flate else body
        return b"%PDF-1.4\n1 0 obj << /Length 9 " + (b"/Filter /FlateDecode " if flate else b"") + b">> stream\n" + data + b"\nendstream endobj"

    body = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\)) Tj ( world) Tj 0 -14 Td [(Wo) -20 (rd) -300 <6E6578 74>] TJ T* (caf\351) Tj ET"
    for flate in (True, False):
        assert pdf.text_layer(file(body, flate)) == "Hello (big) world\nWord next\ncafé"
    assert pdf.text_layer(b"no pdf") == "" and pdf.text_layer(file(b"garbage", False)) == ""

    def broken(_):
        raise ValueError

    assert pdf.first_text(b"x", [broken, lambda c: "  ", lambda c: "found", lambda c: "late"]) == "found" and pdf.first_text(b"x", [broken]) is None
    assert pdf.recognised([b"a", b"!", b"b", b"c"], lambda p: p.decode() if p != b"!" else broken(p), most=3) == "a\nb"
    states = iter([("running", None), ("succeeded", ":selected: yes :unselected: no")])
    assert pdf.polled(b"x", lambda c: "job", lambda j: next(states), sleep=lambda s: None) == "yes  no"
    assert pdf.polled(b"x", lambda c: "job", lambda j: ("failed", None), sleep=lambda s: None) is None
    ticks = iter(range(100))
    assert pdf.polled(b"x", lambda c: "job", lambda j: ("running", None), timeout=5, clock=lambda: next(ticks), sleep=lambda s: None) is None


def test_run_lock(spark, tmp_path):
    from quarry.storage import RunLock

    a, b = (RunLock(spark, str(tmp_path / "lock")) for _ in range(2))
    assert a.acquire() and not b.acquire()
    a.release()
    assert b.acquire() and RunLock(spark, str(tmp_path / "lock"), ttl=-1).acquire()


def test_command_line(spark, tmp_path, capsys):
    from quarry import cli

    rows = [(str(i), f"https://docs.example.org/docs/{i}", f"title {i}", _text(i) + f" needle{i % 3}", None, None) for i in range(6)]
    _fetched(spark, rows).write.parquet(str(tmp_path / "pages"))
    path = str(tmp_path / "s")

    def run(*words):
        assert cli.main(["--path", path, *words]) == 0
        return capsys.readouterr().out

    run("run-once", str(tmp_path / "pages"), "--batch", "0")
    run("rebuild-index")
    assert "[needle1]" in run("search", "needle1") and "version 1" in run("force-recheck", "--doc-id", "3")
    assert streaming.read_snapshot(spark, path).documents.filter("next_recheck_at <= current_timestamp()").select("doc_id").collect()[0].doc_id == "3"
    run("backfill", "2024-01-05", "2024-01-01")
    assert "|        6|    5|" in run("stats")
    assert "title 2" in run("show-doc", "title 2") and "content_hash string" in run("schema") and "doc_id" in run("chunk-counts")
    assert '"responder": "results"' in run("ask", "needle1 where?") and '"blocks"' in run("ask", "needle2", "--structured")
    assert cli.ask(spark, path, "{}") == {"error": "question is missing"} and cli.ask(spark, path, "x") == {"error": "request is not JSON"}
    run("export-corpus", str(tmp_path / "out"))
    from quarry.sources import sinks

    sinks.text_files(spark, str(tmp_path / "out"), ["4"], str(tmp_path / "plain"))
    assert next((tmp_path / "plain" / "file=4.txt").glob("part*")).read_text().strip() == rows[4][3]


def test_approximate_search_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vectors.top_k(q, v, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in vectors.approximate_top_k(q, v, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_index_of_a_folder(spark, tmp_path):
    from quarry.sources import sinks

    (tmp_path / "in/x").mkdir(parents=True)
    (tmp_path / "in/7.html").write_text("<title>t</title><body><h1>Seven</h1><p>needle words here</p>")
    (tmp_path / "in/x/-8.htm").write_text("<body><p>other words</p>")
    (tmp_path / "in/9.html").write_text("<body></body>")
    meta = sinks.index_folder(spark, str(tmp_path / "in"), str(tmp_path / "index"))
    assert {r.key: r.value for r in meta.collect()} == {"files": "3", "documents": "2", "chunks": "2"}
    wanted = search.terms(spark.createDataFrame([(1, "needle seven")], "query_id int, query string"))
    assert [r.doc_id for r in search.stored_hits(spark, str(tmp_path / "index"), wanted, ["doc_id", "chunk_index"]).collect()] == ["7"]


def test_index_reads_its_chunks_once_and_counts_each_rows_terms(spark, tmp_path):
    from quarry.sources import sinks

    rows = [("a", 0, "x Y y y z"), ("a", 1, "it's ' "), ("b", 0, " ' \xa0"), ("b", 1, "y q"), ("b", 1, "q q"), ("c", 0, "gone"), ("c", 1, None)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, text string").mapInPandas(counted, "doc_id string, chunk_index int, text string")
    titles = spark.createDataFrame([("a", "u", "Y w"), ("b", "u", None)], "doc_id string, url string, title string")
    sinks.search_index(chunks.withColumn("active", F.when(F.col("text") == "gone", 0).otherwise(1)), titles, str(tmp_path / "i"))
    assert seen.value == len(rows)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "i/postings")).select("doc_id", "chunk_index", "term", "d", "f").collect()))
    assert got == [
        ("a", 0, "w", 7, 6.0), ("a", 0, "x", 7, 1.0), ("a", 0, "y", 7, 9.0), ("a", 0, "z", 7, 1.0),
        ("a", 1, "its", 3, 1.0), ("a", 1, "w", 3, 6.0), ("a", 1, "y", 3, 6.0), ("b", 1, "q", 2, 3.0), ("b", 1, "y", 2, 1.0),
    ]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "i/stats")).collect()] == [(4, 3.5)]
    assert spark.read.parquet(str(tmp_path / "i/rows")).count() == 4


def test_embedding_takes_batches_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, sizes = spark.conf.get(name), spark.sparkContext.accumulator(0)

    def make():
        def model(texts):
            sizes.add(sum(map(len, texts)) > 8 << 20)
            return np.ones((len(texts), 2), np.float32)

        return model

    try:
        spark.conf.unset(name)
        rows = spark.range(0, 1500, 1, 1).select("id", F.repeat(F.lit("x"), 20000).alias("text"))
        assert vectors.embed(rows, "text", make=make).filter("embedding[0] > 0").count() == 1500
        assert sizes.value == 0
    finally:
        spark.conf.set(name, before)


def test_search_holds_a_bounded_number_of_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (900, 4)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    q = v.filter("vec_id < 300").withColumnRenamed("vec_id", "query_id")
    score = np.round(x[:300] @ x.T, 6)
    want = {(i, p + 1): (int(j), score[i, j]) for i in range(300) for p, j in enumerate(np.lexsort((np.arange(900), -score[i]))[:5])}
    monkeypatch.setattr(vectors, "CELLS", 3000)
    steps, was = [], pa.RecordBatch.slice

    class Batch:
        def __init__(self, b):
            self.b, self.num_rows = b, b.num_rows

        def slice(self, at, n):
            steps.append(n)
            return was(self.b, at, n)

    class Rows:  # runs the task here, over two batches
        sparkSession = spark

        def filter(self, _):
            return self

        select = lambda self, *_: self

        def mapInArrow(self, run, schema):
            made = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(x[a:b].tolist())], names=["vec_id", "embedding"]) for a, b in ((0, 500), (500, 900))]
            return spark.createDataFrame([r for o in run(map(Batch, made)) for r in map(tuple, map(dict.values, o.to_pylist()))], schema)

    got = {(r.query_id, r.pos): (r.vec_id, r.score) for r in vectors.top_k(q, Rows(), 5, metric="ip").collect()}
    assert got == want and max(steps) * 300 <= 3000
