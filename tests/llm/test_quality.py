import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    w = WORDS.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts(docs, edge):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: columns(r) for r in quality.counts(docs).collect()}
    assert all(got[i] == plain(t) for i, t in texts)
    for r in quality.counts(edge).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect():
        assert columns(r) == plain(r.text)


def test_windows_that_overlap(spark):
    texts = ["a b c a b c a b c", "a a a a", "x y z q x y z", "a b", "", "p q r s\np q r s\n \np q r s"]
    rows = quality.counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    assert [columns(r) for r in rows] == [plain(t) for t in texts]


def test_estimate_equals_numpy(spark):
    rng = np.random.default_rng(7)
    names = list(quality.STATISTICS)
    good = rng.normal(0.3, 0.05, (300, len(names)))
    bad = rng.normal(0.9, 0.05, (60, len(names)))
    x = np.vstack([good, bad])
    df = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(x)], "doc_id long, g string, " + ", ".join(f"{n} double" for n in names))
    p = quality.estimates(df).first()
    floors = np.diag([v**2 for v in quality.STATISTICS.values()])

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    q = (np.floor(q * 512) + [[0], [0.5], [0]]) / 512
    m, c = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors
    for _ in range(3):
        bins = np.floor(np.log2(distance(m, c) + 1e-6) * 32)
        near = x[bins <= np.quantile(bins, 0.75, method="inverted_cdf")]
        m, c = near.mean(axis=0), np.cov(near.T, bias=True) + floors
    factor = np.linalg.cholesky(c)
    assert np.allclose([p[f"m{i}"] for i in range(len(names))], m, atol=1e-9)
    assert np.allclose([p[f"l{i}{j}"] for i in range(len(names)) for j in range(i + 1)], [factor[i, j] for i in range(len(names)) for j in range(i + 1)], atol=1e-9)
    assert abs(m - 0.3).max() < 0.02  # the sixth that is off doesn't draw it


def test_verdicts_on_labels(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert all(not r.kept for r in rows if r.quality == 0)


def test_a_group_of_much_junk(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(400)]

    def text(junk):
        w = [str(x) for x in rng.choice(words, 90)]
        return " ".join(x + "#$%"[i % 3] if junk and i % 4 < junk else x for i, x in enumerate(w)) + "."

    # Sources with 30, 40 and 45 of 100 documents of junk, in two kinds.
    rows = [(1000 * s + i, text(1 + i % 2 * 2 if i < n else 0), "en", f"s{s}", i < n) for s, n in enumerate((30, 40, 45)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    got = quality.judge(docs).collect()
    assert not any(r.base_failed for r in got)
    assert [r.doc_id for r in got if r.kept == r.junk] == []


def test_steps_end_when_settled(spark, monkeypatch):
    x = np.random.default_rng(5).normal(0.3, 0.05, (200, len(quality.STATISTICS)))
    df = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(x)], "doc_id long, g string, " + ", ".join(f"{n} double" for n in quality.STATISTICS))
    asked, was = [], quality._settled
    monkeypatch.setattr(quality, "_settled", lambda a, b: asked.append(was(a, b)) or asked[-1])
    quality.estimates(df, share=None, steps=40)
    assert asked == [False] * (len(asked) - 1) + [True] and len(asked) < 40


def test_edge_rows(edge, none):
    rows = quality.judge(edge).collect()
    assert len(rows) == 9 and [r.n_words for r in rows if r.doc_id == 4] == [60_000]
    assert [r.kept for r in rows if r.doc_id == 2] == [False]
    kept = quality.keep(edge).collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in kept] == [(4, 3, "y")]
    assert quality.judge(none).count() == 0 and quality.keep(none).columns == none.columns


def test_small_groups_are_pooled(spark, docs):
    out = quality.judge(docs.withColumn("source", F.col("doc_id").cast("string")))
    assert out.filter("kept").count() > 0.5 * out.count()
