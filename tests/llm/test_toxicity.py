import numpy as np
from pyspark.sql import functions as F

from quarry.llm import toxicity


def corpus(spark, n=400):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in "mnrst"]
    words = np.array(words, dtype="<U12")
    rows, labels = [], []
    for i in range(n):
        parts = [" ".join(rng.choice(words, 6)) + "." for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            spot = rng.choice(words, 6)
            spot[2] = rng.choice(["zibot", "vukking", "vukkers"])
            parts[int(rng.integers(5))] = " ".join(spot) + "."
        rows.append((i, " ".join(parts)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_locates(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("doc_id % 5 = 0").collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in rows)
    # An unseen form of a known beginning counts too, and a sentence is named.
    odd = spark.createDataFrame([(1, "Fine day. That vukkish thing! Fine.")], "doc_id long, text string")
    found = toxicity.locate(odd, model).collect()
    assert [r.sentence.strip() for r in found] == ["That vukkish thing!"]


def test_score_is_noisy_or(spark):
    docs, labels = corpus(spark, 200)
    model = toxicity.train(docs, labels, F.lit(True))
    leak = 1 / (1 + np.exp(-model.leak))
    for r in docs.limit(20).collect():
        clean = np.prod([1 - s for _, _, s in model.sentence_scores(r.text)])
        assert abs(model.score(r.text) - (1 - (1 - leak) * clean)) < 1e-9
    assert model.score("plain words. " * 50_000) < 0.1


def test_gradient_matches_differences():
    sentences, y = [(0, [0, 1]), (0, [1]), (1, [0]), (2, [1])], np.array([True, False, False, True])
    w, leak = toxicity.fit_noisy_or(sentences, y, 2, steps=3000, l2=0.05, rate=0.02)

    def loss(w, leak):
        z = np.array([toxicity.BIAS + sum(w[i] for i in ws) for _, ws in sentences])
        s = np.bincount([d for d, _ in sentences], np.logaddexp(0, z), minlength=4) + np.logaddexp(0, leak)
        return np.where(y, -np.log1p(-np.exp(-s)), s).mean() + 0.025 * (w**2).sum()

    best = loss(w, leak)
    for i in range(3):
        for e in (-0.05, 0.05):
            assert loss(w + e * np.eye(3)[i][:2], leak + e * (i == 2)) > best - 1e-5


def test_edge_rows(spark, edge, none):
    docs, labels = corpus(spark, 100)
    model = toxicity.train(docs, labels, F.lit(True))
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == 9 and {r.score for r in rows if r.doc_id in (2, 3, 5)} == {0.0}
    assert toxicity.keep(edge, model).columns == edge.columns and toxicity.keep(edge, model).count() == 9
    assert toxicity.score(none, model).count() == 0
    bare = toxicity.train(edge, labels.filter("false"), F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(docs, bare).collect())
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert toxicity.train(docs, nulls, F.lit(True)).weights == {}


def test_query_by_plain_scores(spark, sf, docs):
    """The query's scores are the noisy-or of plainly computed sentence scores of its model."""
    import math
    import re

    from quarry.llm.queries import op10_noisy_or_toxicity, remainder

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), remainder(5) != 0)

    def plain(text):
        if not re.search(r"[^\W\d_]", text or ""):
            return 0.0
        clean = 1 - 1 / (1 + math.exp(-model.leak))
        for part in re.split(r"[.!?\n]+", text.lower()):
            words = re.findall(r"[^\W\d_]+", part)
            known = {f for w in words for f in (w + "$", *(w[:k] for k in (3, 4, 5, 6) if len(w) >= k))} & set(model.weights)
            if known:
                clean *= 1 / (1 + math.exp(-3.0 + sum(model.weights[f] for f in known)))
        return 1 - clean

    rows = op10_noisy_or_toxicity(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - plain(texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_weights_by_plain_descent(spark):
    """Counts, choice of features and bags against one document at a time; then one fit on both."""
    docs, labels = corpus(spark, 200)
    model = toxicity.train(docs, labels, F.lit(True), min_docs=3, least_z=3.0)
    rows = sorted(zip([r.text for r in docs.orderBy("doc_id").collect()], [r.toxic for r in labels.orderBy("doc_id").collect()], strict=True), key=lambda x: 0)
    bags = [[toxicity.features(toxicity.WORD.findall(p)) for p in toxicity.BREAK.split(t.lower()) if toxicity.WORD.search(p)] for t, _ in rows]
    y = np.array([bool(x) for _, x in rows])
    n, p = {}, {}
    for bag, bad in zip(bags, y, strict=True):
        for f in set().union(*bag):
            n[f] = n.get(f, 0) + 1
            p[f] = p.get(f, 0) + bad
    rate = y.mean()
    z = {f: (p[f] - n[f] * rate) / np.sqrt(n[f] * rate * (1 - rate)) for f in n if n[f] >= 3}
    assert set(model.weights) == {f for f, x in z.items() if x >= 3.0}
    index = {f: i for i, f in enumerate(sorted(model.weights))}
    sentences = [(d, [index[f] for f in s & index.keys()]) for d, bag in enumerate(bags) for s in bag if s & index.keys()]
    w, leak = toxicity.fit_noisy_or(sentences, y, len(index))
    assert abs(leak - model.leak) < 0.05 and all(abs(w[i] - model.weights[f]) < 0.1 for f, i in index.items())


def test_repeated_sentences_count(spark):
    one = toxicity.fit_noisy_or([(0, [0]), (1, [0]), (2, [0])], np.array([True, False, False]), 1, times=[3, 1, 1])
    many = toxicity.fit_noisy_or([(0, [0]), (0, [0]), (0, [0]), (1, [0]), (2, [0])], np.array([True, False, False]), 1)
    assert np.allclose(one[0], many[0]) and abs(one[1] - many[1]) < 1e-9
