"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence with known features (words and their
beginnings, which inflected forms share) has the score sigmoid(sum of their weights - 3),
any other 0; the document's is their noisy-or with a leak, 1 - (1 - leak) prod(1 - s).  The
leak stands for labels that no sentence explains, and doesn't grow with a text's length.  Weights are
learned from document labels alone by gradient descent on the log loss of the noisy-or,
so the sentences that carry a label are found without sentence labels, and ``locate``
returns them.

Training reads at most ``sample`` labelled documents (those with the lowest hash of
doc_id; whole texts) and keeps at most ``vocabulary`` features: those whose rates in toxic
and other documents differ most.  Sentences of a document with the same known features
count together, and at most ``instances`` such kinds of a document reach the driver, the
commonest first.  The model is a few thousand numbers.  Scoring streams over all documents
and needs no shuffle.

Null labels are no labels; a document whose rows differ in text learns from the least
text, so reruns agree.  Null, empty and wordless texts have score 0; a text of any length
is scored whole, and equal texts alike.  An empty table gives an empty result, and without
labels every score is close to 0.  Other columns are kept by ``keep`` and unused elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, map_columns, released, returned, written

WORD = re.compile(r"[^\W\d_]+")
#: What the weights of a sentence must outweigh.
BIAS = -3.0
#: Lengths of the word beginnings that count as features besides whole words.
STEMS = (3, 4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
BREAK = re.compile(r"[.!?\n]+")


def features(words: list[str]) -> set[str]:
    """Each word, marked with $, and its beginnings."""
    out = {w + "$" for w in words}
    for k in STEMS:
        out.update([w[:k] for w in words if len(w) >= k])
    return out


class Model:
    """Weights of features, and the logit of the leak."""

    def __init__(self, weights: dict[str, float], leak: float):
        self.weights, self.leak = weights, leak
        # Words that begin otherwise have no feature, as most have not.
        self.starts = {f.rstrip("$")[: STEMS[0]] for f in weights}

    def known(self, part: str) -> list[float]:
        """Weights of the features in lower-case text."""
        starts, k = self.starts, STEMS[0]
        words = [w for w in WORD.findall(part) if w[:k] in starts]
        return [self.weights[f] for f in features(words) & self.weights.keys()] if words else []

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence with a word."""
        out = []
        for m in SENTENCE.finditer(text):
            if WORD.search(m[0]):
                hit = self.known(m[0].lower())
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-BIAS - sum(hit))) if hit else 0.0))
        return out

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences; a text without words has score 0."""
        if not text or not WORD.search(text):
            return 0.0
        miss = math.log1p(math.exp(self.leak))
        for part in BREAK.split(text.lower()):
            if hit := self.known(part):
                z = BIAS + sum(hit)
                miss += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
        return -math.expm1(-miss)


def _parts(text: str) -> list[set[str]]:
    """The features of each sentence with a word."""
    return [features(w) for p in BREAK.split(text.lower()) if (w := WORD.findall(p))]


def _counted(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """word, pos and all: in how many documents, and toxic ones, a feature occurs.

    Counts are summed in the tasks before they are shuffled; a task holds about ``most``.
    """

    def run(batches):
        held: dict[str, list[int]] = {}

        def counts():
            cols = [list(held), *([v[i] for v in held.values()] for i in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["word", "pos", "all"])

        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                one = int(toxic.as_py() > 0)
                for w in set().union(*_parts(text.as_py() or "")):
                    n = held.setdefault(w, [0, 0])
                    n[0] += one
                    n[1] += 1
                if len(held) >= most:
                    yield counts()
        yield counts()
        returned()

    bounded_batches(docs.sparkSession)
    made = docs.select("toxic", "text").mapInArrow(run, "word string, pos long, all long")
    return made.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))


def _hits(docs: DataFrame, index: dict[str, int], instances: int) -> DataFrame:
    """doc_id, toxic, kinds of sentences (numbers of the known features) and how many are of each."""

    def body():
        def step(keys, labels, texts):
            kinds, times = [], []
            for t in texts:
                found = Counter(h for p in _parts(t or "") if (h := tuple(sorted(index[w] for w in p & index.keys()))))
                most = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:instances]
                kinds.append([k for k, _ in most])
                times.append([n for _, n in most])
            return keys, labels, kinds, times

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs.select("doc_id", "toxic", "text"), body, f"doc_id {kind}, toxic int, kinds array<array<int>>, times array<int>")


def fit_noisy_or(
    sentences: list[tuple[int, list[int]]], labels: np.ndarray, size: int, *, times: list[int] | None = None, steps: int = 600, rate: float = 0.1, l2: float = 2e-5
) -> tuple[np.ndarray, float]:
    """Weights and the leak's logit.  sentences: (document, feature numbers); times: how many such."""
    n = max(1, len(labels))
    doc = np.array([d for d, _ in sentences], dtype=np.int64)
    lengths = np.array([len(w) for _, w in sentences], dtype=np.int64)
    word = np.array([w for _, ws in sentences for w in ws], dtype=np.int64)
    times = np.ones(len(sentences)) if times is None else np.array(times, dtype=float)
    row = np.repeat(np.arange(len(sentences)), lengths)
    y = labels.astype(float)
    theta = np.zeros(size + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, leak = theta[:-1], theta[-1]
        z = BIAS + np.bincount(row, w[word], minlength=len(sentences))
        total = np.bincount(doc, times * np.logaddexp(0, z), minlength=len(y)) + np.logaddexp(0, leak)
        slope = np.where(y > 0, -1 / np.expm1(np.maximum(total, 1e-12)), 1.0) / n
        each = times * slope[doc] / (1 + np.exp(-z))
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(word, each[row], minlength=size) + l2 * w
        grad[-1] = slope.sum() / (1 + np.exp(-leak))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, *, sample: int = 10_000, vocabulary: int = 2_000, instances: int = 1_000, min_docs: int = 4, least_z: float = 5.0
) -> Model:
    """A model from the labelled documents for which ``usable`` (over doc_id) holds.

    Null labels and null ids are left out; of several labels of a document the largest
    counts.  Without labelled rows every score is close to 0.
    """
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(10), "doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers are broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    both = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("p")).first()
    n, p = both.n, both.p or 0
    if not n:
        return Model({}, -10.0)
    rate = p / n
    # Signed root of the chi-square statistic of word against label.
    expected = F.col("all") * F.lit(rate)
    spread = F.sqrt(F.col("all") * F.lit(max(rate * (1 - rate), 1e-9)))
    chosen = (
        _counted(rows).filter(F.col("all") >= min_docs)
        .withColumn("z", (F.col("pos") - expected) / spread)
        .filter(F.col("z") >= least_z)
        .orderBy(F.col("z").desc(), "word")
        .limit(vocabulary)
        .collect()
    )
    index = {r.word: i for i, r in enumerate(chosen)}
    # At most ``sample`` times ``instances`` short lists reach the driver.
    found = _hits(rows, index, instances).orderBy("doc_id").collect()
    released(rows)
    sentences = [(d, ws) for d, r in enumerate(found) for ws in r.kinds]
    y = np.array([r.toxic > 0 for r in found])
    weights, leak = fit_noisy_or(sentences, y, len(index), times=[k for r in found for k in r.times])
    return Model({w: float(weights[i]) for w, i in index.items()}, leak)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score of each row; null and empty texts have score 0."""

    def body():
        return lambda keys, texts: (keys, [model.score(t) for t in texts])

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs.select(key, text), body, f"`{key}` {kind}, score double")


def keep(docs: DataFrame, model: Model, most: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs whose score is below ``most``, with all their columns."""
    at = docs.columns.index(text)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < most for t in batch.column(at)], pa.bool_()))
        returned()

    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The offending sentences: key, start and end in code points, sentence, score."""

    def body():
        def step(keys, texts):
            rows = [(k, a, b, t[a:b], s) for k, t in zip(keys, texts, strict=True) if t for a, b, s in model.sentence_scores(t) if s >= least]
            return list(zip(*rows, strict=True)) if rows else [[]] * 5

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs.select(key, text), body, f"`{key}` {kind}, start int, end int, sentence string, score double")
