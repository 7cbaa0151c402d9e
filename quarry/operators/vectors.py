"""Dense vectors: embedding, exact top-k search and index upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import bounded_batches, written

PASSAGE, QUERY = "passage: ", "query: "


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine; 0 for a zero vector.  eps is added to the denominator."""
    d = norm(a) * norm(b) + eps
    return F.when(d > 0, dot(a, b) / d).otherwise(0.0)


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed counts of words by the first 32 bits of their MD5."""

    def embed(texts: list[str]) -> np.ndarray:
        import hashlib
        import re

        known: dict[str, int] = {}
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = known.get(w)
                if h is None:
                    if len(known) > 100_000:
                        known.clear()
                    h = known[w] = int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4])
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        return out

    return embed


def embed(rows: DataFrame, text: str = "chunk_text", prefix: str = PASSAGE, normalize: bool = True, make: Callable[[], Callable] = hashing_embedder, most: int | None = None) -> DataFrame:
    """rows with an embedding; make() gives the model once for each worker's task.

    Texts reach the model in batches bounded by their bytes, however many rows there are.
    """
    bounded_batches(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            v = model([prefix + (t or "")[:most] for t in s]).astype(np.float32)
            if normalize:
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
            yield pd.Series(list(v))

    return rows.withColumn("embedding", run(F.col(text)))


def half_precision(a: Column) -> Column:
    """Vectors as they are after storage in 16 bits: ten binary places, halves to even."""

    def one(x: Column) -> Column:
        v = x.cast("double")
        # Steps double with each power of two, and are the same below 2 ** -14.
        place = F.greatest(F.floor(F.log2(F.greatest(F.abs(v), F.lit(2.0**-24)))), F.lit(-14)) - 10
        step = F.pow(F.lit(2.0), place)
        near = F.rint(v / step) * step
        return F.when(F.abs(near) >= 65520, F.signum(v) * float("inf")).otherwise(near).cast("float")

    return F.transform(a, one)


def active(vectors: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """Vectors that may be found: active, of an active chunk, of the index's dimension."""
    return vectors.filter((F.col("active") == 1) & (F.size("embedding") == dim)).join(chunks.filter("active = 1").select("chunk_id"), "chunk_id", "left_semi")


def rebuilt(vectors: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """vector_id and embedding of the index made anew: active vectors of its dimension."""
    return active(vectors, chunks, dim).select("vector_id", "embedding")


def removed(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the vectors of gone (vector_id)."""
    return index.join(gone.select("vector_id"), "vector_id", "left_anti")


def vectors_of(chunks: DataFrame, vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """vector_id and doc_id of the active vectors of documents: what an update retires."""
    mine = chunks.filter("active = 1").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id", "doc_id")
    return vectors.filter("active = 1").join(mine, "chunk_id").select("vector_id", "doc_id")


def appended(index: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """The index with new vectors in place of those with their ids; other dimensions are an error."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("vector of another dimension"))))
    return index.join(new.select("vector_id"), "vector_id", "left_anti").unionByName(checked)


#: Scores that a task of ``top_k`` holds at once, queries times vectors.
CELLS = 1 << 19


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, metric: str = "cosine", block: int = 4096, at_once: int = 1024) -> DataFrame:
    """query_id, vec_id, score and pos of the k best vectors for each query.

    Vectors stream through each task in blocks of at most ``block`` vectors and ``CELLS`` scores,
    so a worker's memory doesn't grow with the queries; a task multiplies a block with the query
    matrix and keeps k candidates a query, so what is shuffled is tasks * queries * k rows.
    The driver reads ``at_once`` queries at a time, so their matrix has a bound; where there are
    more, a block's hits are written to the shared folder before the next is read.  Scores are
    rounded to 6 places and ties go by id.
    """
    bounded_batches(vectors.sparkSession)
    rows = queries.filter("embedding IS NOT NULL").select("query_id", "embedding").toLocalIterator()
    part, found = list(islice(rows, at_once)), None
    while part or found is None:
        following = list(islice(rows, at_once))
        hits, shared = _candidates(part, vectors, k, metric, block)
        if found is not None or following:
            kept = written(hits)
            shared.destroy()
            found = kept if found is None else found.unionByName(kept)
        else:
            found = hits
        part = following
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def _candidates(rows: list, vectors: DataFrame, k: int, metric: str, block: int) -> tuple[DataFrame, Broadcast]:
    """The k best of each task for the queries in rows, and the query matrix that it uses."""
    ids = [r.query_id for r in rows]
    q = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)
        ids, q = [i for i, x in zip(ids, n, strict=True) if x > 0], q[n > 0] / n[n > 0, None]
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, m = shared.value
        best_s, best_i = np.full((len(qid), 0), 0.0), np.zeros((len(qid), 0), np.int64)
        step = max(1, min(block, CELLS // max(len(qid), 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                col = part.column(1)
                if not len(qid) or not len(col):
                    continue
                v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
                s = m @ v.T
                if metric == "cosine":
                    n = np.linalg.norm(v, axis=1)
                    s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
                s = np.round(np.hstack([best_s, s]), 6)
                i = np.hstack([best_i, np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False), (len(qid), len(col)))])
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best_s.shape[1])), pa.array(best_i.ravel()), pa.array(best_s.ravel())], names=["query_id", "vec_id", "score"])

    found = vectors.filter("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
    return found, shared


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, tables: int = 4, length: float = 0.5, seed: int = 0) -> DataFrame:
    """Optional approximate search by random projections (unit vectors: same order as cosine)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    left, right = (x.withColumn("v", array_to_vector("embedding")) for x in (queries, vectors))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=length, seed=seed).fit(right)
    near = model.approxSimilarityJoin(left, right, 2.0, "dist")
    rows = near.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"), F.round(1 - F.col("dist") ** 2 / 2, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
