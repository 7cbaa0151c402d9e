"""Hybrid ranking, diversity and the context of an answer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import shorten


def min_max(c: Column, query: str = "query_id") -> Column:
    """c scaled to the range of its query's candidates."""
    w = Window.partitionBy(query)
    return (c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-9)


def hybrid(cos: Column | None, bm25: Column, bonus: Column, alpha: float = 0.7, query: str = "query_id") -> Column:
    """Blend of cosine and scaled BM25 with the bonus of a place; no vectors: BM25 alone."""
    if cos is None:
        return min_max(bm25, query) + bonus
    return alpha * (cos + 1) / 2 + (1 - alpha) * min_max(bm25, query) + bonus


def cap_after(hits: DataFrame, k: int, per_group: int, group: str, score: str = "score", tie: str = "item_id", query: str = "query_id") -> DataFrame:
    """Top k first, then at most per_group of a group: fewer than k may stay."""
    order = [F.desc(score), F.col(tie)]
    top = hits.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("pos") <= k)
    return top.withColumn("g", F.row_number().over(Window.partitionBy(query, group).orderBy(*order))).filter(F.col("g") <= per_group).drop("g")


def cap_before(hits: DataFrame, k: int, per_group: int, group: str, score: str = "score", tie: str = "item_id", query: str = "query_id") -> DataFrame:
    """At most per_group of a group first, then the top k."""
    order = [F.desc(score), F.col(tie)]
    few = hits.withColumn("g", F.row_number().over(Window.partitionBy(query, group).orderBy(*order))).filter(F.col("g") <= per_group).drop("g")
    return few.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("pos") <= k)


def mmr_order(sim: np.ndarray, vectors: np.ndarray, k: int, lam: float) -> list[int]:
    """Greedy choice: relevance less likeness to what is chosen; the first of equals."""
    between = vectors @ vectors.T
    chosen = [int(np.argmax(sim))]
    while len(chosen) < min(k, len(sim)):
        score = lam * sim - (1 - lam) * between[:, chosen].max(axis=1)
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
    return chosen


def mmr(candidates: DataFrame, k: int = 8, lam: float = 0.7, pool: int = 15) -> DataFrame:
    """query_id, item_id and pos by maximal marginal relevance over unit vectors.

    candidates: query_id, item_id, score (similarity to the query) and embedding.  Only the
    best ``pool`` of a query are looked at, so a group is small; with no more than k the
    order of scores stays.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    few = candidates.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= pool)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        if len(pdf) <= k:
            order = list(range(len(pdf)))
        else:
            v = np.array(pdf["embedding"].tolist(), np.float64)
            v = np.divide(v, n := np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=n > 0)
            order = mmr_order(pdf["score"].to_numpy(np.float64), v, k, lam)
        got = pdf.iloc[order]
        return pd.DataFrame({"query_id": got["query_id"].to_numpy(), "item_id": got["item_id"].to_numpy(), "pos": np.arange(1, len(got) + 1)})

    return few.select("query_id", "item_id", "score", "embedding", "r").groupBy("query_id").applyInPandas(run, "query_id long, item_id long, pos int")


def rerank(candidates: DataFrame, scorer, top_n: int, most: int = 4000) -> DataFrame:
    """candidates by a scorer of (question, passage) columns; left as they are if few.

    scorer is a column function, such as a pandas UDF around a cross-encoder.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    scored = candidates.withColumn("n", n).withColumn("rerank", F.when(F.col("n") > top_n, scorer(F.col("question"), F.left("chunk_text", F.lit(most)))))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), F.col("pos"))
    return scored.withColumn("pos", F.row_number().over(order)).drop("n")


def context_lines(items: DataFrame, budget: int, line: str = "line", query: str = "query_id") -> DataFrame:
    """The items by pos that fit in ``budget`` characters with their line breaks.

    The first that doesn't fit is cut to what is left less 50 and marked; later ones go.
    Lengths are summed first, so only texts that are used move.  query and pos name an item.
    """
    w = Window.partitionBy(query).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sizes = items.select(query, "pos", F.length(line).alias("__n"))
    before = F.coalesce(F.sum(F.col("__n") + 1).over(w), F.lit(0))
    few = sizes.withColumn("used", before).filter(F.col("used") < budget).select(F.col(query).alias("__q"), F.col("pos").alias("__p"), "used")
    used = items.join(few, F.col(query).eqNullSafe(F.col("__q")) & (F.col("pos") == F.col("__p"))).drop("__q", "__p")
    fits = F.col("used") + F.length(line) + 1 <= budget
    cut = F.concat(F.left(F.col(line), F.greatest(F.lit(0), F.lit(budget) - F.col("used") - 50).cast("int")), F.lit("\n..."))
    return used.withColumn(line, F.when(fits, F.col(line)).otherwise(cut)).drop("used")


def context_blocks(items: DataFrame, most: int = 1200, query: str = "query_id") -> DataFrame:
    """One text for each query with a numbered block for each item by pos."""
    block = F.format_string(
        "[SOURCE %d]\nTitle: %s\nURL: %s\nChunk: %d\nText:\n%s\n",
        F.col("pos").cast("int"), F.coalesce(F.nullif("title", F.lit("")), F.lit("(no title)")), "url", F.col("chunk_index").cast("int"), shorten(F.col("text"), most),
    )
    return items.withColumn("block", block).groupBy(query).agg(F.expr("listagg(block, '\\n\\n') WITHIN GROUP (ORDER BY pos)").alias("context"))
