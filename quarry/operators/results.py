"""Lists of search results: filter, merge and keep one of each.

A list has query_id, pos (1 first), url, title and snippet; every operator renumbers pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import urls


def renumber(rows: DataFrame, *order: Column | str, query: str = "query_id") -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def documents_only(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Document pages of the site."""
    return renumber(rows.filter(urls.is_document(F.col("url"), s) & ~urls.is_index(F.col("url"), s)), "pos")


def first_of(rows: DataFrame, *key: str, query: str = "query_id") -> DataFrame:
    """The first row of each key, in the order of the list."""
    first = Window.partitionBy(query, *key).orderBy("pos")
    return renumber(rows.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r"), "pos", query=query)


def one_per_document(rows: DataFrame, old: tuple[str, ...] = ("old.", "test.")) -> DataFrame:
    """The best URL of each document, where its first one stood; those without id come last.

    URLs without a query are best, then those under the language or with few parts; the
    first of equals stays.  Old and test hosts go.
    """
    u = F.trim("url")
    kept = rows.filter(~F.lower(u).rlike("//(" + "|".join(x.replace(".", "\\.") for x in old) + ")"))
    slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))
    score = F.when(F.contains(u, F.lit("?")), 0).otherwise(2) + F.when(F.contains(u, F.lit("/uz/")) | (slashes <= 4), 1).otherwise(0)
    keyed = kept.withColumns({"score": score, "key": F.coalesce(urls.doc_key(u), F.concat(F.lit("#"), F.col("pos").cast("string"))), "rest": urls.doc_key(u).isNull()})
    group = Window.partitionBy("query_id", "key")
    ranked = keyed.withColumns({"r": F.row_number().over(group.orderBy(F.desc("score"), "pos")), "first": F.min("pos").over(group)})
    return renumber(ranked.filter("r = 1"), "rest", "first").drop("score", "key", "rest", "r", "first")


def merged(first: DataFrame, second: DataFrame, trusted: Column | None = None) -> DataFrame:
    """Both lists one after the other, each URL once, those of trusted places first."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1))).filter("url <> ''")
    good = F.when(trusted, 0).otherwise(1) if trusted is not None else F.lit(0)
    ranked = both.withColumn("good", good)
    one = Window.partitionBy("query_id", "url").orderBy("good", "part", "pos")
    return renumber(ranked.withColumn("r", F.row_number().over(one)).filter("r = 1"), "good", "part", "pos").drop("part", "good", "r")


def per_domain(rows: DataFrame, most: int, top_n: int, score: str) -> DataFrame:
    """At most ``most`` of a host, then the top n by score."""
    order = [F.desc(score), F.col("pos")]
    few = rows.withColumn("g", F.row_number().over(Window.partitionBy("query_id", urls.host(F.col("url"))).orderBy(*order))).filter(F.col("g") <= most)
    return renumber(few, *order).filter(F.col("pos") <= top_n).drop("g")


def longest(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k results with most words, earlier ones first of equals."""
    return renumber(rows, F.desc("n_words"), "pos").filter(F.col("pos") <= k)
