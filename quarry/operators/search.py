"""Keyword search: postings, BM25 with column weights, and the candidate set's BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions.text import fold_accents, once, query_terms, relevance_tokens

TOKEN = r"([\p{L}\p{N}]+)"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold_accents(c), F.lit(TOKEN), 1)


def postings(rows: DataFrame, keys: list[str], columns: dict[str, float], wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, keys, length d and weighted frequency f; keys and length d) of the indexed columns.

    Each row is a unit of the index; columns gives each searchable column's weight.  With
    ``wanted`` (term) only those terms' tokens go on, before anything is grouped or shuffled:
    a search shuffles its matches, not the corpus.  A token says nothing about how often a
    term is wanted, so the terms are taken once each.
    """
    if wanted is None:
        all_ = units(rows, keys, columns)
        return merged(listed(all_, keys), keys), all_.select(*keys, "d")
    all_ = _weighed(rows, keys, columns)
    long = all_.select(*keys, "d", F.explode("t").alias("t")).select(*keys, "d", "t.term", "t.w")
    f = long.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", *keys, "d").agg(F.sum("w").alias("f"))
    return f, all_.select(*keys, "d")


def _weighed(rows: DataFrame, keys: list[str], columns: dict[str, float]) -> DataFrame:
    """keys, length d and the tokens t of each row, each with its column's weight w."""
    def weighed(c: str, w: float) -> Column:
        return F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    return rows.select(*keys, F.concat(*[weighed(c, w) for c, w in columns.items()]).alias("t")).select(*keys, F.size("t").alias("d"), "t")


def units(rows: DataFrame, keys: list[str], columns: dict[str, float]) -> DataFrame:
    """keys, length d and the terms t of each row, each once with its weighted frequency f.

    A row's tokens are sorted and their runs added up, so nothing is grouped over rows.
    """
    def runs(s: Column) -> Column:
        first = F.transform(s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i))
        return once(F.array_compact(first), lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i)["term"].alias("term"), total(s, i, F.coalesce(F.get(at, j + 1), F.size(s))).alias("f"))))

    def total(s: Column, start: Column, end: Column) -> Column:
        return F.aggregate(F.slice(s, start + 1, end - start), F.lit(0.0), lambda f, x: f + x["w"])

    return _weighed(rows, keys, columns).select(*keys, "d", once(F.sort_array("t"), runs).alias("t"))


def listed(units: DataFrame, keys: list[str]) -> DataFrame:
    """term, keys, d and f: one row for each term of each unit."""
    return units.select(*keys, "d", F.explode("t").alias("t")).select("t.term", *keys, "d", "t.f")


def merged(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Postings in which units with the same keys and length are one."""
    return postings.groupBy("term", *keys, "d").agg(F.sum("f").alias("f"))


def terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """query_id and term, as often as the query has it; uppercase operators are plain terms."""
    return queries.select("query_id", F.explode(query_terms(F.col(query))).alias("t")).select("query_id", F.explode(tokens(F.col("t"))).alias("term"))


def bm25(freq: DataFrame, sizes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """query_id, keys and bm25 of the matching rows; lower is better.

    freq: term, keys, d and f, all of the index or at least the wanted terms'.  sizes: the
    lengths d of all rows, or the one row (rows_all, avg_d) that an index stores.  The
    statistics are those of the whole index.  A term in most rows has the least weight,
    and a repeated one counts twice.
    """
    stats = sizes if "rows_all" in sizes.columns else index_stats(sizes)
    some = freq.join(wanted.select("term").distinct(), "term", "left_semi")
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("rows_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.crossJoin(F.broadcast(stats)).select("term", "avg_d", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))  # one row
    each = F.col("idf") * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("d") / F.col("avg_d")))
    return (
        wanted.join(weight, "term").join(some, "term")
        .groupBy("query_id", *keys).agg((F.round(-F.sum(each), 6) + 0.0).alias("bm25"))
    )


def index_stats(sizes: DataFrame) -> DataFrame:
    """rows_all and avg_d of an index in one row."""
    return sizes.agg(F.count(F.lit(1)).alias("rows_all"), F.avg("d").alias("avg_d"))


def stored_hits(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """query_id, keys and bm25 from the index that ``sinks.search_index`` has written.

    Postings are sorted by term: up to ``most`` terms are given to the scan, which skips the
    row groups without them; more are joined.
    """
    freq = spark.read.parquet(f"{path}/postings")
    few = [r.term for r in wanted.select("term").distinct().limit(most + 1).collect()]
    if len(few) <= most:
        freq = freq.filter(F.col("term").isin(few))
    return bm25(freq, spark.read.parquet(f"{path}/stats"), wanted, keys)


def with_recency(hits: DataFrame, documents: DataFrame, s: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """hits with rank, bm25 with recency; a hit without a document counts as the base year."""
    days = documents.select(key, "source_date")
    return hits.join(days, key, "left").withColumn("rank", boosted(F.col("bm25"), F.col("source_date"), s)).drop("source_date")


def over_fetched(hits: DataFrame, allowed: DataFrame, want: int, score: str, key: str, s: Settings = Settings(), query: str = "query_id") -> DataFrame:
    """The best ``want`` hits that are allowed, from a wider candidate set.

    ``candidate_multiplier`` times as many candidates as wanted, ``candidate_cap`` at most,
    are looked up; the cap is the search's own setting.  Highest scores are best.
    """
    order = [F.desc(score), F.col(key)]
    wide = min(max(want * s.candidate_multiplier, want), s.candidate_cap)
    top = hits.withColumn("c", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("c") <= wide).drop("c")
    left = top.join(allowed.select(key), key, "left_semi")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("pos") <= want)


def boosted(bm: Column, day: Column, s: Settings = Settings()) -> Column:
    """Rank with recency: newer years are better, unknown ones count as the base year."""
    year = F.coalesce(F.year(day), F.lit(s.recency_base_year))
    return bm - (year - s.recency_base_year) * s.recency_weight


def capped(hits: DataFrame, score: str, group: str, per_group: int, k: int, candidates: int | None = None, query: str = "query_id", tie: list[str] = []) -> DataFrame:
    """Top candidates, at most per_group of a group, then the top k, for each query.

    The lowest score is best; ties go by ``tie``.
    """
    order = [F.col(score).asc(), *[F.col(t).asc() for t in tie]]
    if candidates:
        hits = hits.withColumn("c", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("c") <= candidates).drop("c")
    hits = hits.withColumn("g", F.row_number().over(Window.partitionBy(query, group).orderBy(*order))).filter(F.col("g") <= per_group).drop("g")
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("pos") <= k)


def snippet(text: Column, wanted: Column, size: int = 18) -> Column:
    """The window of ``size`` words with most of the wanted terms, those in brackets.

    An approximation of the index's own choice: the first of the densest windows.
    """
    ws = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    hit = F.transform(ws, lambda w: F.array_contains(wanted, F.regexp_replace(fold_accents(w), r"[^\p{L}\p{N}]", "")))
    counts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ws) - size)),
        lambda i: F.struct(F.size(F.filter(F.slice(hit, i + 1, F.lit(size)), lambda h: h)).alias("n"), (-i).alias("i")),
    )
    start = -F.array_max(counts)["i"]
    shown = F.transform(F.slice(ws, start + 1, F.lit(size)), lambda w, j: F.when(F.element_at(hit, start + j + 1), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(start + size < F.size(ws), "…").otherwise(""))


def bm25_lite(queries: DataFrame, candidates: DataFrame, k1: float = 1.2, text: str = "text") -> DataFrame:
    """query_id, item_id and bm25 (higher is better) without length norm.

    candidates: item_id and text, with the query_id whose candidate a row is, or without one
    where each row is a candidate of every query (a stated set).  N and df are those of each
    query's own candidates; a term counts once however often the query has it.  Tokens meet
    the query terms before they are grouped, so hits are shuffled and not the texts' tokens.
    """
    mine = ["query_id"] if "query_id" in candidates.columns else []
    wanted = queries.select("query_id", F.explode(F.array_distinct(relevance_tokens(F.col("query")))).alias("term"))
    found = candidates.select(*mine, "item_id", F.explode(relevance_tokens(F.col(text))).alias("term"))
    hit = found.join(wanted, [*mine, "term"]).groupBy("query_id", "item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    ids = candidates.select(*mine, "item_id")
    ids = ids if mine else ids.crossJoin(F.broadcast(queries.select("query_id")))  # the stated queries, once for each row
    df = hit.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    n = ids.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_all"))
    idf = F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    score = hit.join(df, ["query_id", "term"]).join(n, "query_id").groupBy("query_id", "item_id").agg(
        F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1)).alias("s")
    )
    # Candidates without a term keep a score of 0.
    return ids.join(score, ["query_id", "item_id"], "left").select("query_id", "item_id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("bm25"))
