"""The registered queries of the corpus operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, extraction, language, media, mixing, ngram_join, packing, quality, sharding, toxicity
from quarry.llm.common import documents, word_count


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = sharding.shard(docs, 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), size=2048)
    return out.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", F.col("doc_tokens").cast("long").alias("doc_tokens"),
        "sequence_id", "offset",
    )


def op4_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = language.train(docs, remainder(4) != 2)
    out = language.predict(docs, filters)
    return out.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(documents(spark, sf_dir)))


def op6_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op8_block_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts under 50 words are wanted half as often as the others.
    out = mixing.mix(documents(spark, sf_dir), weight=F.when(word_count(F.col("text")) < 50, 0.5).otherwise(1.0))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def held_out(n: int, rest: int) -> Column:
    """Whether remainder(n) is rest; a null doc_id has none."""
    return F.coalesce(remainder(n) == rest, F.lit(False)).alias("held_out")


def op10_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, remainder(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op7, which SQL can express."""
    out = quality.counts(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op9, which SQL can express."""
    sizes = documents(spark, sf_dir).select("source", word_count(F.col("text")).cast("long").alias("size"))
    return mixing.source_targets(sizes).select("source", "source_size", F.round("target", 4).alias("target"))


_SPACE = "\\x20\\x09-\\x0D"

SQL = {
    "base_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls FROM d),
t AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY 1),
x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x""",
    "mix_targets": f"""
WITH s AS (SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACE}]+'), lambda x: x <> ''))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, 3.0 * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
x AS (SELECT max(level) FILTER (level <= most / w) AS settled FROM l)
SELECT source, source_size, round(CAST(least(most, w * coalesce(settled, 'inf'::DOUBLE)) AS DOUBLE), 4) AS target FROM l, x""",
}


def queries() -> dict:
    return {
        "op1_histogram_sharding": op1_histogram_sharding,
        "op2_role_repair": op2_role_repair,
        "op3_histogram_packing": op3_histogram_packing,
        "op4_language_filters": op4_language_filters,
        "op5_ogg_media": op5_ogg_media,
        "op6_prefix_tree_join": op6_prefix_tree_join,
        "op7_robust_outliers": op7_robust_outliers,
        "op8_block_tree_extraction": op8_block_tree_extraction,
        "op9_pareto_mixing": op9_pareto_mixing,
        "op10_noisy_or_toxicity": op10_noisy_or_toxicity,
        "base_rules": base_rules,
        "mix_targets": mix_targets,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
