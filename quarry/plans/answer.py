"""From a question to a structured answer: requests, providers in order, blocks and sources.

A provider is a name and a function from rows (query_id, question, history, context) to
query_id and answer; where it has no answer, the next one is asked.  The last resort is an
answer made of the results themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import answers
from quarry.functions.text import strip
from quarry.operators import ranking
from quarry.storage import written

REQUEST = "question string, history array<struct<role:string,content:string>>, structured boolean"
MISSING = "question is missing"


@dataclass(frozen=True)
class Provider:
    name: str
    answer: Callable[[DataFrame], DataFrame]


def parsed(requests: DataFrame, body: str = "request") -> DataFrame:
    """query_id, question, history, structured and error of JSON requests."""
    r = F.from_json(F.col(body), REQUEST)
    plain = requests.select("query_id", r.alias("r"), (F.col(body).isNull() | F.from_json(F.col(body), "map<string,string>").isNull()).alias("bad"))
    question = strip(F.coalesce("r.question", F.lit("")))
    error = F.when(F.col("bad"), "request is not JSON").when(question == "", MISSING)
    return plain.select(
        "query_id", F.nullif(question, F.lit("")).alias("question"), F.coalesce("r.history", F.array().cast("array<struct<role:string,content:string>>")).alias("history"),
        F.coalesce("r.structured", F.lit(False)).alias("structured"), error.alias("error"),
    )


def context(results: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id and context: the results as lines in their order, within the budget."""
    line = F.concat_ws("\n", F.format_string("[%d] %s", F.col("pos").cast("int"), "title"), "url", "snippet")
    lines = ranking.context_lines(results.select("query_id", "pos", line.alias("line")), s.context_chars)
    return lines.groupBy("query_id").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY pos)").alias("context"))


def ask(requests: DataFrame, results: DataFrame, providers: list[Provider], s: Settings = Settings()) -> DataFrame:
    """A row for each request: query_id, question, structured, error, responder, answer, blocks, sources, relatedQuestions.

    requests: of ``parsed``.  results: query_id, pos, url, title and snippet, the retrieval's
    few rows a question.  Each provider sees only the questions that are still open.
    """
    asked = written(requests.join(context(results, s), "query_id", "left"))
    open_ = asked.filter("error IS NULL").select("query_id", "question", "history", "context")
    done = None
    for p in providers:
        said = p.answer(open_).select("query_id", strip(F.col("answer")).alias("answer")).filter("answer <> ''")
        got = written(said.dropDuplicates(["query_id"]).withColumn("responder", F.lit(p.name)))
        done = got if done is None else done.unionByName(got)
        open_ = open_.join(got, "query_id", "left_anti")
    plain = answers.fallback_answer(results).join(open_.select("query_id"), "query_id", "left_semi").withColumn("responder", F.lit("results"))
    done = plain if done is None else done.unionByName(plain)
    ids = results.groupBy("query_id").agg(F.array_sort(F.collect_list("pos")).alias("ids"))
    sources = results.join(done.select("query_id", "answer"), "query_id", "left")
    mapped = answers.source_map(sources, answers.citations(F.coalesce("answer", F.lit(""))))
    rows = asked.drop("context", "history").join(done, "query_id", "left").join(ids, "query_id", "left").join(mapped, "query_id", "left")
    texts = F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda x: x.cast("string"))
    made = F.when(F.col("answer").isNotNull(), answers.blocks(F.col("answer"), texts))
    return rows.select(
        "query_id", "question", "structured", "error", F.when(F.col("error").isNull(), F.coalesce("responder", F.lit("none"))).alias("responder"), "answer",
        F.when(F.col("structured"), made).alias("blocks"), F.when(F.col("structured"), F.col("sources")).alias("sources"),
        F.when(F.col("structured"), answers.related_questions(F.coalesce("answer", F.lit("")))).alias("relatedQuestions"),
    )
