"""Questions to a language model in batches, and its answers as rows.

The model is a function from prompts to answers that is handed in, so that
tests and replays use stored ones. One prompt holds all open facts of a
question; answers come back by the number of the fact.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import scoring, text
from . import synthesis

ANSWER = "results array<struct<index:int,verdict:string,reasoning:string,source_urls:array<string>>>"
MOST_FACT = 300
MOST_SOURCE = 1500

Model = Callable[[str], str]


def prompts(facts: DataFrame, evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """One prompt per question: numbered facts, then sources with their best windows.

    ``facts`` has fact_no and fact; ``evidence`` url, score and text.
    """
    line = F.format_string("%d. %s", "nr", text.sanitized(F.col("fact"), MOST_FACT))
    nr = F.row_number().over(_by(key, "fact_no"))
    listed = facts.withColumn("nr", nr).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", line.alias("line")))), lambda s: s["line"]), "\n").alias("facts"))
    shown = F.concat(F.lit("SOURCE "), F.col("url"), F.lit("\n"), text.sanitized(F.col("text"), MOST_SOURCE))
    sources = evidence.dropDuplicates([key, "url", "text"]).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "url", shown.alias("line")))), lambda s: s["line"]), "\n\n").alias("sources"))
    rows = listed.join(sources, key, "left")
    return rows.select(key, F.concat(F.lit("FACTS\n"), "facts", F.lit("\n\nSOURCES\n"), F.coalesce("sources", F.lit("")), F.lit('\n\nReply with JSON: {"results": [{"index", "verdict", "reasoning", "source_urls"}]}')).alias("prompt"))


def _by(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


TRANSIENT = frozenset({429, 500, 502, 503, 504})


class ModelError(RuntimeError):
    """A model's refusal, with the status of its service if there was one."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def is_transient(problem: Exception) -> bool:
    """Whether another try or another model may help: no connection, no answer in time, or a service that is busy or broken."""
    if isinstance(problem, ModelError) and problem.status is not None:
        return problem.status in TRANSIENT
    return isinstance(problem, OSError | ModelError)


def ask(rows: DataFrame, models: list[Model], key: str = "query_id", retries: int = 2, wait: float = 1.0) -> DataFrame:
    """(key, answer, error): each prompt goes to the first model that answers.

    A failing model is tried again with doubled waits, and then the next
    one; an error that is not transient is our own and ends the asking.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, prompt in zip(part[key], part["prompt"], strict=True):
                answer, error = None, "no model"
                for model, attempt in itertools.product(models, range(retries + 1)):
                    try:
                        answer, error = model(prompt), None
                        break
                    except (OSError, RuntimeError) as problem:
                        error = str(problem) or type(problem).__name__
                        if not is_transient(problem):
                            break
                        if attempt < retries:
                            time.sleep(wait * 2**attempt)
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return rows.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, error string")


def parsed(answer: Column) -> Column:
    """The results in an answer: its outermost braces as JSON, an empty list if that is none."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), ANSWER)["results"]
    return F.coalesce(found, F.array().cast("array<struct<index:int,verdict:string,reasoning:string,source_urls:array<string>>>"))


def answers(facts: DataFrame, replies: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per fact with the model's verdict, INSUFFICIENT where it has none: key, fact_no, answer, reasoning, urls."""
    numbered = facts.withColumn("index", F.row_number().over(_by(key, "fact_no")))
    each = replies.select(key, F.explode(parsed(F.col("answer"))).alias("_r")).select(key, "_r.*")
    each = each.groupBy(key, "index").agg(F.first(F.struct("verdict", "reasoning", "source_urls")).alias("_r")).select(key, "index", "_r.*")
    rows = numbered.join(each, [key, "index"], "left")
    return rows.select(key, "fact_no", F.coalesce(scoring.verdict_of(F.col("verdict")), F.lit("INSUFFICIENT")).alias("answer"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce("source_urls", F.array().cast("array<string>")).alias("urls"))


MOST_FACTS = 20
MOST_CITATIONS = 30
RULES = """Rules:
- Use only the citation ids listed above. Format: [1][2]
- Do not invent URLs or sources.
- Keep inline citations where the deterministic answer had them.
- Return ONLY the new markdown, no preamble."""


def rewrite_prompts(answers_: DataFrame, questions: DataFrame, facts: DataFrame, citations: DataFrame, key: str = "query_id") -> DataFrame:
    """One prompt per answer: question, facts, citations and the answer to be written anew."""
    nr = F.row_number().over(_by(key, "fact_no"))
    numbered = facts.withColumn("nr", nr).filter(F.col("nr") <= MOST_FACTS).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", F.format_string("- %d. %s", "nr", "fact").alias("line")))), lambda s: s["line"]), "\n").alias("facts"))
    shown = F.concat(F.format_string("[%d] ", "id"), "title", F.lit(" — "), "url")
    listed = citations.filter(F.col("id") <= MOST_CITATIONS).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", shown.alias("line")))), lambda s: s["line"]), "\n").alias("cited"))
    rows = answers_.join(questions.select(key, "query"), key).join(numbered, key, "left").join(listed, key, "left").fillna("", ["facts", "cited"])
    parts = [F.lit("## User query"), F.col("query"), F.lit("\n## Verified facts"), F.col("facts"), F.lit("\n## Citations (use ONLY these)"), F.col("cited"), F.lit("\n## Deterministic answer (rewrite, don't copy)"), F.col("answer_markdown"), F.lit("\n" + RULES)]
    return rows.select(key, F.concat_ws("\n", *parts).alias("prompt"))


def rewritten(answers_: DataFrame, replies: DataFrame, citations: DataFrame, key: str = "query_id") -> DataFrame:
    """Answers with a model's wording where it is sound: every marker and URL in it is a citation; else as they were, with the reason.

    ``replies`` has the key, answer and error, as ``ask`` gives them.
    """
    known = citations.groupBy(key).agg(F.collect_set("id").alias("ids"), F.collect_set(F.when(F.col("url") != "?", F.col("url"))).alias("urls"))
    rows = answers_.join(replies.select(key, F.trim("answer").alias("reply"), "error"), key, "left").join(known, key, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    sound = synthesis.valid_markdown(F.col("reply"), none("ids", "int"), none("urls", "string"))
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("llm call failed: "), F.col("error"))).when(F.coalesce("reply", F.lit("")) == "", "llm returned non-string / empty")
        .when(~sound, "post-validation failed")
    )
    rows = rows.withColumn("llm_fallback_reason", reason).withColumn("enriched_by_llm", F.col("llm_fallback_reason").isNull())
    return rows.select(key, F.when(F.col("enriched_by_llm"), F.col("reply")).otherwise(F.col("answer_markdown")).alias("answer_markdown"), "enriched_by_llm", "llm_fallback_reason")


def enrich(answers_: DataFrame, questions: DataFrame, facts: DataFrame, citations: DataFrame, models: list[Model], key: str = "query_id") -> DataFrame:
    """Answers in a model's wording where that is sound; all as they were if there is no model."""
    if not models:
        return answers_.select(key, "answer_markdown", F.lit(False).alias("enriched_by_llm"), F.lit("no llm_client").alias("llm_fallback_reason"))
    return rewritten(answers_, ask(rewrite_prompts(answers_, questions, facts, citations, key), models, key), citations, key)
