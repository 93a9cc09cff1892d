"""The order-dependent functions by name, for use in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import udfs


@F.udtf(returnType="fact_no int, fact string")
class Facts:
    """``evidra_facts(text, question, most)``: a row per fact of a text, in order."""

    def eval(self, text: str | None, question: str | None, most: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(udfs.extract_facts(text, most, question or ""))


@F.udtf(returnType="nr int, start int, end int, score double, terms array<string>, body string")
class Windows:
    """``evidra_windows(text, claim)``: a row per stretch of a text with a claim's words, the best first."""

    def eval(self, text: str | None, claim: str | None) -> Iterator[tuple]:
        for nr, w in enumerate(udfs.extract_windows(text, claim)):
            yield nr, w["start"], w["end"], w["score"], w["terms"], w["text"]


def register(spark: SparkSession) -> None:
    """Make ``evidra_facts``, ``evidra_windows``, ``evidra_span``, ``evidra_ratio`` and ``evidra_redact`` known to the session."""
    spark.udtf.register("evidra_facts", Facts)
    spark.udtf.register("evidra_windows", Windows)
    for name, function in (("evidra_span", udfs.span_of), ("evidra_ratio", udfs.fuzzy), ("evidra_redact", udfs.redact_udf)):
        spark.udf.register(name, function)
