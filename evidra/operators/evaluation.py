"""Evaluation of runs: quality score, aggregates, recall of primary sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, scoring, urls
from . import planning


def load_cases(spark: SparkSession, path: str, items: str = "cases") -> DataFrame:
    """The cases of an evaluation set: a JSON file that is an array of cases, or an object with one under ``items``."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode(items).alias("_case")).select("_case.*") if items in rows.columns else rows


def quality_rows(results: DataFrame) -> DataFrame:
    """Results with ``route_ok`` and the quality score ``qs``."""
    rows = results.withColumn("route_ok", (F.col("expected_route") == F.col("route")).cast("double"))
    return rows.withColumn("qs", scoring.quality_score(F.col("coverage"), F.col("contradiction_rate"), F.col("confidence"), F.col("route_ok")))


def score_offline(cases: DataFrame) -> DataFrame:
    """Cases (id, query, expected_route) with what can be told without a network: route, main query, reasons to ask back, and the score with no coverage."""
    plans = planning.classify(planning.adapt(cases))
    rows = plans.withColumns({"coverage": F.lit(0.0), "confidence": F.lit(0.0), "contradiction_rate": F.lit(0.0), "mode": F.lit("offline")})
    return quality_rows(rows).select("id", "query", "expected_route", "route", "route_ok", "main_query", "needs_confirmation", "dropped_terms", "coverage", "confidence", "contradiction_rate", "mode", "qs")


def aggregate(results: DataFrame) -> DataFrame:
    """One row over all results: scores, rates, numbers of errors and model calls, and the counters of what was skipped, as far as the results have them."""
    have = set(results.columns)
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    parts = [F.count(F.lit(1)).alias("queries"), mean("qs", "qs_mean"), F.round(F.min("qs"), 4).alias("qs_min"), F.round(F.max("qs"), 4).alias("qs_max"), mean("coverage", "avg_coverage"), mean("confidence", "avg_confidence"), mean("route_ok", "routing_accuracy")]
    share = lambda cond, name: F.round(F.count_if(cond) / F.count(F.lit(1)), 4).alias(name)
    optional = {
        "needs_confirmation": share(F.col("needs_confirmation"), "confirmation_rate"), "error": F.count_if(F.coalesce("error", F.lit("")) != "").alias("error_count"),
        "mode": F.count_if(F.col("mode") == "online").alias("online_count"), "llm_calls": F.sum("llm_calls").alias("total_llm_calls"), "stage": share(F.col("stage") == "done", "pipeline_completion_rate"),
    }
    parts += [c for name, c in optional.items() if name in have]
    return results.agg(*parts, *(F.sum(c).alias(c) for c in fixed.SKIP_COUNTERS if c in have))


def url_counters(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """URLs seen, repeated (raw or canonical) and denied per question."""
    blank = F.coalesce("url", F.lit("")) == ""
    raw = F.row_number().over(Window.partitionBy(key, "url").orderBy("seq")) > 1
    rows = hits.withColumn("again", blank | raw).withColumn("denied", ~F.col("again") & urls.is_denied(F.col("url")))
    rows = rows.withColumn("open", ~F.col("again") & ~F.col("denied")).withColumn("canon_url", urls.canonical_url(F.col("url")))
    nth = F.row_number().over(Window.partitionBy(key, "canon_url", "open").orderBy("seq"))
    rows = rows.withColumn("same_page", F.col("open") & (nth > 1))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("urls_total"), F.count_if(F.col("again") | F.col("same_page")).alias("urls_skipped_duplicate"),
        F.count_if("denied").alias("urls_skipped_deny_pattern"), F.count_if(F.col("open") & ~F.col("same_page")).alias("urls_kept"),
    )


def primary_recall(cases: DataFrame, hits: DataFrame, key: str = "case_id") -> DataFrame:
    """Per case whether a hit is one of its primary sources (array ``primary_urls``)."""
    wanted = cases.select(key, F.explode("primary_urls").alias("url")).select(key, urls.canonical_url(F.col("url")).alias("canon_url"))
    seen = hits.select(key, urls.canonical_url(F.col("url")).alias("canon_url")).distinct()
    recalled = wanted.join(seen, [key, "canon_url"], "left_semi").select(key).distinct().withColumn("primary_source_recalled", F.lit(True))
    return cases.join(recalled, key, "left").fillna(False, ["primary_source_recalled"])


def retrieval_summary(results: DataFrame) -> DataFrame:
    """One row: recall of releases and of hard negatives, cases without results, engines that answered."""
    release, negative = F.col("status").isin("release", "limited_release"), F.col("status") == "not_release_in_window"
    hit = F.col("primary_source_recalled")
    return results.agg(
        scoring.ratio(F.count_if(release & hit), F.count_if(release)).alias("release_recall"),
        scoring.ratio(F.count_if(negative & hit), F.count_if(negative)).alias("negative_recall"),
        F.count_if(F.col("result_count") == 0).alias("zero_result_cases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines")))).alias("engines"),
    )


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))
