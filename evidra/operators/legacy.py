"""The older flows: search, fetch and order; and many wordings of a question, votes, and the best source checked against the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, language, scoring, text, udfs, urls
from . import matching, ranking
from .research import Fetch, Search

ALTERNATIVES = 3
SHOWN = 30


def _scored(fetched: DataFrame, questions: DataFrame) -> DataFrame:
    """Fetched sources with the older score and their rank by it."""
    rows = fetched.join(questions.select("query_id", F.col("query").alias("_asked")), "query_id")
    score = scoring.legacy_confidence(F.col("text"), F.col("length"), text.legacy_terms(F.col("_asked")))
    score = F.when(F.coalesce("error", F.lit("")) != "", 0.0).otherwise(score)
    return ranking.legacy_order(rows.withColumn("source_score", score).drop("_asked"))


def _stats(questions: DataFrame, sources: DataFrame) -> DataFrame:
    failed = F.coalesce("error", F.lit("")) != ""
    counts = sources.groupBy("query_id").agg(F.count_if(~failed).alias("fetched_ok"), F.count_if(failed).alias("fetched_err"))
    return questions.select("query_id", "query").join(counts, "query_id", "left").fillna(0, ["fetched_ok", "fetched_err"])


def deep_search(questions: DataFrame, search: Search, fetch: Fetch, top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sources with score and rank, and one row of counts per question: the first ``top_n`` pages found, by place, fetched and ordered."""
    tasks = questions.select("query_id", "query", F.lit("general").alias("route"), F.lit(100).alias("priority"))
    hits = search(tasks).withColumn("canon_url", urls.canonical_url(F.col("url"))).filter("canon_url <> '' AND NOT startswith(canon_url, 'javascript:')")
    first = ranking.rank_within(hits, ["query_id", "canon_url"], [F.asc("rank")], "_n").filter("_n = 1").drop("_n")
    kept = ranking.top_n(first.withColumnRenamed("rank", "place"), "query_id", [F.asc("place"), F.asc("canon_url")], top_n).drop("rank")
    sources = _scored(fetch(kept), questions)
    return sources, _stats(questions, sources)


def wordings(questions: DataFrame) -> DataFrame:
    """The ways to ask (query_id, nr, query, language) of questions (query_id, query, language, alt_queries): as is, up to three others of 1 to 15 words, and with words replaced."""
    words = lambda q: F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    others = F.filter(F.slice(F.coalesce("alt_queries", F.array().cast("array<string>")), 1, ALTERNATIVES), lambda q: words(q).between(1, 15) & (q != F.col("query")))
    replaced = F.when(F.col("language") == "ru", text.reformulated(F.col("query"), fixed.REFORMULATIONS))
    way = lambda q, lang: F.struct(q.alias("query"), lang.alias("language"))
    ways = F.concat(F.array(way(F.col("query"), F.col("language"))), F.transform(others, lambda q: way(q, F.col("language"))), F.filter(F.array(way(replaced, F.lit("en"))), lambda w: w["query"].isNotNull()))
    return questions.select("query_id", F.col("query").alias("question"), F.posexplode(ways).alias("nr", "_w")).select("query_id", "question", "nr", "_w.query", "_w.language")


@dataclass
class LegacyResearch:
    """The tables of a run; each has ``query_id``."""

    queries: DataFrame
    hits: DataFrame
    sources: DataFrame
    verdicts: DataFrame
    summary: DataFrame


def _hit_score(rank: Column) -> Column:
    return F.round(scoring.hit_score(rank, F.col("title"), F.col("snippet"), F.col("engine"), text.legacy_terms(F.col("question"))), 10)


def deep_research(questions: DataFrame, search: Search, fetch: Fetch, top_n: int = 4, facts: int = 8) -> LegacyResearch:
    """Answer questions (query_id, query, language, alt_queries) by several wordings.

    ``search`` gives hits (query_id, task_query, rank, engine, url, title,
    snippet). Votes add up over engines and wordings, hits rank by place,
    words and engine, the first ``top_n`` pages are fetched, and the facts
    of the best one are checked against the others.
    """
    ways = wordings(questions).withColumn("time_range", language.infer_time_range(F.col("question")))
    found = search(ways.select("query_id", "query", F.lit("general").alias("route"), F.lit(100).alias("priority"), "language", "time_range"))
    hits = found.join(ways.select("query_id", F.col("query").alias("task_query"), "nr", "question"), ["query_id", "task_query"])
    hits = hits.withColumn("seq", F.col("nr") * 1000 + F.col("rank")).withColumn("score", _hit_score(F.col("rank") - 1)).withColumn("canon_url", urls.canonical_url(F.col("url")))
    votes = ranking.vote_aggregation(hits.withColumn("query", F.col("task_query")))
    best = ranking.rank_within(hits.filter("canon_url <> ''"), ["query_id", "canon_url"], [F.desc("score"), F.asc("seq")], "_n").filter("_n = 1")
    top = ranking.top_n(best.select("query_id", "canon_url", "score", "seq"), "query_id", [F.desc("score"), F.asc("seq"), F.asc("canon_url")], top_n).select("query_id", "canon_url")
    chosen = top.join(votes.drop("seq", "best_rank"), ["query_id", "canon_url"]).withColumn("url", F.col("canon_url"))
    sources = _scored(fetch(chosen), questions)
    told = sources.filter("rank = 1").select("query_id", F.col("text").alias("top_text"), F.posexplode(udfs.facts_of(F.col("text"), F.lit(""), F.lit(facts))).alias("fact_no", "fact"))
    others = sources.filter((F.col("rank") > 1) & (F.coalesce("error", F.lit("")) == "") & (F.coalesce("text", F.lit("")) != ""))
    verdicts = matching.verify(told, others.select("query_id", "url", "text"))
    shown = ranking.top_n(hits.withColumnRenamed("rank", "place"), "query_id", [F.desc("score"), F.asc("seq")], SHOWN)
    one = sources.filter("rank = 1").select("query_id", F.col("url").alias("top1_url"), F.col("source_score").alias("top1_confidence"))
    unique = votes.groupBy("query_id").agg(F.count(F.lit(1)).alias("unique_sources"))
    summary = _stats(questions, sources)
    for part in (one, unique, matching.verification_rate(verdicts)):
        summary = summary.join(part, "query_id", "left")
    summary = summary.fillna(0, ["unique_sources", "verified_facts", "total_facts"]).fillna(0.0, ["top1_confidence", "verification_rate"])
    return LegacyResearch(ways, shown, sources, verdicts, summary)
