"""The whole loop: plan, search, rank, extract, verify, find gaps, search again, answer, review.

Searching and fetching are functions that turn tasks into hits and hits
into documents; offline they replay stored relations. Every iteration is
one plan over all questions at once; its tables are written to the shared
folder, so the plan of the next iteration stays short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..session import cut
from . import critic, gaps, matching, planning, ranking, synthesis

Search = Callable[[DataFrame], DataFrame]
Fetch = Callable[[DataFrame], DataFrame]


@dataclass
class Research:
    """The tables of a run; each has ``query_id``."""

    plans: DataFrame
    tasks: DataFrame
    hits: DataFrame
    documents: DataFrame
    claims: DataFrame
    verdicts: DataFrame
    gaps: DataFrame
    citations: DataFrame
    answers: DataFrame
    audit: DataFrame
    review: DataFrame


def extract_claims(documents: DataFrame, limit: int = 8) -> DataFrame:
    """Claims of all documents with the span in the document they are from."""
    rows = documents.withColumn("_facts", udfs.facts_of(F.col("text"), F.lit(""), F.lit(limit)))
    rows = rows.select("query_id", F.col("rank").alias("doc_rank"), "url", "text", F.posexplode("_facts").alias("nr", "claim"))
    rows = rows.withColumn("span", udfs.span_of(F.col("claim"), F.col("text")))
    return rows.select("query_id", (F.col("doc_rank") * 1000 + F.col("nr")).alias("claim_no"), "doc_rank", "url", "claim", F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def run_research(questions: DataFrame, search: Search, fetch: Fetch, top_n: int = 4, max_iterations: int = 2, approved: bool = True) -> Research:
    """Answer all questions (query_id, query).

    ``search`` gives hits (query_id, task_query, task_route, rank, url,
    title, snippet) for tasks; ``fetch`` adds text, length and error to
    distinct hits. Unless ``approved``, questions whose plan needs
    confirmation get no tasks.
    """
    plans = cut(planning.classify(planning.adapt(questions)), "plans")
    ready = plans if approved else plans.filter(~F.col("needs_confirmation") & ~F.col("routing_warning"))
    done = cut(planning.search_tasks(ready), "tasks")
    pending, hits, documents, claims, verdicts = done, None, None, None, None
    seen: DataFrame | None = None
    found = None
    for turn in range(max_iterations):
        raw = search(pending)
        order = F.row_number().over(ranking.Window.partitionBy("query_id").orderBy(F.desc("priority"), "task_query", "rank", "url"))
        place = F.struct("task_query", "task_route", F.col("priority").alias("task_priority"), "rank")
        merged = ranking.merge_provenance(raw.withColumn("seq", order).withColumn("provenance", place))
        fresh = merged if seen is None else ranking.unseen(merged, seen, ["query_id", "canon_url"])
        fresh = cut(ranking.top_n(fresh, "query_id", [F.asc("seq")], 3 * top_n).drop("rank"), "hits")
        seen = fresh.select("query_id", "canon_url") if seen is None else seen.unionByName(fresh.select("query_id", "canon_url"))
        fetched = fetch(fresh).join(plans.select("query_id", "query"), "query_id")
        ranked = ranking.rank_documents(fetched, F.col("query")).filter((F.col("rank") <= top_n) & (F.coalesce("text", F.lit("")) != ""))
        ranked = cut(ranked.withColumn("iteration", F.lit(turn)), "documents")
        told = extract_claims(ranked).withColumn("iteration", F.lit(turn))
        top = told.filter("doc_rank = 1").join(ranked.filter("rank = 1").select("query_id", F.col("text").alias("top_text")), "query_id")
        facts = top.select("query_id", F.col("claim_no").alias("fact_no"), F.col("claim").alias("fact"), "top_text")
        judged = cut(matching.verify(facts, ranked.filter("rank > 1").select("query_id", "url", "text")).withColumn("iteration", F.lit(turn)), "verdicts")
        told = cut(told, "claims")
        hits, documents, claims, verdicts = (new if old is None else old.unionByName(new) for old, new in ((hits, fresh), (documents, ranked), (claims, told), (verdicts, judged)))
        state = documents.withColumn("seq", F.col("iteration") * 1000 + F.col("rank"))
        found = cut(gaps.analyze(questions, hits, state, claims, verdicts.withColumn("method", F.lit(None).cast("string"))), "gaps")
        if turn + 1 == max_iterations:
            break
        asked = gaps.gap_tasks(found, plans.select("query_id", "query", "route", "language"))
        asked = asked.withColumn("engines", F.lit(None).cast("string")).withColumn("categories", F.lit(None).cast("string"))
        pending = cut(gaps.new_tasks(asked, done), "tasks")
        if pending.isEmpty():
            break
        done = done.unionByName(pending, allowMissingColumns=True)
    sources = documents.withColumn("seq", F.col("iteration") * 1000 + F.col("rank")).select("query_id", "seq", "url", "title", "snippet", "text")
    citations = cut(synthesis.citation_table(sources), "citations")
    rows = synthesis.classified(verdicts, citations)
    spans = claims.select("query_id", F.col("claim_no").alias("fact_no"), "iteration", synthesis.span_marker(F.col("doc_rank") - 1, F.col("start"), F.col("end")).alias("span_marker"))
    places = documents.select("query_id", "iteration", "url", (F.col("rank") - 1).alias("doc_index"))
    contested = synthesis.contradiction_markers(verdicts, places, ["query_id", "iteration"])
    rows = rows.join(spans, ["query_id", "fact_no", "iteration"], "left").join(contested, ["query_id", "fact_no", "iteration"], "left")
    rows = cut(rows, "classified")
    answers = cut(synthesis.render_answer(questions, rows, citations), "answers")
    told, sources = claims.select("query_id", "claim_no", "claim"), critic.with_blob(sources)
    flags = critic.numeric_consistency(told, sources)
    for more in (critic.entity_hallucination(told, sources), critic.self_contradiction(verdicts), critic.citation_integrity(answers, citations), critic.temporal_consistency(told, sources)):
        flags = flags.unionByName(more)
    return Research(plans, done, hits, documents, claims, verdicts, found, citations, answers, synthesis.render_audit(questions, rows), critic.review(flags, questions))


def manifest(run: Research, approved: bool = True) -> DataFrame:
    """One JSON object per question: status, plan, tasks, documents, citations, answer and review, and what the numbers are."""
    waits = F.lit(False) if approved else F.col("needs_confirmation") | F.col("routing_warning")
    in_order = lambda rows, order, *cols: rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("_l"))
    plans = run.plans.select("query_id", F.when(waits, "needs_confirmation").otherwise("done").alias("status"), F.struct("query", "main_query", "alt_queries", "route", "language", "confirmation_reason").alias("plan"))
    parts = {
        "tasks": in_order(run.tasks, "task_id", "query", "priority", "rationale"), "documents": in_order(run.documents, "iteration", "rank", "url", "source_score"), "gaps": in_order(run.gaps, "kind", "detail"),
        "citations": in_order(run.citations, "id", "url", "title"),
    }
    for name, rows in parts.items():
        plans = plans.join(rows.withColumnRenamed("_l", name), "query_id", "left")
    plans = plans.join(run.answers, "query_id", "left").join(run.review.select("query_id", F.struct("risk_score", "risk_level", "recommendations").alias("review")), "query_id", "left")
    return plans.select("query_id", F.to_json(F.struct(*(c for c in plans.columns if c != "query_id"))).alias("manifest"))


def replayed_search(corpus: DataFrame, most: int = 10) -> Search:
    """Search over a stored corpus (url, title, text): documents with most of a task's terms.

    The terms of the tasks meet the words of the documents by equality, so
    no task meets every document.
    """
    from ..functions import text

    words = corpus.select("url", "title", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))

    def search(tasks: DataFrame) -> DataFrame:
        asked = tasks.select("query_id", "query", F.col("route").alias("task_route"), "priority", F.explode(text.terms(F.col("query"))).alias("term"))
        found = asked.join(words, "term").groupBy("query_id", "query", "task_route", "priority", "url", "title").agg(F.count(F.lit(1)).alias("n"))
        first = ranking.rank_within(found, ["query_id", "query", "task_route"], [F.desc("n"), F.asc("url")]).filter(F.col("rank") <= most)
        return first.select("query_id", F.col("query").alias("task_query"), "task_route", "priority", "rank", "url", "title", F.lit("").alias("snippet"))

    return search


def replayed_fetch(corpus: DataFrame) -> Fetch:
    """Pages of a stored corpus (url, text); unknown URLs get an error."""

    def fetch(hits: DataFrame) -> DataFrame:
        rows = hits.join(corpus.select("url", "text"), "url", "left")
        return rows.withColumn("error", F.when(F.col("text").isNull(), "not stored")).withColumn("length", F.coalesce(F.length("text"), F.lit(0)))

    return fetch
