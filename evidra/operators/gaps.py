"""What a research state lacks, and the tasks that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls

LEAST_DOCUMENTS = 3
LEAST_DOMAINS = 2
MOST_UNSUPPORTED = 0.4
LEAST_CONFIDENCE = 0.5


def domain_counts(documents: DataFrame, key: str = "query_id") -> DataFrame:
    """Documents and distinct domains per question, exactly."""
    return documents.groupBy(key).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(F.nullif(urls.domain_of(F.col("url")), F.lit(""))).alias("domains"))


def strongest_verdicts(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Whether any fact with the same first 50 characters is supported."""
    known = verdicts.filter("coalesce(fact, '') <> '' AND verdict IS NOT NULL").withColumn("head", F.lower(F.substring("fact", 1, 50)))
    return known.groupBy(key, "head").agg(F.bool_or(F.col("verdict") == "SUPPORTS").alias("supported"))


def analyze(questions: DataFrame, hits: DataFrame, documents: DataFrame, claims: DataFrame, verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Gaps (key, kind, detail) of every question.

    ``documents`` has seq, url, text and source_score; ``claims`` claim_no
    and claim. Each relation is one row per question before they meet.
    """
    n_hits = hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    docs = domain_counts(documents, key).join(documents.groupBy(key).agg(F.min_by("source_score", "seq").alias("top")), key)
    heads = strongest_verdicts(verdicts, key)
    any_ = heads.select(key).distinct().withColumn("judged", F.lit(True))
    told = claims.filter("coalesce(claim, '') <> ''").withColumn("head", F.lower(F.substring("claim", 1, 50)))
    judged = told.join(heads, [key, "head"], "left").join(any_, key, "left")
    # before anything is verified, a claim counts as supported where a document has it
    texts = documents.select(key, F.lower("text").alias("_text"))
    plain = told.join(any_, key, "left_anti").select(key, "claim_no", "head").join(texts, key).filter(F.contains("_text", F.col("head"))).select(key, "claim_no").distinct().withColumn("found", F.lit(True))
    judged = judged.join(plain, [key, "claim_no"], "left")
    fine = F.when(F.col("judged"), F.coalesce("supported", F.lit(False))).otherwise(F.coalesce("found", F.lit(False)))
    loose = judged.groupBy(key).agg(F.count_if(~fine).alias("unsupported"), F.bool_or(F.coalesce("judged", F.lit(False))).alias("judged"))
    all_claims = claims.groupBy(key).agg(F.count(F.lit(1)).alias("claims"))
    conflict = verdicts.groupBy(key).agg((F.bool_or(F.col("method") == "conflicting") | (F.count_if("verified") / F.count(F.lit(1)) < 0.2)).alias("conflict"))
    state = questions.select(key)
    for part in (n_hits, docs, loose, all_claims, conflict):
        state = state.join(part, key, "left")
    state = state.fillna(0, ["hits", "documents", "domains", "unsupported", "claims"])
    share = F.col("unsupported") / F.greatest(F.col("claims"), F.lit(1))
    percent = F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))
    source = F.when(F.col("judged"), "verdicts").otherwise("substring_fallback")
    gap = lambda kind, cond, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    found = F.array_compact(F.array(
        gap("too_few_sources", F.col("documents") < LEAST_DOCUMENTS, F.format_string(f"only %d documents fetched (min {LEAST_DOCUMENTS})", "documents")),
        gap("no_search_results", (F.col("hits") == 0) & (F.col("documents") == 0), F.lit("web_search returned 0 hits for all tasks")),
        gap("low_source_diversity", (F.col("documents") > 0) & (F.col("domains") < LEAST_DOMAINS), F.format_string(f"only %d unique domain(s) (min {LEAST_DOMAINS})", "domains")),
        gap("too_many_unsupported_claims", (F.col("claims") > 0) & (share > MOST_UNSUPPORTED), F.concat(F.format_string("%d/%d claims (", "unsupported", "claims"), percent, F.lit(") unsupported (max 40%, source="), source, F.lit(")"))),
        gap("contradictions_unresolved", F.coalesce("conflict", F.lit(False)), F.lit("verification found conflicting sources that weren't reconciled")),
        gap("low_confidence", (F.col("documents") > 0) & (F.coalesce("top", F.lit(0.0)) < LEAST_CONFIDENCE), F.format_string(f"top-1 source_score=%.2f (min {LEAST_CONFIDENCE})", F.coalesce("top", F.lit(0.0)))),
    ))
    return state.select(key, F.explode(F.array_sort(found)).alias("_g")).select(key, "_g.kind", "_g.detail")


def gap_tasks(gaps: DataFrame, questions: DataFrame, key: str = "query_id") -> DataFrame:
    """One task of priority 50 per kind of gap that a search can fill."""
    spark = gaps.sparkSession
    rules = spark.createDataFrame([(k, e, w) for k, (e, w) in fixed.GAP_TASKS.items()], "kind string, ending string, why string")
    rows = gaps.select(key, "kind").distinct().join(F.broadcast(rules), "kind").join(questions, key)  # five rules
    return rows.select(key, "kind", F.concat("query", F.col("ending")).alias("query"), "route", "language", F.lit(50).alias("priority"), F.concat(F.lit("gap-fill: "), F.col("kind"), F.lit(" → "), F.col("why")).alias("rationale"))


TASK_KEY = ["query", "route", "language", "engines", "categories"]


def new_tasks(tasks: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Tasks that were not dispatched before, one per task key; time range and priority are not part of it."""
    same: list[Column] = [tasks[c].eqNullSafe(done[c]) for c in [key, *TASK_KEY]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return tasks.dropDuplicates([key, *TASK_KEY]).join(done, condition, "left_anti")
