"""Hits and documents: dedup by canonical URL, provenance, votes, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text, urls


def normalize_hits(raw: DataFrame, max_results: int, key: str = "query_id", position: str = "seq") -> DataFrame:
    """Raw result rows in one shape: cut to the first ``max_results`` before bad rows go, engines never empty if known."""
    first = raw.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(position))).filter(F.col("_n") <= max_results).drop("_n")
    named = F.filter(F.coalesce("engines", F.array().cast("array<string>")), lambda e: e != "")
    engines = F.when(F.size(named) > 0, named).when(F.coalesce("engine", F.lit("")) != "", F.array("engine")).otherwise(F.array().cast("array<string>"))
    return first.filter("url IS NOT NULL").select(
        key, position, F.coalesce("engine", F.lit("")).alias("engine"), engines.alias("engines"), "title", "url",
        F.coalesce("content", F.lit("")).alias("snippet"), "score", "category", F.col("publishedDate").alias("published_date"),
    )


def unresponsive_labels(pairs: Column) -> Column:
    """``engine: reason`` of engines that failed, distinct and sorted."""
    labels = F.transform(pairs, lambda p: F.when(F.coalesce(p["reason"], F.lit("")) != "", F.concat_ws(": ", p["engine"], p["reason"])).otherwise(p["engine"]))
    return F.array_sort(F.array_distinct(F.filter(labels, lambda x: x != "")))


def is_degraded(error: Column, unresponsive: Column, hits: Column) -> Column:
    """A search that failed, missed an engine or found nothing."""
    return (F.coalesce(error, F.lit("")) != "") | (F.size(unresponsive) > 0) | (hits == 0)


def rank_within(rows: DataFrame, key: str | list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Numbers from 1 in each group."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(rows: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; none if ``n`` is not positive."""
    return rank_within(rows, key, order).filter(F.col("rank") <= max(n, 0))


def merge_provenance(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per canonical URL: its first hit, and all distinct places from which it was found, in order.

    ``hits`` has ``seq``, ``url``, ``title``, ``snippet`` and a struct
    ``provenance``. Rows without a URL go.
    """
    named = hits.filter(F.trim(F.coalesce("url", F.lit(""))) != "").withColumn("canon_url", urls.canonical_url(F.col("url")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "provenance")))
    first = F.min_by(F.struct("url", "title", "snippet"), "seq")
    merged = named.groupBy(key, "canon_url").agg(F.min("seq").alias("seq"), first.alias("_first"), F.array_distinct(F.transform(ordered, lambda x: x["provenance"])).alias("provenance"))
    return merged.select(key, "canon_url", "seq", "_first.*", "provenance")


def vote_aggregation(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Votes of engines and questions for each canonical URL; ``hits`` has seq, url, engine, query, rank, title and snippet."""
    named = hits.filter(F.trim(F.coalesce("url", F.lit(""))) != "").withColumn("canon_url", urls.canonical_url(F.col("url")))
    votes = named.groupBy(key, "canon_url").agg(
        F.array_sort(F.collect_set(F.when(F.col("engine") != "", F.col("engine")))).alias("found_by_engines"),
        F.array_sort(F.collect_set("query")).alias("found_by_queries"),
        F.array_sort(F.collect_set("url")).alias("raw_urls"),
        F.min("rank").alias("best_rank"),
        F.min("seq").alias("seq"),
        F.min_by("title", "seq").alias("title"),
        F.min_by("snippet", "seq").alias("snippet"),
    )
    return votes.withColumn("search_votes", F.size("found_by_engines") + F.size("found_by_queries"))


def rank_documents(documents: DataFrame, question: Column, key: str = "query_id") -> DataFrame:
    """Documents with ``source_score`` and ``rank``.

    ``documents`` has seq, url, text, length, error and provenance (array
    of structs with task_query and rank). Equal scores rank by seq, then url.
    """
    ranks = F.transform("provenance", lambda p: p["rank"].cast("int"))
    search = F.coalesce(scoring.search_score(ranks, F.transform("provenance", lambda p: p["task_query"])), scoring.position_score(F.col("seq")))
    score = scoring.source_score(F.col("text"), F.col("length"), text.terms(question), search, F.coalesce("error", F.lit("")) != "")
    return rank_within(documents.withColumn("source_score", score), key, [F.desc("source_score"), F.asc("seq"), F.asc("url")])


def search_events(tasks: DataFrame, hits: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """One row per task (keys): number of results, engines that answered and that did not, error, and whether the search was degraded.

    ``hits`` has the keys and ``engine``; ``failures`` the keys,
    ``unresponsive`` (labels) and ``error``.
    """
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("result_count"), F.array_sort(F.collect_set(F.when(F.col("engine") != "", F.col("engine")))).alias("responding_engines"))
    rows = tasks.join(counts, keys, "left").join(failures.select(*keys, "unresponsive", "error"), keys, "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"result_count": F.coalesce("result_count", F.lit(0)), "responding_engines": F.coalesce("responding_engines", empty), "unresponsive_engines": F.coalesce("unresponsive", empty)}).drop("unresponsive")
    return rows.withColumn("degraded", is_degraded(F.col("error"), F.col("unresponsive_engines"), F.col("result_count")))


def legacy_order(sources: DataFrame, key: str = "query_id") -> DataFrame:
    """Fetched sources with ``rank``: by score, then by length, then by URL."""
    return rank_within(sources, key, [F.desc(F.coalesce("source_score", F.lit(0.0))), F.desc(F.coalesce("length", F.lit(0))), F.asc("url")])


def engines_of(engines: Column, engine: Column) -> Column:
    """The engines of a hit, distinct and sorted: the list if there is one, else the single name."""
    listed = F.when(engines.isNotNull(), engines).otherwise(F.array(engine))
    return F.array_sort(F.array_distinct(F.filter(listed, lambda e: e.isNotNull() & (e != ""))))


def first_per_url(sources: DataFrame, key: str = "query_id") -> DataFrame:
    """The first source of each exact URL; sources without one (empty or ``?``) all stay."""
    blank = F.coalesce("url", F.lit("")).isin("", "?")
    same = Window.partitionBy(key, F.when(~blank, F.col("url")), F.when(blank, F.col("seq"))).orderBy("seq")
    return sources.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")


def unseen(hits: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Hits that no earlier iteration had."""
    return hits.join(history.select(*keys).distinct(), keys, "left_anti")


def url_whitelist(answers: DataFrame, candidates: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """URLs of a language model that are candidates by canonical form, as the candidates write them, at most ``most`` in order.

    ``answers`` has the keys, ``pos`` and ``url``; ``candidates`` the first
    key, ``pos`` and ``url``. Anything but http and https is refused.
    """
    web = answers.filter(F.lower(F.trim("url")).rlike("^https?://")).withColumn("canon_url", urls.canonical_url(F.col("url")))
    known = candidates.withColumn("canon_url", urls.canonical_url(F.col("url"))).groupBy(keys[0], "canon_url").agg(F.min_by("url", "pos").alias("original_url"))
    found = web.join(known, [keys[0], "canon_url"]).groupBy(*keys, "original_url").agg(F.min("pos").alias("pos"))
    return rank_within(found, keys, [F.asc("pos")], "nr").filter(F.col("nr") <= most).select(*keys, "nr", "original_url")
