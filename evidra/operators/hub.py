"""Repository events of a model hub: signals, families, candidates, recall."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, scoring, urls

HUB = "https://huggingface.co"
PAYLOAD = (
    "id string, modelId string, createdAt string, lastModified string, pipeline_tag string, library_name string, tags array<string>, "
    "cardData struct<base_model:string, base_model_relation:string>, downloads bigint, likes bigint, gated string"
)


def _utc(stamp: Column) -> Column:
    return F.try_to_timestamp(F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), stamp))


def base_model(tags: Column, card: Column) -> Column:
    """Base model and relation: from the card, or from the first tag ``base_model:[relation:]id``."""
    listed = F.get(F.from_json(card["base_model"], "array<string>"), F.lit(0))
    carded = F.when(card["base_model"].startswith("["), listed).otherwise(card["base_model"])
    tagged = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith("base_model:"))
    rest = F.transform(tagged, lambda t: F.substring(t, F.lit(12), F.length(t)))
    relation = lambda r: F.regexp_extract(r, "^(" + "|".join(fixed.HUB_RELATIONS) + "):.", 1)
    related = F.get(F.filter(rest, lambda r: relation(r) != ""), F.lit(0))
    plain = F.get(F.filter(rest, lambda r: (relation(r) == "") & (r != "")), F.lit(0))
    tag = F.coalesce(related, plain)
    name = F.regexp_replace(tag, "^(" + "|".join(fixed.HUB_RELATIONS) + "):", "")
    return F.struct(F.coalesce(F.nullif(carded, F.lit("")), name).alias("base_model"), F.coalesce(card["base_model_relation"], F.nullif(relation(tag), F.lit(""))).alias("relation"))


def parse_models(payloads: DataFrame) -> DataFrame:
    """Signals from payloads of the hub's models; rows without an owner in the id or without both times go."""
    base = base_model(F.col("tags"), F.col("cardData"))
    rows = payloads.withColumn("_id", F.coalesce("id", "modelId")).withColumn("_base", base)
    rows = rows.select(
        F.col("_id").alias("repo_id"), _utc(F.col("createdAt")).alias("created_at"), _utc(F.col("lastModified")).alias("last_modified"), "pipeline_tag", "library_name",
        "_base.base_model", "_base.relation", F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("gated", F.lit("false")).alias("gated"),
    )
    return rows.filter(F.contains("repo_id", F.lit("/")) & F.col("created_at").isNotNull() & F.col("last_modified").isNotNull())


def is_derivative() -> Column:
    return F.coalesce((F.col("base_model") != "") & (F.lower("base_model") != F.lower("repo_id")), F.lit(False))


def family_id() -> Column:
    return F.coalesce(F.nullif(F.col("base_model"), F.lit("")), F.col("repo_id"))


def newest_signals(signals: DataFrame) -> DataFrame:
    """The signal of each repository with the latest change; of equals the one that came last (``arrival``)."""
    columns = [c for c in signals.columns if c != "repo_id"]
    return signals.groupBy("repo_id").agg(F.max_by(F.struct(*columns), F.struct("last_modified", "arrival")).alias("_s")).select("repo_id", "_s.*")


def in_window(since: datetime | Column, until: datetime | Column) -> Column:
    """Created or changed in the window, both ends included."""
    return F.col("created_at").between(since, until) | F.col("last_modified").between(since, until)


def build_candidates(signals: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """Families with events in the window: state, score, counts and times.

    All sums are partial before the shuffle, so a family with a third of
    all repositories costs a row per task.
    """
    if until < since:
        raise ValueError("until must not be earlier than since")
    lo, hi = F.lit(since), F.lit(until)
    inside = lambda c: F.when(F.col(c).between(lo, hi), F.col(c))
    rows = signals.filter(in_window(lo, hi)).withColumn("family_id", family_id()).withColumn("_derived", is_derivative())
    new = F.col("created_at").between(lo, hi)
    families = rows.groupBy("family_id").agg(
        F.count_if(new & ~F.col("_derived")).alias("new_roots"),
        F.count_if(new & F.col("_derived")).alias("derivative_repositories"),
        F.count_if(new).alias("new_repositories"),
        F.count_if((F.col("created_at") < lo) & F.col("last_modified").between(lo, hi)).alias("updated_repositories"),
        (F.sum("likes") + F.least(F.lit(1000), F.sum("downloads")) / 100).alias("_engagement"),
        F.least(F.min(inside("created_at")), F.min(inside("last_modified"))).alias("first_signal_at"),
        F.greatest(F.max(inside("created_at")), F.max(inside("last_modified"))).alias("last_signal_at"),
        F.count(F.lit(1)).alias("signal_count"),
    )
    state = scoring.candidate_state(F.col("new_roots"), F.col("derivative_repositories"), F.col("updated_repositories"))
    families = families.withColumn("_state", state).filter("_state.state <> 'outside_window'")
    score = scoring.rounded(F.least(F.lit(1.0), F.col("_state.base") + F.least(F.lit(0.15), F.col("_engagement") / 1000)))
    path = F.replace(F.replace(F.url_encode("family_id"), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return families.select(
        "family_id", F.col("_state.state").alias("state_hint"), score.alias("score"), "new_repositories", "updated_repositories", "derivative_repositories",
        "first_signal_at", "last_signal_at", "signal_count", F.concat(F.lit(f"{HUB}/"), path).alias("model_url"), F.concat(F.lit(f"{HUB}/api/models/"), path).alias("model_api_url"),
    )


def top_candidates(candidates: DataFrame, top: int) -> DataFrame:
    """The best candidates by score, then by family, case ignored."""
    if not 1 <= top <= 500:
        raise ValueError("top must be between 1 and 500")
    return candidates.orderBy(F.desc("score"), F.lower("family_id"), "family_id").limit(top)


def channel_completeness(channels: DataFrame, errors: DataFrame) -> DataFrame:
    """Per sort: whether all its channels were read to the window's end without failing."""
    failed = errors.select("channel").distinct().withColumn("failed", F.lit(True))
    rows = channels.join(failed, "channel", "left")
    return rows.groupBy("sort").agg(F.count(F.lit(1)).alias("channels"), F.bool_and(~F.col("truncated") & F.col("failed").isNull()).alias("window_complete"))


def recall(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of recall over cases (case_id, status, availability, aliases, primary_urls) with their denominators."""
    families = candidates.select(F.lower("family_id").alias("alias"), "state_hint", urls.plain_canonical_url(F.col("model_url")).alias("u1"), urls.plain_canonical_url(F.col("model_api_url")).alias("u2"))
    named = cases.select("case_id", "primary_urls", F.explode(F.array_distinct(F.transform("aliases", lambda a: F.lower(a)))).alias("alias"))
    hits = named.join(families, "alias").groupBy("case_id").agg(
        F.array_sort(F.collect_set("state_hint")).alias("states"),
        F.bool_or(F.arrays_overlap(F.transform("primary_urls", urls.plain_canonical_url), F.array("u1", "u2"))).alias("primary"),
    )
    rows = cases.join(hits, "case_id", "left")
    eligible = F.col("status").isin(fixed.FRESH_STATUSES) & F.arrays_overlap("availability", F.array(*map(F.lit, fixed.HUB_AVAILABILITY)))
    negative, found = F.col("status") == "not_release_in_window", F.col("states").isNotNull()
    return rows.agg(
        F.count_if(eligible).alias("eligible_fresh_cases"),
        F.count_if(eligible & found).alias("eligible_fresh_cases_recalled"),
        scoring.ratio(F.count_if(eligible & found), F.count_if(eligible)).alias("eligible_fresh_case_recall"),
        scoring.ratio(F.count_if(eligible & F.coalesce("primary", F.lit(False))), F.count_if(eligible)).alias("eligible_primary_source_recall"),
        F.count_if(negative).alias("hard_negative_cases"),
        F.count_if(negative & found).alias("hard_negative_cases_with_hub_signal"),
        F.count_if(negative & (F.array_join("states", ",") == "update_only")).alias("hard_negative_update_only_signals"),
    )


def discovery_report(candidates: DataFrame, top: int) -> DataFrame:
    """The best candidates with ``rank``, the number of all candidates, and whether some are left out."""
    best = top_candidates(candidates, top)
    order = Window.orderBy(F.desc("score"), F.lower("family_id"), "family_id")  # at most 500 rows
    total = candidates.agg(F.count(F.lit(1)).alias("candidate_count"))
    return best.withColumn("rank", F.row_number().over(order)).join(F.broadcast(total)).withColumn("output_truncated", F.col("candidate_count") > top)


def family_signals(signals: DataFrame, families: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """The signals in the window of some families (family_id), in order of family, creation and repository.

    They are rows and not an array per family, as one family may hold a
    third of all repositories.
    """
    rows = signals.filter(in_window(F.lit(since), F.lit(until))).withColumn("family_id", family_id()).withColumn("is_derivative", is_derivative())
    return rows.join(families.select("family_id").distinct(), "family_id", "left_semi").orderBy("family_id", "created_at", "repo_id")


def discovery_window(as_of: datetime, buffer_hours: float) -> tuple[datetime, datetime]:
    """Since and until of a discovery that looks back ``buffer_hours`` from ``as_of``."""
    if buffer_hours <= 0:
        raise ValueError("the window must be longer than nothing")
    return as_of - timedelta(hours=buffer_hours), as_of
