"""Queries over repository signals, evaluation rows and streams of events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import evaluation, hub, research
from ..streaming import hub_stream
from .base import register, relation, table, with_inputs

SINCE, UNTIL = datetime(2024, 1, 10), datetime(2024, 1, 25, 12)

_NEWEST = "newest AS (SELECT repo_id, arg_max(base_model, (last_modified, arrival)) AS base_model, max(last_modified) AS last_modified, arg_max(downloads, (last_modified, arrival)) AS downloads, arg_max(likes, (last_modified, arrival)) AS likes, arg_max(user_id, (last_modified, arrival)) AS user_id FROM signals GROUP BY 1)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "signals")
    return rows.withColumn("created_at", F.col("base_ts") + F.make_dt_interval(F.col("user_id") % 30)).drop("base_ts")


@register(
    "hub_signal_dedup",
    with_inputs("SELECT repo_id, last_modified, arrival, downloads, likes FROM signals QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY last_modified DESC, arrival DESC) = 1", "signals"),
)
def hub_signal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub.newest_signals(signals(spark, sf_dir)).select("repo_id", "last_modified", "arrival", "downloads", "likes")


FAMILIES = """s AS (SELECT repo_id, coalesce(nullif(base_model, ''), repo_id) AS family_id, base_ts + to_days((user_id % 30)::INTEGER) AS created_at, last_modified, downloads, likes, arrival,
    coalesce(base_model <> '' AND lower(base_model) <> lower(repo_id), false) AS derived FROM signals QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY last_modified DESC, arrival DESC) = 1),
  w AS (SELECT *, created_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-25 12:00:00' AS new, last_modified BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-25 12:00:00' AS mod FROM s),
  f AS (SELECT family_id, count_if(new AND NOT derived) AS roots, count_if(new AND derived) AS ders, count_if(new) AS news, count_if(created_at < TIMESTAMP '2024-01-10' AND mod) AS upd, sum(likes) + least(1000, sum(downloads)) / 100 AS eng,
    least(min(CASE WHEN new THEN created_at END), min(CASE WHEN mod THEN last_modified END)) AS first_signal_at, greatest(max(CASE WHEN new THEN created_at END), max(CASE WHEN mod THEN last_modified END)) AS last_signal_at, count(*) AS n
    FROM w WHERE new OR mod GROUP BY 1),
  c AS (SELECT *, CASE WHEN ders >= 2 THEN 'derivative_burst' WHEN roots > 0 THEN 'new_root_repository' WHEN ders = 1 THEN 'derivative_signal' WHEN upd > 0 THEN 'update_only' END AS state_hint,
    CASE WHEN ders >= 2 THEN 0.8 WHEN roots > 0 THEN 0.7 WHEN ders = 1 THEN 0.5 ELSE 0.2 END AS base FROM f)"""


@register(
    "hub_candidates",
    with_inputs(
        f"""WITH {FAMILIES} SELECT family_id, state_hint, round(CAST(least(1.0, base + least(0.15, eng / 1000)) AS DECIMAL(18, 10)), 4)::DOUBLE AS score, news::BIGINT AS new_repositories, upd::BIGINT AS updated_repositories, ders::BIGINT AS derivative_repositories, first_signal_at, last_signal_at, n AS signal_count,
        'https://huggingface.co/' || family_id AS model_url, 'https://huggingface.co/api/models/' || family_id AS model_api_url FROM c WHERE state_hint IS NOT NULL""",
        "signals",
    ),
)
def hub_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub.build_candidates(hub.newest_signals(signals(spark, sf_dir)), SINCE, UNTIL)


@register("hub_top_candidates", with_inputs(f"WITH {FAMILIES} SELECT family_id, state_hint, round(CAST(least(1.0, base + least(0.15, eng / 1000)) AS DECIMAL(18, 10)), 4)::DOUBLE AS score FROM c WHERE state_hint IS NOT NULL ORDER BY 3 DESC, lower(family_id), family_id LIMIT 20", "signals"))
def hub_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub.top_candidates(hub_candidates(spark, sf_dir), 20).select("family_id", "state_hint", "score")


@register(
    "hub_payload_parse",
    """SELECT 'org' || user_id || '/m' AS repo_id, CASE WHEN event_id % 3 = 0 THEN 'base/' || user_id WHEN event_id % 3 = 1 THEN 'lab/x' || user_id END AS base_model, CASE WHEN event_id % 3 = 0 THEN 'quantized' END AS relation, event_id AS downloads FROM events WHERE event_type <> 'error'""",
)
def hub_payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    tags = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("license:mit"), F.concat(F.lit("base_model:base/"), user), F.concat(F.lit("base_model:quantized:base/"), user))).otherwise(F.array(F.lit("license:mit")))
    card = F.struct(F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("lab/x"), user)).alias("base_model"), F.lit(None).cast("string").alias("base_model_relation"))
    payload = F.to_json(F.struct(F.concat(F.lit("org"), user, F.lit("/m")).alias("id"), F.lit("2024-01-01T00:00:00.000Z").alias("createdAt"), F.when(F.col("event_type") == "error", "not a date").otherwise("2024-01-02T00:00:00Z").alias("lastModified"), tags.alias("tags"), card.alias("cardData"), F.col("event_id").alias("downloads")))
    parsed = e.select(F.from_json(payload, hub.PAYLOAD).alias("p")).select("p.*")
    return hub.parse_models(parsed).select("repo_id", "base_model", "relation", "downloads")


@register(
    "channel_completeness",
    """SELECT sort, count(*) AS channels, bool_and(NOT truncated AND NOT failed) AS window_complete FROM (SELECT event_type AS sort, user_id, bool_or(value > 380) AS truncated, user_id % 50 = 7 AS failed FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def channel_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    channels = e.groupBy(F.col("event_type").alias("sort"), name.alias("channel")).agg(F.bool_or(F.col("value") > 380).alias("truncated"))
    return hub.channel_completeness(channels, e.filter("user_id % 50 = 7").select(name.alias("channel")))


@register(
    "hub_recall",
    with_inputs(
        f"""WITH {FAMILIES}, cand AS (SELECT lower(family_id) AS fam, state_hint, 'https://huggingface.co/' || family_id AS u1, 'https://huggingface.co/api/models/' || family_id AS u2 FROM c WHERE state_hint IS NOT NULL),
        hit AS (SELECT case_id, list_sort(list(DISTINCT state_hint)) AS states, bool_or(p IN (u1, u2)) AS prim FROM (SELECT case_id, unnest(list_distinct([lower(alias1), lower(alias2)])) AS a, 'https://huggingface.co' || rtrim(regexp_extract(primary_url, 'https://[^/]*(.*)', 1), '/') AS p FROM cases) x JOIN cand ON cand.fam = x.a GROUP BY 1),
        r AS (SELECT *, status IN ('release', 'limited_release') AND availability = 'open_weights' AS el, status = 'not_release_in_window' AS neg FROM cases LEFT JOIN hit USING (case_id))
        SELECT count_if(el)::BIGINT AS eligible_fresh_cases, count_if(el AND states IS NOT NULL)::BIGINT AS eligible_fresh_cases_recalled, round(count_if(el AND states IS NOT NULL) / nullif(count_if(el), 0), 4) AS eligible_fresh_case_recall, round(count_if(el AND coalesce(prim, false)) / nullif(count_if(el), 0), 4) AS eligible_primary_source_recall,
        count_if(neg)::BIGINT AS hard_negative_cases, count_if(neg AND states IS NOT NULL)::BIGINT AS hard_negative_cases_with_hub_signal, count_if(neg AND array_to_string(states, ',') = 'update_only')::BIGINT AS hard_negative_update_only_signals FROM r""",
        "signals", "cases",
    ),
)
def hub_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "cases")
    cases = rows.select("case_id", "status", F.array("availability").alias("availability"), F.array("alias1", "alias2").alias("aliases"), F.array("primary_url").alias("primary_urls"))
    return hub.recall(cases, hub_candidates(spark, sf_dir))


@register("status_counts", with_inputs("SELECT status, count(*) AS cases FROM cases GROUP BY 1", "cases"))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.status_counts(relation(spark, sf_dir, "cases"))


_QS = "SELECT *, (CASE WHEN expected_route = route THEN 1.0 ELSE 0.0 END)::DOUBLE AS route_ok, round((0.45::DOUBLE * coverage::DOUBLE + 0.22::DOUBLE * (1 - contradiction_rate::DOUBLE) + 0.22::DOUBLE * confidence::DOUBLE + 0.11::DOUBLE * (CASE WHEN expected_route = route THEN 1.0 ELSE 0.0 END)::DOUBLE), 4) AS qs FROM eval_rows"


def _eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "eval_rows")
    return evaluation.quality_rows(rows.withColumns({c: F.col(c).cast("double") for c in ("coverage", "contradiction_rate", "confidence")}))


@register("quality_score", with_inputs(f"SELECT id, qs FROM ({_QS})", "eval_rows"))
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir).select("id", "qs")


@register(
    "eval_aggregate",
    with_inputs(
        f"""SELECT count(*) AS queries, round(avg(qs), 3) AS qs_mean, min(qs) AS qs_min, max(qs) AS qs_max, round(avg(route_ok), 4) AS routing_accuracy, sum(urls_total)::BIGINT AS urls_total, sum(urls_skipped_duplicate)::BIGINT AS urls_skipped_duplicate FROM ({_QS})""",
        "eval_rows",
    ),
)
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.aggregate(_eval(spark, sf_dir))
    return rows.select("queries", F.round("qs_mean", 3).alias("qs_mean"), "qs_min", "qs_max", "routing_accuracy", "urls_total", "urls_skipped_duplicate")


@register(
    "primary_source_recall",
    """SELECT c_custkey AS case_id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS primary_source_recalled FROM customer""",
)
def primary_source_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = lambda c, tail: F.concat(F.lit("https://Example.com/"), F.col(c).cast("string"), F.lit(tail))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.array(url("c_custkey", "/")).alias("primary_urls"))
    hits = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"), url("o_custkey", "?utm_source=x").alias("url"))
    return evaluation.primary_recall(cases, hits).select("case_id", "primary_source_recalled")


@register("research_run")
def research_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop over stored documents for three questions: status of each answer."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), "text")
    questions = spark.createDataFrame([(1, "the edition of another thing"), (2, "elle avec pour dans les"), (3, "das ist nicht der Berg")], "query_id long, query string")
    run = research.run_research(questions, research.replayed_search(docs), research.replayed_fetch(docs))
    n = run.documents.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("source_score"), 4).alias("top_score"))
    return run.answers.join(n, "query_id", "left").join(run.review.select("query_id", "risk_level"), "query_id", "left").select("query_id", "documents", "top_score", "risk_level", F.length("answer_markdown").alias("answer_length"))


# --- Extensions: windows over time, relational operators ------------------


@register(
    "tumbling_windows",
    """SELECT time_bucket(INTERVAL 48 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""",
)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hub_stream.tumbling_counts(table(spark, sf_dir, "events"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "events", F.round("value", 2).alias("value"))


@register(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
      SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, nr""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub_stream.sessions(table(spark, sf_dir, "events"), "user_id").select("user_id", F.col("session_window.start").alias("start"), "events")


@register(
    "asof_join",
    """SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the user before each error: one window over the union, no pairs."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')")
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    before = research.ranking.Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(research.ranking.Window.unboundedPreceding, 0)
    rows = e.withColumn("purchase_id", F.last(mark, ignorenulls=True).over(before))
    return rows.filter("event_type = 'error'").select("event_id", "purchase_id")


@register("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register(
    "topk_per_group",
    "SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
)
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = research.ranking.top_n(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", "rank")


@register("risk_levels", with_inputs("SELECT id, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM eval_rows", "eval_rows"))
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "eval_rows").select("id", scoring.risk_level(F.col("confidence")).alias("level"))
