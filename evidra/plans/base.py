"""What the queries share: tables, input relations in SQL that both engines read, and the registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Input relations built from the tables, in SQL that Spark and others read alike.
INPUTS = {
    # questions of all routes, one per order
    "questions": """SELECT o_orderkey AS query_id, CASE o_orderkey % 10
        WHEN 0 THEN 'latest news about ' || lower(o_orderpriority) || ' shipments today'
        WHEN 1 THEN 'GPT-4 vs Claude benchmark pricing ' || CAST(2018 + o_custkey % 9 AS VARCHAR(4))
        WHEN 2 THEN 'how to read the docs tutorial for Falcon 9 rocket ' || CAST(o_custkey AS VARCHAR(20))
        WHEN 3 THEN 'CVE exploit patch for nvidia GPU yesterday'
        WHEN 4 THEN 'что такое столица страны и население города'
        WHEN 5 THEN 'reddit forum discussion about iPhone ' || CAST(o_custkey % 20 AS VARCHAR(20)) || ' Pro'
        WHEN 6 THEN 'arxiv paper on quantum energy this week'
        WHEN 7 THEN 'свежие языковые модели релиз 2026 за неделю'
        WHEN 8 THEN 'in ' || CAST(2018 + o_custkey % 9 AS VARCHAR(4)) || ' user reviews of MacBook Pro opinions'
        ELSE 'order ' || CAST(o_orderkey AS VARCHAR(20)) || ' status ' || o_orderstatus END AS query FROM orders""",
    # hits of three tasks: every document is found by its source's task and some by others
    "hits": """SELECT query_id, task_query, seq, hit_rank, engine, 'https://' || source || '.example.com/' || CAST(doc_id AS VARCHAR(20)) || tail AS url, 'Title ' || CAST(doc_id AS VARCHAR(20)) AS title, snippet FROM (
        SELECT n_chars % 7 AS query_id, 'the of and' AS task_query, doc_id AS seq, doc_id % 10 + 1 AS hit_rank, 'bing' AS engine, source, doc_id, '' AS tail, substr(text, 1, 80) AS snippet FROM documents
        UNION ALL SELECT n_chars % 7, 'le la de', doc_id + 10000000, doc_id % 6 + 1, 'duckduckgo', source, doc_id, '?utm_source=feed', substr(text, 1, 80) FROM documents WHERE lang = 'fr' OR doc_id % 3 = 0
        UNION ALL SELECT n_chars % 7, 'the of and', doc_id + 20000000, doc_id % 4 + 1, 'wikipedia', source, doc_id, '/#top', substr(text, 1, 80) FROM documents WHERE lang = 'es' OR doc_id % 5 = 0) h""",
    # facts with a number and a noun, and another text about the same
    "fact_pairs": """SELECT o_orderkey AS fact_no, o_custkey % 100 AS query_id, CAST(o_orderkey % 50 + 1 AS VARCHAR(20)) || ' drones' AS fact, CASE o_custkey % 6
        WHEN 0 THEN 'Reports say ' || CAST(o_orderkey % 50 + 1 AS VARCHAR(20)) || ' drones were seen near the port.'
        WHEN 1 THEN 'First ' || CAST(o_orderkey % 50 + 2 AS VARCHAR(20)) || ' drone, later ' || CAST(o_orderkey % 50 + 1 AS VARCHAR(20)) || '  drone landed.'
        WHEN 2 THEN 'In all ' || CAST(o_orderkey % 50 + 3 AS VARCHAR(20)) || ' drones came.'
        WHEN 3 THEN 'There were no such ' || CAST(o_orderkey % 50 + 1 AS VARCHAR(20)) || ' drones at all.'
        WHEN 4 THEN 'Nothing happened near the harbour on that long day, says the town.'
        ELSE 'It is not true that ' || CAST(o_orderkey % 50 + 1 AS VARCHAR(20)) || ' drones, or 7 missiles, were there.' END AS text FROM orders""",
    # claims about orders, alike but for their numbers
    "claims": """SELECT o_custkey % 100 AS query_id, o_orderkey AS claim_no, 'Acme Corp shipped ' || CAST(o_orderkey % 90 AS VARCHAR(20)) || ' units to Port ' || CASE WHEN o_orderkey % 4 = 0 THEN 'Alpha' ELSE 'Beta' END
        || ' in ' || CAST(1990 + o_orderkey % 35 AS VARCHAR(4)) || CASE WHEN o_orderkey % 9 = 0 THEN ' [1]' ELSE '' END AS claim FROM orders""",
    "claim_sources": """SELECT c_custkey % 100 AS query_id, 'https://s' || CAST(c_custkey AS VARCHAR(20)) || '.example.com/' AS url,
        'In ' || CAST(1995 + c_custkey % 20 AS VARCHAR(4)) || ' Acme Corp sent ' || CAST(c_custkey % 60 AS VARCHAR(20)) || ' units to Port Beta' AS text FROM customer""",
    # texts with numbers, dates and names, some of which contain each other
    "fact_texts": """SELECT o_orderkey AS doc_id, 'On ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) || ' ' || CAST(o_orderkey % 30 + 1 AS VARCHAR(20)) || ' crates and ' || CAST(o_custkey % 50 + 1 AS VARCHAR(20)) || ' boats reached Port '
        || CASE WHEN o_orderkey % 2 = 0 THEN 'Alpha' ELSE 'Beta' END || '. Acme Corp sent ' || CAST(o_custkey % 30 + 1 AS VARCHAR(20)) || ' crates on 5 March ' || CAST(1990 + o_orderkey % 30 AS VARCHAR(4)) || '. Beta Corp said so.' AS text FROM orders""",
    # claims that stand in a text literally, with other white space, by their beginning only, or not at all
    "span_pairs": """SELECT o_orderkey AS fact_no, 'the shipment of order ' || CAST(o_orderkey AS VARCHAR(20)) || ' left port' AS claim, 'Source ' || CAST(o_custkey AS VARCHAR(20)) AS title, 'https://s.example.com/' || CAST(o_custkey AS VARCHAR(20)) AS url,
        'As told, ' || CASE o_orderkey % 4 WHEN 0 THEN 'the shipment of order ' || CAST(o_orderkey AS VARCHAR(20)) || ' left port' WHEN 1 THEN 'the  shipment of  order ' || CAST(o_orderkey AS VARCHAR(20)) || '  left   port'
        WHEN 2 THEN 'the shipment of  order ' || CAST(o_orderkey AS VARCHAR(20)) || ' left' ELSE 'no ship left' END || ' on that day.' AS text FROM orders""",
    # verdicts with the number of sources on each side
    "verdict_rows": """SELECT o_custkey % 200 AS query_id, o_orderkey AS fact_no, 'Order ' || CAST(o_orderkey AS VARCHAR(20)) || ' shipped ' || CAST(o_orderkey % 40 AS VARCHAR(20)) || ' items' AS fact,
        o_orderkey % 3 AS n_support, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n_refute, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n_mismatch,
        CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'SUPPORTS' WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'REFUTES' WHEN o_orderkey % 3 > 0 THEN 'CONFLICTING'
        WHEN o_orderkey % 7 = 0 THEN 'NUMERIC_MISMATCH' ELSE 'INSUFFICIENT' END AS verdict FROM orders""",
    # repositories of a hub: a row per day and user
    "signals": """SELECT CASE WHEN user_id % 3 = 0 THEN 'Org' ELSE 'lab' END || CAST(user_id % 40 AS VARCHAR(20)) || '/model-' || CAST(user_id AS VARCHAR(20)) AS repo_id, event_id AS arrival,
        CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS base_ts, ts AS last_modified, user_id,
        CASE WHEN user_id % 4 = 1 THEN 'Org' || CAST(user_id % 10 AS VARCHAR(20)) || '/base' WHEN user_id % 11 = 2 THEN '' ELSE NULL END AS base_model,
        CAST(floor(value) AS BIGINT) AS downloads, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS likes FROM events""",
    "eval_rows": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'news' ELSE 'technical' END AS expected_route, CASE o_orderkey % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN 'news' ELSE 'technical' END AS route,
        (o_orderkey % 11) / 10.0 AS coverage, (o_orderkey % 5) / 5.0 AS contradiction_rate, (o_orderkey % 7) / 10.0 AS confidence, o_orderkey % 9 AS urls_total, o_orderkey % 2 AS urls_skipped_duplicate, 0 AS urls_skipped_deny_pattern FROM orders""",
    "cases": """SELECT user_id AS case_id, CASE user_id % 5 WHEN 0 THEN 'release' WHEN 1 THEN 'limited_release' WHEN 2 THEN 'preview' ELSE 'not_release_in_window' END AS status,
        CASE WHEN user_id % 2 = 0 THEN 'open_weights' ELSE 'api' END AS availability, 'ORG' || CAST(user_id % 10 AS VARCHAR(20)) || '/Base' AS alias1, 'lab' || CAST(user_id % 40 AS VARCHAR(20)) || '/model-' || CAST(user_id AS VARCHAR(20)) AS alias2,
        'https://HuggingFace.co/Org' || CAST(user_id % 8 AS VARCHAR(20)) || '/base/' AS primary_url FROM (SELECT DISTINCT user_id FROM events) u""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input relation over the tables of a folder."""
    sql = INPUTS[name]
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql.replace("substr(", "substring("))


def with_inputs(sql: str, *names: str) -> str:
    """SQL (with or without common table expressions of its own) over input relations."""
    head = "WITH " + ",\n".join(f"{n} AS ({INPUTS[n]})" for n in names)
    return head + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query, and SQL that gives the same rows where there is any."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def re2(pattern: str) -> str:
    """A Java pattern with Unicode word boundaries for engines that have only ASCII ones; quotes doubled."""
    out = re.sub(r"\\b\.\{0,50\}\\b", r"(?:[^\\pL\\pN_].{0,50}[^\\pL\\pN_]|[^\\pL\\pN_])", pattern)
    out = re.sub(r"^(\(\?\w+\))?\\b", r"\1(?:^|[^\\pL\\pN_])", out)
    out = re.sub(r"\\b$", r"(?:[^\\pL\\pN_]|$)", out)
    return out.replace(r"\w", r"[\pL\pN_]").replace("'", "''")
