"""Queries over pages, documents and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text, udfs, urls
from ..operators import evaluation, gaps, matching, ranking
from .base import register, relation, table, with_inputs

_TRACKING = "|".join(fixed.TRACKING_PARAMS)
#: Canonical form of a column ``url`` without user parts or escapes, as the tables have them.
CANON = rf"""(lower(regexp_extract(trim(url), '^([^:/?#]+):', 1)) || '://' || lower(regexp_extract(trim(url), '^[^:]+://([^/?#]*)', 1))
  || CASE WHEN regexp_extract(trim(url), '^[^:]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE rtrim(regexp_extract(trim(url), '^[^:]+://[^/?#]*([^?#]*)', 1), '/') END
  || CASE WHEN len(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)({_TRACKING})(=|$)'))) > 0
     THEN '?' || array_to_string(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)({_TRACKING})(=|$)')), '&') ELSE '' END)"""
DOMAIN = r"regexp_replace(lower(regexp_extract(trim(coalesce(url, '')), '^[^:]+://([^/?#]*)', 1)), '^www\.', '')"


@register("canonical_url", f"SELECT page_id, {CANON} AS canon_url FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canon_url"))


@register(
    "url_parts",
    rf"""SELECT page_id, {DOMAIN} AS domain, {DOMAIN} || CASE WHEN length(list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')[-1]) > 2
      THEN ' — ' || substr(list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')[-1], 1, 40) ELSE '' END AS title,
      contains(url, '?action=') OR contains(url, 't.me/') AS denied FROM pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.domain_of(u).alias("domain"), urls.url_title(u).alias("title"), urls.is_denied(u).alias("denied"))


@register("domain_diversity", f"SELECT page_id % 20 AS query_id, count(*) AS documents, count(DISTINCT nullif({DOMAIN}, '')) AS domains FROM pages GROUP BY 1")
def domain_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.domain_counts(table(spark, sf_dir, "pages").withColumn("query_id", F.col("page_id") % 20))


@register("html_title", "SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


_PLAIN = r"""regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"""


@register("html_to_text", rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract({_PLAIN}, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


def terms_sql(column: str) -> str:
    words = f"list_filter(regexp_extract_all(lower({column}), '[a-zа-яё0-9]+'), lambda w: length(w) >= 3)"
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)[1:12]"


_ASKED = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


@register("query_terms", f"SELECT conv_id, turn, array_to_string({terms_sql('text')}, ' ') AS terms FROM ({_ASKED})")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(text.terms(F.col("text")), " ").alias("terms"))


def coverage_sql(column: str, wanted: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{w}') AS INTEGER)" for w in wanted) + f")::DOUBLE / {len(wanted)}"


WANTED = ["the", "tion", "ouer", "sche", "eaux", "ingha"]


@register("keyword_coverage", f"SELECT doc_id, round({coverage_sql('text', WANTED)}, 6) AS coverage FROM documents")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, WANTED))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.coverage(F.col("text"), wanted), 6).alias("coverage"))


def noise_sql(column: str) -> str:
    hits = " + ".join(f"CASE WHEN regexp_matches({column}, '{p.replace(chr(92) + 'A', '^')}') THEN 0.5 ELSE 0.0 END" for p in fixed.NOISE_PAGES)
    return f"CASE WHEN coalesce({column}, '') = '' THEN 1.0 ELSE least(1.0, {hits}) END"


@register("noise_penalty", f"SELECT doc_id, CAST({noise_sql('text')} AS DOUBLE) AS noise, round(least(0.5, len(regexp_extract_all(substr(lower(text), 1, 2000), '{fixed.NOISE_MATCHES}')) * 0.1), 6)::DOUBLE AS legacy_noise FROM documents")
def noise_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.page_noise(F.col("text")).alias("noise"), F.round(text.legacy_noise(F.col("text")), 6).alias("legacy_noise"))


ASK = "the tion ouer scheme eauxle ingha"
_SCORE = f"0.35e0 * (1e0 / (1 + doc_id % 50)) + 0.45e0 * ({coverage_sql('text', ASK.split())}) * (1 - 0.5e0 * {noise_sql('text')}) + 0.20e0 * least(1e0, n_chars / 4000e0)"
_SCORED = f"SELECT doc_id, doc_id % 20 AS query_id, doc_id % 50 AS seq, 'https://' || source || '.example.com/' || doc_id AS url, CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round(CAST(greatest(0.0, least(1.0, {_SCORE})) AS DECIMAL(18, 10)), 4) END::DOUBLE AS source_score FROM documents"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumns({"query_id": F.col("doc_id") % 20, "seq": F.col("doc_id") % 50, "length": F.col("n_chars")})
    score = scoring.source_score(F.col("text"), F.col("length"), text.terms(F.lit(ASK)), scoring.position_score(F.col("seq")), F.lit(False))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", "query_id", "seq", url.alias("url"), score.alias("source_score"))


@register("source_score", f"SELECT doc_id, source_score FROM ({_SCORED})")
def source_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "source_score")


@register(
    "rank_documents_topn",
    rf"""WITH scored AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_score DESC, seq, url) AS rank FROM ({_SCORED}))
      SELECT query_id, rank::INTEGER AS rank, url, source_score FROM scored WHERE rank <= 5""",
)
def rank_documents_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked per question by terms, noise, length and place, the first five of each."""
    order = [F.desc("source_score"), F.asc("seq"), F.asc("url")]
    return ranking.top_n(_scored(spark, sf_dir), "query_id", order, 5).select("query_id", "rank", "url", "source_score")


@register(
    "legacy_confidence",
    f"""SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5 * least(1.0, n_chars / 2000.0) + 0.5 * ({coverage_sql('text', WANTED)})
      - least(0.5, len(regexp_extract_all(substr(lower(text), 1, 2000), '{fixed.NOISE_MATCHES}')) * 0.1))) END, 6)::DOUBLE AS confidence FROM documents""",
)
def legacy_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.legacy_confidence(F.col("text"), F.col("n_chars"), F.array(*map(F.lit, WANTED)))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("confidence"))


@register(
    "legacy_hit_ranking",
    with_inputs(
        rf"""WITH scored AS (SELECT query_id, seq, url, {CANON} AS canon_url, round(0.45 / hit_rank + 0.35 * ({coverage_sql("title || ' ' || snippet", ['the', 'tion', 'title'])}) + 0.20 * CASE engine WHEN 'wikipedia' THEN 0.85 WHEN 'bing' THEN 0.75 ELSE 0.70 END, 6) AS score FROM hits),
        once AS (SELECT *, row_number() OVER (PARTITION BY query_id, canon_url ORDER BY score DESC, seq) AS n FROM scored),
        first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM once WHERE n = 1)
        SELECT query_id, rank::INTEGER AS rank, canon_url, score::DOUBLE AS score FROM first WHERE rank <= 10""",
        "hits",
    ),
)
def legacy_hit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("the"), F.lit("tion"), F.lit("title"))
    rows = relation(spark, sf_dir, "hits")
    score = F.round(scoring.hit_score(F.col("hit_rank") - 1, F.col("title"), F.col("snippet"), F.col("engine"), wanted), 6)
    rows = rows.select("query_id", "seq", urls.canonical_url(F.col("url")).alias("canon_url"), score.alias("score"))
    best = ranking.rank_within(rows, ["query_id", "canon_url"], [F.desc("score"), F.asc("seq")], "n").filter("n = 1")
    return ranking.top_n(best, "query_id", [F.desc("score"), F.asc("seq")], 10).select("query_id", "rank", "canon_url", "score")


@register(
    "vote_aggregation",
    with_inputs(
        f"""SELECT query_id, {CANON} AS canon_url, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines, array_to_string(list_sort(list(DISTINCT task_query)), ',') AS queries,
        count(DISTINCT url) AS raw_urls, min(hit_rank) AS best_rank, (count(DISTINCT engine) + count(DISTINCT task_query))::INTEGER AS search_votes FROM hits GROUP BY 1, 2""",
        "hits",
    ),
)
def vote_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = ranking.vote_aggregation(relation(spark, sf_dir, "hits").withColumnsRenamed({"task_query": "query", "hit_rank": "rank"}))
    return votes.select("query_id", "canon_url", F.array_join("found_by_engines", ",").alias("engines"), F.array_join("found_by_queries", ",").alias("queries"), F.size("raw_urls").cast("long").alias("raw_urls"), F.col("best_rank"), "search_votes")


@register(
    "provenance_merge",
    with_inputs(
        f"""SELECT query_id, canon_url, arg_min(url, seq) AS url, min(seq) AS seq, count(DISTINCT place) AS places, string_agg(DISTINCT place, ';' ORDER BY place) AS provenance FROM (
        SELECT query_id, seq, url, {CANON} AS canon_url, task_query || '@' || hit_rank AS place FROM hits) GROUP BY 1, 2""",
        "hits",
    ),
)
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = relation(spark, sf_dir, "hits").withColumn("provenance", F.concat_ws("@", "task_query", F.col("hit_rank").cast("string")))
    merged = ranking.merge_provenance(hits)
    return merged.select("query_id", "canon_url", "url", "seq", F.size("provenance").cast("long").alias("places"), F.array_join(F.array_sort("provenance"), ";").alias("provenance"))


@register("seen_url_antijoin", with_inputs(f"SELECT DISTINCT query_id, {CANON} AS canon_url FROM hits h WHERE engine <> 'bing' AND NOT EXISTS (SELECT 1 FROM hits s WHERE s.engine = 'bing' AND s.seq % 2 = 0 AND s.query_id = h.query_id AND {CANON.replace('url', 's.url')} = {CANON.replace('url', 'h.url')})", "hits"))
def seen_url_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "hits").withColumn("canon_url", urls.canonical_url(F.col("url")))
    seen = rows.filter("engine = 'bing' AND seq % 2 = 0")
    return ranking.unseen(rows.filter("engine <> 'bing'").select("query_id", "canon_url").distinct(), seen, ["query_id", "canon_url"])


@register(
    "url_whitelist_semijoin",
    with_inputs(
        f"""SELECT query_id, original_url, nr::INTEGER AS nr FROM (SELECT a.query_id, c.original_url, row_number() OVER (PARTITION BY a.query_id ORDER BY a.pos) AS nr FROM
        (SELECT query_id, {CANON} AS canon_url, min(seq) AS pos FROM hits WHERE engine = 'duckduckgo' GROUP BY 1, 2) a JOIN (SELECT query_id, {CANON} AS canon_url, arg_min(url, seq) AS original_url FROM hits WHERE engine = 'bing' GROUP BY 1, 2) c
        ON a.query_id = c.query_id AND a.canon_url = c.canon_url) WHERE nr <= 5""",
        "hits",
    ),
)
def url_whitelist_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "hits").withColumnRenamed("seq", "pos")
    return ranking.url_whitelist(rows.filter("engine = 'duckduckgo'"), rows.filter("engine = 'bing'"), ["query_id"]).select("query_id", "original_url", "nr")


@register(
    "url_counters",
    f"""WITH a AS (SELECT page_id % 10 AS query_id, page_id AS seq, url, coalesce(url, '') = '' OR row_number() OVER (PARTITION BY page_id % 10, url ORDER BY page_id) > 1 AS again FROM pages),
      b AS (SELECT *, NOT again AND ({' OR '.join(f"contains(url, '{p}')" for p in fixed.DENIED_URL_PARTS)}) AS denied FROM a),
      c AS (SELECT *, NOT again AND NOT denied AS open, {CANON} AS canon_url FROM b),
      d AS (SELECT *, open AND row_number() OVER (PARTITION BY query_id, canon_url, open ORDER BY seq) > 1 AS same_page FROM c)
      SELECT query_id, count(*) AS urls_total, count_if(again OR same_page)::BIGINT AS urls_skipped_duplicate, count_if(denied)::BIGINT AS urls_skipped_deny_pattern, count_if(open AND NOT same_page)::BIGINT AS urls_kept FROM d GROUP BY 1""",
)
def url_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.url_counters(table(spark, sf_dir, "pages").withColumns({"query_id": F.col("page_id") % 10, "seq": F.col("page_id")}))


#: A secret of each of the five kinds, in texts with one, some or all of them; the secret itself is a checksum of the key.
_KEY = "md5(CAST(c_custkey AS VARCHAR(20)))"
_SECRETS = [("'at https://bob:'", "'@host.example.com/x'"), ("'LLM_API_KEY='", "''"), ("'bot 123456789:'", "''"), ("'Bearer '", "''"), ("'use ghp_'", "''")]
_HAS = ["c_custkey % 6 IN (0, 5)", "c_custkey % 6 IN (1, 5)", "c_custkey % 6 IN (2, 5)", "c_custkey % 6 IN (3, 5)", "c_custkey % 3 = 1"]


def _secret_text(secret: str) -> str:
    return " || ".join(f"CASE WHEN {has} THEN {before} || {secret} || {after} ELSE 'nothing' END || ' ; '" for has, (before, after) in zip(_HAS, _SECRETS, strict=True))


@register("secret_counts", "SELECT c_custkey, (" + " + ".join(f"CASE WHEN {has} THEN 1 ELSE 0 END" for has in _HAS) + ")::INTEGER AS matches FROM customer")
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.secret_counts(F.expr(_secret_text(_KEY))).alias("matches"))


@register("redact_secrets", f"SELECT c_custkey, {_secret_text(f'{chr(39)}...{chr(39)} || substr({_KEY}, 29, 4)')} AS redacted FROM customer")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all five kinds but their last four characters."""
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.redact_secrets(F.expr(_secret_text(_KEY))).alias("redacted"))


@register(
    "find_span_exact",
    "SELECT b.item_id, d.doc_id, (strpos(d.text, b.text) - 1)::INTEGER AS span_start, (strpos(d.text, b.text) - 1 + length(b.text))::INTEGER AS span_end FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def find_span_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark passages stand in documents, at whatever position."""
    return matching.exact_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
