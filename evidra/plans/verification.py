"""Queries over facts, verdicts, citations, claims and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language
from ..operators import critic, gaps, matching, synthesis
from .base import register, relation, table, with_inputs

_ORDER_TEXT = "'Order ' || CAST(o_orderkey AS VARCHAR(20)) || ' shipped ' || CAST(o_custkey % 97 AS VARCHAR(20)) || ' crates on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) || ' and 3 items, then 12 boats'"


@register(
    "numeric_facts",
    rf"""SELECT o_orderkey, array_to_string(list_transform(list_zip(regexp_extract_all(t, '\b(\d+)\s+([a-z]{{3,}})\b', 1), regexp_extract_all(t, '\b(\d+)\s+([a-z]{{3,}})\b', 2)),
      lambda p: p[1] || ' ' || CASE WHEN p[2] LIKE '%ies' THEN substr(p[2], 1, length(p[2]) - 3) || 'y' WHEN p[2] LIKE '%es' THEN substr(p[2], 1, length(p[2]) - 2) WHEN p[2] LIKE '%s' THEN substr(p[2], 1, length(p[2]) - 1) ELSE p[2] END), ', ') AS facts
      FROM (SELECT o_orderkey, lower({_ORDER_TEXT}) AS t FROM orders)""",
)
def numeric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("t", F.expr(_ORDER_TEXT))
    pairs = F.transform(language.number_units(F.col("t")), lambda p: F.concat_ws(" ", p["number"], p["stem"]))
    return rows.select("o_orderkey", F.array_join(pairs, ", ").alias("facts"))


@register("date_facts", rf"SELECT o_orderkey, array_to_string(regexp_extract_all({_ORDER_TEXT}, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), ',') AS dates FROM orders")
def date_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("t", F.expr(_ORDER_TEXT))
    return rows.select("o_orderkey", F.array_join(F.regexp_extract_all("t", F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), 0), ",").alias("dates"))


_UNITS = r"regexp_extract_all(lower(text), '\b(\d+)\s+([a-z]{{3,}})\b', {})"
NUMERIC = rf"""CASE WHEN len(list_filter(list_zip({_UNITS.format(1)}, {_UNITS.format(2)}), lambda p: p[2] IN ('drone', 'drones') AND p[1] = split_part(fact, ' ', 1))) > 0 THEN 'num_morph'
  WHEN len(list_filter({_UNITS.format(2)}, lambda w: w IN ('drone', 'drones'))) > 0 THEN 'num_mismatch' END"""


@register("numeric_match", with_inputs(f"SELECT fact_no, {NUMERIC} AS method FROM fact_pairs", "fact_pairs"))
def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "fact_pairs").select("fact_no", language.numeric_match(F.col("fact"), F.col("text")).alias("method"))


NEGATED = r"regexp_matches(lower(text), '(^|[^a-z0-9])(no|not)\s+(\w+\s+){0,3}' || fact || '\w*(\b|[^a-z0-9])')"


@register("negation_ascii", with_inputs(f"SELECT fact_no, {NEGATED} AS negated FROM fact_pairs", "fact_pairs"))
def negation_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "fact_pairs").select("fact_no", language.is_negated(F.col("fact"), F.col("text")).alias("negated"))


@register(
    "negation_spans",
    with_inputs(
        r"""SELECT fact_no, (strpos(lower(text), m) - 1)::INTEGER AS span_start, (strpos(lower(text), m) - 1 + length(m))::INTEGER AS span_end FROM (
        SELECT fact_no, text, regexp_extract(lower(text), '(^|[^a-z0-9])(no|not)\s+(\w+\s+){0,3}' || fact || '\w*(\b|[^a-z0-9])') AS m FROM fact_pairs) WHERE m <> ''""",
        "fact_pairs",
    ),
)
def negation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "fact_pairs").withColumn("s", language.negation_span(F.col("fact"), F.col("text"))).filter("s IS NOT NULL")
    return rows.select("fact_no", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@register(
    "mismatch_spans",
    with_inputs(
        rf"""SELECT fact_no, w AS wrong FROM (SELECT fact_no, list_filter(regexp_extract_all(lower(text), '\b\d+\s+drones?\b'), lambda m: split_part(m, ' ', 1) <> split_part(fact, ' ', 1))[1] AS w FROM fact_pairs) WHERE w IS NOT NULL""",
        "fact_pairs",
    ),
)
def mismatch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "fact_pairs").withColumn("s", language.mismatch_span(F.col("fact"), F.lower("text"))).filter("s IS NOT NULL")
    return rows.select("fact_no", F.expr("substring(lower(text), s.start + 1, s.end - s.start)").alias("wrong"))


_SIDES = f"""SELECT query_id, fact, fact_no, CASE WHEN contains(lower(text), fact) THEN 'exact' ELSE {NUMERIC} END AS method, {NEGATED} AS negated FROM fact_pairs"""


@register(
    "verdict_rollup",
    with_inputs(
        f"""WITH sides AS ({_SIDES}), sums AS (SELECT query_id, fact, coalesce(bool_or(method IS NOT NULL AND NOT negated AND method <> 'num_mismatch'), false) AS s, coalesce(bool_or(method IS NOT NULL AND negated), false) AS r,
        coalesce(bool_or(method = 'num_mismatch' AND NOT negated), false) AS m FROM sides GROUP BY 1, 2)
        SELECT query_id, fact, CASE WHEN s AND NOT r AND NOT m THEN 'SUPPORTS' WHEN r AND NOT s THEN 'REFUTES' WHEN s AND (r OR m) THEN 'CONFLICTING' WHEN m THEN 'NUMERIC_MISMATCH' ELSE 'INSUFFICIENT' END AS verdict FROM sums""",
        "fact_pairs",
    ),
)
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "fact_pairs")
    method = F.when(F.contains(F.lower("text"), F.col("fact")), "exact").otherwise(language.numeric_match(F.col("fact"), F.col("text")))
    rows = rows.withColumn("method", method).withColumn("negated", language.is_negated(F.col("fact"), F.col("text")))
    rows = rows.withColumn("side", matching.side_of(F.col("method").isNotNull(), F.col("method"), F.col("negated")))
    has = lambda side: F.coalesce(F.bool_or(F.col("side") == side), F.lit(False)).alias(side)
    sums = rows.groupBy("query_id", "fact").agg(has("supports"), has("refutes"), has("mismatch"))
    return sums.select("query_id", "fact", matching.verdict(F.col("supports"), F.col("refutes"), F.col("mismatch")).alias("verdict"))


def verdict_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with source lists of the given sizes."""
    rows = relation(spark, sf_dir, "verdict_rows")
    urls = lambda side, n: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= F.col(n), F.format_string(f"https://{side}.example.com/%d", (F.col("fact_no") + i) % 60)))
    listed = lambda side, n: F.array_compact(urls(side, n))
    entry = lambda side, n: F.transform(listed(side, n), lambda u: F.struct(u.alias("url"), F.lit(100.0).alias("score"), F.lit("exact").alias("method")))
    return rows.select(
        "query_id", "fact_no", "fact", "verdict", (F.col("verdict") == "SUPPORTS").alias("verified"), F.lit(None).cast("string").alias("method"),
        entry("s", "n_support").alias("supporting_sources"), listed("r", "n_refute").alias("refuting_sources"), entry("m", "n_mismatch").alias("numeric_mismatch_sources"),
    )


@register("verification_rate", with_inputs("SELECT query_id, count_if(verdict = 'SUPPORTS')::BIGINT AS verified_facts, count(*) AS total_facts, round(count_if(verdict = 'SUPPORTS') / count(*), 3) AS verification_rate FROM verdict_rows GROUP BY 1", "verdict_rows"))
def verification_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.verification_rate(verdict_frame(spark, sf_dir))


_COVER = "SELECT query_id, count_if(verdict = 'SUPPORTS')::BIGINT AS supported, count_if(verdict IN ('CONFLICTING', 'NUMERIC_MISMATCH'))::BIGINT AS partial, count(*) AS total, round((count_if(verdict = 'SUPPORTS') + 0.5 * count_if(verdict IN ('CONFLICTING', 'NUMERIC_MISMATCH'))) / count(*), 4)::DOUBLE AS score FROM verdict_rows GROUP BY 1"


@register("coverage", with_inputs(_COVER, "verdict_rows"))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.coverage(verdict_frame(spark, sf_dir))


@register("unsupported_claims", with_inputs("SELECT query_id, fact_no, fact AS claim, verdict AS reason FROM verdict_rows WHERE verdict <> 'SUPPORTS'", "verdict_rows"))
def unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.unsupported(verdict_frame(spark, sf_dir))


@register(
    "contradictions",
    with_inputs(
        """SELECT query_id, fact_no, fact, verdict AS type, (CASE verdict WHEN 'REFUTES' THEN n_refute WHEN 'NUMERIC_MISMATCH' THEN n_mismatch ELSE n_support + n_refute + n_mismatch END)::INTEGER AS n_urls
        FROM verdict_rows WHERE verdict IN ('REFUTES', 'CONFLICTING', 'NUMERIC_MISMATCH')""",
        "verdict_rows",
    ),
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.contradictions(verdict_frame(spark, sf_dir)).withColumn("n_urls", F.size("urls")).drop("urls")


@register(
    "open_questions",
    with_inputs(
        """SELECT query_id, fact_no, question, rank::INTEGER AS rank FROM (SELECT query_id, fact_no, CASE WHEN verdict = 'REFUTES' THEN 'Оспаривается: ' ELSE 'Не подтверждено: ' END || fact AS question,
        row_number() OVER (PARTITION BY query_id ORDER BY fact_no) AS rank FROM verdict_rows WHERE verdict IN ('REFUTES', 'INSUFFICIENT')) WHERE rank <= 20""",
        "verdict_rows",
    ),
)
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.open_questions(verdict_frame(spark, sf_dir))


def source_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = relation(spark, sf_dir, "hits")
    return hits.select("query_id", "seq", "url", "title", "snippet", F.col("snippet").alias("text"))


@register(
    "citation_table",
    with_inputs(
        """SELECT query_id, id::INTEGER AS id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS id FROM
        (SELECT query_id, url, min(seq) AS seq, arg_min(title, seq) AS title FROM hits GROUP BY 1, 2)) WHERE id <= 50""",
        "hits",
    ),
)
def citation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.citation_table(source_frame(spark, sf_dir)).select("query_id", "id", "url", "title")


_CITED = "SELECT query_id, least(50, count(DISTINCT url)) AS citations FROM hits GROUP BY 1"


@register(
    "answer_confidence",
    with_inputs(
        f"""WITH cover AS ({_COVER}), cited AS ({_CITED}), contra AS (SELECT query_id, count_if(verdict IN ('REFUTES', 'CONFLICTING', 'NUMERIC_MISMATCH')) AS n FROM verdict_rows GROUP BY 1)
        SELECT query_id, round(greatest(0.0, least(1.0, score - 0.1 * n + least(0.1, 0.02 * coalesce(citations, 0)))), 4)::DOUBLE AS confidence FROM cover JOIN contra USING (query_id) LEFT JOIN cited USING (query_id)""",
        "verdict_rows", "hits",
    ),
)
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.answer_confidence(verdict_frame(spark, sf_dir), synthesis.citation_table(source_frame(spark, sf_dir))).select("query_id", "confidence")


@register(
    "citation_stats",
    """SELECT o_custkey % 50 AS query_id, count(*) AS total, count_if(o_orderkey % 3 = 0)::BIGINT AS cited, count_if(o_orderkey % 3 <> 0)::BIGINT AS uncited, count_if(o_orderkey % 5 = 0)::BIGINT AS stub,
      round(count_if(o_orderkey % 3 = 0) / count(*), 4) AS coverage, coalesce(round(count_if(o_orderkey % 3 = 0) / nullif(count_if(o_orderkey % 5 <> 0), 0), 4), 0) AS non_stub_coverage FROM orders GROUP BY 1""",
)
def citation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("query_id"), (F.col("o_orderkey") % 3 == 0).alias("has_evidence"), (F.col("o_orderkey") % 5 == 0).alias("is_stub"))
    return synthesis.citation_stats(rows)


@register(
    "claim_buckets",
    with_inputs(
        """SELECT query_id, count_if(verdict = 'SUPPORTS')::BIGINT AS confirmed, 0::BIGINT AS weak, count_if(verdict IN ('REFUTES', 'CONFLICTING', 'NUMERIC_MISMATCH'))::BIGINT AS contradiction, count_if(verdict = 'INSUFFICIENT')::BIGINT AS unverifiable FROM verdict_rows GROUP BY 1""",
        "verdict_rows",
    ),
)
def claim_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.bucket_counts(classified_frames(spark, sf_dir)[1])


def classified_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    verdicts = verdict_frame(spark, sf_dir)
    every = F.concat(F.transform("supporting_sources", lambda s: s["url"]), F.col("refuting_sources"), F.transform("numeric_mismatch_sources", lambda s: s["url"]))
    links = verdicts.select("query_id", F.explode(every).alias("url")).distinct()
    cited = links.withColumn("id", F.row_number().over(synthesis.Window.partitionBy("query_id").orderBy("url"))).withColumn("title", F.col("url")).withColumn("quote", F.lit(""))
    return cited, synthesis.classified(verdicts, cited)


# --- Critic ---------------------------------------------------------------

_NUMBERS = r"list_distinct(regexp_extract_all({}, '\b\d{{1,3}}\b'))"


@register(
    "numeric_consistency",
    with_inputs(
        rf"""WITH told AS (SELECT query_id, trim(lower(regexp_replace(claim, '\b\d{{1,3}}\b', '', 'g'))) AS context, {_NUMBERS.format('claim')} AS nums FROM claims),
        groups AS (SELECT query_id, context, list_distinct(flatten(list(nums))) AS nums FROM told GROUP BY 1, 2 HAVING count(*) >= 2),
        known AS (SELECT DISTINCT query_id, unnest({_NUMBERS.format('text')}) AS num FROM claim_sources),
        missing AS (SELECT g.query_id, g.context, g.nums, list(x.num) AS miss FROM (SELECT *, unnest(nums) AS num FROM groups WHERE len(nums) >= 2) x JOIN groups g USING (query_id, context)
          WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = x.query_id AND k.num = x.num) GROUP BY ALL),
        flags AS (SELECT query_id, context, 'Numeric disagreement across related claims: [' || array_to_string(list_transform(list_sort(nums), lambda v: '''' || v || ''''), ', ') || '] (unsupported by sources: [' || array_to_string(list_transform(list_sort(miss), lambda v: '''' || v || ''''), ', ') || '])' AS message,
          row_number() OVER (PARTITION BY query_id ORDER BY context) AS n FROM missing)
        SELECT query_id, 'medium' AS severity, 'numeric_consistency' AS category, message, substr(context, 1, 120) AS claim FROM flags WHERE n <= 20""",
        "claims", "claim_sources",
    ),
)
def numeric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critic.numeric_consistency(relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "claim_sources"))


ENTITIES = r"list_distinct(regexp_extract_all({}, '\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){{0,3}})\b'))"


@register(
    "entity_grounding_antijoin",
    with_inputs(
        rf"""WITH known AS (SELECT DISTINCT query_id, lower(unnest({ENTITIES.format('text')})) AS entity FROM claim_sources)
        SELECT query_id, claim_no, name FROM (SELECT query_id, claim_no, unnest({ENTITIES.format('claim')}) AS name FROM claims) c
        WHERE EXISTS (SELECT 1 FROM known k WHERE k.query_id = c.query_id) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = c.query_id AND k.entity = lower(c.name))""",
        "claims", "claim_sources",
    ),
)
def entity_grounding_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critic.ungrounded_entities(relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "claim_sources")).select("query_id", "claim_no", "name")


@register(
    "temporal_consistency",
    with_inputs(
        r"""WITH src AS (SELECT query_id, url, CAST(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1) AS INTEGER) AS y FROM claim_sources), cl AS (SELECT query_id, claim_no, claim, CAST(regexp_extract(claim, '\b((?:19|20)\d{2})\b', 1) AS INTEGER) AS cy FROM claims),
        flags AS (SELECT query_id, CASE WHEN cy > y + 1 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN cy > y + 1 THEN 'Claim mentions ' || cy || ' but source max year is ' || y || ' (anachronism)' ELSE 'Claim mentions ' || cy || ' but source min year is ' || y || ' (unusually old)' END AS message,
          substr(claim, 1, 120) AS claim, lpad(CAST(claim_no AS VARCHAR), 9, '0') || '|' || url AS position FROM cl JOIN src USING (query_id) WHERE cy > y + 1 OR cy < y - 5),
        nth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, claim, message) AS n FROM flags)
        SELECT query_id, severity, 'temporal_consistency' AS category, message, claim FROM nth WHERE n <= 20""",
        "claims", "claim_sources",
    ),
)
def temporal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critic.temporal_consistency(relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "claim_sources"))


@register(
    "self_contradiction",
    with_inputs(
        r"""WITH own AS (SELECT query_id, 'high' AS severity, 'Both supporting and refuting sources for same claim: ' || substr(fact, 1, 80) AS message, fact AS claim, row_number() OVER (PARTITION BY query_id ORDER BY CAST(fact_no AS VARCHAR), fact) AS n FROM verdict_rows WHERE verdict = 'CONFLICTING' OR (n_support > 0 AND n_refute > 0)),
        topics AS (SELECT query_id, substr(trim(lower(regexp_replace(fact, '\b\d{1,3}\b', '', 'g'))), 1, 80) AS claim FROM verdict_rows GROUP BY ALL HAVING bool_or(verdict = 'SUPPORTS') AND bool_or(verdict = 'REFUTES')),
        two_sides AS (SELECT query_id, severity, message, claim FROM own WHERE n <= 20 UNION ALL SELECT query_id, 'medium', 'Cross-claim contradiction on same topic: SUPPORTS vs REFUTES', claim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY claim) AS n FROM topics WHERE claim <> '') WHERE n <= 20),
        nth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, claim) AS n FROM two_sides)
        SELECT query_id, severity, 'self_contradiction' AS category, message, claim FROM nth WHERE n <= 20""",
        "verdict_rows",
    ),
)
def self_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critic.self_contradiction(verdict_frame(spark, sf_dir))


_RISK = """SELECT o_custkey AS query_id, CASE WHEN o_orderkey % 29 = 0 THEN 'high' WHEN o_orderkey % 13 = 0 THEN 'medium' ELSE 'low' END AS severity, CASE o_orderkey % 2 WHEN 0 THEN 'numeric_consistency' ELSE 'temporal_consistency' END AS category, '' AS message, CAST(o_orderkey AS VARCHAR(20)) AS claim FROM orders"""


@register(
    "risk_score",
    f"""WITH flags AS ({_RISK}), nth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY category, claim) AS n FROM flags), s AS (SELECT query_id, count(*) AS flags, round(least(1.0, sum(CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.1 END) / 3), 4)::DOUBLE AS risk FROM nth WHERE n <= 100 GROUP BY 1),
      q AS (SELECT c_custkey AS query_id FROM customer)
      SELECT query_id, coalesce(flags, 0) AS flags, coalesce(risk, 0) AS risk_score, CASE WHEN coalesce(risk, 0) >= 0.7 THEN 'high' WHEN coalesce(risk, 0) >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level, round(0 - coalesce(risk, 0) * 0.3, 4)::DOUBLE AS confidence_adjustment FROM q LEFT JOIN s USING (query_id)""",
)
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("orders")
    questions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    return critic.review(spark.sql(_RISK), questions).drop("recommendations")


# --- Gaps -----------------------------------------------------------------


@register(
    "gap_analysis",
    with_inputs(
        r"""WITH q AS (SELECT DISTINCT query_id FROM claims), d AS (SELECT query_id, count(*) AS documents, count(DISTINCT url) AS domains FROM claim_sources WHERE text LIKE 'In 2%' GROUP BY 1),
        v AS (SELECT query_id, count_if(verdict = 'SUPPORTS') / count(*) < 0.2 AS conflict FROM verdict_rows GROUP BY 1), c AS (SELECT query_id, count(*) AS claims FROM claims GROUP BY 1),
        judged AS (SELECT DISTINCT query_id FROM verdict_rows)
        SELECT query_id, unnest(kinds) AS kind FROM (SELECT q.query_id, list_filter([CASE WHEN coalesce(documents, 0) < 3 THEN 'too_few_sources' END, CASE WHEN coalesce(documents, 0) = 0 THEN 'no_search_results' END, CASE WHEN documents > 0 AND domains < 2 THEN 'low_source_diversity' END,
          'too_many_unsupported_claims', CASE WHEN conflict THEN 'contradictions_unresolved' END, CASE WHEN documents > 0 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS kinds FROM q LEFT JOIN d USING (query_id) LEFT JOIN v USING (query_id) LEFT JOIN c USING (query_id))""",
        "claims", "claim_sources", "verdict_rows",
    ),
)
def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_frame(spark, sf_dir).select("query_id", "kind")


def gap_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, sources = relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "claim_sources").filter("text LIKE 'In 2%'")
    documents = sources.withColumn("seq", F.xxhash64("url")).withColumn("source_score", F.lit(0.25))
    return gaps.analyze(claims.select("query_id").distinct(), sources.select("query_id"), documents, claims, verdict_frame(spark, sf_dir))


@register(
    "gap_tasks",
    """WITH g AS (SELECT DISTINCT o_custkey AS query_id, CASE o_orderkey % 6 WHEN 0 THEN 'too_few_sources' WHEN 1 THEN 'low_source_diversity' WHEN 2 THEN 'too_many_unsupported_claims' WHEN 3 THEN 'contradictions_unresolved' WHEN 4 THEN 'low_confidence' ELSE 'no_search_results' END AS kind FROM orders)
      SELECT query_id, kind, c_name || CASE kind WHEN 'too_many_unsupported_claims' THEN ' facts evidence sources' WHEN 'contradictions_unresolved' THEN ' review' WHEN 'low_confidence' THEN ' official documentation' ELSE '' END AS query, 50 AS priority
      FROM g JOIN customer ON c_custkey = query_id WHERE kind <> 'no_search_results'""",
)
def gap_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["too_few_sources", "low_source_diversity", "too_many_unsupported_claims", "contradictions_unresolved", "low_confidence", "no_search_results"]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), kind.alias("kind"))
    questions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"), F.lit("general").alias("route"), F.lit("en").alias("language"))
    return gaps.gap_tasks(found, questions).select("query_id", "kind", "query", "priority")


@register("first_unused_claim", with_inputs(
    """WITH c AS (SELECT query_id, claim_no, claim, row_number() OVER (PARTITION BY query_id, claim ORDER BY claim_no) AS nth FROM claims), f AS (SELECT query_id, claim_no AS fact_no, claim, row_number() OVER (PARTITION BY query_id, claim ORDER BY claim_no) AS nth FROM claims WHERE claim_no % 2 = 0)
    SELECT f.query_id, f.fact_no, c.claim_no FROM f LEFT JOIN c USING (query_id, claim, nth)""", "claims"))  # fmt: skip
def first_unused_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "claims")
    facts = rows.filter("claim_no % 2 = 0").select("query_id", F.col("claim_no").alias("fact_no"), F.col("claim").alias("fact"))
    return synthesis.first_unused(rows.withColumnRenamed("claim", "text"), facts).select("query_id", "fact_no", "claim_no")
