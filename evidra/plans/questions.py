"""Queries over questions: language, time, routes, entities, adapted queries, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, language, scoring, text
from ..operators import planning
from .base import re2, register, relation, table, with_inputs


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@register(
    "language_detection",
    with_inputs(
        r"""WITH w AS (SELECT query_id, list_filter(regexp_split_to_array(query, '\s+'), lambda x: regexp_matches(x, '\pL')) AS words FROM questions)
        SELECT query_id, CASE WHEN 2 * len(list_filter(words, lambda x: regexp_matches(x, '[Ѐ-ӿ]'))) > len(words) THEN 'ru' ELSE 'en' END AS language FROM w""",
        "questions",
    ),
)
def language_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "questions").select("query_id", language.detect_language(F.col("query")).alias("language"))


_INFER = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(query), {quoted([w])})' for w in words)} THEN '{span}'" for span, words in fixed.TIME_WORDS.items()) + rf" WHEN regexp_matches(lower(query), '(^|[^\pL\pN_])(в|за|in|during)\s+(19|20)\d\d([^\pL\pN_]|$)') THEN 'year' END"
_RECENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(lower(query), {chr(39)}{re2(p)}{chr(39)})' for p in patterns)} THEN '{span}'" for span, patterns in fixed.RECENCY.items()) + " END"


@register("time_range", with_inputs(f"SELECT query_id, {_INFER} AS inferred, {_RECENT} AS recency FROM questions", "questions"))
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "questions").select("query_id", language.infer_time_range(F.col("query")).alias("inferred"), language.detect_recency(F.col("query")).alias("recency"))


def _hits(route: str) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(lower(query), '(?i){re2(p)}') AS INTEGER)" for p in fixed.ROUTE_PATTERNS[route]) + ")"


_ROUTES = list(fixed.ROUTE_PATTERNS)
_RAW = "SELECT query_id, query, " + ", ".join(f"{_hits(r)}::DOUBLE AS {r}" for r in _ROUTES) + " FROM questions"
_YEAR = "regexp_matches(query, '(^|[^0-9a-z_])20[2-9][0-9]([^0-9a-z_]|$)') AND (news > 0 OR technical > 0)"
_LONG = f"""raw AS ({_RAW}), scored AS (SELECT query_id, unnest([{quoted(_ROUTES)}]) AS route, unnest([{', '.join(f"{r} + CASE WHEN {_YEAR} THEN 0.5 ELSE 0 END" if r == 'news' else r for r in _ROUTES)}]) AS score, unnest(range({len(_ROUTES)})) AS nr FROM raw)"""


@register("route_scoring", with_inputs(f"WITH {_LONG} SELECT query_id, route, score FROM scored WHERE score > 0", "questions"))
def route_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an outer explode: for an inner one Spark would put all patterns into a filter below it, too
    rows = language.with_routes(relation(spark, sf_dir, "questions")).select("query_id", F.explode_outer("all_routes").alias("r"))
    return rows.filter("r IS NOT NULL").select("query_id", "r.route", "r.score")


@register(
    "route_choice",
    with_inputs(
        f"""WITH {_LONG}, best AS (SELECT query_id, arg_min(route, (-score, nr)) AS route, max(score) AS top FROM scored WHERE score > 0 GROUP BY 1)
        SELECT query_id, coalesce(route, 'general') AS route, CASE WHEN top IS NULL THEN 0.5 WHEN top >= 3 THEN 0.9 WHEN top >= 2 THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence FROM questions LEFT JOIN best USING (query_id)""",
        "questions",
    ),
)
def route_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.classify(relation(spark, sf_dir, "questions")).select("query_id", "route", "confidence")


def _by_route(values: dict[str, str | None]) -> str:
    return "CASE route " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in values.items() if v is not None) + " END"


_VARIANTS = "CASE route " + " ".join(f"WHEN '{r}' THEN [" + ", ".join(f"query || '{e}'" for e in ends) + "]" for r, ends in fixed.ROUTE_VARIANTS.items()) + " ELSE [] END"
#: Routes with all that follows from them, per question.
_INTENTS = f"""{_LONG}, tops AS (SELECT query_id, arg_min(route, (-score, nr)) AS route, list(score ORDER BY score DESC) AS scores FROM scored WHERE score > 0 GROUP BY 1),
  routed AS (SELECT query_id, query, coalesce(route, 'general') AS route, coalesce(scores, []) AS scores, CASE WHEN scores IS NULL THEN 0.5 WHEN scores[1] >= 3 THEN 0.9 WHEN scores[1] >= 2 THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence, {_RECENT} AS recent
    FROM questions LEFT JOIN tops USING (query_id)),
  intents AS (SELECT query_id, query, route, confidence, {_by_route({r: v[0] for r, v in fixed.ROUTE_PARAMS.items()})} AS engines, {_by_route({r: v[1] for r, v in fixed.ROUTE_PARAMS.items()})} AS categories,
    coalesce(CASE WHEN route = 'llm_release' AND recent = 'year' THEN NULL ELSE recent END, {_by_route({r: v[2] for r, v in fixed.ROUTE_PARAMS.items()})}) AS time_range, {_VARIANTS} AS variants,
    confidence < 0.75 OR route = 'security' OR coalesce(len(scores) > 1 AND scores[1] = scores[2], false) AS routing_warning FROM routed)"""


@register("intents", with_inputs(f"WITH {_INTENTS} SELECT query_id, route, confidence, engines, categories, time_range, array_to_string(variants, '|') AS variants, routing_warning FROM intents", "questions"))
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.classify(relation(spark, sf_dir, "questions"))
    return rows.select("query_id", "route", "confidence", "engines", "categories", "time_range", F.array_join("variants", "|").alias("variants"), "routing_warning")


@register(
    "content_nouns",
    with_inputs(
        f"""SELECT query_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS nouns FROM (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-zа-яё]{{4,}}'), lambda x: x NOT IN ({quoted(fixed.STOP_WORDS)}) AND x NOT IN ({quoted(fixed.CONTENT_BLACKLIST)})) AS w FROM questions)""",
        "questions",
    ),
)
def content_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "questions").select("query_id", F.array_join(language.content_nouns(F.col("query")), " ").alias("nouns"))


@register(
    "entity_scoring",
    with_inputs(
        r"""SELECT query_id, ((length(lower(query)) - length(replace(lower(query), e, ''))) // length(e)) * 2.0 + CASE WHEN strpos(lower(query), e) = 0 THEN 0 WHEN strpos(lower(query), e) - 1 < length(query) / 3.0 THEN 3 WHEN strpos(lower(query), e) - 1 < 2 * length(query) / 3.0 THEN 2 ELSE 1 END + 1.0
        + CASE WHEN regexp_matches(e, '\d') THEN 2.0 ELSE 0.0 END AS score FROM (SELECT query_id, query, 'pro' AS e FROM questions)""",
        "questions",
    ),
)
def entity_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "questions").select("query_id", language.entity_score(F.lit("Pro"), F.col("query")).alias("score"))


#: Adapted questions. Those of up to ten words stay as they are; the one longer kind has two names, of which the second overlaps the first, and common words.
PLANS = f"""{_INTENTS}, adapted AS (SELECT *, query LIKE 'how to read%' AS long_, regexp_extract(query, '(\\d+)$', 1) AS last_, CASE WHEN regexp_matches(query, '^[^a-zA-Z]*$') OR query LIKE '%языковые%' THEN 'ru' ELSE 'en' END AS language FROM intents),
  plans AS (SELECT *, CASE WHEN long_ THEN 'Falcon 9 9 rocket read' ELSE query END AS main_query, CASE WHEN long_ THEN ['Falcon 9 9 rocket', 'Falcon 9 read', '9 rocket read'] ELSE [] END AS alt_queries,
    CASE WHEN long_ THEN 'deterministic' ELSE 'passthrough' END AS adaptation_method, CASE WHEN long_ THEN 0.8 ELSE 0.95 END::DOUBLE AS adaptation_confidence,
    CASE WHEN long_ THEN list_sort(list_concat(['docs', 'for', 'how', 'the', 'to', 'tutorial'], CASE WHEN last_ = '9' THEN [] ELSE [last_] END)) ELSE [] END AS dropped,
    CASE WHEN long_ THEN 'dropped_critical_terms: ' || CASE WHEN length(last_) >= 3 THEN last_ || ', ' ELSE '' END || 'docs, tutorial' ELSE '' END AS reasons FROM adapted)"""


@register(
    "adapted_queries",
    with_inputs(f"WITH {PLANS} SELECT query_id, main_query, adaptation_method, adaptation_confidence, array_to_string(alt_queries, ' | ') AS alternatives, array_to_string(dropped, ' ') AS dropped, reasons, reasons <> '' AS needs_confirmation FROM plans", "questions"),
)
def adapted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.adapt(relation(spark, sf_dir, "questions"))
    return rows.select("query_id", "main_query", "adaptation_method", "adaptation_confidence", F.array_join("alt_queries", " | ").alias("alternatives"), F.array_join("dropped_terms", " ").alias("dropped"), F.array_join("confirmation_reason", "; ").alias("reasons"), "needs_confirmation")


@register(
    "alt_query_pairs",
    """SELECT p_partkey, a || ' ' || b AS pair FROM (SELECT p_partkey, e.a, f.b, e.i, f.j FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) p, LATERAL (VALUES (1, p_name), (2, p_brand), (3, p_type)) e(i, a), LATERAL (VALUES (1, p_name), (2, p_brand), (3, p_type)) f(j, b)) WHERE i < j""",
)
def alt_query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", planning.entity_pairs(F.array("p_name", "p_brand", "p_type")).alias("e"))
    return rows.select("p_partkey", F.explode("e").alias("pair"))


_W = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@register(
    "term_diff",
    f"""SELECT p_partkey, array_to_string(list_sort(list_filter({_W.format('a')}, lambda x: NOT list_contains({_W.format('b')}, x))), ' ') AS dropped, array_to_string(list_sort(list_filter({_W.format('b')}, lambda x: NOT list_contains({_W.format('a')}, x))), ' ') AS added
      FROM (SELECT p_partkey, p_name || ' ' || p_type AS a, p_name || ' ' || p_brand AS b FROM part)""",
)
def term_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped, added = planning.term_diff(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(dropped, " ").alias("dropped"), F.array_join(added, " ").alias("added"))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.classify(planning.adapt(relation(spark, sf_dir, "questions")))


#: The ending of a query that looks for dissent follows a checksum, which SQL has no function for; its row is compared without it.
_TASKS = f"""{PLANS}, listed AS (SELECT *, list_concat([{{'q': CASE WHEN route = 'llm_release' THEN query ELSE main_query END, 'p': 100, 'w': 'main adapted query'}}],
    CASE WHEN route = 'llm_release' THEN [] ELSE list_transform(alt_queries, lambda a: {{'q': a, 'p': 80, 'w': 'alt query'}}) END, list_transform(variants, lambda v: {{'q': v, 'p': 70, 'w': 'route-specific variant'}}),
    CASE WHEN route IN ({quoted(fixed.FALSIFICATION_ROUTES)}) THEN [{{'q': main_query, 'p': 40, 'w': 'falsification'}}] ELSE [] END) AS tasks FROM plans)"""


@register(
    "search_tasks",
    with_inputs(
        f"""WITH {_TASKS}, each AS (SELECT query_id, route, language, engines, categories, time_range, unnest(tasks) AS t, unnest(range(len(tasks))) AS nr FROM listed)
        SELECT query_id, nr::INTEGER AS task_id, trim(t.q) AS query, route, language, engines, categories, time_range, t.p AS priority, t.w AS rationale FROM each""",
        "questions",
    ),
)
def search_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.search_tasks(_plans(spark, sf_dir))
    asked = F.regexp_replace("query", "(" + "|".join(fixed.FALSIFICATION_TERMS) + ")$", "")
    return rows.withColumn("query", F.when(F.col("rationale") == "falsification", asked).otherwise(F.col("query")))


_ROUTED = " || ".join(f"CASE WHEN route <> 'general' AND {c} IS NOT NULL THEN chr(10) || '- suggested_{c}: ' || {c} ELSE '' END" for c in ("engines", "categories", "time_range"))


@register(
    "plan_preview",
    with_inputs(
        f"""WITH {PLANS} SELECT query_id, concat_ws(chr(10), 'Я понял задачу так:', '', '**Цель:** найти источники по запросу пользователя.', '**Исходный запрос:** ' || query, '', '**Основной запрос:** ' || main_query)
        || CASE WHEN long_ THEN chr(10) || chr(10) || '**Дополнительные запросы:**' || chr(10) || '1. ' || alt_queries[1] || chr(10) || '2. ' || alt_queries[2] || chr(10) || '3. ' || alt_queries[3] ELSE '' END
        || chr(10) || chr(10) || concat_ws(chr(10), '**Параметры поиска:**', '- language: ' || language, '- adaptation_method: ' || adaptation_method, '- adaptation_confidence: ' || printf('%.2f', adaptation_confidence), '- extracted_entities: …')
        || CASE WHEN long_ THEN chr(10) || chr(10) || '**Что было отброшено из исходного запроса:** ' || array_to_string(dropped[1:5], ', ') || CASE WHEN len(dropped) > 5 THEN ' (+' || (len(dropped) - 5) || ')' ELSE '' END ELSE '' END
        || CASE WHEN route <> 'general' THEN chr(10) || chr(10) || '**Рекомендованный маршрут поиска (advisory):**' || chr(10) || '- inferred_route: ' || route || chr(10) || '- routing_confidence: ' || printf('%.2f', confidence) ELSE '' END || {_ROUTED}
        || CASE WHEN route <> 'general' AND len(variants) > 0 THEN chr(10) || '- query_variants:' || array_to_string(list_transform(variants[1:4], lambda v: chr(10) || '  - ' || v), '') ELSE '' END
        || CASE WHEN route <> 'general' AND routing_warning THEN chr(10) || '- routing_warning: да (рекомендую подтвердить маршрут)' ELSE '' END || chr(10) || chr(10)
        || CASE WHEN reasons = '' THEN '**Требуется подтверждение:** нет (риск низкий, ищу автоматически).' ELSE concat_ws(chr(10), '**Требуется подтверждение:** да', '**Причины:** ' || reasons, '', 'Действия:', '1. APPROVE_SEARCH_PLAN', '2. SEARCH_RAW_QUERY', '3. EDIT_QUERY_PLAN: <новые параметры>') END AS preview FROM plans""",
        "questions",
    ),
)
def plan_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews; the list of entities is replaced by dots, as ``entity_scoring`` and ``adapted_queries`` compare entities."""
    rows = planning.plan_preview(_plans(spark, sf_dir))
    return rows.withColumn("preview", F.regexp_replace("preview", r"(?m)^(- extracted_entities: ).*$", "$1…"))


@register(
    "adaptation_confidence",
    """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 0.95 WHEN o_custkey % 7 = 0 THEN 0.8 WHEN n = 0 THEN 0.4 WHEN n >= 3 AND s >= 0.5 THEN 0.9 WHEN n >= 2 AND s >= 0.3 THEN 0.8 ELSE 0.65 END::DOUBLE AS confidence
      FROM (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS n, (o_orderkey % 8) / 8.0 AS s FROM orders)""",
)
def adaptation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("o_custkey") % 5 == 0, "passthrough").when(F.col("o_custkey") % 7 == 0, "llm").otherwise("deterministic")
    return table(spark, sf_dir, "orders").select("o_orderkey", planning.adapted_confidence(method, F.col("o_orderkey") % 5, (F.col("o_orderkey") % 8) / 8).alias("confidence"))


@register("llm_verdict_words", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'INSUFFICIENT' WHEN 2 THEN 'REFUTES' ELSE 'INSUFFICIENT' END AS verdict FROM orders")
def llm_verdict_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(F.lit(" match"), F.lit("No Match"), F.lit("refutes"), F.lit("perhaps")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.verdict_of(words).alias("verdict"))
