"""Questions become routes, entities, adapted queries and search tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, language, text, udfs

TASK = "query string, route string, language string, engines string, categories string, time_range string, priority int, rationale string"


def _of_route(route: Column, index: int) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, params in fixed.ROUTE_PARAMS.items():
        out = out.when(route == name, F.lit(params[index]).cast("string"))
    return out


def _once(questions: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``questions`` with the columns that ``add`` gives for their ``query``, worked out once for questions that repeat."""
    done = add(questions.select(F.col("query").alias("_query")).distinct().withColumn("query", F.col("_query"))).drop("query")
    return questions.join(done, questions["query"].eqNullSafe(done["_query"])).drop("_query")


def classify(questions: DataFrame) -> DataFrame:
    """``questions`` (with ``query``) with route, confidence, engines, categories, time_range, variants and warning."""
    return _once(questions, _classify)


def _classify(questions: DataFrame) -> DataFrame:
    rows = language.with_routes(questions)
    best = F.try_element_at("all_routes", F.lit(1))
    second = F.try_element_at("all_routes", F.lit(2))
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    rows = rows.withColumn("route", F.when(blank, "general").otherwise(F.coalesce(best["route"], F.lit("general"))))
    confidence = F.when(blank, 0.0).when(best.isNull(), 0.5).when(best["score"] >= 3, 0.9).when(best["score"] >= 2, 0.75).otherwise(0.6)
    rows = rows.withColumn("confidence", confidence).withColumn("engines", _of_route(F.col("route"), 0)).withColumn("categories", _of_route(F.col("route"), 1))
    recent = language.detect_recency(F.col("query"))
    recent = F.when((F.col("route") == "llm_release") & (recent == "year"), None).otherwise(recent)
    rows = rows.withColumn("time_range", F.coalesce(recent, _of_route(F.col("route"), 2)))
    variants = F.when(F.lit(False), F.array().cast("array<string>"))
    for route, endings in fixed.ROUTE_VARIANTS.items():
        variants = variants.when(F.col("route") == route, F.array(*(F.concat("query", F.lit(e)) for e in endings)))
    rows = rows.withColumn("variants", variants.otherwise(F.array().cast("array<string>")))
    narrow = (F.col("route") == "security") & F.col("engines").isNotNull()
    tie = F.coalesce(best["score"] == second["score"], F.lit(False))
    return rows.withColumn("routing_warning", (F.col("confidence") < 0.75) | narrow | tie)


def entities(questions: DataFrame) -> DataFrame:
    """``questions`` with up to ten ``entities``, the best first, narrative phrases left out."""
    listed = F.array_union(language.candidate_entities(F.col("query")), F.filter("_facts", lambda f: F.size(F.split(f, r"\s+")) <= 4))
    nouns = F.array_except(language.content_nouns(F.col("query")), listed)
    combined = F.concat(listed, F.slice(nouns, 1, F.greatest(F.lit(0), F.lit(12) - F.size(listed))))
    rows = questions.withColumn("_facts", udfs.facts_of(F.col("query"), F.lit(""), F.lit(8)))
    rows = rows.withColumn("_all", F.filter(combined, lambda e: ~language.is_narrative(e)))
    scored = F.transform("_all", lambda e, i: F.struct((-language.entity_score(e, F.col("query"))).alias("minus"), i.alias("at"), e.alias("entity")))
    return rows.withColumn("entities", F.slice(F.transform(F.array_sort(scored), lambda s: s["entity"]), 1, 10)).drop("_facts", "_all")


def adapted_confidence(method: Column, found: Column, shared: Column) -> Column:
    """How much an adapted query can be trusted, by its entities and the share of the question's words in it."""
    return (
        F.when(method == "passthrough", 0.95).when(method == "llm", 0.80).when(found == 0, 0.40)
        .when((found >= 3) & (shared >= 0.5), 0.90).when((found >= 2) & (shared >= 0.3), 0.80).otherwise(0.65)
    )


def first_words(query: Column, most: int = 8) -> Column:
    return F.array_join(F.slice(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != ""), 1, most), " ")


def main_query(entities: Column) -> Column:
    """The first eight words of the first three entities, URLs left out."""
    return first_words(text.without_urls(F.array_join(F.slice(entities, 1, 3), " ")))


def entity_pairs(entities: Column) -> Column:
    """Every two of the first three entities, in order, unless they are equal."""
    at = lambda i: F.try_element_at(entities, F.lit(i))
    pairs = (F.when(at(i) != at(j), F.concat_ws(" ", at(i), at(j))) for i, j in ((1, 2), (1, 3), (2, 3)))
    return F.array_compact(F.array(*pairs))


def term_diff(before: Column, after: Column) -> tuple[Column, Column]:
    """Words that went and words that came, sorted."""
    a, b = text.words(before), text.words(after)
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


def adapt(questions: DataFrame) -> DataFrame:
    """``questions`` with main and alternative queries, terms that came and went, and reasons to ask back."""
    return _once(questions, _adapt)


def _adapt(questions: DataFrame) -> DataFrame:
    size = F.size(F.filter(F.split(F.trim("query"), r"(?U)\s+"), lambda w: w != ""))
    rows = entities(questions).withColumn("n_words", size).withColumn("language", language.detect_language(F.col("query")))
    short = F.col("n_words") <= 10
    found = F.size("entities") > 0
    rows = rows.withColumn("adaptation_method", F.when(short, "passthrough").when(found, "deterministic").otherwise("degraded"))
    rows = rows.withColumn("main_query", F.when(short, F.trim("query")).when(found, main_query(F.col("entities"))).otherwise(first_words(F.col("query"))))
    alts = F.array_distinct(F.filter(entity_pairs(F.col("entities")), lambda a: a != F.col("main_query")))
    rows = rows.withColumn("alt_queries", F.when(short, F.array().cast("array<string>")).otherwise(alts))
    new = F.concat_ws(" ", F.col("main_query"), F.array_join("alt_queries", " "))
    asked, used = text.words(F.col("query")), text.words(new)
    dropped, added = term_diff(F.col("query"), new)
    rows = rows.withColumn("dropped_terms", dropped).withColumn("added_terms", added)
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, used)), F.size(F.array_distinct(asked))), F.lit(0.0))
    rows = rows.withColumn("adaptation_confidence", adapted_confidence(F.col("adaptation_method"), F.size("entities"), shared))
    critical = F.slice(F.filter("dropped_terms", lambda t: (F.length(t) >= 3) & ~language.is_stop_word(t)), 1, 5)
    reasons = F.array(
        F.when(F.col("n_words") > 40, F.concat(F.lit("long_query: "), F.col("n_words").cast("string"))),
        F.when(~found & ~short, F.lit("no_entities")),
        F.when(F.size("added_terms") > 0, F.concat(F.lit("added_terms: "), F.array_join("added_terms", ", "))),
        F.when(F.size(critical) > 0, F.concat(F.lit("dropped_critical_terms: "), F.array_join(critical, ", "))),
        F.when(F.col("adaptation_confidence") < 0.75, F.lit("low_confidence")),
    )
    return rows.withColumn("confirmation_reason", F.array_compact(reasons)).withColumn("needs_confirmation", F.size("confirmation_reason") > 0)


def falsification(query: Column, route: Column) -> Column:
    """The question with one of four endings that look for dissent, the same one in every run."""
    terms = F.array(*map(F.lit, fixed.FALSIFICATION_TERMS))
    return F.concat(query, F.element_at(terms, (F.pmod(F.crc32(F.encode(F.concat(query, F.lit("|"), route), "UTF-8")), F.lit(4)) + 1).cast("int")))


def search_tasks(plans: DataFrame, key: str = "query_id") -> DataFrame:
    """Tasks of adapted and classified questions, by priority: main 100, alternatives 80, variants 70, dissent 40."""
    release = F.col("route") == "llm_release"
    main = F.trim(F.when(release, F.col("query")).otherwise(F.col("main_query")))
    task = lambda q, p, why: F.struct(F.trim(q).alias("query"), F.lit(p).alias("priority"), F.lit(why).alias("rationale"))
    dissent = F.when(F.col("route").isin(fixed.FALSIFICATION_ROUTES) & (main != ""), F.array(task(falsification(main, F.col("route")), 40, "falsification")))
    branches = [
        F.array(task(main, 100, "main adapted query")),
        F.when(release, None).otherwise(F.transform("alt_queries", lambda q: task(q, 80, "alt query"))),
        F.transform("variants", lambda q: task(q, 70, "route-specific variant")),
        dissent,
    ]
    empty = F.array().cast("array<struct<query:string,priority:int,rationale:string>>")
    listed = F.filter(F.flatten(F.array(*(F.coalesce(b, empty) for b in branches))), lambda t: t["query"] != "")
    rows = plans.select(key, "route", "language", "engines", "categories", "time_range", F.posexplode(listed).alias("task_id", "_t"))
    return rows.select(key, "task_id", "_t.query", "route", "language", "engines", "categories", "time_range", "_t.priority", "_t.rationale")


SHOWN_TERMS = 5
SHOWN_VARIANTS = 4


def plan_preview(plans: DataFrame, key: str = "query_id") -> DataFrame:
    """What will be searched and why, for a person to approve."""
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    blank = F.lit("")

    def some(values: Column, heading: str) -> Column:
        more = F.when(F.size(values) > SHOWN_TERMS, F.format_string(" (+%d)", F.size(values) - SHOWN_TERMS)).otherwise("")
        return F.when(F.size(values) > 0, line("\n", heading, F.array_join(F.slice(values, 1, SHOWN_TERMS), ", "), more))

    listed = F.transform("alt_queries", lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q))
    quoted = F.concat(F.lit("['"), F.array_join("entities", "', '"), F.lit("']"))
    two = lambda c: F.format_number(c, 2)
    routed = F.col("route") != "general"
    shown = F.transform(F.slice("variants", 1, SHOWN_VARIANTS), lambda v: F.concat(F.lit("  - "), v))
    lines = [
        F.lit("Я понял задачу так:"), blank, F.lit("**Цель:** найти источники по запросу пользователя."), line("**Исходный запрос:** ", F.col("query")), blank,
        line("**Основной запрос:** ", F.when(F.col("main_query") != "", F.col("main_query")).otherwise("(пусто)")),
        F.when(F.size("alt_queries") > 0, line("\n**Дополнительные запросы:**\n", F.array_join(listed, "\n"))),
        blank, F.lit("**Параметры поиска:**"), line("- language: ", F.col("language")), line("- adaptation_method: ", F.col("adaptation_method")),
        line("- adaptation_confidence: ", two(F.col("adaptation_confidence"))),
        F.when(F.size("entities") > 0, line("- extracted_entities: ", quoted)),
        some(F.col("dropped_terms"), "**Что было отброшено из исходного запроса:** "),
        some(F.col("added_terms"), "**Что было добавлено (нет в исходном запросе):** "),
        F.when(routed, line("\n**Рекомендованный маршрут поиска (advisory):**\n- inferred_route: ", F.col("route"), "\n- routing_confidence: ", two(F.col("confidence")))),
        *(F.when(routed, line(f"- suggested_{c}: ", F.col(c))) for c in ("engines", "categories", "time_range")),
        F.when(routed & (F.size("variants") > 0), line("- query_variants:\n", F.array_join(shown, "\n"))),
        F.when(routed & F.col("routing_warning"), F.lit("- routing_warning: да (рекомендую подтвердить маршрут)")),
        blank,
        F.when(
            F.col("needs_confirmation"),
            line("**Требуется подтверждение:** да\n**Причины:** ", F.array_join("confirmation_reason", "; "), "\n\nДействия:\n1. APPROVE_SEARCH_PLAN\n2. SEARCH_RAW_QUERY\n3. EDIT_QUERY_PLAN: <новые параметры>"),
        ).otherwise("**Требуется подтверждение:** нет (риск низкий, ищу автоматически)."),
    ]
    return plans.select(key, F.concat_ws("\n", *lines).alias("preview"))
