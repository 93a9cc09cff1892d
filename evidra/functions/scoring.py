"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text


def rounded(value: Column) -> Column:
    """Four places; what lies within 1e-10 of a half is rounded up, whatever the last bits say."""
    return F.round(F.round(value, 10), 4)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def position_score(index: Column) -> Column:
    """1 for the first place, falling with the place; 0 for none."""
    return F.when(index < 0, 0.0).otherwise(1.0 / (1 + index))


def search_score(ranks: Column, queries: Column) -> Column:
    """The best place among ``ranks`` and a tenth for each further question that led here, at most 0.2; null without places."""
    best = F.array_min(F.filter(ranks, lambda r: r >= 1))
    asked = F.size(F.array_distinct(F.filter(F.transform(queries, lambda q: F.trim(q)), lambda q: q != "")))
    bonus = F.least(F.lit(0.2), F.greatest(F.lit(0.0), (asked - 1) * 0.1))
    return F.when(best.isNotNull(), F.least(F.lit(1.0), 1.0 / best + bonus))


def source_score(body: Column, length: Column, wanted: Column, search: Column, failed: Column) -> Column:
    """0.35 search + 0.45 coverage less noise + 0.20 length; 0 for pages without text."""
    covered = F.when(F.size(wanted) == 0, 0.5).otherwise(text.coverage(body, wanted))
    score = 0.35 * search + 0.45 * covered * (1 - 0.5 * text.page_noise(body)) + 0.20 * F.least(F.lit(1.0), length / 4000)
    return F.when(failed | (F.coalesce(body, F.lit("")) == ""), 0.0).otherwise(rounded(clamp(score)))


def legacy_confidence(body: Column, length: Column, wanted: Column) -> Column:
    """Half length, half share of terms, less noise."""
    covered = F.when(F.size(wanted) == 0, 0.5).otherwise(text.coverage(body, wanted))
    return F.when(F.coalesce(body, F.lit("")) == "", 0.0).otherwise(clamp(0.5 * F.least(F.lit(1.0), length / 2000) + 0.5 * covered - text.legacy_noise(body)))


def hit_score(rank: Column, title: Column, snippet: Column, engine: Column, wanted: Column) -> Column:
    """Place, terms in title and snippet, and weight of the engine."""
    shown = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    weights = F.create_map(*(F.lit(x) for kv in fixed.ENGINE_WEIGHTS.items() for x in kv))
    covered = F.when(F.size(wanted) == 0, 0.5).otherwise(text.coverage(shown, wanted))
    return 0.45 / F.greatest(rank + 1, F.lit(1)) + 0.35 * covered + 0.20 * F.coalesce(F.try_element_at(weights, F.lower(engine)), F.lit(0.5))


def answer_confidence(coverage: Column, contradictions: Column, citations: Column) -> Column:
    return rounded(clamp(coverage - 0.1 * contradictions + F.least(F.lit(0.1), 0.02 * citations)))


def quality_score(coverage: Column, contradictions: Column, confidence: Column, route: Column) -> Column:
    return rounded(0.45 * coverage + 0.22 * (1 - contradictions) + 0.22 * confidence + 0.11 * route)


def ratio(part: Column, whole: Column) -> Column:
    """Rounded to four places; null if there is nothing to divide by."""
    return F.round(F.try_divide(part, whole), 4)


def severity_weight(severity: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, weight in fixed.SEVERITY_WEIGHTS.items():
        out = out.when(severity == name, weight)
    return out.otherwise(0.0)


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")


def candidate_state(roots: Column, derivatives: Column, updated: Column) -> Column:
    """State and base score of a family of repositories in a window."""
    state = lambda name, base: F.struct(F.lit(name).alias("state"), F.lit(base).alias("base"))
    return F.when(derivatives >= 2, state("derivative_burst", 0.8)).when(roots > 0, state("new_root_repository", 0.7)).when(derivatives == 1, state("derivative_signal", 0.5)).when(updated > 0, state("update_only", 0.2)).otherwise(state("outside_window", 0.0))


def verdict_of(answer: Column) -> Column:
    """A language model's word for a verdict in ours."""
    word = F.upper(F.trim(answer))
    return F.when(word == "MATCH", "SUPPORTS").when(word.isin("SUPPORTS", "REFUTES", "INSUFFICIENT", "CONFLICTING", "NUMERIC_MISMATCH"), word).otherwise("INSUFFICIENT")
