"""Checks of an answer against its sources, and the risk they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from . import ranking

PER_CHECK = 20
IN_ALL = 100
SHOWN = 120


def with_blob(sources: DataFrame) -> DataFrame:
    """``sources`` with all they say in ``text``: text, content, body and snippet, as far as they have them."""
    return sources.withColumn("text", text.blob(*(F.col(c) for c in ("text", "content", "body", "snippet") if c in sources.columns)))


def _flags(rows: DataFrame, key: str, severity: Column, category: str, message: Column, claim: Column, order: Column) -> DataFrame:
    flags = rows.select(key, severity.alias("severity"), F.lit(category).alias("category"), message.alias("message"), claim.alias("claim"), order.cast("string").alias("position"))
    return ranking.top_n(flags, key, [F.asc("position"), F.asc("claim"), F.asc("message")], PER_CHECK).drop("rank", "position")


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def numeric_consistency(claims: DataFrame, sources: DataFrame, key: str = "query_id") -> DataFrame:
    """Claims alike but for their numbers, where some number is in no source."""
    told = claims.filter("coalesce(claim, '') <> ''").select(key, text.without_numbers(F.col("claim")).alias("context"), text.numbers_of(F.col("claim")).alias("numbers")).filter("context <> ''")
    groups = told.groupBy(key, "context").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("numbers"))).alias("numbers")).filter("n >= 2 AND size(numbers) >= 2")
    each = groups.select(key, "context", "numbers", F.explode("numbers").alias("number"))
    known = sources.filter("coalesce(url, '') <> ''").select(key, F.explode(text.numbers_of(F.col("text"))).alias("number")).distinct()
    missing = each.join(known, [key, "number"], "left_anti").groupBy(key, "context", "numbers").agg(F.collect_set("number").alias("missing"))
    message = F.concat(F.lit("Numeric disagreement across related claims: "), _list(F.col("numbers")), F.lit(" (unsupported by sources: "), _list(F.col("missing")), F.lit(")"))
    return _flags(missing, key, F.lit("medium"), "numeric_consistency", message, F.substring("context", 1, SHOWN), F.col("context"))


def ungrounded_entities(claims: DataFrame, sources: DataFrame, key: str = "query_id") -> DataFrame:
    """Entities of claims that no source of the question has, case ignored; questions whose sources have none are left out."""
    known = sources.select(key, F.explode(F.transform(text.entities_of(F.col("text")), lambda e: F.lower(e))).alias("entity")).distinct()
    each = claims.select(key, "claim_no", "claim", F.posexplode(text.entities_of(F.col("claim"))).alias("at", "name")).withColumn("entity", F.lower("name"))
    return each.join(known.select(key).distinct(), key, "left_semi").join(known, [key, "entity"], "left_anti")


def entity_hallucination(claims: DataFrame, sources: DataFrame, key: str = "query_id") -> DataFrame:
    """One flag per claim with entities that are not grounded; high if the claim cites a source."""
    per = ungrounded_entities(claims, sources, key).groupBy(key, "claim_no", "claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("names"))
    severity = F.when(F.col("claim").rlike(fixed.CITATION_MARK), "high").otherwise("medium")
    shown = F.concat(F.lit("['"), F.array_join(F.slice("names", 1, 5), "', '"), F.lit("']"), F.when(F.size("names") > 5, "…").otherwise(""))
    return _flags(per, key, severity, "entity_hallucination", F.concat(F.lit("Entity not grounded in any source: "), shown), F.substring("claim", 1, SHOWN), F.col("claim_no"))


def self_contradiction(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Facts with both sides, and facts alike but for numbers with opposite verdicts."""
    fact = F.coalesce("fact", F.lit(""))
    both = (F.col("verdict") == "CONFLICTING") | ((F.size("supporting_sources") > 0) & (F.size("refuting_sources") > 0))
    own = _flags(verdicts.filter(both), key, F.lit("high"), "self_contradiction", F.concat(F.lit("Both supporting and refuting sources for same claim: "), F.substring(fact, 1, 80)), F.substring(fact, 1, SHOWN), F.col("fact_no"))
    topics = verdicts.withColumn("context", F.substring(text.without_numbers(F.col("fact")), 1, 80)).filter("context <> ''")
    sides = topics.groupBy(key, "context").agg(F.bool_or(F.col("verdict") == "SUPPORTS").alias("s"), F.bool_or(F.col("verdict") == "REFUTES").alias("r")).filter("s AND r")
    cross = _flags(sides, key, F.lit("medium"), "self_contradiction", F.lit("Cross-claim contradiction on same topic: SUPPORTS vs REFUTES"), F.col("context"), F.col("context"))
    order = [F.when(F.col("severity") == "high", 0).otherwise(1), F.asc("claim")]
    return ranking.top_n(own.unionByName(cross), key, order, PER_CHECK).drop("rank")


def citation_integrity(answers: DataFrame, citations: DataFrame, key: str = "query_id") -> DataFrame:
    """Markers and URLs in an answer that are no citations, and citations without a URL."""
    ids = citations.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("ids"), F.collect_set("url").alias("urls"))
    rows = answers.join(ids, key, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    used = rows.select(key, none("ids", "int").alias("ids"), F.posexplode(F.regexp_extract_all("answer_markdown", F.lit(fixed.CITATION_MARK), 1)).alias("at", "mark"))
    wrong = used.filter(~F.array_contains("ids", F.col("mark").cast("int")))
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ", ")
    a = _flags(wrong, key, F.lit("high"), "citation_integrity", F.concat(F.lit("Unknown citation id: ["), F.col("mark").cast("int").cast("string"), F.lit("] (valid: ["), listed, F.lit("])")), F.lit(""), F.lpad(F.col("at").cast("string"), 6, "0"))
    b = _flags(citations.filter("coalesce(url, '') IN ('', '?')"), key, F.lit("medium"), "citation_integrity", F.format_string("Citation [%d] has empty URL", "id"), F.lit(""), F.lpad(F.col("id").cast("string"), 6, "0"))
    links = rows.select(key, none("urls", "string").alias("urls"), F.posexplode(F.regexp_extract_all("answer_markdown", F.lit(fixed.TEXT_URL), 0)).alias("at", "link"))
    links = links.withColumn("link", F.rtrim(F.col("link"), F.lit(".,;:!?)"))).filter(~F.array_contains("urls", F.col("link")))
    c = _flags(links, key, F.lit("high"), "citation_integrity", F.concat(F.lit("URL in markdown not in citation table: "), F.col("link")), F.lit(""), F.lpad(F.col("at").cast("string"), 6, "0"))
    return ranking.top_n(a.unionByName(b).unionByName(c), key, [F.asc("message")], PER_CHECK).drop("rank")


def temporal_consistency(claims: DataFrame, sources: DataFrame, key: str = "query_id") -> DataFrame:
    """Claims with a year after all years of a source, or long before; one flag per claim and source, the first ``PER_CHECK`` of a question.

    Only what can be among those is joined, so pairs do not grow with the
    tables: of sources with the same years the first by URL, of claims with
    the same years the first by number, and of claims with any flag the first
    by number, with ties.
    """
    spans = sources.withColumn("years", text.years_of(F.col("text"))).filter("size(years) > 0").select(key, F.coalesce("url", F.lit("")).alias("url"), F.array_max("years").alias("last"), F.array_min("years").alias("first"))
    spans = ranking.top_n(spans, [key, "last", "first"], [F.asc("url")], PER_CHECK).drop("rank")
    number = F.concat(F.coalesce(F.lpad(F.col("claim_no").cast("string"), 9, "0"), F.lit("")), F.lit("|"))
    rows = claims.select(key, number.alias("number"), F.substring("claim", 1, SHOWN).alias("claim"), text.years_of(F.col("claim")).alias("years")).filter("size(years) > 0")
    rows = ranking.top_n(rows, [key, "years"], [F.asc("number"), F.asc("claim")], PER_CHECK).drop("rank")
    ends = spans.groupBy(key).agg(F.min("last").alias("least"), F.max("first").alias("most"))
    rows = rows.join(ends, key).filter((F.array_max("years") > F.col("least") + 1) | (F.array_min("years") < F.col("most") - 5)).drop("least", "most")
    rows = rows.withColumn("place", F.rank().over(ranking.Window.partitionBy(key).orderBy("number"))).filter(F.col("place") <= PER_CHECK).join(spans, key)
    year = F.get(F.filter("years", lambda y: (y > F.col("last") + 1) | (y < F.col("first") - 5)), F.lit(0))
    rows = rows.withColumn("year", year).filter("year IS NOT NULL")
    late = F.col("year") > F.col("last") + 1
    message = F.when(late, F.format_string("Claim mentions %d but source max year is %d (anachronism)", "year", "last")).otherwise(F.format_string("Claim mentions %d but source min year is %d (unusually old)", "year", "first"))
    return _flags(rows, key, F.when(late, "medium").otherwise("low"), "temporal_consistency", message, F.col("claim"), F.concat("number", "url"))


def review(flags: DataFrame, questions: DataFrame, key: str = "query_id") -> DataFrame:
    """Risk score, level, adjustment and advice per question from at most 100 flags."""
    order = {name: i for i, name in enumerate(fixed.ADVICE)}
    nr = F.when(F.lit(False), F.lit(0))
    for name, i in order.items():
        nr = nr.when(F.col("category") == name, i)
    kept = ranking.top_n(flags, key, [nr, F.asc("claim"), F.asc("message")], IN_ALL)
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    sums = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("flags"),
        F.round(F.least(F.lit(1.0), F.sum(scoring.severity_weight(F.col("severity"))) / 3), 4).alias("risk_score"),
        *(has(F.col("category") == c).alias(f"_{c}") for c in fixed.ADVICE),
        has(F.col("severity") == "high").alias("_high"),
        has(F.col("severity") == "medium").alias("_medium"),
    )
    advice = F.array(*(F.when(F.col(f"_{c}"), F.lit(words)) for c, words in fixed.ADVICE.items()), F.when(F.col("_high"), F.lit(fixed.ADVICE_HIGH)).when(F.col("_medium"), F.lit(fixed.ADVICE_MEDIUM)))
    out = questions.select(key).join(sums.withColumn("recommendations", F.array_compact(advice)), key, "left")
    score = F.coalesce("risk_score", F.lit(0.0))
    return out.select(
        key, F.coalesce("flags", F.lit(0)).alias("flags"), score.alias("risk_score"), scoring.risk_level(score).alias("risk_level"),
        F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"), F.round(F.lit(0.0) - score * 0.3, 4).alias("confidence_adjustment"),
    )
