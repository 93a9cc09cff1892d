"""What a question or a phrase says about language, time, numbers and negation, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, text


def _plain(pattern: str) -> str:
    """A pattern that ignores case, for text in lower case: the pattern in lower case, which is much faster to look for."""
    if re.search(r"\\[A-Z]", pattern):
        raise ValueError(f"{pattern} has a class that lower case would change")
    return "(?U)" + pattern.lower()


def _any(column: Column, patterns: list[str], flags: str = "(?iUu)") -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(flags + p) for p in patterns))


def detect_language(query: Column) -> Column:
    """``ru`` if more than half of the words with letters have a Cyrillic one, else ``en``."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: w.rlike(r"\p{L}"))
    russian = F.filter(words, lambda w: w.rlike(r"[Ѐ-ӿ]"))
    return F.when(F.size(russian) * 2 > F.size(words), "ru").otherwise("en")


def infer_time_range(query: Column) -> Column:
    """day, week or month by words that the question contains anywhere, year by a year with its preposition."""
    low = F.lower(query)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for span, words in fixed.TIME_WORDS.items():
        out = out.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), span)
    return out.when(_any(low, fixed.YEAR_PATTERNS, ""), "year")


def detect_recency(query: Column) -> Column:
    """day, week, month or year by whole words."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for span, patterns in fixed.RECENCY.items():
        out = out.when(_any(F.lower(query), list(map(_plain, patterns)), ""), span)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stem(word: Column) -> Column:
    """The known stem of a word, or the word without its first known ending."""
    known = F.create_map(*(F.lit(x) for kv in fixed.STEMS.items() for x in kv))

    def of(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for ending, least, new in fixed.ENDINGS:
            fits = low.endswith(ending) & (F.length(low) > least)
            fits = fits & ~low.endswith("ss") if ending == "s" else fits
            out = out.when(fits, F.concat(F.substring(low, F.lit(1), F.length(low) - len(ending)), F.lit(new)))
        return F.coalesce(F.try_element_at(known, low), out.otherwise(low))

    return let(F.lower(word), of)


def number_units(column: Column) -> Column:
    """All pairs of a number and a stemmed noun, in order."""
    numbers, nouns = (F.regexp_extract_all(column, F.lit(fixed.NUMBER_UNIT), i) for i in (1, 2))
    return F.transform(F.arrays_zip(numbers.alias("number"), nouns.alias("noun")), lambda p: F.struct(p["number"].alias("number"), stem(p["noun"]).alias("stem")))


def synonyms(word: Column) -> Column:
    """Known synonyms of a word; none is an empty array."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for known, others in fixed.SYNONYMS.items():
        out = out.when(word == known, F.array(*map(F.lit, others)))
    return out.otherwise(F.array().cast("array<string>"))


def _alike(a: str, b: str) -> bool:
    """Whether two stems are equal or synonyms of each other or of a third word."""
    of_a, of_b = set(fixed.SYNONYMS.get(a, [])), set(fixed.SYNONYMS.get(b, []))
    return a == b or a in of_b or b in of_a or bool(of_a & of_b)


_KNOWN = sorted({*fixed.SYNONYMS, *(w for words in fixed.SYNONYMS.values() for w in words)})


def relatives(stem_: Column) -> Column:
    """The stem and all stems that mean the same, from a constant map."""
    pairs = [x for w in _KNOWN for x in (F.lit(w), F.array(*(F.lit(k) for k in _KNOWN if _alike(k, w))))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), stem_), F.array(stem_))


def numeric_match(fact: Column, other: Column) -> Column:
    """``num_morph`` if the other text has the fact's number and noun anywhere, ``num_mismatch`` if only the noun with other numbers, else null."""

    def against(mine: Column) -> Column:
        near = F.filter(number_units(other), lambda p: F.array_contains(mine["kin"], p["stem"]))
        return let(F.transform(near, lambda p: p["number"]), lambda found: F.when(F.array_contains(found, mine["number"]), "num_morph").when(F.size(found) > 0, "num_mismatch"))

    first = let(F.get(number_units(fact), F.lit(0)), lambda p: F.when(p.isNotNull(), F.struct(p["number"].alias("number"), relatives(p["stem"]).alias("kin"))))
    return let(first, lambda mine: F.when(mine.isNotNull(), against(mine)))


def negation_patterns(fact: Column) -> list[tuple[str, Column]]:
    """Methods and patterns of a negated fact, the fact quoted."""
    quoted = text.regex_quote(F.lower(fact))
    flags = F.lit("(?iUu)")
    return [
        ("negation_after", F.concat(flags, F.lit(fixed.NEGATION_BEFORE_FACT), quoted, F.lit(fixed.WORD_END))),
        ("negation_before", F.concat(flags, quoted, F.lit(fixed.NEGATION_AFTER_FACT))),
        ("negation_en", F.concat(flags, F.lit(fixed.NEGATION_ENGLISH), quoted, F.lit(r"\w*" + fixed.WORD_END))),
    ]


def is_negated(fact: Column, other: Column) -> Column:
    """Whether the other text denies the fact."""
    low = F.lower(other)
    found = reduce(lambda a, b: a | b, (F.regexp_like(low, p) for _, p in negation_patterns(fact)))
    return F.coalesce((fact != "") & (other != "") & found, F.lit(False))


def negation_span(fact: Column, other: Column) -> Column:
    """Start, end (exclusive) and method of the first pattern that denies the fact, or null."""
    low = F.lower(other)
    out = F.when(F.lit(False), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("method")))
    for method, pattern in negation_patterns(fact):
        start = F.regexp_instr(low, pattern) - 1
        out = out.when(start >= 0, F.struct(start.alias("start"), (start + F.length(F.regexp_substr(low, pattern))).alias("end"), F.lit(method).alias("method")))
    return out


def mismatch_span(fact: Column, other: Column) -> Column:
    """Start and end of the first pair with the fact's noun and another number, or null."""
    mine = F.get(number_units(fact), F.lit(0))
    whole = F.regexp_extract_all(other, F.lit(fixed.NUMBER_UNIT), 0)
    pairs = F.arrays_zip(whole.alias("whole"), number_units(other).alias("pair"))
    wrong = F.get(F.filter(pairs, lambda p: F.array_contains(relatives(mine["stem"]), p["pair"]["stem"]) & (p["pair"]["number"] != mine["number"])), F.lit(0))["whole"]
    start = F.regexp_instr(other, F.concat(F.lit(r"(?U)\b"), text.regex_quote(wrong), F.lit(r"\b"))) - 1
    return F.when(wrong.isNotNull(), F.struct(start.alias("start"), (start + F.length(wrong)).alias("end"), F.lit("num_mismatch").alias("method")))


def with_routes(rows: DataFrame, query: str = "query") -> DataFrame:
    """``rows`` with ``all_routes``: routes with the number of their patterns in the question, best first, ties in the fixed order.

    The numbers are columns of their own before anything compares them, so
    that each pattern is looked for once in a question.
    """
    low, routes = F.lower(F.coalesce(query, F.lit(""))), list(fixed.ROUTE_PATTERNS)
    hits = {f"_hits_{r}": reduce(lambda a, b: a + b, (low.rlike(_plain(p)).cast("double") for p in fixed.ROUTE_PATTERNS[r])) for r in routes}
    rows = rows.withColumns(hits | {"_recent": low.rlike(fixed.RECENT_YEAR)})
    more = F.when(F.col("_recent") & ((F.col("_hits_news") > 0) | (F.col("_hits_technical") > 0)), 0.5).otherwise(0.0)
    rows = rows.withColumn("_hits_news", F.col("_hits_news") + more)
    all_ = F.array(*(F.struct((-F.col(f"_hits_{r}")).alias("minus"), F.lit(i).alias("nr"), F.lit(r).alias("route"), F.col(f"_hits_{r}").alias("score")) for i, r in enumerate(routes)))
    found = F.transform(F.array_sort(F.filter(all_, lambda x: x["score"] > 0)), lambda x: F.struct(x["route"].alias("route"), x["score"].alias("score")))
    return rows.withColumn("all_routes", found).drop("_recent", *hits)


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(fixed.STOP_WORDS)


def is_narrative(entity: Column) -> Column:
    """Phrases that introduce a question or give a size: nothing to search for."""
    parts = F.filter(F.split(F.lower(F.trim(entity)), r"(?U)\s+"), lambda t: t != "")
    intro = F.filter(F.transform(parts, lambda t: F.regexp_replace(t, r"^[.,!?;:]+|[.,!?;:]+$", "")), lambda t: t.isin(fixed.INTRO_WORDS))
    filler = (F.size(parts) > 0) & (F.size(intro) * 2 >= F.size(parts))
    return filler | F.trim(entity).rlike(r"(?iu)^\d+\s+(?:" + "|".join(fixed.SIZE_UNITS) + ")$")


def candidate_entities(query: Column) -> Column:
    """Product-like names and capitalised words that are not all stop words."""
    found = F.transform(F.regexp_extract_all(query, F.lit(fixed.PRODUCT_ENTITY), 0), lambda e: F.trim(e))
    return F.filter(found, lambda e: (F.length(e) >= 2) & e.rlike(r"\p{L}") & ~F.forall(F.split(e, r"\s+"), is_stop_word))


def content_nouns(query: Column) -> Column:
    """Distinct words of four letters or more that carry meaning, in lower case."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"[a-zа-яё]{4,}"), 0)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(fixed.STOP_WORDS) & ~w.isin(fixed.CONTENT_BLACKLIST)))


def entity_score(entity: Column, query: Column) -> Column:
    """Occurrences, how early the first one is, capitals and digits; less for stop words."""
    low, mine = F.lower(query), F.lower(entity)
    times = (F.length(low) - F.length(F.replace(low, mine, F.lit("")))) / F.length(mine)
    at, third = F.position(mine, low) - 1, F.length(query) / 3
    early = F.when(at < 0, 0.0).when(at < third, 3.0).when(at < 2 * third, 2.0).otherwise(1.0)
    parts = F.split(F.trim(entity), r"\s+")
    upper = F.when(entity.rlike(r"^\p{Lu}"), 1.0).otherwise(0.0)
    mixed = F.when(entity.rlike(r"\p{L}") & entity.rlike(r"\d"), 2.0).otherwise(0.0)
    return F.floor(times) * 2.0 + early + upper + mixed - F.when(F.forall(parts, is_stop_word), 5.0).otherwise(0.0)
