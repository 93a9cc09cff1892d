"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_title(html: Column) -> Column:
    """The first title, trimmed; empty if there is none. Entities: ``unescape`` of the UDF module."""
    return F.trim(F.regexp_extract(html, r"<title[^>]*>([^<]+)</title>", 1))


def html_to_text(html: Column) -> Column:
    """The article, or else the page, without scripts, styles and tags."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    article = F.regexp_extract(clean, r"(?is)<article[^>]*>(.*?)</article>", 1)
    return collapse(F.regexp_replace(F.when(article != "", article).otherwise(clean), r"<[^>]+>", " "))


def cut_off(text: Column, most: int) -> Column:
    """At most ``most`` characters, with a note if there were more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…[truncated]"))).otherwise(text)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, an ellipsis included, cut at a blank if there is one."""
    text = F.trim(F.coalesce(text, F.lit("")))
    head = F.substring(text, 1, most - 1)
    head = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit("…")))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


def regex_quote(text: Column) -> Column:
    """The text as a pattern that matches it literally."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def first_text(*columns: Column) -> Column:
    """The first column that has more than white space."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns), F.lit(""))


def blob(*columns: Column) -> Column:
    """What several columns of a source say, with blanks between; those that are null or empty are left out."""
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in columns))


def sanitized(text: Column, most: int) -> Column:
    """Without control characters other than tab and line feed, at most ``most`` characters, trimmed."""
    return F.trim(F.substring(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", ""), 1, most))


def words(text: Column) -> Column:
    """Runs of Latin and Russian letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-zа-яё0-9]+"), 0)


def terms(text: Column) -> Column:
    """The first 12 distinct words of three characters or more."""
    return F.slice(F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= 3)), 1, 12)


def legacy_terms(text: Column) -> Column:
    """Words of three characters or more but the stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{3,}"), 0), lambda w: ~w.isin(fixed.LEGACY_STOP_WORDS))


def coverage(text: Column, wanted: Column) -> Column:
    """The share of ``wanted`` that the text has as substrings; 0 if nothing is wanted."""
    low = F.lower(text)
    return F.coalesce(F.try_divide(F.size(F.filter(wanted, lambda t: F.contains(low, F.lower(t)))), F.size(wanted)), F.lit(0.0))


def page_noise(text: Column) -> Column:
    """0 to 1 by how many of the five patterns of empty pages are there; 1 for no text."""
    hits = reduce(lambda a, b: a + b, (F.when(text.rlike(p), 0.5).otherwise(0.0) for p in fixed.NOISE_PAGES))
    return F.when(F.coalesce(text, F.lit("")) == "", 1.0).otherwise(F.least(F.lit(1.0), hits))


def legacy_noise(text: Column) -> Column:
    """A tenth per noise match in the first 2000 characters, at most one half."""
    return F.least(F.lit(0.5), F.regexp_count(F.substring(F.lower(text), 1, 2000), F.lit(fixed.NOISE_MATCHES)) * 0.1)


def without_urls(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"(?i)https?://\S+|www\.\S+", ""))


def reformulated(query: Column, replacements: dict[str, str]) -> Column:
    """The question in lower case with words replaced; null if none was."""
    new = reduce(lambda q, kv: F.replace(q, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), F.lower(query))
    return F.when(new != F.lower(query), new)


def numbers_of(text: Column) -> Column:
    """Distinct numbers of at most three digits before the point."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.CLAIM_NUMBER), 0))


def years_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(fixed.CLAIM_YEAR), 0), lambda y: y.cast("int")))


def entities_of(text: Column) -> Column:
    """Distinct runs of up to four capitalised words, English and Russian."""
    found = F.concat(F.regexp_extract_all(text, F.lit(fixed.CLAIM_ENTITY), 1), F.regexp_extract_all(text, F.lit(fixed.CLAIM_ENTITY_RU), 1))
    return F.array_distinct(F.filter(found, lambda e: F.length(e) >= 2))


def without_numbers(text: Column) -> Column:
    """What a claim is about: in lower case, numbers taken out."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), fixed.CLAIM_NUMBER, "")))
