"""Functions that depend on the order of what they find, as Arrow-batched UDFs.

Built-in expressions cannot hold the state these need: facts evict each
other, evidence clusters move as they grow, spans need a map of offsets.
Callers filter rows first, as Spark evaluates a UDF on every row it gets.
"""

from __future__ import annotations

import html
import html.entities
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

_NUMBER = re.compile(fixed.FACT_NUMBER, re.IGNORECASE)
_DATE = re.compile(fixed.FACT_DATE, re.IGNORECASE)
_ANCHOR = re.compile(fixed.FACT_ANCHOR)
_NEXT = re.compile(fixed.FACT_NEXT)
_STOP = frozenset(fixed.FACT_STOP_WORDS)
_SKIP = frozenset(fixed.FACT_SKIP_UNITS)

# --- Facts ----------------------------------------------------------------


class _Facts:
    """Facts in order of discovery; of two that contain each other the longer one stays."""

    def __init__(self, most: int) -> None:
        self.found: list[str] = []
        self.most = most

    def full(self) -> bool:
        return len(self.found) >= self.most

    def add(self, phrase: str) -> None:
        if not phrase or phrase in self.found or _STOP.intersection(phrase.lower().split()):
            return
        if any(phrase in longer for longer in self.found):
            return
        self.found = [shorter for shorter in self.found if shorter not in phrase]
        self.found.append(phrase)


def _named(text: str, anchor: re.Match) -> str | None:
    """The anchor with up to three words behind it, or nothing if it stands alone."""
    phrase, at = [anchor.group()], anchor.end()
    while len(phrase) < 4 and (following := _NEXT.match(text, at)):
        word = following.group(1)
        if len(word) < 3 or word.lower() in _STOP:
            break
        phrase.append(word)
        at = following.end()
    return " ".join(phrase) if len(phrase) > 1 else None


def fact_score(fact: str, query: str) -> float:
    """How well a fact answers a question: shared words and length, less for fragments and navigation."""
    low = fact.lower()
    parts = low.split()
    asked = {w.lower().strip(".,!?") for w in query.split() if len(w) >= 2}
    score = float(sum(w in low for w in asked)) + min(1.5, 0.5 * max(0, len(parts) - 1))
    score -= 2.0 * (len(parts) < 2 or len(fact) < 8)
    score -= 1.0 * bool(set(parts) & set(fixed.NAVIGATION_WORDS))
    return score - 0.5 * (bool(parts) and parts[0].isdigit())


def extract_facts(text: str | None, limit: int = 8, query: str | None = "") -> list[str]:
    """Numbers with nouns, then dates, then names of a text; ranked by the question if there are more than ``limit``."""
    if not text:
        return []
    facts = _Facts(3 * limit)
    for m in _NUMBER.finditer(text):
        noun = m.group(2).lower()
        phrase = f"{m.group(1)} {m.group(2)}"
        if noun in _STOP or noun in _SKIP or len(phrase) > 30:
            continue
        facts.add(phrase)
        if facts.full():
            break
    for m in _DATE.finditer(text):
        facts.add(m.group(1))
        if facts.full():
            break
    for m in _ANCHOR.finditer(text):
        if m.group().lower() in _STOP:
            continue
        phrase = _named(text, m)
        if phrase and len(phrase) <= 80:
            facts.add(phrase)
            if facts.full():
                break
    found = facts.found
    if query and len(found) > limit:
        found = sorted(found, key=lambda f: -fact_score(f, query))
    return found[:limit]


# --- Fuzzy matching -------------------------------------------------------


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    ones = (1 << len(a)) - 1
    row = ones
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & ones
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """0 to 100: similarity by insertions and deletions of the words in sorted order."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def fuzzy_best(fact: str | None, text: str | None) -> float:
    """The best ratio of the fact with half-overlapping stretches of the text; 95 ends the search."""
    if not fact or not text:
        return 0.0
    fact, text = fact.lower(), text.lower()
    width = max(20, int(1.5 * len(fact)))
    best = 0.0
    for start in range(0, max(1, len(text) - width), width // 2):
        best = max(best, token_sort_ratio(fact, text[start : start + width]))
        if best >= 95:
            break
    return best


# --- Spans ----------------------------------------------------------------


def find_span(claim: str | None, text: str | None) -> tuple[int, int]:
    """Where a claim stands in a text, end exclusive: literally, up to white space, or by its first 30 characters."""
    if not claim or not text:
        return -1, -1
    at = text.find(claim)
    if at >= 0:
        return at, at + len(claim)
    # characters of the text with white space collapsed, and where each came from
    pieces = [(" " if m.group().isspace() else m.group(), m.start()) for m in re.finditer(r"\s+|\S", text)]
    if pieces and pieces[0][0] == " ":
        pieces = pieces[1:]
    if pieces and pieces[-1][0] == " ":
        pieces = pieces[:-1]
    flat = "".join(c for c, _ in pieces)
    wanted = " ".join(claim.split())
    if wanted and (at := flat.find(wanted)) >= 0:
        return pieces[at][1], pieces[at + len(wanted) - 1][1] + 1
    if len(wanted) >= 10 and (at := flat.find(wanted[:30])) >= 0:
        return pieces[at][1], pieces[at][1] + len(claim)
    return -1, -1


# --- Evidence windows -----------------------------------------------------

WINDOW = 300
WINDOWS = 3
MOST_WINDOW = 600
LEAST_SCORE = 0.1


def claim_terms(claim: str) -> list[str]:
    """The first 12 distinct words of three characters or more."""
    found = dict.fromkeys(w for w in re.findall(r"[A-Za-zА-Яа-яЁё0-9]+", claim.lower()) if len(w) >= 3)
    return list(found)[:12]


class _Edges:
    """Where a stretch of a text can begin and end so that it cuts no word: at a blank within ``REACH`` characters, else where it is."""

    REACH = 30

    def __init__(self, text: str) -> None:
        self.size = len(text)
        self.blanks = [m.start() for m in re.finditer(r"\s", text)]

    def begin(self, at: int) -> int:
        nth = bisect_left(self.blanks, at)
        inside = 0 < at and nth < len(self.blanks) and self.blanks[nth] < at + self.REACH
        return self.blanks[nth] + 1 if inside else max(0, at)

    def end(self, at: int) -> int:
        nth = bisect_left(self.blanks, at) - 1
        inside = at < self.size and nth >= 0 and self.blanks[nth] >= at - self.REACH
        return self.blanks[nth] if inside else min(self.size, at)


def _window(text: str, start: int, end: int, terms: Iterable[str], score: float) -> dict:
    dots = ["..." if more else "" for more in (start > 0, end < len(text))]
    return {"text": text[start:end].strip().join(dots), "start": start, "end": end, "terms": sorted(terms), "score": score}


def term_groups(text: str, terms: list[str], reach: int) -> list[tuple[float, set[str]]]:
    """Mean place and terms of each group of places, in order of their first place.

    Places, those that overlap too, come from left to right; each joins the
    first group whose mean so far is at most ``reach`` away, or begins one.
    """
    places = sorted((m.start(), nr) for nr, t in enumerate(terms) for m in re.finditer(f"(?={re.escape(t)})", text))
    total, number, members = np.zeros(len(places)), np.zeros(len(places)), [set() for _ in places]
    groups = 0
    for place, nr in places:
        near = np.abs(place - total[:groups] / number[:groups]) <= reach
        home = int(near.argmax()) if near.any() else groups
        groups = max(groups, home + 1)
        total[home] += place
        number[home] += 1
        members[home].add(terms[nr])
    return list(zip((total[:groups] / number[:groups]).tolist(), members, strict=False))


def extract_windows(text: str | None, claim: str | None, size: int = WINDOW, most: int = WINDOWS) -> list[dict]:
    """The stretches of a text with most of a claim's terms, ranked by their share of the terms, then by place.

    If even the best has next to none of them, the text's beginning comes first.
    """
    if not text:
        return []
    size, most = min(max(50, size), MOST_WINDOW), max(1, most)
    edges, terms = _Edges(text), claim_terms(claim or "")
    shares = [(-len(found) / len(terms), centre, found) for centre, found in term_groups(text.lower(), terms, size)]
    best = sorted(shares, key=lambda g: g[:2])[:most]
    windows = [_window(text, edges.begin(int(c) - size), edges.end(int(c) + size), found, -minus) for minus, c, found in best]
    if windows and windows[0]["score"] >= LEAST_SCORE:
        return windows
    return [_window(text, 0, edges.end(size), [], 0.0), *windows[: most - 1]]


# --- Redaction ------------------------------------------------------------


def _value(value: str) -> str:
    if value.strip() in fixed.REDACTED:
        return value
    return "***" if len(value) <= 4 else f"...{value[-4:]}"


def _assignment(m: re.Match) -> str:
    quote = '"' if m.group(2) is not None else "'" if m.group(3) is not None else ""
    return f"{m.group(1)}={quote}{_value(m.group(2) or m.group(3) or m.group(4) or '')}{quote}"


def _credentials(m: re.Match) -> str:
    if m.group(1).lower()[:-3] not in fixed.CREDENTIAL_SCHEMES:
        return m.group()
    return f"{m.group(1)}{m.group(2)}:{_value(m.group(3))}@{m.group(4)}"


_RULES: list[tuple[re.Pattern, Callable[[re.Match], str]]] = [
    (re.compile(fixed.SECRET_URL), _credentials),
    (re.compile(fixed.SECRET_ENV + r"(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'\n#]+))"), _assignment),
    (re.compile(fixed.SECRET_BOT), lambda m: f"{m.group(1)}:{_value(m.group(2))}"),
    (re.compile(fixed.SECRET_BEARER), lambda m: m.group(1) + _value(m.group(2))),
    (re.compile(fixed.SECRET_LITERAL), lambda m: f"{m.group(1)}...{m.group(2)[-4:]}"),
]


def redact(text: str) -> str:
    """The text without passwords, keys and tokens; the last four characters of longer ones stay."""
    for pattern, replacement in _RULES:
        text = pattern.sub(replacement, text)
    return text


# --- As columns -----------------------------------------------------------

WINDOW_TYPE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(T.StringType())
def redact_udf(text: pd.Series) -> pd.Series:
    return text.map(redact, na_action="ignore")


def redact_secrets(text: Column) -> Column:
    """``redact`` on the rows that have anything to redact; the others never leave the JVM's columns but as nulls."""
    suspect = text.rlike(fixed.SECRET_URL) | text.rlike(fixed.SECRET_ENV) | text.rlike(fixed.SECRET_BOT) | text.rlike(fixed.SECRET_BEARER) | text.rlike(fixed.SECRET_LITERAL)
    return F.coalesce(redact_udf(F.when(suspect, text)), text)


def secret_counts(text: Column) -> Column:
    """Matches of the five rules in a text as it is."""
    patterns = [fixed.SECRET_URL, fixed.SECRET_ENV, fixed.SECRET_BOT, fixed.SECRET_BEARER, fixed.SECRET_LITERAL]
    total = F.lit(0)
    for pattern in patterns:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities decoded, as browsers do also without a semicolon."""
    return text.map(html.unescape, na_action="ignore")


_CLOSED_ENTITY = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)")


def _closed_entity(found: re.Match) -> str:
    return html.unescape(found[0]) if found[1][0] == "#" or found[1] in html.entities.html5 else found[0]


@F.pandas_udf(T.StringType())
def unescape_closed(text: pd.Series) -> pd.Series:
    """HTML entities that end with a semicolon decoded; what is cut off before it stays as it is."""
    return text.map(lambda t: _CLOSED_ENTITY.sub(_closed_entity, t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def facts_of(text: pd.Series, query: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([extract_facts(t, int(n), q) for t, q, n in zip(text, query, limit, strict=True)])


@F.pandas_udf(T.DoubleType())
def fuzzy(fact: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_best(f, t) for f, t in zip(fact, text, strict=True)], dtype=float)


SPAN_TYPE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(SPAN_TYPE)
def span_of(claim: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([find_span(c, t) for c, t in zip(claim, text, strict=True)], columns=["start", "end"])


@F.pandas_udf(WINDOW_TYPE)
def windows_of(text: pd.Series, claim: pd.Series) -> pd.Series:
    return pd.Series([extract_windows(t, c) for t, c in zip(text, claim, strict=True)])
