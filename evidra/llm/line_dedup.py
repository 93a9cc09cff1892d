"""Line deduplication by overlapping windows of three lines.

Lines that are not empty are numbered; their white space counts as single
blanks. Every three consecutive ones are a window, known by two hashes of 64
bits that do not follow from each other and its length; a text of one or two
lines is one window as a whole. A window that occurs
more than once in the corpus stays where it occurs first, by the smallest
(doc_id, checksum of the text, line); everywhere else it covers its lines.
Covered positions are merged per text and removed, so a repeated passage
goes as a whole however its windows overlap. Empty lines stay.

Windows are counted with partial sums before the shuffle: a passage that a
third of all texts share sends one row per task. Where repeated windows meet
their places, each is dealt to ``PLACES`` places by the texts' checksums.
Windows count however short their lines are.

Defined results: a null text stays null, has no lines and loses none; an
empty text likewise; a text whose lines are all covered becomes empty but
its row stays; rows with the same id are told apart by their texts; rows
alike in id and text lose the same lines; an empty table gives an empty
table; other columns pass through, whatever their names, but that the
operator's own ``n_lines`` and ``n_removed`` stand in for the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, drop_cut, field, nested

WINDOW = 3
#: Places that a repeated window is dealt to.
PLACES = 16
#: What must agree for two windows to be equal.
KEY = ["w1", "w2", "n_bytes"]


def _raw(text: Column) -> Column:
    """The lines of a text as they are."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _clean(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, f"[{SPACE}]+", " "))


def _crc(text: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(-1))


def windows(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """(doc_id, crc, line, w1, w2): ``line`` is the number of the window's first line, from 0."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), _crc(F.col(text)).alias("crc"), F.filter(F.transform(_raw(F.col(text)), _clean), lambda x: x != "").alias("lines"))
    rows = rows.filter(F.size("lines") > 0)
    rows = rows.select("doc_id", "crc", "lines", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("lines") - size))).alias("line"))
    rows = rows.select("doc_id", "crc", "line", F.array_join(F.slice("lines", F.col("line") + 1, size), "\n").alias("lines"))
    # the salt first: after the text it would only scramble the first hash once more
    return rows.select("doc_id", "crc", "line", F.xxhash64("lines").alias("w1"), F.xxhash64(F.lit(1), "lines").alias("w2"), F.octet_length("lines").cast("long").alias("n_bytes"))


def repeated_windows(places: DataFrame) -> DataFrame:
    """(KEY, first): the windows that occur more than once, and where first."""
    found = places.groupBy(*KEY).agg(F.min(F.struct("doc_id", "crc", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    return found.filter("n > 1").drop("n")


def covered_lines(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """(doc_id, crc, covered): the first lines of a text's windows that occurred before."""
    places = cut(windows(documents, text, doc_id, size), "windows")
    repeated = cut(repeated_windows(places), "repeated").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    dealt = places.withColumn("place", F.pmod("crc", F.lit(PLACES)).cast("int"))
    later = dealt.join(repeated.hint("merge"), [*KEY, "place"]).filter(~F.struct("doc_id", "crc", "line").eqNullSafe(F.col("first")))
    covered = cut(later.groupBy("doc_id", "crc").agg(F.collect_set("line").alias("covered")), "covered")
    drop_cut(places)
    return covered


def dedup_lines(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """The documents with their columns, the text without repeated passages, and ``n_lines`` and ``n_removed``."""
    covered = covered_lines(documents, text, doc_id, size)
    rows = nested(documents).withColumn("of", _crc(field(text)))
    # merged at every size: a broadcast that only small inputs allow would hide what large ones move
    rows = rows.join(covered.hint("merge"), field(doc_id).eqNullSafe(covered["doc_id"]) & (rows["of"] == covered["crc"]), "left")
    rows = rows.withColumn("raw", _raw(field(text)))
    # places in the raw text of the lines that are not empty
    rows = rows.withColumn("places", F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: _clean(F.get("raw", i)) != ""))
    gone = F.array_distinct(F.flatten(F.transform("covered", lambda c: F.slice("places", c + 1, size))))
    rows = rows.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.col("gone")), lambda i: F.get("raw", i))
    new = F.when(field(text).isNotNull(), F.when(F.size("gone") == 0, field(text)).otherwise(F.array_join(left, "\n")))
    kept = [(new if c == text else field(c)).alias(c) for c in documents.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*kept, F.size("places").alias("n_lines"), F.size("gone").alias("n_removed"))
