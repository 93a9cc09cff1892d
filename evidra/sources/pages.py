"""Pages and files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text, udfs, urls

MOST_CHARACTERS = 8000
MOST_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fetched(pages: DataFrame, most: int = MOST_CHARACTERS, closed: bool = False) -> DataFrame:
    """Stored pages (url, html, and as far as known final_url and content_type) as fetched documents: title, text cut to ``most`` characters, length, error.

    Errors are rows: addresses that may not be fetched, before or after a
    redirect, and content that is no HTML or XML. Of longer pages only the
    first ``MOST_BYTES`` are looked at, as a fetcher reads no more. Entities
    are decoded as browsers do; with ``closed`` only those with a semicolon.
    """
    have = pages.columns
    final = F.coalesce("final_url", "url") if "final_url" in have else F.col("url")
    kind = F.coalesce("content_type", F.lit("")) if "content_type" in have else F.lit("text/html")
    why = (
        F.when(~urls.is_safe_literal(F.col("url")), "blocked unsafe URL (SSRF guard)").when(~urls.is_safe_literal(final), "blocked unsafe final URL (after redirect)")
        .when(~F.contains(kind, F.lit("html")) & ~F.contains(kind, F.lit("xml")), F.concat(F.lit("non-html: "), kind))
    )
    html = F.when(F.octet_length("html") > MOST_BYTES, F.decode(F.substring(F.encode("html", "UTF-8"), 1, MOST_BYTES), "UTF-8")).otherwise(F.col("html"))
    rows = pages.select(F.when(urls.is_safe_literal(F.col("url")), final).otherwise(F.col("url")).alias("url"), why.alias("error"), html.alias("html"))
    body = text.html_to_text(F.col("html"))
    rows = rows.select("url", "error", F.when(F.col("error").isNull(), text.html_title(F.col("html"))).alias("title"), F.when(F.col("error").isNull(), body).alias("text"))
    decoded = udfs.unescape_closed if closed else udfs.unescape
    plain = lambda c: F.when(F.contains(c, F.lit("&")), decoded(F.when(F.contains(c, F.lit("&")), F.col(c)))).otherwise(F.col(c))
    rows = rows.select("url", "error", plain("title").alias("title"), text.cut_off(plain("text"), most).alias("text"))
    return rows.select("url", F.coalesce("title", F.lit("")).alias("title"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), "error")


def collect_files(spark: SparkSession, root: str, ignore: list[str]) -> DataFrame:
    """Files below a folder (path, length), those that match an ignored pattern (``*``, ``?``) left out, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    for pattern in ignore:
        regex = "(^|/)" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r".\+^$()[]{}|" else c for c in pattern) + "(/|$)"
        files = files.filter(~F.col("path").rlike(regex))
    return files.orderBy("path")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder with their content and whether it is binary: whether a byte of the first 1024 is 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content", F.hex(F.substring("content", 1, 1024)).rlike("^(..)*00").alias("binary"))


def scan_secrets(spark: SparkSession, root: str) -> DataFrame:
    """Matches of the redaction rules per file; 0 for binary ones."""
    return _files(spark, root).select("path", F.when(F.col("binary"), 0).otherwise(udfs.secret_counts(F.decode("content", "UTF-8"))).alias("matches"))


def redact_files(spark: SparkSession, root: str) -> DataFrame:
    """The text of every file without its secrets; a note for binary ones."""
    return _files(spark, root).select("path", F.when(F.col("binary"), "<binary file redacted>").otherwise(udfs.redact_secrets(F.when(~F.col("binary"), F.decode("content", "UTF-8")))).alias("text"))


def has_secret_name(name: Column) -> Column:
    """Whether a variable's name has a part that marks secrets."""
    return F.arrays_overlap(F.split(F.replace(F.upper(name), F.lit("."), F.lit("_")), "_"), F.array(*map(F.lit, fixed.SECRET_PARTS)))
