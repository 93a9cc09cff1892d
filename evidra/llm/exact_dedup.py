"""Exact deduplication as a tree of merged sorted digest runs.

Every text is normalised (runs of white space become one blank) and
digested. Rows are dealt to ``DIGITS`` ** ``ROUNDS`` partitions by a hash of
their id; a partition's run has one row per digest, in the order of the
digests: the smallest id and the number of rows.

Partitions exchange runs in binomial rounds, ``DIGITS`` = 2 ** 4 of them at a
time, which is four steps of two in one. A partition's number is read in
digits; in round i those partitions meet whose numbers differ in digit i
only. Each keeps the part of all their runs whose digests have its own
digit i, and merges these sorted pieces: rows that agree in digest, length
and second hash become one, with the smallest id. So after round i a run
covers ``DIGITS`` ** (i + 1) of the first ones, and is spread over as many
partitions by digest; after the last, there is one run, sorted and in as
many pieces as there were partitions at first, none of which ever held more
than its share. The answers then go back to the first runs and from there to
the rows.

A group of copies that holds a third of all rows is spread over all
partitions, and each sends one row for it: no task ever reads the group.
DataFrame operations only.

Defined results: a null text counts as empty; equal texts with equal ids
stay separate rows, and the row with the smallest id is the one kept (of
several rows with that id all are marked kept); a row without an id is
kept only if its whole group has none; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, field, flat, nested

#: Runs that one merge takes, and rounds: 4096 partitions.
DIGITS = 16
ROUNDS = 3

#: What must agree for two texts to be equal, the sorting order of a run.
KEY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """The text with every run of white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def digest_rows(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", digits: int = DIGITS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, partition, digest and two further marks of the normalised text.

    The marks (bytes and a second hash) take part in every comparison, so
    a digest alone never decides that two texts are equal.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_norm"))
    return rows.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(digits**rounds)).cast("int").alias("piece"),
        F.unhex(F.sha2("_norm", 256)).alias("digest"),
        F.octet_length("_norm").cast("long").alias("n_bytes"),
        F.xxhash64("_norm").alias("check"),
    )


def first_runs(rows: DataFrame) -> DataFrame:
    """The sorted run of every partition: KEY, piece, keep (a struct of the smallest id), group_size."""
    return rows.groupBy("piece", *KEY).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))


def exchange(runs: DataFrame, level: int, digits: int) -> DataFrame:
    """The runs after one round: pieces go to the partition with the digest's digit ``level``, and are merged there in order.

    The smallest of structs has no fixed width, so Spark merges by sorting
    and comparing neighbours, and not in a hash table.
    """
    unit = digits**level
    # the digit of the digest: bits that differ from level to level
    own = F.pmod(F.shiftright(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), 8 * level), F.lit(digits))
    there = (F.col("piece") - F.pmod(F.expr(f"piece div {unit}"), F.lit(digits)) * unit + own * unit).cast("int")
    dealt = runs.withColumn("piece", there).repartition("piece").sortWithinPartitions("piece", *KEY)
    return dealt.groupBy("piece", *KEY).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))


def exact_dedup(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", digits: int = DIGITS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digest_rows(documents, text, doc_id, digits, rounds), "digests")
    bottom = first_runs(rows)
    run = bottom
    for level in range(rounds):
        run = exchange(run, level, digits)
    answers = bottom.select("piece", *KEY).join(run.drop("piece").hint("merge"), KEY)
    # merged at every size: a broadcast that only small inputs allow would hide what large ones move
    return rows.join(answers.hint("merge"), ["piece", *KEY]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with their columns.

    Of rows alike in id and text one stays: the one whose columns together
    have the smallest hash, so that reruns agree.
    """
    # by digest and a hash of the id, so that a large group is spread, and one dealing of the texts serves the join and the choice;
    # the digest is never null, or Spark would take it twice, once in a filter
    answers = exact_dedup(documents, text, doc_id).filter("kept").select(F.col("text_sha256").alias("sha"), F.xxhash64("doc_id").alias("place")).distinct()
    rows = nested(documents).select("row", F.coalesce(F.sha2(normalised(field(text)), 256), F.lit("")).alias("sha"), F.xxhash64(field(doc_id)).alias("place"))
    stay = rows.join(answers.hint("merge"), ["sha", "place"], "left_semi")
    hashed = [F.to_json(field(c)) if "map<" in kind else field(c) for c, kind in documents.dtypes]  # maps have no hash
    first = F.struct(field(doc_id).isNull(), field(doc_id), F.xxhash64(*hashed))
    one = stay.groupBy("sha", "place").agg(F.min_by("row", first).alias("row"))
    return flat(one, documents.columns)
