"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, drop_cut

__all__ = ["SPACE", "byte_batches", "cut", "drop_cut", "field", "flat", "hash32", "join_groups", "nested", "places_for", "running_start", "tokenizer_path"]

#: White space of the contracts, as a character class body: blank and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
#: Rows of a group that are worth a place of their own where they meet what is known of the group.
PLACE_ROWS = 50_000


def hash32(column: Column, salt: str) -> Column:
    """A number from 0 to 2**32 - 1 from a column's text: the first 32 bits of its MD5.

    MD5 rather than Spark's own hashes, so that plain SQL elsewhere can
    give the same number. Null hashes like the text ``null``.
    """
    text = F.concat(F.coalesce(column.cast("string"), F.lit("null")), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def nested(documents: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that no working column can clash with a caller's."""
    return documents.select(F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("row"))


def field(name: str) -> Column:
    """A caller's column of ``nested`` rows."""
    return F.col("row").getField(name)


def flat(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The caller's columns of ``nested`` rows."""
    return rows.select(*(field(c).alias(c) for c in columns))


def places_for(rows: DataFrame, n_rows: int) -> int:
    """To how many places the rows of one group are dealt: as many as could be busy if all rows were of one group."""
    return max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // PLACE_ROWS))


def join_groups(rows: DataFrame, groups: DataFrame, group: str, position: str, places: int) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per ``group``; null groups meet too.

    Every group is dealt to ``places`` places by ``position``, so a group
    that holds a third of all rows is never one task, and nothing has to
    be broadcast.
    """
    many = groups.withColumnRenamed(group, "_group").withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    dealt = rows.withColumn("_deal", F.pmod(F.col(position), F.lit(places)).cast("int"))
    found = dealt.join(many.hint("merge"), dealt[group].eqNullSafe(many["_group"]) & (dealt["_deal"] == many["_spread"]))
    return found.drop("_group", "_spread", "_deal")


def running_start(df: DataFrame, group: str, part: str, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    ``part`` numbers stretches of the group's order. With about sqrt(n)
    stretches in a group of n rows, neither the sums of the stretches nor
    the rows of one are ever more than about sqrt(n) rows in one task, even
    if one group holds a third of all rows.
    """
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    sums = sums.select(group, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # merged at every size, so that one dealing by group and stretch serves the join and the window
    rows = df.withColumn("_value", value).join(sums.hint("merge"), [group, part])
    rows = rows.withColumn(out, F.col("_before") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return rows.drop("_value", "_before")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, or of one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, done = 0, 0
        while start < len(ends):
            stop = int(np.searchsorted(ends, done + limit - size, side="right"))
            if stop == start and held:
                yield _joined(held)
                held, size = [], 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start, done = stop, int(ends[stop - 1])
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)
    held, batch = [], None
    # workers serve other tasks next, and what they keep counts
    pa.default_memory_pool().release_unused()


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
