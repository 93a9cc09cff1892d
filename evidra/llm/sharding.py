"""Shards by jump consistent hashing, without a ring or a table.

A document's key seeds a small generator; from it follow the shard counts
at which the key jumps to a new shard. The shard is the last jump below
the shard count, so one more shard takes rows only into itself. The law is
``key``: the id and the shard count decide, nothing else.

The generator is Lehmer's (modulus 2**31 - 1), seeded from the MD5 of the
id's text, so plain SQL elsewhere can compute the same shards. A key jumps
about ln(n) times among n shards and at most n + 1 times. ``jumps(n)`` steps
are followed: all there can be up to 60 shards, and beyond that so many
that a key needs more with a probability below 1e-40.

Slots number a shard's rows from 0 without gaps, ordered by the hash of
the id, then the id, then the text's checksum. DataFrame operations only.

Defined results: a null id hashes as the text ``null``; a null text has
size 1 and no checksum; rows alike in every respect get different slots;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash32, running_start

MODULUS = 2_147_483_647
FACTOR = 48_271


def jumps(shards: int) -> int:
    """How many jumps are followed, the last one beyond the last shard."""
    return min(shards + 2, 40 + 4 * shards.bit_length())


def jump_shards(key_hash: Column, shards: int) -> tuple[Column, Column]:
    """The shard among ``shards`` and among one more, from a 32-bit hash of the key."""
    start = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("at"), (F.pmod(key_hash, F.lit(MODULUS - 1)) + 1).alias("x"))

    def jump(s: Column, _: Column) -> Column:
        inside = s["at"] <= shards
        x = F.pmod(s["x"] * FACTOR, F.lit(MODULUS))
        # the next jump: floor((at + 1) / u) with u = x / MODULUS
        to = F.floor(((s["at"] + 1) * MODULUS).cast("double") / x).cast("long")
        return F.struct(
            F.when(s["at"] < shards, s["at"]).otherwise(s["now"]).alias("now"),
            F.when(inside, s["at"]).otherwise(s["grown"]).alias("grown"),
            F.when(inside, to).otherwise(s["at"]).alias("at"),
            F.when(inside, x).otherwise(s["x"]).alias("x"),
        )

    last = F.aggregate(F.sequence(F.lit(1), F.lit(jumps(shards))), start, jump)
    return last["now"].cast("int"), last["grown"].cast("int")


def assign_shards(documents: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.col(text), "UTF-8")).alias("text_crc32"),
        hash32(F.col(doc_id), "shard").alias("_hash"),
        hash32(F.col(doc_id), "slot").alias("_place"),
    )
    rows = rows.withColumn("_jumps", F.struct(*(c.alias(n) for c, n in zip(jump_shards(F.col("_hash"), shards), ("now", "grown")))))
    rows = cut(rows.select("doc_id", "size", "text_crc32", "_place", F.col("_jumps.now").alias("shard"), F.col("_jumps.grown").alias("grown_shard")), "shards")
    # shards are of about equal size
    parts = math.isqrt(rows.count() // shards) + 1
    rows = running_start(rows.withColumn("part", F.expr(f"_place * {parts} div 4294967296")), "shard", "part", ["_place", "doc_id", "text_crc32"], F.lit(1).cast("long"), "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
