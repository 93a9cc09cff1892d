"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. Every source gets a target: its share by weight of all
words, stopped at ``epochs`` times its own size, with the excess shared
again by weight. A schedule of equal slots then interleaves the sources:
slot i stands at the point frac(i * golden ratio), held exactly as
i * 2654435769 mod 2**32, and belongs to the source whose stretch of the
cumulative targets holds the point. Slots are ranked per source, and the
r-th slot takes the r-th block of ``block_words`` words from the source's
documents in shuffled order, which are read round and round; the last
block stops at the target. Sources for which the schedule came out a slot
or two short get these slots at its end.

No step gathers a source: running sums and ranks go by stretches of about
sqrt(n) rows, points meet the sources by cells of the unit interval, and a
block has no more rows than words. DataFrame operations only; the sources
themselves (their names and sums) are sorted in one task. Each step is
written and read again, so that no plan holds more than one of them.

Defined results: a null text has size 0; a null source is a source of its
own, last in order; documents without words have taken 0, and so has a
source without words; equal rows are counted one by one; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut, drop_cut, field, flat, hash32, join_groups, nested, places_for, running_start

#: 2**32 divided by the golden ratio.
GOLDEN = 2_654_435_769
#: Cells of the unit interval by which points and sources meet.
CELL_BITS = 14
#: Words of a slot and of a block.
BLOCK_WORDS = 2048


def source_targets(rows: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """Per source: its number, size, target, the whole words that it gives, and into how many stretches its rows are cut."""
    everywhere = Window.partitionBy(F.lit(0))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.sqrt(F.count(F.lit(1)))).alias("parts"))
    sources = sources.withColumn("source_no", F.row_number().over(everywhere.orderBy(F.asc_nulls_last("source"))) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), F.pmod("source_no", F.lit(len(weights))).cast("int") + 1))
    sources = sources.withColumn("cap", F.col("source_size") * epochs)
    before = everywhere.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.select(
        "*",
        F.sum("source_size").over(everywhere).alias("all_words"),
        (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    sources = sources.withColumn("level", F.col("words_left") / F.col("weight_left"))
    # the first source, by cap over weight, that stays below its cap sets the level for all after it
    free = F.col("level") * F.col("weight") <= F.col("cap")
    sources = sources.withColumn("level", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(everywhere)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    sources = sources.withColumn("target", target)
    return sources.select("source", "source_no", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), F.col("cap")).alias("goal"), "parts")


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """The slots: source_no, rank in the source, and number in the schedule."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum(F.ceil(F.col("goal") / block_words)), F.lit(0)).alias("n")).first()["n"]
    everywhere = Window.partitionBy(F.lit(0))
    running = F.sum("goal").over(everywhere.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    stretches = sources.filter("goal > 0").select("source_no", "goal", running.alias("_to"), F.sum("goal").over(everywhere).alias("_all"))
    edge = lambda c: F.floor(c.cast("double") / F.col("_all") * 4294967296.0)
    stretches = cut(stretches.select("source_no", F.ceil(F.col("goal") / block_words).alias("needed"), edge(F.col("_to") - F.col("goal")).alias("lo"), edge(F.col("_to")).alias("hi")), "stretches")
    cells = stretches.filter("hi > lo").select("source_no", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 32 - CELL_BITS), F.shiftright(F.col("hi") - 1, 32 - CELL_BITS))).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"pmod(pmod(id, 4294967296) * {GOLDEN}, 4294967296)").alias("point"))
    points = points.withColumn("cell", F.shiftright("point", 32 - CELL_BITS))
    part = F.expr(f"slot div {math.isqrt(total) + 1}").alias("part")
    slots = cut(points.join(cells, "cell").filter("point >= lo AND point < hi").select("slot", "source_no", part), "points")
    ranked = running_start(slots, "source_no", "part", ["slot"], F.lit(1).cast("long"), "rank").select("source_no", "rank", "slot")
    got = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("got"))
    short = stretches.join(got, "source_no", "left").select("source_no", "needed", F.coalesce("got", F.lit(0)).alias("got")).filter("got < needed")
    late = short.select("source_no", F.explode(F.sequence(F.col("got"), F.col("needed") - 1)).alias("rank")).withColumn("slot", F.lit(total) + F.col("rank"))
    ready = cut(ranked.unionByName(late), "schedule")
    drop_cut(stretches, slots)
    return ready


def mix_sources(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3, text: str = "text", source: str = "source", doc_id: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot."""
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long").alias("size"),
        hash32(F.col(doc_id), "mix").alias("_place"),
    )
    rows = cut(rows, "sizes")
    sources = cut(source_targets(rows, weights, epochs), "sources")
    dealt = join_groups(rows, sources, "source", "_place", places_for(rows, rows.count()))
    dealt = cut(dealt.select("doc_id", "size", "_place", "source_no", "source_size", "target", "goal", F.expr("_place * parts div 4294967296").alias("part")), "dealt")
    placed = cut(running_start(dealt, "source_no", "part", ["_place", "doc_id", "size"], F.col("size"), "start").drop("_place", "part"), "placed")
    slots = schedule(sources, block_words)
    drop_cut(rows, sources, dealt)
    rounds = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("goal") - F.col("start") - 1) / F.col("source_size"))))
    copies = placed.filter("size > 0").withColumn("_round", F.explode(rounds)).withColumn("_from", F.col("_round") * F.col("source_size") + F.col("start"))
    blocks = copies.withColumn("rank", F.explode(F.sequence(F.expr(f"_from div {block_words}"), F.expr(f"(_from + size - 1) div {block_words}"))))
    taken = blocks.join(slots.hint("merge"), ["source_no", "rank"], "left")
    upto = F.least(F.col("_from") + F.col("size"), (F.col("rank") + 1) * block_words, F.col("goal"))
    words = F.when(F.col("slot").isNull(), 0).otherwise(F.greatest(F.lit(0).cast("long"), upto - F.greatest("_from", F.col("rank") * block_words)))
    taken = taken.withColumn("words", words)
    keys = ["source_no", "start", "doc_id", "size", "source_size", "target"]
    some = taken.groupBy(*keys).agg(F.sum("words").cast("long").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"))
    none = placed.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def apply_mix(documents: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **settings: object) -> DataFrame:
    """The documents as the mix takes them: each as often as its words are taken, rounded up.

    Documents of which nothing is taken go, but those without words stay.
    Rows that share an id are repeated as often as the most-taken of them.
    """
    taken = mix_sources(documents, text=text, source=source, doc_id=doc_id, **settings)  # type: ignore[arg-type]
    times = F.max(F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size")))).cast("int").alias("times")
    times = taken.groupBy("doc_id").agg(times).filter("times > 0")
    mixed = nested(documents).join(times, field(doc_id).eqNullSafe(times["doc_id"]))
    return flat(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))), documents.columns)
