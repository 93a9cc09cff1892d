"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, line_dedup, media, mixing, near_dedup, quality, sharding, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).drop("first_slot")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir), shards=16)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_source_mix": op4_source_mix,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_media": op8_media,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_bpe": op10_bpe,
}

_OP4 = r"""
WITH sizes AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 8) AS BIGINT) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS source_no
  FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(source_no % 3) + 1] AS weight FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own_level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, cap, least(cap::DOUBLE, coalesce(
           (SELECT own_level FROM levels WHERE own_level * weight <= cap ORDER BY cap / weight, source_no LIMIT 1) * weight,
           cap::DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, least(floor(t.target + 0.5)::BIGINT, t.cap) AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, goal) - start)
          + greatest(0, least(source_size + start + size, goal) - source_size - start)
          + greatest(0, least(2 * source_size + start + size, goal) - 2 * source_size - start) AS BIGINT) AS taken
FROM placed
"""

_OP6 = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, text,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':shard'), 1, 8) AS BIGINT) % 2147483646 + 1 AS x,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':slot'), 1, 8) AS BIGINT) AS place
  FROM documents),
table0 AS (SELECT i AS crc, 0 AS step, i FROM range(256) t(i)
  UNION ALL
  SELECT CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1, i FROM table0 WHERE step < 8),
crcs AS (SELECT list(crc ORDER BY i) AS t FROM table0 WHERE step = 8),
jumps AS (
  SELECT doc_id, 0::BIGINT AS pos, x FROM rows
  UNION ALL
  SELECT doc_id, floor(((pos + 1) * 2147483647)::DOUBLE / (x * 48271 % 2147483647))::BIGINT, x * 48271 % 2147483647
  FROM jumps WHERE pos <= 16),
shards AS (
  SELECT doc_id, max(pos) FILTER (pos < 16)::INTEGER AS shard, max(pos) FILTER (pos <= 16)::INTEGER AS grown_shard
  FROM jumps GROUP BY doc_id),
summed AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM rows, crcs WHERE text IS NOT NULL)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id) - 1 AS slot, grown_shard
FROM rows JOIN shards USING (doc_id) LEFT JOIN summed USING (doc_id)
"""

_OP5 = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
clean AS (
  SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS words FROM raw),
numbered AS (
  SELECT doc_id, place, words, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS nr,
         count(*) OVER (PARTITION BY doc_id) AS n_lines
  FROM clean WHERE words <> ''),
windowed AS (
  SELECT doc_id, nr, array_to_string(list(words) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), chr(10)) AS win
  FROM numbered QUALIFY nr <= greatest(0, n_lines - 3)),
later AS (
  SELECT doc_id, nr FROM windowed
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, nr) > 1),
gone AS (
  SELECT DISTINCT n.doc_id, n.place FROM later l JOIN numbered n ON n.doc_id = l.doc_id AND n.nr BETWEEN l.nr AND l.nr + 2),
left_ AS (
  SELECT c.doc_id, coalesce(string_agg(c.line, chr(10) ORDER BY c.place) FILTER (g.place IS NULL), '') AS text,
         count(*) FILTER (c.words <> '') AS n_lines, count(g.place) AS n_removed
  FROM clean c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.place = c.place GROUP BY c.doc_id)
SELECT doc_id, n_lines::INTEGER AS n_lines, n_removed::INTEGER AS n_removed, text FROM left_
"""

ORACLE: dict[str, str] = {
    "op5_line_dedup": _OP5,
    "op4_source_mix": _OP4,
    "op6_sharding": _OP6,
    "op9_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
""",
}
