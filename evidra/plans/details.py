"""Queries over facts, evidence, spans and rendered answers, whose SQL takes recursion or much text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..functions import text, udfs
from ..operators import critic, matching, synthesis
from .base import register, relation, table, with_inputs
from .verification import ENTITIES, NUMERIC, classified_frames, gap_frame, verdict_frame

# --- Facts and evidence ---------------------------------------------------


#: Numbers with nouns, then dates, then names of a text, before those within others go.
_SPLIT = r"""list_concat(regexp_extract_all(text, '\b\d{1,4}\s+[a-zA-Z]{3,}\b'), regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'), regexp_extract_all(text, '\b[A-Z][a-z]{2,}(?:\s+[A-Za-z]{3,}){1,3}\b'))"""


@register(
    "extract_facts",
    with_inputs(
        f"""WITH found AS (SELECT doc_id, {_SPLIT} AS every FROM fact_texts),
        kept AS (SELECT doc_id, list_filter(every, lambda f, i: list_position(every, f) = i AND len(list_filter(every, lambda g: g <> f AND contains(g, f))) = 0)[1:8] AS facts FROM found)
        SELECT doc_id, (unnest(range(len(facts))))::INTEGER AS fact_no, unnest(facts) AS fact FROM kept""",
        "fact_texts",
    ),
)
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "fact_texts")
    return rows.select("doc_id", F.posexplode(udfs.facts_of(F.col("text"), F.lit(""), F.lit(8))).alias("fact_no", "fact"))


@register(
    "facts_in_sql",
    with_inputs(
        f"""WITH found AS (SELECT doc_id, {_SPLIT} AS every FROM fact_texts), kept AS (SELECT doc_id, list_filter(every, lambda f, i: list_position(every, f) = i AND len(list_filter(every, lambda g: g <> f AND contains(g, f))) = 0)[1:3] AS facts FROM found)
        SELECT doc_id, (unnest(range(len(facts))))::INTEGER AS fact_no, unnest(facts) AS fact, 'KEY_TOKEN=...' || right('0000' || doc_id, 4) AS clean FROM kept""",
        "fact_texts",
    ),
)
def facts_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions by name in SQL: the first three facts of a text by a table function, and a redacted line."""
    sql_functions.register(spark)
    relation(spark, sf_dir, "fact_texts").createOrReplaceTempView("fact_texts")
    return spark.sql("SELECT doc_id, fact_no, fact, evidra_redact(concat('KEY_TOKEN=abc', lpad(doc_id, 9, '0'))) AS clean FROM fact_texts, LATERAL evidra_facts(text, '', 3)")


CLAIM = "the edition of another thing"
#: Evidence windows of ``CLAIM``: a recursion takes the places of its words from left to right and keeps sums, numbers and words of the groups in lists.
_WINDOWS = r"""terms(nr, term) AS (VALUES (1, 'the'), (2, 'edition'), (3, 'another'), (4, 'thing')),
  docs AS (SELECT doc_id, text, length(text) AS size FROM documents WHERE coalesce(text, '') <> ''),
  parts AS (SELECT doc_id, nr, term, unnest(string_split(lower(text), term)) AS p, generate_subscripts(string_split(lower(text), term), 1) AS k, len(string_split(lower(text), term)) AS n FROM docs, terms),
  found AS (SELECT doc_id, nr, k, n, sum(length(p)) OVER (PARTITION BY doc_id, nr ORDER BY k) + (k - 1) * length(term) AS pos FROM parts),
  places AS (SELECT doc_id, nr, pos::DOUBLE AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos, nr) AS i FROM found WHERE k < n),
  walk AS (
    SELECT doc_id, 0::BIGINT AS i, []::DOUBLE[] AS sums, []::DOUBLE[] AS counts, []::INTEGER[] AS words FROM docs
    UNION ALL
    SELECT doc_id, i, CASE WHEN home > 0 THEN list_transform(sums, lambda s, k: CASE WHEN k = home THEN s + pos ELSE s END) ELSE list_append(sums, pos) END,
      CASE WHEN home > 0 THEN list_transform(counts, lambda c, k: CASE WHEN k = home THEN c + 1 ELSE c END) ELSE list_append(counts, 1.0::DOUBLE) END,
      CASE WHEN home > 0 THEN list_transform(words, lambda w, k: CASE WHEN k = home THEN w | (1 << (nr - 1))::INTEGER ELSE w END) ELSE list_append(words, (1 << (nr - 1))::INTEGER) END
    FROM (SELECT w.doc_id, p.i, p.pos, p.nr, w.sums, w.counts, w.words, coalesce(list_position(list_transform(w.sums, lambda s, k: abs(p.pos - s / w.counts[k]) <= 300), true), 0) AS home FROM walk w JOIN places p ON p.doc_id = w.doc_id AND p.i = w.i + 1) x),
  ends AS (SELECT doc_id, arg_max(sums, i) AS sums, arg_max(counts, i) AS counts, arg_max(words, i) AS words FROM walk GROUP BY doc_id),
  groups AS (SELECT doc_id, unnest(list_transform(sums, lambda s, k: s / counts[k])) AS centre, unnest(words) AS mask FROM ends),
  ranked AS (SELECT doc_id, floor(centre)::BIGINT AS c, mask, bit_count(mask) / 4.0 AS score, row_number() OVER (PARTITION BY doc_id ORDER BY bit_count(mask) DESC, centre) AS nr FROM groups),
  raw AS (SELECT d.doc_id, d.text, d.size, coalesce(r.nr, 1) AS nr, coalesce(r.mask, 0) AS mask, coalesce(r.score, 0) AS score, greatest(0, coalesce(r.c - 300, 0)) AS s, least(d.size, coalesce(r.c + 300, 300)) AS e FROM docs d LEFT JOIN ranked r USING (doc_id) WHERE coalesce(r.nr, 1) <= 3),
  cuts AS (SELECT *, regexp_extract(substr(text, s + 1, 30), '^\S*\s') AS head, regexp_extract(substr(text, greatest(0, e - 30) + 1, e - greatest(0, e - 30)), '\s\S*$') AS tail FROM raw),
  windows AS (SELECT doc_id, nr - 1 AS nr, text, size, mask, score, (CASE WHEN s > 0 THEN s + length(head) ELSE 0 END)::INTEGER AS s, (CASE WHEN e < size THEN e - length(tail) ELSE e END)::INTEGER AS e FROM cuts),
  shown AS (SELECT *, CASE WHEN s > 0 THEN '...' ELSE '' END || regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') || CASE WHEN e < size THEN '...' ELSE '' END AS body FROM windows)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(udfs.windows_of(F.col("text"), F.lit(CLAIM))).alias("nr", "w"))


@register(
    "evidence_windows",
    f"""WITH RECURSIVE {_WINDOWS} SELECT doc_id, nr::INTEGER AS nr, s AS start, e AS "end", round(score, 6)::DOUBLE AS score,
      array_to_string(list_filter(['another', 'edition', 'the', 'thing'], lambda t: (mask & CASE t WHEN 'the' THEN 1 WHEN 'edition' THEN 2 WHEN 'another' THEN 4 ELSE 8 END) > 0), ' ') AS terms FROM shown""",
)
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", "nr", "w.start", "w.end", F.round("w.score", 6).alias("score"), F.array_join("w.terms", " ").alias("terms"))


@register(
    "evidence_blob",
    f"""WITH RECURSIVE {_WINDOWS}, running AS (SELECT doc_id, nr, body, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY nr) AS total FROM shown)
      SELECT doc_id, string_agg(body, chr(10) ORDER BY nr) AS blob FROM running WHERE total <= 1500 GROUP BY 1""",
)
def evidence_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.prefix_within(_windows(spark, sf_dir).select("doc_id", "nr", "w.text"), ["doc_id"], "nr")


#: Matches by the cascade. The longest common subsequence is a recursion over the characters of a stretch: each step is a running maximum over the fact's characters.
_FUZZY = rf"""staged AS (SELECT fact_no, fact, lower(text) AS text, CASE WHEN contains(lower(text), fact) THEN 'exact' ELSE {NUMERIC} END AS method FROM fact_pairs),
  open_ AS (SELECT DISTINCT fact, text FROM staged WHERE method IS NULL),
  stretches AS (SELECT fact, text, unnest(list_transform(range(0, greatest(1, length(text) - 20), 10), lambda i: substr(text, (i + 1)::INTEGER, 20))) AS stretch FROM open_),
  pairs AS (SELECT DISTINCT fact, stretch, array_to_string(list_sort(string_split(fact, ' ')), ' ') AS a, array_to_string(list_sort(list_filter(regexp_split_to_array(stretch, '\s+'), lambda w: w <> '')), ' ') AS b FROM stretches),
  steps AS (
    SELECT fact, stretch, a, b, 0 AS i, list_transform(range(length(a)), lambda j: 0::BIGINT) AS best FROM pairs
    UNION ALL
    SELECT fact, stretch, a, b, i + 1, list_transform(range(1, length(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN substr(a, k::INTEGER, 1) = substr(b, i + 1, 1) THEN coalesce(best[k - 1], 0) + 1 ELSE best[k] END))) FROM steps WHERE i < length(b)),
  ratios AS (SELECT fact, stretch, 200.0 * best[-1] / (length(a) + length(b)) AS ratio FROM steps WHERE i = length(b)),
  bests AS (SELECT s.fact, s.text, max(ratio) AS ratio FROM stretches s JOIN ratios r USING (fact, stretch) GROUP BY 1, 2)"""


@register(
    "fuzzy_match",
    with_inputs(
        f"""WITH RECURSIVE {_FUZZY} SELECT fact_no, method IS NOT NULL OR coalesce(ratio >= 75, false) AS matched, CASE WHEN method IS NULL AND ratio >= 75 THEN 'fuzzy' ELSE method END AS method,
        round(CASE method WHEN 'exact' THEN 100.0 WHEN 'num_morph' THEN 90.0 WHEN 'num_mismatch' THEN 85.0 ELSE ratio END, 4)::DOUBLE AS score FROM staged LEFT JOIN bests USING (fact, text)""",
        "fact_pairs",
    ).replace("WITH fact_pairs", "WITH RECURSIVE fact_pairs").replace(", RECURSIVE staged", ", staged"),
)
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.match_facts(relation(spark, sf_dir, "fact_pairs"))
    return rows.select("fact_no", "matched", "method", F.round("score", 4).alias("score"))


# --- Spans ----------------------------------------------------------------

#: Where a claim stands: literally, or up to white space, or by its first 30 characters and then as long as the claim.
_SPANS = r"""found AS (SELECT *, strpos(text, claim) - 1 AS direct, regexp_extract(text, replace(claim, ' ', '\s+')) AS loose, regexp_extract(text, replace(substr(claim, 1, 30), ' ', '\s+')) AS head FROM span_pairs),
  spans AS (SELECT *, (CASE WHEN direct >= 0 THEN direct WHEN loose <> '' THEN strpos(text, loose) - 1 WHEN head <> '' THEN strpos(text, head) - 1 ELSE -1 END)::INTEGER AS s,
    (CASE WHEN direct >= 0 THEN direct + length(claim) WHEN loose <> '' THEN strpos(text, loose) - 1 + length(loose) WHEN head <> '' THEN strpos(text, head) - 1 + length(claim) ELSE -1 END)::INTEGER AS e FROM found)"""


@register("claim_spans", with_inputs(f"WITH {_SPANS} SELECT fact_no, s AS span_start, e AS span_end, CASE WHEN s >= 0 THEN '[doc_0:' || s || '-' || e || ']' END AS marker FROM spans", "span_pairs"))
def claim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "span_pairs").withColumn("s", udfs.span_of(F.col("claim"), F.col("text")))
    return rows.select("fact_no", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), synthesis.span_marker(F.lit(0), F.col("s.start"), F.col("s.end")).alias("marker"))


@register(
    "claim_windows",
    with_inputs(
        f"""WITH {_SPANS} SELECT fact_no, s AS offset_start, e AS offset_end, CASE WHEN e <= length(text) THEN substr(text, s + 1, CASE WHEN direct < 0 AND loose <> '' THEN e - s ELSE length(claim) END) ELSE claim END AS shown, url AS source_url, title AS source_title
        FROM spans WHERE s >= 0""",
        "span_pairs",
    ),
)
def claim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "span_pairs")
    found = matching.claim_windows(rows.select("fact_no", "claim"), rows.select("fact_no", "url", "title", "text"), ["fact_no"])
    return found.withColumnRenamed("window", "shown").drop("claim", "score")


# --- Rendered answers -----------------------------------------------------

#: Facts with the marks of their sources, all and supporting ones.
_FACTS = """links AS (SELECT query_id, fact_no, 's' AS side, 'https://s.example.com/' || ((fact_no + i) % 60) AS url FROM verdict_rows, range(1, 4) t(i) WHERE i <= n_support
    UNION ALL SELECT query_id, fact_no, 'r', 'https://r.example.com/' || ((fact_no + i) % 60) FROM verdict_rows, range(1, 4) t(i) WHERE i <= n_refute
    UNION ALL SELECT query_id, fact_no, 'm', 'https://m.example.com/' || ((fact_no + i) % 60) FROM verdict_rows, range(1, 4) t(i) WHERE i <= n_mismatch),
  cited AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY url) AS id FROM (SELECT DISTINCT query_id, url FROM links)),
  numbered AS (SELECT query_id, fact_no, list_sort(list(DISTINCT id)) AS every, list_sort(coalesce(list(DISTINCT id) FILTER (side = 's'), [])) AS own FROM links JOIN cited USING (query_id, url) GROUP BY 1, 2),
  facts AS (SELECT v.*, coalesce(array_to_string(list_transform(every, lambda i: '[' || i || ']'), ''), '') AS all_marks, coalesce(array_to_string(list_transform(own, lambda i: '[' || i || ']'), ''), '') AS own_marks FROM verdict_rows v LEFT JOIN numbered USING (query_id, fact_no))"""


def _section(heading: str, lines: str) -> str:
    return f"chr(10) || '## {heading}' || chr(10) || chr(10) || CASE WHEN len({lines}) > 0 THEN array_to_string({lines}, chr(10)) ELSE '_нет_' END || chr(10)"


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id").distinct().withColumn("query", F.format_string("What about customer %d?", "query_id"))


@register(
    "answer_markdown",
    with_inputs(
        rf"""WITH {_FACTS}, lines AS (SELECT query_id, fact_no, CASE verdict WHEN 'SUPPORTS' THEN 'confirmed' WHEN 'INSUFFICIENT' THEN 'open' ELSE 'contested' END AS bucket,
          '- ' || fact || CASE verdict WHEN 'SUPPORTS' THEN ' ' || own_marks WHEN 'INSUFFICIENT' THEN ' — _не удалось проверить_' ELSE ' — _' || CASE verdict WHEN 'REFUTES' THEN 'опровергнуто' WHEN 'CONFLICTING' THEN 'противоречие' ELSE 'числовое расхождение' END || '_ ' || all_marks END AS line FROM facts),
        lists AS (SELECT query_id, coalesce(list(line ORDER BY fact_no) FILTER (bucket = 'confirmed'), []) AS yes, coalesce(list(line ORDER BY fact_no) FILTER (bucket = 'contested'), []) AS no_, coalesce(list(line ORDER BY fact_no) FILTER (bucket = 'open'), []) AS open_, count(*) AS total FROM lines GROUP BY 1),
        sources AS (SELECT query_id, list('- [' || id || '] [' || replace(url, '.', '\.') || '](' || url || ')' ORDER BY id) AS listed FROM cited GROUP BY 1),
        whole AS (SELECT query_id, '## Краткий ответ' || chr(10) || chr(10) || 'Вопрос: _What about customer ' || query_id || '?_.' || chr(10) || chr(10) || 'Покрытие: **' || len(yes) || '/' || total || '** утверждений подтверждено'
          || CASE WHEN len(open_) > 0 THEN ' (не проверено ' || len(open_) || '/' || total || ')' ELSE '' END || CASE WHEN len(no_) > 0 THEN ', противоречий ' || len(no_) ELSE '' END || '.' || chr(10) || chr(10)
          || {_section("Подтверждено источниками", "yes")} || chr(10) || {_section("Слабые или неподтверждённые сигналы", "[]")} || chr(10) || {_section("Противоречия / расхождения", "no_")} || chr(10) || {_section("Что не удалось проверить", "open_")} || chr(10)
          || {_section("Источники", "coalesce(listed, [])")} AS md FROM lists LEFT JOIN sources USING (query_id))
        SELECT query_id, CASE WHEN length(md) > 60000 THEN substr(md, 1, 60000) || chr(10) || chr(10) || '_… truncated для безопасности._' ELSE md END AS answer_markdown FROM whole""",
        "verdict_rows",
    ),
)
def answer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited, rows = classified_frames(spark, sf_dir)
    return synthesis.render_answer(_asked(rows), rows, cited)


@register(
    "audit_markdown",
    with_inputs(
        f"""WITH {_FACTS}, lines AS (SELECT query_id, fact_no, chr(10) || '### ' || fact_no || '. ' || fact || chr(10) || '**Вердикт:** ' || CASE verdict WHEN 'SUPPORTS' THEN '✅ Подтверждено' WHEN 'REFUTES' THEN '❌ Опровергнуто' WHEN 'INSUFFICIENT' THEN '⚠️ Недостаточно данных'
          WHEN 'CONFLICTING' THEN '⚡ Противоречие' ELSE '🔢 Числовое расхождение' END || CASE WHEN all_marks <> '' THEN ' ' || all_marks ELSE '' END || chr(10) AS line FROM facts)
        SELECT query_id, substr('## Ответ' || chr(10) || chr(10) || 'What about customer ' || query_id || '?' || chr(10) || chr(10) || '## Детали по утверждениям' || chr(10) || string_agg(line, '' ORDER BY fact_no), 1, 60000) AS audit_markdown FROM lines GROUP BY query_id""",
        "verdict_rows",
    ),
)
def audit_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified_frames(spark, sf_dir)[1]
    return synthesis.render_audit(_asked(rows), rows)


# --- Critic and gaps ------------------------------------------------------


@register(
    "entity_hallucination",
    with_inputs(
        rf"""WITH known AS (SELECT DISTINCT query_id, lower(unnest({ENTITIES.format('text')})) AS entity FROM claim_sources), named AS (SELECT query_id, claim_no, claim, regexp_extract_all(claim, '\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){{0,3}})\b') AS names FROM claims),
        each AS (SELECT query_id, claim_no, claim, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM named), once AS (SELECT query_id, claim_no, claim, name, min(pos) AS pos FROM each GROUP BY ALL),
        loose AS (SELECT query_id, claim_no, claim, list(name ORDER BY pos) AS names FROM once o WHERE EXISTS (SELECT 1 FROM known k WHERE k.query_id = o.query_id) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = o.query_id AND k.entity = lower(o.name)) GROUP BY 1, 2, 3),
        nth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(claim_no AS VARCHAR) COLLATE "binary", claim) AS n FROM loose)
        SELECT query_id, CASE WHEN regexp_matches(claim, '\[\d{{1,3}}\]') THEN 'high' ELSE 'medium' END AS severity, 'entity_hallucination' AS category,
          'Entity not grounded in any source: [' || chr(39) || array_to_string(names[1:5], chr(39) || ', ' || chr(39)) || chr(39) || ']' || CASE WHEN len(names) > 5 THEN '…' ELSE '' END AS message, substr(claim, 1, 120) AS claim FROM nth WHERE n <= 20""",
        "claims", "claim_sources",
    ),
)
def entity_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critic.entity_hallucination(relation(spark, sf_dir, "claims"), relation(spark, sf_dir, "claim_sources"))


_ANSWERS = "SELECT c_custkey AS query_id, 'As [1] and [' || CAST(c_custkey % 9 + 1 AS VARCHAR(9)) || '] tell, see https://s.example.com/' || CAST(c_custkey % 4 AS VARCHAR(9)) || ', and (https://t.example.com/' || CAST(c_custkey % 3 AS VARCHAR(9)) || ').' AS answer_markdown FROM customer"
_TABLE = "SELECT c_custkey AS query_id, c.id AS id, CASE WHEN c.id = 3 AND c_custkey % 5 = 0 THEN '?' ELSE 'https://s.example.com/' || CAST(c.id AS VARCHAR(9)) END AS url FROM customer, (SELECT 1 AS id UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c WHERE c.id <= c_custkey % 4 + 1"


@register(
    "citation_integrity",
    rf"""WITH answers AS ({_ANSWERS}), cited AS ({_TABLE}), valid AS (SELECT query_id, list_sort(list(id)) AS ids, list(url) AS urls FROM cited GROUP BY 1),
      marks AS (SELECT query_id, ids, unnest(regexp_extract_all(answer_markdown, '\[(\d{{1,3}})\]', 1))::INTEGER AS mark FROM answers JOIN valid USING (query_id)),
      links AS (SELECT query_id, urls, rtrim(unnest(regexp_extract_all(answer_markdown, 'https?://[^\s\)\]"<>]+')), '.,;:!?)') AS link FROM answers JOIN valid USING (query_id))
      SELECT query_id, 'high' AS severity, 'citation_integrity' AS category, 'Unknown citation id: [' || mark || '] (valid: [' || array_to_string(ids, ', ') || '])' AS message, '' AS claim FROM marks WHERE NOT list_contains(ids, mark)
      UNION ALL SELECT query_id, 'medium', 'citation_integrity', 'Citation [' || id || '] has empty URL', '' FROM cited WHERE url = '?'
      UNION ALL SELECT query_id, 'high', 'citation_integrity', 'URL in markdown not in citation table: ' || link, '' FROM links WHERE NOT list_contains(urls, link)""",
)
def citation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return critic.citation_integrity(spark.sql(_ANSWERS), spark.sql(_TABLE))


@register(
    "gap_details",
    with_inputs(
        r"""WITH q AS (SELECT DISTINCT query_id FROM claims), docs AS (SELECT * FROM claim_sources WHERE text LIKE 'In 2%'), d AS (SELECT query_id, count(*) AS documents, count(DISTINCT url) AS domains FROM docs GROUP BY 1),
        v AS (SELECT query_id, count_if(verdict = 'SUPPORTS') / count(*) < 0.2 AS conflict FROM verdict_rows GROUP BY 1),
        heads AS (SELECT query_id, lower(substr(fact, 1, 50)) AS head, bool_or(verdict = 'SUPPORTS') AS yes FROM verdict_rows GROUP BY 1, 2),
        judged AS (SELECT c.query_id, v.query_id IS NOT NULL AS judged, CASE WHEN v.query_id IS NOT NULL THEN coalesce(h.yes, false) ELSE EXISTS (SELECT 1 FROM docs t WHERE t.query_id = c.query_id AND contains(lower(t.text), lower(substr(c.claim, 1, 50)))) END AS fine
          FROM claims c LEFT JOIN v USING (query_id) LEFT JOIN heads h ON h.query_id = c.query_id AND h.head = lower(substr(c.claim, 1, 50))),
        c AS (SELECT query_id, count(*) AS claims, count_if(NOT fine) AS loose, bool_or(judged) AS judged FROM judged GROUP BY 1),
        s AS (SELECT q.query_id, coalesce(documents, 0) AS documents, coalesce(domains, 0) AS domains, claims, loose, judged, coalesce(conflict, false) AS conflict FROM q LEFT JOIN d USING (query_id) LEFT JOIN v USING (query_id) LEFT JOIN c USING (query_id))
        SELECT query_id, 'too_few_sources' AS kind, 'only ' || documents || ' documents fetched (min 3)' AS detail FROM s WHERE documents < 3
        UNION ALL SELECT query_id, 'no_search_results', 'web_search returned 0 hits for all tasks' FROM s WHERE documents = 0
        UNION ALL SELECT query_id, 'low_source_diversity', 'only ' || domains || ' unique domain(s) (min 2)' FROM s WHERE documents > 0 AND domains < 2
        UNION ALL SELECT query_id, 'too_many_unsupported_claims', loose || '/' || claims || ' claims (' || round(100.0 * loose / claims)::INTEGER || '%) unsupported (max 40%, source=' || CASE WHEN judged THEN 'verdicts' ELSE 'substring_fallback' END || ')' FROM s WHERE loose / claims > 0.4
        UNION ALL SELECT query_id, 'contradictions_unresolved', 'verification found conflicting sources that weren''t reconciled' FROM s WHERE conflict
        UNION ALL SELECT query_id, 'low_confidence', 'top-1 source_score=0.25 (min 0.5)' FROM s WHERE documents > 0""",
        "claims", "claim_sources", "verdict_rows",
    ),
)
def gap_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_frame(spark, sf_dir)


# --- Text helpers ---------------------------------------------------------

_LONG_NAME = "p_name || ' #' || CAST(p_partkey AS VARCHAR(9)) || ' *' || p_brand || '* [' || p_type || '] (x)! a+b-c <d> {e} | `f`'"


@register(
    "text_helpers",
    rf"""WITH t AS (SELECT p_partkey, {_LONG_NAME} AS c FROM part), h AS (SELECT *, substr(c, 1, 29) AS head FROM t)
      SELECT p_partkey, CASE WHEN length(c) <= 30 THEN c ELSE CASE WHEN contains(head, ' ') THEN substr(head, 1, length(head) - strpos(reverse(head), ' ')) ELSE head END || '…' END AS shown,
        regexp_replace(c, '([\\`*_{{}}\[\]()#+\-.!|<>])', '\\\1', 'g') AS escaped, trim(substr(replace(c, '#', ''), 1, 25)) AS clean, trim(c) AS first_one FROM h""",
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("c", F.expr(_LONG_NAME))
    control = F.replace(F.col("c"), F.lit("#"), F.lit("\x01\x0b\x7f"))
    first = text.first_text(F.lit("  "), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("c"), F.lit(" ")), F.lit("later"))
    return rows.select("p_partkey", text.shortened(F.col("c"), 30).alias("shown"), text.markdown_escape(F.col("c")).alias("escaped"), text.sanitized(control, 25).alias("clean"), first.alias("first_one"))


@register("flattened_details", with_inputs("SELECT query_id, fact_no::INTEGER AS fact_no, fact, verdict FROM (SELECT query_id, fact, verdict, row_number() OVER (PARTITION BY query_id ORDER BY fact_no) - 1 AS fact_no FROM verdict_rows) WHERE verdict <> 'INSUFFICIENT'", "verdict_rows"))
def flattened_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per question taken apart; the details of facts without evidence are null and give no row."""
    entry = F.when(F.col("verdict") != "INSUFFICIENT", F.struct("fact", "verdict"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("fact_no", entry.alias("d")))), lambda s: s["d"])
    results = verdict_frame(spark, sf_dir).groupBy("query_id").agg(listed.alias("verification_details"))
    return matching.flatten_details(results)
