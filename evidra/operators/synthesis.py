"""Verdicts become coverage, contradictions, citations and the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text, urls
from . import ranking

PREVIEW = 200
CITATIONS = 50
QUESTIONS = 20
MOST_MARKDOWN = 60_000
CONFLICTS = ["CONFLICTING", "NUMERIC_MISMATCH"]


def citation_table(sources: DataFrame, key: str = "query_id") -> DataFrame:
    """Numbered citations of the first 50 distinct sources: id, url, title, quote."""
    first = ranking.rank_within(ranking.first_per_url(sources, key), key, [F.asc("seq")], "id").filter(F.col("id") <= CITATIONS)
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit("?"))
    quote = text.shortened(text.first_text(*(F.col(c) for c in ("snippet", "quote", "text") if c in sources.columns)), PREVIEW)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), urls.url_title(url))
    return first.select(key, "id", url.alias("url"), title.alias("title"), quote.alias("quote"), (F.col("id") - 1).alias("source_index"))


def coverage(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Supported facts, half of the contested ones, and their share."""
    yes, half = F.count_if(F.col("verdict") == "SUPPORTS"), F.count_if(F.col("verdict").isin(CONFLICTS))
    return verdicts.groupBy(key).agg(yes.alias("supported"), half.alias("partial"), F.count(F.lit(1)).alias("total"), F.round((yes + 0.5 * half) / F.count(F.lit(1)), 4).alias("score"))


def unsupported(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Facts that are not supported, with the reason."""
    rows = verdicts.filter(F.coalesce("verdict", F.lit("")) != "SUPPORTS")
    return rows.select(key, "fact_no", text.shortened(F.col("fact"), PREVIEW).alias("claim"), F.coalesce("verdict", F.lit("INSUFFICIENT")).alias("reason"))


def sides(verdict: Column) -> Column:
    """The URLs that stand behind a verdict, distinct, in order."""
    supports = F.transform("supporting_sources", lambda s: s["url"])
    mismatch = F.transform("numeric_mismatch_sources", lambda s: s["url"])
    return F.when(verdict == "REFUTES", F.col("refuting_sources")).when(verdict == "NUMERIC_MISMATCH", mismatch).otherwise(F.array_distinct(F.concat(supports, F.col("refuting_sources"), mismatch)))


def contradictions(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Contested facts with the URLs of their sides."""
    rows = verdicts.filter(F.col("verdict").isin("REFUTES", *CONFLICTS))
    return rows.select(key, "fact_no", text.shortened(F.col("fact"), PREVIEW).alias("fact"), F.col("verdict").alias("type"), sides(F.col("verdict")).alias("urls"))


def open_questions(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Up to 20 facts that are disputed or lack sources."""
    rows = verdicts.filter((F.coalesce("verdict", F.lit("INSUFFICIENT")).isin("INSUFFICIENT", "REFUTES")) & (F.coalesce("fact", F.lit("")) != ""))
    shown = F.concat(F.when(F.col("verdict") == "REFUTES", "Оспаривается: ").otherwise("Не подтверждено: "), text.shortened(F.col("fact"), PREVIEW))
    return ranking.top_n(rows.select(key, "fact_no", shown.alias("question")), key, [F.asc("fact_no")], QUESTIONS)


def markers(links: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    """``[1][3]`` for the URLs (keys, url) that are citations of the same question."""
    known = citations.filter("url <> '?'").select(keys[0], "url", "id")
    ids = F.array_sort(F.collect_set("id"))
    return links.join(known, [keys[0], "url"]).groupBy(*keys).agg(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "").alias("markers"))


def span_marker(document: Column, start: Column, end: Column) -> Column:
    """``[doc_i:start-end]``; null where there is no document or no span."""
    return F.when(document.isNotNull() & (start >= 0) & (end > start), F.format_string("[doc_%d:%d-%d]", document, start, end))


def bucket(verdict: Column, cited: Column) -> Column:
    """Where a claim goes in the answer."""
    return F.when(verdict.isin("REFUTES", *CONFLICTS), "contradiction").when(verdict == "WEAK_SUPPORT", "weak").when(verdict == "SUPPORTS", F.when(cited, "confirmed").otherwise("weak")).otherwise("unverifiable")


def classified(verdicts: DataFrame, citations: DataFrame, key: str = "query_id") -> DataFrame:
    """Verdicts with bucket, markers of support and markers of all sides."""
    all_urls = F.array_distinct(F.concat(F.transform("supporting_sources", lambda s: s["url"]), F.col("refuting_sources"), F.transform("numeric_mismatch_sources", lambda s: s["url"])))
    support = verdicts.select(key, "fact_no", F.explode(F.transform("supporting_sources", lambda s: s["url"])).alias("url"))
    every = verdicts.select(key, "fact_no", F.explode(all_urls).alias("url"))
    keys = [key, "fact_no"]
    rows = verdicts.join(markers(support, citations, keys).withColumnRenamed("markers", "support_markers"), keys, "left").join(markers(every, citations, keys).withColumnRenamed("markers", "all_markers"), keys, "left")
    rows = rows.fillna("", ["support_markers", "all_markers"])
    return rows.withColumn("bucket", bucket(F.col("verdict"), F.col("support_markers") != ""))


def bucket_counts(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Claims per bucket."""
    return rows.groupBy(key).pivot("bucket", ["confirmed", "weak", "contradiction", "unverifiable"]).count().fillna(0)


_LABELS = {"REFUTES": "опровергнуто", "CONFLICTING": "противоречие", "NUMERIC_MISMATCH": "числовое расхождение"}
_SECTIONS = [("confirmed", "Подтверждено источниками"), ("weak", "Слабые или неподтверждённые сигналы"), ("contradiction", "Противоречия / расхождения"), ("unverifiable", "Что не удалось проверить")]


def render_answer(questions: DataFrame, rows: DataFrame, citations: DataFrame, key: str = "query_id") -> DataFrame:
    """The answer as Markdown: a summary, four lists and the sources; empty ones say so.

    ``rows`` is what ``classified`` gives, with optional columns
    ``span_marker`` and ``contradiction_marker``.
    """
    for extra in ("span_marker", "contradiction_marker"):
        if extra not in rows.columns:
            rows = rows.withColumn(extra, F.lit(None).cast("string"))
    claim = text.markdown_escape(text.shortened(F.col("fact"), PREVIEW))
    label = F.when(F.lit(False), F.lit(""))
    for verdict, word in _LABELS.items():
        label = label.when(F.col("verdict") == verdict, word)
    ending = F.when(F.col("verdict") == "WEAK_SUPPORT", " — _слабый сигнал, не подтверждено источниками_").otherwise(" — _не подтверждено источниками_")
    with_span = lambda body, marks, span: F.concat_ws(" ", body, F.nullif(marks, F.lit("")), F.when(marks != "", span))
    line = (
        F.when(F.col("bucket") == "confirmed", with_span(claim, F.col("support_markers"), F.col("span_marker")))
        .when(F.col("bucket") == "weak", F.concat(claim, ending))
        .when(F.col("bucket") == "contradiction", with_span(F.concat(claim, F.lit(" — _"), label, F.lit("_")), F.col("all_markers"), F.col("contradiction_marker")))
        .otherwise(F.concat(claim, F.lit(" — _не удалось проверить_")))
    )
    shown = rows.filter(claim != "").withColumn("line", F.concat(F.lit("- "), line))
    in_order = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("fact_no", "line")))), lambda s: s["line"])
    spans = F.bool_or(F.col("line").rlike(r"\[doc_\d+:\d+-\d+\]"))
    lists = shown.groupBy(key).agg(*(in_order(F.col("bucket") == b).alias(b) for b, _ in _SECTIONS), spans.alias("has_spans"))
    title = text.markdown_escape(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")))
    entry = F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] ["), title, F.lit("]("), F.col("url"), F.lit(")"))
    entry = F.concat_ws("\n", entry, F.when(F.col("quote") != "", F.concat(F.lit("  > "), text.markdown_escape(text.shortened(F.col("quote"), PREVIEW)))))
    listed = citations.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("line")))), lambda s: s["line"]).alias("sources"))
    empty = F.array().cast("array<string>")
    all_ = questions.select(key, "query").join(lists, key, "left").join(listed, key, "left")
    all_ = all_.select(key, "query", F.coalesce("has_spans", F.lit(False)).alias("has_spans"), *(F.coalesce(c, empty).alias(c) for c in [b for b, _ in _SECTIONS] + ["sources"]))
    n = {b: F.size(b) for b, _ in _SECTIONS}
    total = n["confirmed"] + n["weak"] + n["contradiction"] + n["unverifiable"]
    of = lambda word, c: F.when(c > 0, F.format_string(f"{word} %d/%d", c, total))
    extras = F.concat_ws(", ", of("слабых", n["weak"]), of("не проверено", n["unverifiable"]))
    asked = F.concat(F.lit("Вопрос: _"), text.markdown_escape(F.col("query")), F.lit("_.\n\n"))
    share = F.concat(F.format_string("Покрытие: **%d/%d** утверждений подтверждено", n["confirmed"], total), F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise(""), F.when(n["contradiction"] > 0, F.format_string(", противоречий %d", n["contradiction"])).otherwise(""), F.lit("."))
    short = F.concat(asked, F.when(total == 0, "Недостаточно данных для ответа.").otherwise(share))
    body = lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n")).otherwise("_нет_")
    parts = [F.concat(F.lit("## Краткий ответ\n\n"), short, F.lit("\n"))]
    for name, heading in _SECTIONS:
        parts += [F.lit(f"\n## {heading}\n"), body(name), F.lit("")]
    parts += [F.lit("\n## Источники\n"), body("sources")]
    note = "_Примечание: [N] — номер источника в списке ниже; [doc_M:start-end] — технический указатель на фрагмент в документе M с символьными offset-ами._"
    parts += [F.when(F.col("has_spans"), F.lit(note)), F.lit("")]
    whole = F.concat_ws("\n", *parts)
    cut = F.when(F.length(whole) > MOST_MARKDOWN, F.concat(F.substring(whole, 1, MOST_MARKDOWN), F.lit("\n\n_… truncated для безопасности._"))).otherwise(whole)
    return all_.select(key, cut.alias("answer_markdown"))


def render_audit(questions: DataFrame, rows: DataFrame, key: str = "query_id") -> DataFrame:
    """All claims with verdict and markers, for review."""
    words = {"SUPPORTS": "✅ Подтверждено", "REFUTES": "❌ Опровергнуто", "INSUFFICIENT": "⚠️ Недостаточно данных", "CONFLICTING": "⚡ Противоречие", "NUMERIC_MISMATCH": "🔢 Числовое расхождение"}
    label = F.when(F.lit(False), F.lit(""))
    for verdict, word in words.items():
        label = label.when(F.coalesce("verdict", F.lit("INSUFFICIENT")) == verdict, word)
    label = label.otherwise(F.concat(F.lit("❓ "), F.col("verdict")))
    line = F.concat(F.lit("\n### "), F.col("fact_no").cast("string"), F.lit(". "), text.markdown_escape(text.shortened(F.col("fact"), 120)), F.lit("\n**Вердикт:** "), F.concat_ws(" ", label, F.nullif(F.col("all_markers"), F.lit(""))), F.lit("\n"))
    lists = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_no", line.alias("line")))), lambda s: s["line"]), "").alias("details"))
    out = questions.select(key, "query").join(lists, key, "left")
    whole = F.concat(F.lit("## Ответ\n\n"), text.markdown_escape(F.col("query")), F.lit("\n\n## Детали по утверждениям\n"), F.col("details"))
    return out.select(key, F.when(F.col("details").isNull(), "_Нет данных для аудита._").otherwise(F.substring(whole, 1, MOST_MARKDOWN)).alias("audit_markdown"))


def answer_confidence(verdicts: DataFrame, citations: DataFrame, key: str = "query_id") -> DataFrame:
    """Confidence of an answer: coverage, less contradictions, plus citations."""
    contested = verdicts.groupBy(key).agg(F.count_if(F.col("verdict").isin("REFUTES", *CONFLICTS)).alias("contradictions"))
    cited = citations.groupBy(key).agg(F.count(F.lit(1)).alias("citations"))
    rows = coverage(verdicts, key).join(contested, key).join(cited, key, "left").fillna(0, ["citations"])
    return rows.withColumn("confidence", scoring.answer_confidence(F.col("score"), F.col("contradictions"), F.col("citations")))


def citation_stats(claims: DataFrame, key: str = "query_id") -> DataFrame:
    """Claims with and without evidence; ``cited`` counts stubs too, as does the share without stubs."""
    cited, stubs, total = F.count_if("has_evidence"), F.count_if("is_stub"), F.count(F.lit(1))
    return claims.groupBy(key).agg(
        total.alias("total"), cited.alias("cited"), (total - cited).alias("uncited"), stubs.alias("stub"),
        F.coalesce(F.round(F.try_divide(cited, total), 4), F.lit(0.0)).alias("coverage"), F.coalesce(F.round(F.try_divide(cited, total - stubs), 4), F.lit(0.0)).alias("non_stub_coverage"),
    )


def first_unused(claims: DataFrame, facts: DataFrame, key: str = "query_id") -> DataFrame:
    """Facts joined to claims of the same text, the n-th to the n-th."""
    nth = lambda order: F.row_number().over(Window.partitionBy(key, "text").orderBy(order))
    left = facts.withColumnRenamed("fact", "text").withColumn("nth", nth("fact_no"))
    right = claims.withColumn("nth", nth("claim_no"))
    return left.join(right, [key, "text", "nth"], "left").drop("nth")


def claim_documents(claims: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Claims (keys, url) with the least index of a document of that URL; null where there is none."""
    first = documents.groupBy(*keys, "url").agg(F.min("doc_index").alias("doc_index"))
    return claims.join(first, [*keys, "url"], "left")


def contradiction_markers(verdicts: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fact_no, contradiction_marker): where the side that contests a fact says so, denials before numbers."""
    window = F.when(F.col("verdict") == "NUMERIC_MISMATCH", F.col("mismatch_window")).otherwise(F.coalesce("refuting_window", "mismatch_window"))
    rows = verdicts.filter(F.col("verdict").isin("REFUTES", *CONFLICTS)).select(*keys, "fact_no", window.alias("w")).filter("w IS NOT NULL").select(*keys, "fact_no", "w.url", "w.start", "w.end")
    return claim_documents(rows, documents, keys).select(*keys, "fact_no", span_marker(F.col("doc_index"), F.col("start"), F.col("end")).alias("contradiction_marker"))


def missing_evidence(claims: DataFrame, key: str = "query_id") -> DataFrame:
    """Claims per question that are no stubs and have no evidence: an answer is complete if there are none."""
    return claims.groupBy(key).agg(F.count_if(~F.col("is_stub") & ~F.col("has_evidence")).alias("missing")).filter("missing > 0")


def prefix_within(windows: DataFrame, keys: list[str], order: str, most: int = 1500) -> DataFrame:
    """Windows joined to one text while their running length stays within ``most``."""
    running = F.sum(F.length("text")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    kept = windows.withColumn("_sum", running).filter(F.col("_sum") <= most)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda w: w["text"]), "\n").alias("blob"))


def valid_markdown(markdown: Column, ids: Column, known: Column) -> Column:
    """Whether a rewritten answer has only known citation ids and URLs, and ten characters at least."""
    used = F.transform(F.regexp_extract_all(markdown, F.lit(r"\[(\d{1,3})\]"), 1), lambda x: x.cast("int"))
    links = F.transform(F.regexp_extract_all(markdown, F.lit(r"https?://[^\s\)\]\"'<>]+"), 0), lambda u: F.rtrim(u, F.lit(".,;:!?)")))
    return (F.length(F.trim(markdown)) >= 10) & F.forall(used, lambda i: F.array_contains(ids, i)) & F.forall(links, lambda u: F.array_contains(known, u))
