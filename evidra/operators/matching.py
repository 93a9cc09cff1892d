"""Facts against other sources: the cascade of matches, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, language, passages, text, udfs


def match_facts(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with ``fact`` and ``text``) with ``matched``, ``method`` and ``score``.

    Exact, numeric, fuzzy and synonym matches in this order; each stage
    sees only what the ones before it left open, so the expensive ratio is
    computed for few pairs. A numeric match of either kind ends the cascade.
    """
    low, wanted = F.lower("text"), F.lower("fact")
    usable = (F.coalesce("fact", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    cheap = F.when(~usable, "none").when(F.contains(low, wanted), "exact").otherwise(language.numeric_match(F.col("fact"), F.col("text")))
    staged = pairs.withColumn("_cheap", cheap)
    done = staged.filter("_cheap IS NOT NULL").withColumn("_best", F.lit(0.0))
    left = staged.filter("_cheap IS NULL").withColumn("_best", udfs.fuzzy(F.col("fact"), F.col("text")))
    staged = done.unionByName(left)
    known = language.synonyms(F.lower("fact"))
    synonym = F.exists(known, lambda s: F.contains(F.lower("text"), F.lower(s)))
    method = F.when(F.col("_cheap") == "none", None).when(F.col("_cheap").isNotNull(), F.col("_cheap")).when(F.col("_best") >= fixed.FUZZY_LEAST, "fuzzy").when(synonym, "synonym")
    score = F.when(F.col("_cheap") == "exact", 100.0).when(F.col("_cheap") == "num_morph", 90.0).when(F.col("_cheap") == "num_mismatch", 85.0).when((F.col("_best") < fixed.FUZZY_LEAST) & synonym & F.col("_cheap").isNull(), 90.0).otherwise(F.col("_best"))
    return staged.withColumn("method", method).withColumn("score", score).withColumn("matched", F.col("method").isNotNull()).drop("_cheap", "_best")


def exact_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Where the first occurrence of each item's ``text`` stands in each document that has it.

    Every position of a document is a candidate. The heads of the items
    are sent to all tasks; rows whose text has one meet the items of that
    head, and only these are searched.
    """
    width = F.expr(f"shiftleft(1, length(bin(least(length(passage), {max(passages.WIDTHS)}))) - 1)")
    wanted = items.select("item_id", F.col("text").alias("passage")).filter("passage IS NOT NULL")
    wanted = wanted.withColumn("head", F.substring(F.col("passage"), F.lit(1), width))
    scan = passages.head_scanner([r.head for r in wanted.select("head").distinct().collect()])
    rows = documents.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"doc_id {id_type}, text string, heads array<string>")
    found = found.select("doc_id", "text", F.explode("heads").alias("head")).join(wanted, "head").filter(F.contains("text", F.col("passage")))
    at = F.position(F.col("passage"), F.col("text")) - 1
    return found.select("item_id", "doc_id", at.alias("span_start"), (at + F.length("passage")).alias("span_end"))


def side_of(matched: Column, method: Column, negated: Column) -> Column:
    """What a matched source says about a fact."""
    return F.when(~matched, None).when(negated, "refutes").when(method == "num_mismatch", "mismatch").otherwise("supports")


def verdict(supports: Column, refutes: Column, mismatch: Column) -> Column:
    """The verdict on a fact from what its sources say; a denial outweighs a different number."""
    return (
        F.when(supports & ~refutes & ~mismatch, "SUPPORTS")
        .when(refutes & ~supports, "REFUTES")
        .when(supports & (refutes | mismatch), "CONFLICTING")
        .when(mismatch, "NUMERIC_MISMATCH")
        .otherwise("INSUFFICIENT")
    )


def verify(facts: DataFrame, sources: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per fact with its verdict.

    ``facts`` has the key, fact_no, fact and ``top_text``, the text it is
    from; ``sources`` the key, url and text of the others. Every fact
    meets every source of its question, an equi-join on the question.
    """
    pairs = match_facts(facts.join(sources, key)).withColumn("negated", language.is_negated(F.col("fact"), F.col("text")))
    said = pairs.withColumn("side", side_of(F.col("matched"), F.col("method"), F.col("negated")))
    # one column after the other: spans as one expression would repeat each pattern many times
    said = said.withColumn("_wrong", F.when(F.col("side") == "mismatch", language.mismatch_span(F.col("fact"), F.lower("text"))))
    said = said.withColumn("_span", F.coalesce("_wrong", F.when(F.col("side") == "refutes", language.negation_span(F.col("fact"), F.col("text")))))
    said = said.withColumn("window", F.when(F.col("_span").isNotNull(), F.struct("url", "_span.start", "_span.end", "_span.method")))
    entry = F.struct("url", "score", "method")
    per_fact = said.groupBy(key, "fact_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "supports", entry))).alias("supporting_sources"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "refutes", F.col("url")))).alias("refuting_sources"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "mismatch", entry))).alias("numeric_mismatch_sources"),
        F.min(F.when(F.col("side") == "refutes", F.col("window"))).alias("refuting_window"),
        F.min(F.when(F.col("side") == "mismatch", F.col("window"))).alias("mismatch_window"),
    )
    out = facts.withColumn("negated", language.is_negated(F.col("fact"), F.col("top_text"))).drop("top_text").join(per_fact, [key, "fact_no"], "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    out = out.withColumn("verdict", verdict(some("supporting_sources"), some("refuting_sources") | F.col("negated"), some("numeric_mismatch_sources")))
    return out.withColumn("verified", F.col("verdict") == "SUPPORTS")


def verification_rate(verdicts: DataFrame, key: str = "query_id") -> DataFrame:
    """Verified and all facts of a question and their ratio, to three places."""
    return verdicts.groupBy(key).agg(
        F.count_if("verified").alias("verified_facts"),
        F.count(F.lit(1)).alias("total_facts"),
        F.round(F.count_if("verified") / F.count(F.lit(1)), 3).alias("verification_rate"),
    )


def overlay(verdicts: DataFrame, answers: DataFrame, key: str = "query_id", below: float = 0.7) -> DataFrame:
    """Verdicts after a language model has answered for questions with a rate below ``below``.

    ``answers`` has the key, fact_no, answer and ``urls`` (already checked
    against the candidates). Support without a URL is weak and not counted.
    """
    rates = verification_rate(verdicts, key).select(key, "verification_rate")
    asked = verdicts.join(rates, key).join(answers.select(key, "fact_no", "answer", "urls"), [key, "fact_no"], "left")
    open_ = (F.col("verification_rate") < below) & ~F.col("verified") & F.col("answer").isNotNull()
    linked = F.size(F.coalesce("urls", F.array().cast("array<string>"))) > 0
    new = F.when(open_ & (F.col("answer") == "SUPPORTS") & linked, "SUPPORTS").when(open_ & (F.col("answer") == "SUPPORTS"), "WEAK_SUPPORT").when(open_ & (F.col("answer") == "REFUTES"), "REFUTES").otherwise(F.col("verdict"))
    out = asked.withColumn("verdict", new).withColumn("refuted_unlinked", open_ & (F.col("answer") == "REFUTES") & ~linked)
    return out.withColumn("verified", F.col("verdict") == "SUPPORTS").drop("verification_rate", "answer")


def flatten_details(results: DataFrame, key: str = "query_id", details: str = "verification_details") -> DataFrame:
    """One row per fact from results that hold their facts in an array of structs; results and entries that are null give none."""
    rows = results.select(key, F.posexplode(details).alias("fact_no", "_detail")).filter("_detail IS NOT NULL")
    return rows.select(key, "fact_no", "_detail.*")


def claim_windows(claims: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence of each claim (keys, claim) in its document (keys, url, title, text); claims that are not there give no row.

    The window is the document's own text where that is the claim up to
    white space, and else as many characters as the claim has.
    """
    found = claims.join(documents, keys).withColumn("span", udfs.span_of(F.col("claim"), F.col("text"))).filter("span.start >= 0")
    size = F.length("claim")
    own = F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    inside = F.col("span.end") <= F.length("text")
    same = text.collapse(own) == text.collapse(F.col("claim"))
    window = F.when(inside & same, own).when(inside, F.substring(F.col("text"), F.col("span.start") + 1, size)).otherwise(F.col("claim"))
    return found.select(*claims.columns, F.col("span.start").alias("offset_start"), F.col("span.end").alias("offset_end"), window.alias("window"), F.col("url").alias("source_url"), F.col("title").alias("source_title"), F.lit(0.0).alias("score"))
