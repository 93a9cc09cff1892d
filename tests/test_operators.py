"""Operators on small relations with known answers."""

import io
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidra.operators import critic, evaluation, gaps, hub, legacy, matching, planning, ranking, research, synthesis
from evidra.plans import QUERIES
from evidra.sources import pages, replay, sinks
from evidra.streaming import hub_stream


def test_votes_and_provenance(spark):
    hits = spark.createDataFrame(
        [(1, 1, "https://a.b/x?utm_source=t", "bing", "q1", 1), (1, 2, "https://a.b/x", "duckduckgo", "q2", 3), (1, 3, "", "bing", "q1", 2), (1, 4, "https://c.d", "bing", "q1", 4)],
        "query_id int, seq int, url string, engine string, query string, rank int",
    ).withColumns({"title": F.lit("t"), "snippet": F.lit("s")})
    votes = {r.canon_url: r.search_votes for r in ranking.vote_aggregation(hits).collect()}
    assert votes == {"https://a.b/x": 4, "https://c.d/": 2}
    merged = ranking.merge_provenance(hits.withColumn("provenance", F.struct(F.col("query").alias("task_query"), "rank")))
    first = {r.canon_url: (r.url, len(r.provenance)) for r in merged.collect()}
    assert first["https://a.b/x"] == ("https://a.b/x?utm_source=t", 2)


def test_ranking_puts_relevant_first_and_errors_last(spark):
    place = "array<struct<task_query:string,rank:int>>"
    docs = spark.createDataFrame(
        [(1, 0, "u0", "nothing of the kind", 4000, "", None), (1, 1, "u1", "python decorators explained", 4000, "", [("q", 1)]), (1, 2, "u2", None, 0, "timeout", [("q", 1)])],
        f"query_id int, seq int, url string, text string, length int, error string, provenance {place}",
    )
    rows = ranking.rank_documents(docs, F.lit("python decorators")).orderBy("rank").collect()
    assert [r.url for r in rows] == ["u1", "u0", "u2"] and rows[2].source_score == 0.0 and rows[0].source_score == 1.0
    assert ranking.top_n(docs, "query_id", [F.asc("seq")], 0).count() == 0


def test_sources_without_url_all_stay(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, ""), (1, 5, "?"), (1, 6, None)], "query_id int, seq int, url string")
    assert sorted(r.seq for r in ranking.first_per_url(rows).collect()) == [1, 2, 4, 5, 6]


@pytest.mark.parametrize(
    ("s", "r", "m", "expected"),
    [(1, 0, 0, "SUPPORTS"), (0, 1, 0, "REFUTES"), (0, 1, 1, "REFUTES"), (1, 1, 0, "CONFLICTING"), (0, 0, 1, "NUMERIC_MISMATCH"), (1, 0, 1, "CONFLICTING"), (0, 0, 0, "INSUFFICIENT")],
)
def test_verdicts(spark, s, r, m, expected):
    got = spark.range(1).select(matching.verdict(F.lit(bool(s)), F.lit(bool(r)), F.lit(bool(m))).alias("v")).first()
    assert got.v == expected


def test_verify_and_overlay(spark):
    facts = spark.createDataFrame([(1, 1, "14 ракет", "В порту стоят 14 ракет."), (1, 2, "red fox", "A red fox.")], "query_id int, fact_no int, fact string, top_text string")
    sources = spark.createDataFrame([(1, "u", "Сначала насчитали 13 ракет, к вечеру 14 ракет.")], "query_id int, url string, text string")
    rows = matching.verify(facts, sources)
    assert {r.fact_no: r.verdict for r in rows.collect()} == {1: "SUPPORTS", 2: "INSUFFICIENT"}
    answers = spark.createDataFrame([(1, 2, "SUPPORTS", [])], "query_id int, fact_no int, answer string, urls array<string>")
    assert {r.fact_no: r.verdict for r in matching.overlay(rows, answers).collect()} == {1: "SUPPORTS", 2: "WEAK_SUPPORT"}


def test_candidates(spark):
    def model(repo, made, changed, tags=()):
        return json.dumps({"id": repo, "createdAt": made, "lastModified": changed, "tags": list(tags), "likes": 1, "downloads": 10})

    raw = [
        model("lab/antares", "2026-07-22T00:00:00Z", "2026-07-22T00:00:00Z"),
        model("x/q1", "2026-07-22T00:00:00Z", "2026-07-22T01:00:00Z", ["base_model:quantized:poolside/Laguna"]),
        model("x/q2", "2026-07-22T02:00:00Z", "2026-07-22T03:00:00Z", ["base_model:poolside/Laguna"]),
        model("org/old", "2026-01-01T00:00:00Z", "2026-07-22T00:00:00Z"),
        model("noowner", "2026-07-22T00:00:00Z", "2026-07-22T00:00:00Z"),
        model("lab/late", "2026-07-30T00:00:00Z", "2026-07-30T00:00:00Z"),
        model("lab/bad", "yesterday", "2026-07-22T00:00:00Z"),
        "{}",
    ]
    payloads = spark.createDataFrame([(r,) for r in raw], "j string").select(F.from_json("j", hub.PAYLOAD).alias("p")).select("p.*")
    signals = hub.parse_models(payloads)
    rows = {r.family_id: r for r in hub.build_candidates(signals, datetime(2026, 7, 21, 8), datetime(2026, 7, 23)).collect()}
    assert {k: v.state_hint for k, v in rows.items()} == {"lab/antares": "new_root_repository", "poolside/Laguna": "derivative_burst", "org/old": "update_only"}
    assert rows["poolside/Laguna"].derivative_repositories == 2 and rows["org/old"].updated_repositories == 1


def test_plans_and_tasks(spark):
    long = "Please explain in detail how the Falcon 9 rocket of SpaceX compares with the Ariane 6 launcher in cost and reliability"
    questions = spark.createDataFrame([(1, long), (2, "latest news today"), (3, "")], "query_id int, query string")
    rows = {r.query_id: r for r in planning.classify(planning.adapt(questions)).collect()}
    assert rows[1].route == "technical" and rows[1].adaptation_method == "deterministic" and "Falcon" in rows[1].main_query
    assert rows[2].route == "news" and rows[2].time_range == "day" and rows[2].main_query == "latest news today"
    assert rows[3].route == "general" and rows[3].confidence == 0.0
    tasks = planning.search_tasks(planning.classify(planning.adapt(questions))).collect()
    assert [t.priority for t in sorted(tasks, key=lambda t: t.task_id) if t.query_id == 2] == [100, 40]
    assert not [t for t in tasks if t.query_id == 3]


def test_answer(spark):
    entry = "array<struct<url:string,score:double,method:string>>"
    verdicts = spark.createDataFrame(
        [(1, 1, "c1", "SUPPORTS", [("u1", 1.0, "exact")], [], []), (1, 2, "c2", "REFUTES", [], ["u2"], []), (1, 3, "c3", "INSUFFICIENT", [], [], []), (1, 4, "c4", "SUPPORTS", [("u9", 1.0, "exact")], [], [])],
        f"query_id int, fact_no int, fact string, verdict string, supporting_sources {entry}, refuting_sources array<string>, numeric_mismatch_sources {entry}",
    )
    sources = spark.createDataFrame([(1, 1, "u1", "T1", "quote"), (1, 2, "u2", "", ""), (1, 3, "u1", "again", "")], "query_id int, seq int, url string, title string, snippet string")
    citations = synthesis.citation_table(sources)
    rows = synthesis.classified(verdicts, citations)
    assert {r.fact_no: r.bucket for r in rows.collect()} == {1: "confirmed", 2: "contradiction", 3: "unverifiable", 4: "weak"}
    text = synthesis.render_answer(spark.createDataFrame([(1, "why?"), (2, "what")], "query_id int, query string"), rows, citations).orderBy("query_id").collect()
    assert "- c1 [1]" in text[0].answer_markdown and "Покрытие: **1/4**" in text[0].answer_markdown and text[0].answer_markdown.count("## ") == 6
    assert "Недостаточно данных" in text[1].answer_markdown and text[1].answer_markdown.count("_нет_") == 5
    assert synthesis.coverage(verdicts).first().score == 0.5


def test_gap_tasks_are_not_repeated(spark):
    schema = "query_id int, query string, route string, language string, engines string, categories string, priority int"
    new = spark.createDataFrame([(1, "q", "general", "en", None, None, 50), (1, "q", "general", "en", None, None, 40), (1, "z", "general", "en", None, None, 50)], schema)
    done = spark.createDataFrame([(1, "z", "general", "en", None, None, 100)], schema)
    assert [r.query for r in gaps.new_tasks(new, done).collect()] == ["q"]


def test_research_runs_to_an_answer(spark):
    corpus = spark.createDataFrame(
        [("https://a.org/1", "A", "Acme Corporation built 22 drones in Berlin. Acme Corporation grew."), ("https://b.org/2", "B", "It is said that Acme Corporation built 22 drones."), ("https://c.org/3", "C", "No 22 drones were built by anyone.")],
        "url string, title string, text string",
    )
    questions = spark.createDataFrame([(1, "How many drones did Acme build"), (2, "zzz qqq")], "query_id int, query string")
    run = research.run_research(questions, research.replayed_search(corpus), research.replayed_fetch(corpus))
    assert {r.query_id for r in run.answers.collect()} == {1, 2}
    assert run.documents.filter("query_id = 1").count() == 3 and run.verdicts.count() >= 1
    assert "no_search_results" in {r.kind for r in run.gaps.filter("query_id = 2").collect()}
    told = {r.query_id: json.loads(r.manifest) for r in research.manifest(run).collect()}
    assert told[1]["status"] == "done" and [d["rank"] for d in told[1]["documents"]] == [1, 2, 3] and told[1]["review"]["risk_level"] in ("low", "medium", "high") and "Acme" in told[1]["answer_markdown"]
    assert told[1]["citations"][0]["id"] == 1 and "documents" not in told[2] and told[2]["plan"]["query"] == "zzz qqq"


def test_replay_sources(spark, tmp_path):
    (tmp_path / "queries.json").write_text(json.dumps(["q"]))
    (tmp_path / "hits.json").write_text(json.dumps({"q": [{"url": "u1", "engine": "bing", "content": "c"}, "bad", {"url": "u2"}]}))
    replay.register(spark)
    raw = spark.read.format("evidra_hits").option("path", str(tmp_path)).option("max_results", "2").load()
    rows = ranking.normalize_hits(raw, 10, key="query").collect()
    assert [(r.url, r.engines, r.snippet) for r in rows] == [("u1", ["bing"], "c")]
    hit = lambda url, **more: {"url": url, "engine": "bing", "category": "news", "publishedDate": "2031-05-02T00:00:00Z"} | more
    stored = [hit("u1"), hit("u2", category="general"), hit("u3", engine="ask", engines=["ask", "duck"]), hit("u4", publishedDate="2031-03-01T00:00:00Z"), hit("u5", publishedDate=None)]
    (tmp_path / "hits.json").write_text(json.dumps({"q": stored}))
    found = lambda **options: [r.url for r in spark.read.format("evidra_hits").options(path=str(tmp_path), **options).load().orderBy("seq").collect()]
    now = "2031-05-03T00:00:00Z"
    assert found(engines="duck,brave") == ["u3"] and found(categories="news", time_range="week", now=now) == ["u1", "u3"] and found(time_range="year", now=now) == ["u1", "u2", "u3", "u4"]
    assert [r.url for r in replay.news_search(spark, str(tmp_path), now).orderBy("seq").collect()] == ["u1", "u3"]
    asked = []

    def flaky():
        asked.append(1)
        if len(asked) < 3:
            raise OSError("busy")
        return {"results": [1]}

    assert replay.answer(flaky, retries=2, wait=0.0) == ({"results": [1]}, None) and len(asked) == 3
    assert replay.answer(lambda: {}, retries=2, wait=0.0) == ({}, None)
    page = [{"id": "a/b", "createdAt": "2024-01-01T00:00:00Z", "lastModified": "2024-01-01T00:00:00Z"}]
    (tmp_path / "text-generation_createdAt-0.json").write_text(json.dumps(page))
    models = spark.read.format("evidra_models").option("path", str(tmp_path)).option("since", "2024-02-01T00:00:00Z").load()
    (tmp_path / "text-generation_lastModified-0.json").write_text(json.dumps([page[0] | {"lastModified": "2024-03-01T00:00:00Z"}]))
    (tmp_path / "text-generation_lastModified-1.json").write_text("<html>busy</html>")
    got = sorted((r.channel, r.page, r.truncated, r.payload is None, (r.error or "").split(":")[0]) for r in models.collect())
    assert got == [("text-generation:createdAt", 0, False, False, ""), ("text-generation:lastModified", 0, False, False, ""), ("text-generation:lastModified", 1, True, True, "JSONDecodeError")]
    assert hub.discovery_window(datetime(2024, 1, 25, 12), 48) == (datetime(2024, 1, 23, 12), datetime(2024, 1, 25, 12))


def test_sinks_and_files(spark, tmp_path):
    row = spark.range(1).select(sinks.envelope("x", F.lit("ok"), F.struct(F.lit(1).alias("n")), F.array().cast("array<string>")).alias("j")).first()
    assert list(json.loads(row.j)) == ["command", "data", "errors", "status"]
    (tmp_path / "a.txt").write_text("MY_API_KEY=abcdefgh1234")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    found = {r.path.rsplit("/", 1)[1]: r.matches for r in pages.scan_secrets(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": 1, "b.bin": 0}
    clean = {r.path.rsplit("/", 1)[1]: r.text for r in pages.redact_files(spark, str(tmp_path)).collect()}
    assert clean == {"a.txt": "MY_API_KEY=...1234", "b.bin": "<binary file redacted>"}
    assert [r.path.rsplit("/", 1)[1] for r in pages.collect_files(spark, str(tmp_path), ["*.bin"]).collect()] == ["a.txt"]
    for _ in range(2):
        sinks.append_jsonl(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_evaluation_sets_and_reports(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"version": 1, "cases": [{"id": "a", "route": "news"}, {"id": "b", "route": "wiki"}]}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps([{"id": "a"}, {"id": "c"}], indent=1))
    assert [r.id for r in evaluation.load_cases(spark, str(tmp_path / "set.json")).orderBy("id").collect()] == ["a", "b"]
    assert [r.id for r in evaluation.load_cases(spark, str(tmp_path / "list.json")).orderBy("id").collect()] == ["a", "c"]
    rows = spark.createDataFrame([("a", "news", "news", 1.0, 0.0, 1.0, 3), ("b", "wiki", "news", 0.0, 1.0, 0.0, 4)], "id string, expected_route string, route string, coverage double, contradiction_rate double, confidence double, fetch_errors int")
    results = evaluation.quality_rows(rows)
    report = sinks.report_text(evaluation.aggregate(results), results).splitlines()
    assert report[1] == "EVAL REPORT (2 queries)" and report[3] == "QS mean: 0.5000  (min 0.0000 / max 1.0000)" and "fetch_errors: 7" in report and report[-2].endswith("route ✗ (news/wiki)")


def test_critic_reads_all_a_source_says(spark):
    claims = spark.createDataFrame([(1, 1, "Blue Harbour Bank grew")], "query_id int, claim_no int, claim string")
    sources = spark.createDataFrame([(1, "u", "Grand Hotel opened", "a note on Blue Harbour Bank", None)], "query_id int, url string, text string, snippet string, content string")
    assert critic.ungrounded_entities(claims, sources).count() == 1
    assert critic.ungrounded_entities(claims, critic.with_blob(sources)).count() == 0


def test_older_flow(spark):
    pages_ = {"https://a.org/1": "harbour cranes lift 40 boxes. " * 70, "https://b.org/2": "40 boxes were lifted at the harbour.", "https://c.org/3": "Nothing about it."}
    found = [("harbour cranes", 1, "bing", "https://c.org/3", "C"), ("harbour cranes", 2, "bing", "https://a.org/1?utm_source=x", "harbour cranes"), ("lifting boxes", 1, "wikipedia", "https://a.org/1", "harbour cranes"), ("lifting boxes", 2, "bing", "https://b.org/2", "harbour"), ("lifting boxes", 3, "bing", "https://gone.org/", "gone")]
    hits = spark.createDataFrame([(1, *f, "") for f in found], "query_id int, task_query string, rank int, engine string, url string, title string, snippet string")
    corpus = spark.createDataFrame(list(pages_.items()), "url string, text string")
    questions = spark.createDataFrame([(1, "harbour cranes", "en", ["lifting boxes", "harbour cranes"])], "query_id int, query string, language string, alt_queries array<string>")
    run = legacy.deep_research(questions, lambda tasks: hits.join(tasks.select("query_id", F.col("query").alias("task_query")), ["query_id", "task_query"]), research.replayed_fetch(corpus), top_n=4)
    assert [r.query for r in run.queries.orderBy("nr").collect()] == ["harbour cranes", "lifting boxes"]
    ranked = run.sources.orderBy("rank").collect()
    # a.org: 0.5 for its length and 0.5 for both words; b.org: one of two words and little text; c.org: neither; the last one failed
    assert [r.url for r in ranked] == ["https://a.org/1", "https://b.org/2", "https://c.org/3", "https://gone.org/"]
    assert ranked[0].search_votes == 4 and ranked[0].source_score == 1.0 and ranked[0].raw_urls == ["https://a.org/1", "https://a.org/1?utm_source=x"] and ranked[3].source_score == 0.0
    assert ranked[1].source_score == pytest.approx(0.5 * len(pages_["https://b.org/2"]) / 2000 + 0.25)
    summary = run.summary.first()
    assert (summary.fetched_ok, summary.fetched_err, summary.unique_sources, summary.top1_url, summary.verified_facts, summary.total_facts) == (3, 1, 4, "https://a.org/1", 1, 1)
    sources, counts = legacy.deep_search(questions, lambda tasks: hits.filter("task_query = 'harbour cranes'"), research.replayed_fetch(corpus), top_n=1)
    assert [r.url for r in sources.collect()] == ["https://c.org/3"] and counts.first().fetched_ok == 1


def _join_rows(frame):
    """The most rows that a join of a collected frame gave."""
    def walk(node):
        name = node.nodeName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        below = node.children()
        metric = node.metrics().get("numOutputRows")
        own = metric.get().value() if "Join" in name and metric.isDefined() else 0
        return max([own, *map(walk, inner + [below.apply(i) for i in range(below.size())])])

    return walk(frame._jdf.queryExecution().executedPlan())


def _temporal(claims, sources):
    """Flags by the rule, pair by pair."""
    flags = {}
    for key, number, claim in claims:
        for other, url, said in sources:
            told, known = ([int(w) for w in t.split() if len(w) == 4 and w.isdigit()] for t in (claim, said))
            wrong = [y for y in told if known and (y > max(known) + 1 or y < min(known) - 5)]
            if key == other and wrong:
                late = wrong[0] > max(known) + 1
                end = f"max year is {max(known)} (anachronism)" if late else f"min year is {min(known)} (unusually old)"
                flags.setdefault(key, []).append((str(number).rjust(9, "0")[:9] + "|" + url, claim[:120], f"Claim mentions {wrong[0]} but source {end}", "medium" if late else "low"))
    return sorted((k, severity, message, claim) for k, rows in flags.items() for _, claim, message, severity in sorted(rows)[:20])


def test_temporal_consistency_joins_what_can_be_among_the_first(spark):
    draw = random.Random(3)
    years = lambda: " ".join(str(draw.randint(1995, 2012)) for _ in range(draw.choice([0, 1, 1, 2])))
    cases = [
        # numbers and URLs that repeat, texts with several years or none, numbers cut to nine digits
        ([(draw.randint(1, 4), draw.choice([draw.randint(1, 60), 10**11 + draw.randint(1, 30)]), f"Ships {draw.randint(1, 3)} left in {years()}") for _ in range(300)],
         [(draw.randint(1, 4), f"https://s{draw.randint(1, 25)}.example.com/", f"In {years()} ships left") for _ in range(120)]),
        # the only claim with a flag comes last
        ([(1, n, "Ships left in 2003") for n in range(100)] + [(1, 100, "Ships left in 2009")], [(1, f"https://s{n}.example.com/", "In 2004 ships left") for n in range(30)]),
        # one question, many claims and sources
        ([(1, n, f"Ships left in {1990 + n % 35}") for n in range(1000)], [(1, f"https://s{n}.example.com/", f"In {1995 + n % 20} ships left") for n in range(600)]),
    ]
    for claims, sources in cases:
        rows = critic.temporal_consistency(spark.createDataFrame(claims, "query_id int, claim_no long, claim string"), spark.createDataFrame(sources, "query_id int, url string, text string"))
        assert sorted((r.query_id, r.severity, r.message, r.claim) for r in rows.collect()) == _temporal(claims, sources)
    assert 0 < _join_rows(rows) <= 20 * 600


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = hub_stream.read_events(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "))
    query = hub_stream.tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("events")).first()[0] == events.count()
    query = hub_stream.newest_per_key(stream, "user_id").writeStream.outputMode("append").format("memory").queryName("newest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination()
    want = {r.user_id: r.ts for r in events.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    got = {r.user_id: r.ts for r in spark.table("newest").groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert got == want


def test_sliding_windows_drop_what_comes_too_late(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    at = lambda i, stamp: (i, 1, "view", datetime.fromisoformat(stamp), 1.0)
    for n, rows in enumerate(([at(1, "2031-01-10T00:00:00"), at(2, "2031-01-10T05:00:00")], [at(3, "2031-02-10T00:00:00")], [at(4, "2031-01-10T01:00:00"), at(5, "2031-02-10T01:00:00")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = hub_stream.read_events(spark, str(tmp_path / "in"), schema)
        query = hub_stream.sliding_counts(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert n < 3
    done = spark.read.parquet(str(tmp_path / "out"))
    # the first two events are final; the fourth came after the watermark had passed and is not counted
    assert done.filter("window.end <= '2031-02-01'").agg(F.max("events")).first()[0] == 2


def test_model_answers(spark):
    from evidra.operators import assistant

    facts = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "query_id int, fact_no int, fact string")
    evidence = spark.createDataFrame([(1, "u", 0.5, "text")], "query_id int, url string, score double, text string")
    rows = assistant.prompts(facts, evidence)
    assert "1. a\n2. b" in rows.first().prompt and "SOURCE u" in rows.first().prompt

    def broken(prompt):
        raise assistant.ModelError("busy", 429)

    def refusing(prompt):
        raise assistant.ModelError("bad request", 400)

    replies = assistant.ask(rows, [broken, lambda p: 'Sure: {"results": [{"index": 2, "verdict": "match", "source_urls": ["u"]}]} ok'], retries=1, wait=0.0)
    got = {r.fact_no: (r.answer, r.urls) for r in assistant.answers(facts, replies).collect()}
    assert got == {5: ("INSUFFICIENT", []), 9: ("SUPPORTS", ["u"])}
    failed = assistant.ask(rows, [broken], retries=0).first()
    assert failed.answer is None and failed.error == "busy"
    # what is our own fault is not tried elsewhere
    refused = assistant.ask(rows, [refusing, lambda p: "never asked"], retries=1, wait=0.0).first()
    assert (refused.answer, refused.error) == (None, "bad request")
    assert assistant.is_transient(TimeoutError()) and assistant.is_transient(assistant.ModelError("no status")) and not assistant.is_transient(ValueError("x"))


def test_answers_in_a_models_wording(spark):
    from evidra.operators import assistant

    answers = spark.createDataFrame([(1, "## A\nplain [1]"), (2, "## B\nplain")], "query_id int, answer_markdown string")
    questions = spark.createDataFrame([(1, "why?"), (2, "what?")], "query_id int, query string")
    facts = spark.createDataFrame([(1, i, f"fact {i}") for i in range(25)], "query_id int, fact_no int, fact string")
    citations = spark.createDataFrame([(1, 1, "https://s.org/1", "One"), (1, 2, "?", "Two")], "query_id int, id int, url string, title string")
    prompts = {r.query_id: r.prompt for r in assistant.rewrite_prompts(answers, questions, facts, citations).collect()}
    assert "- 20. fact 19" in prompts[1] and "fact 20" not in prompts[1] and "[1] One — https://s.org/1\n[2] Two — ?" in prompts[1] and "why?" in prompts[1]
    out = {r.query_id: r for r in assistant.enrich(answers, questions, facts, citations, [lambda p: "  Well told, by [1].  "]).collect()}
    assert (out[1].answer_markdown, out[1].enriched_by_llm, out[1].llm_fallback_reason) == ("Well told, by [1].", True, None)
    assert (out[2].answer_markdown, out[2].llm_fallback_reason) == ("## B\nplain", "post-validation failed")
    assert {r.llm_fallback_reason for r in assistant.enrich(answers, questions, facts, citations, []).collect()} == {"no llm_client"}


def test_contested_spans(spark):
    facts = spark.createDataFrame([(1, 1, "22 drones", "Then 22 drones came.")], "query_id int, fact_no int, fact string, top_text string")
    sources = spark.createDataFrame([(1, "u", "They say 23 drones came.")], "query_id int, url string, text string")
    rows = matching.verify(facts, sources)
    places = spark.createDataFrame([(1, "u", 4)], "query_id int, url string, doc_index int")
    assert rows.first().verdict == "NUMERIC_MISMATCH"
    assert synthesis.contradiction_markers(rows, places, ["query_id"]).first().contradiction_marker == "[doc_4:9-18]"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from evidra.__main__ import main

    corpus = spark.createDataFrame([("https://a.org/1", "A", "Acme Corporation built 22 drones in Berlin."), ("https://b.org/2", "B", "Acme Corporation built 22 drones.")], "url string, title string, text string")
    corpus.write.parquet(str(tmp_path / "corpus"))
    assert main(["research", "Acme drones", "--corpus", str(tmp_path / "corpus"), "--approve", "--iterations", "1"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["status"] == "done"
    monkeypatch.setattr("sys.stdin", io.StringIO("MAP_SECRET=northwind77"))
    assert main(["redact"]) == 0 and capsys.readouterr().out == "MAP_SECRET=...nd77"
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("MAP_SECRET=northwind77")
    assert main(["redact", "--root", str(tmp_path / "files"), "--check"]) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["data"][0]["matches"] == 1


def test_exact_spans_at_any_position(spark, tmp_path):
    passage = "a benchmark passage of more than forty characters, whole"
    items = {1: passage, 2: "  begins with blanks and is longer than forty characters", 3: "没有空格的文字" * 7, 4: "short", 5: "", 6: None, 7: "x" * 64 + "y"}
    texts = {1: f"see ({passage})", 2: f"in{passage}side \u00a0{passage}", 3: f"\U0001f600{items[2]}", 4: f"前{items[3]}后", 5: "unshortened", 6: "", 7: None, 8: "z" * 262_100 + "x" * 100 + "y", 9: passage[:-1]}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = QUERIES["find_span_exact"](spark, str(tmp_path)).collect()
    want = {(i, d, t.find(p), t.find(p) + len(p)) for i, p in items.items() for d, t in texts.items() if p is not None and t is not None and p in t}
    assert len(rows) == len(want) == 14 and {tuple(r) for r in rows} == want
