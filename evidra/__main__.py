"""Command line: ``research`` over stored pages or documents, ``candidates`` from stored hub payloads, ``redact`` for texts and files; JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import udfs
from .operators import hub, research
from .sources import pages


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evidra")
    commands = top.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("research", help="answer a question from a Parquet table with url, title and text")
    ask.add_argument("question")
    ask.add_argument("--corpus", required=True)
    ask.add_argument("--top-n", type=int, default=5)
    ask.add_argument("--iterations", type=int, default=2)
    ask.add_argument("--approve", action="store_true")
    find = commands.add_parser("candidates", help="families of repositories with events in a window")
    find.add_argument("--payloads", required=True, help="JSON lines of the hub's models")
    find.add_argument("--since", required=True, type=datetime.fromisoformat)
    find.add_argument("--until", required=True, type=datetime.fromisoformat)
    find.add_argument("--top", type=int, default=20)
    clean = commands.add_parser("redact", help="text from standard input, or files below a folder, without secrets")
    clean.add_argument("--root")
    clean.add_argument("--check", action="store_true", help="count matches only; 1 if there are any")
    return top


def main(argv: list[str] | None = None) -> int:
    """0 for an answer, 3 if the question needs confirmation first."""
    args = parser().parse_args(argv)
    if args.command == "redact" and not args.root:
        given = sys.stdin.read()
        left = udfs.redact(given)
        print(json.dumps({"command": "redact", "data": {"changed": left != given}, "errors": [], "status": "ok"}, sort_keys=True) if args.check else left, end="" if not args.check else "\n")
        return int(args.check and left != given)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "redact":
        rows = (pages.scan_secrets if args.check else pages.redact_files)(spark, args.root).orderBy("path").collect()
        print(json.dumps({"command": "redact", "data": [r.asDict() for r in rows], "errors": [], "status": "ok"}, sort_keys=True, ensure_ascii=False))
        return int(args.check and any(r.matches for r in rows))
    if args.command == "candidates":
        signals = hub.parse_models(spark.read.schema(hub.PAYLOAD).json(args.payloads)).withColumn("arrival", F.monotonically_increasing_id())
        found = hub.top_candidates(hub.build_candidates(hub.newest_signals(signals), args.since, args.until), args.top)
        print(json.dumps({"command": "candidates", "data": [json.loads(x) for x in found.toJSON().collect()], "errors": [], "status": "ok"}, sort_keys=True, ensure_ascii=False))
        return 0
    if not 1 <= args.top_n <= 20 or not 1 <= args.iterations <= 5:
        parser().error("--top-n goes from 1 to 20, --iterations from 1 to 5")
    corpus = spark.read.parquet(args.corpus)
    questions = spark.createDataFrame([(1, args.question)], "query_id int, query string")
    run = research.run_research(questions, research.replayed_search(corpus), research.replayed_fetch(corpus), args.top_n, args.iterations, args.approve)
    plan = run.plans.first()
    if not args.approve and (plan["needs_confirmation"] or plan["routing_warning"]):
        print(json.dumps({"command": "research", "data": {"reasons": plan["confirmation_reason"]}, "errors": [], "status": "needs_confirmation"}, sort_keys=True, ensure_ascii=False))
        return 3
    data = {"answer": run.answers.first()["answer_markdown"], "risk": run.review.first()["risk_level"]}
    print(json.dumps({"command": "research", "data": data, "errors": [], "status": "done"}, sort_keys=True, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
