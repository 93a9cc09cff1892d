"""Python data sources that replay stored answers of a search service and of a model hub.

The readers have the shape of live connectors: a partition per request or
channel, pages one after another until the window's edge. The network call
is a function that is handed in; without one, pages come from a folder of
JSON files, ``<channel>-<page>.json``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HIT_SCHEMA = "query string, seq int, engine string, engines array<string>, title string, url string, content string, score double, category string, publishedDate string"
MODEL_SCHEMA = "channel string, page int, arrival bigint, truncated boolean, payload string, error string"
TAGS = ["text-generation", "text-to-text-generation", "image-text-to-text"]
SORTS = ["createdAt", "lastModified"]


class _Request(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


def answer(ask: Callable[[], dict], retries: int = 1, wait: float = 1.5) -> tuple[dict, str | None]:
    """What a search service answers and its error, asked again while it fails or finds nothing."""
    last: dict = {}
    error = None
    for attempt in range(retries + 1):
        try:
            last, error = ask(), None
        except (OSError, ValueError) as problem:
            error = f"{type(problem).__name__}: {problem}"
        if last.get("results") and error is None:
            break
        if attempt < retries:
            time.sleep(wait)
    return last, error


class _HitReader(DataSourceReader):
    """Answers of a search service, stored or live: a partition per query."""

    #: Days back from ``now`` that a time range reaches.
    DAYS = {"day": 1, "week": 7, "month": 31, "year": 366}

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = int(options.get("max_results", "10"))
        self.engines = {e for e in options.get("engines", "").split(",") if e}
        self.categories = {c for c in options.get("categories", "").split(",") if c}
        self.retries = int(options.get("retries", "1"))
        self.since = None
        if span := options.get("time_range"):
            self.since = datetime.fromisoformat(options["now"].replace("Z", "+00:00")) - timedelta(days=self.DAYS[span])

    def partitions(self) -> list[InputPartition]:
        with open(f"{self.path}/queries.json", encoding="utf-8") as file:
            return [_Request(q) for q in json.load(file)]

    def wanted(self, hit: object) -> bool:
        """Whether a service that was asked with these options would give the hit; what is no object is dropped later."""
        if not isinstance(hit, dict):
            return True
        named = set(hit.get("engines") or []) | {hit.get("engine")}
        if self.engines and not self.engines & named or self.categories and hit.get("category") not in self.categories:
            return False
        return self.since is None or datetime.fromisoformat((hit.get("publishedDate") or "0001-01-01T00:00:00+00:00").replace("Z", "+00:00")) >= self.since

    def stored(self, query: str) -> dict:
        with open(f"{self.path}/hits.json", encoding="utf-8") as file:
            return {"results": [h for h in json.load(file).get(query, []) if self.wanted(h)]}

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found, error = answer(lambda: self.stored(partition.name), self.retries, 0.0)
        if error:
            raise OSError(error)
        for seq, hit in enumerate(found.get("results", [])[: self.most]):
            if isinstance(hit, dict):
                yield (partition.name, seq, hit.get("engine"), hit.get("engines"), hit.get("title"), hit.get("url"), hit.get("content"), hit.get("score"), hit.get("category"), hit.get("publishedDate"))


class HitSource(DataSource):
    """``spark.read.format("evidra_hits")``: stored hits, at most ``max_results`` of each query.

    Further options are ``engines`` and ``categories`` (names with commas),
    ``time_range`` (day, week, month, year) back from ``now``, and ``retries``.
    """

    @classmethod
    def name(cls) -> str:
        return "evidra_hits"

    def schema(self) -> str:
        return HIT_SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _HitReader(self.options)


class _ModelReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.pages = int(options.get("max_pages", "5"))
        self.since = datetime.fromisoformat(options["since"].replace("Z", "+00:00"))

    def partitions(self) -> list[InputPartition]:
        return [_Request(f"{tag}:{sort}") for tag in TAGS for sort in SORTS]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        sort = partition.name.split(":")[1]
        arrival = 0
        for page in range(self.pages):
            try:
                with open(f"{self.path}/{partition.name.replace(':', '_')}-{page}.json", encoding="utf-8") as file:
                    models = json.load(file)
            except FileNotFoundError:
                return
            except ValueError as problem:  # what came before stays, and the channel is known to be incomplete
                yield partition.name, page, arrival, True, None, f"{type(problem).__name__}: {problem}"
                return
            stamps = [datetime.fromisoformat(m[sort].replace("Z", "+00:00")) for m in models if isinstance(m.get(sort), str)]
            edge = bool(stamps) and min(stamps) < self.since
            for model in models:
                yield partition.name, page, arrival, page + 1 == self.pages and not edge, json.dumps(model), None
                arrival += 1
            if edge:
                return


class ModelSource(DataSource):
    """``spark.read.format("evidra_models")``: stored pages of a model hub, a partition per channel; a page that cannot be read is a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "evidra_models"

    def schema(self) -> str:
        return MODEL_SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _ModelReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(HitSource)
    spark.dataSource.register(ModelSource)


def news_search(spark: SparkSession, path: str, now: str, time_range: str = "day", max_results: int = 10) -> DataFrame:
    """Stored hits of the category ``news`` that are new enough."""
    options = {"path": path, "categories": "news", "time_range": time_range, "now": now, "max_results": str(max_results)}
    return spark.read.format(HitSource.name()).options(**options).load()
