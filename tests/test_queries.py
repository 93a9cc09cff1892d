"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pandas as pd
import pytest

from evidra.plans import ORACLE, QUERIES
from evidra.plans.base import TABLES


def rows(frame):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "-"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_fetched_pages_with_entities_that_are_cut_off(spark, tmp_path):
    """Titles cut inside an entity, names that only begin like one, and whole entities."""
    heads = ["Salt &amp", "Salt &am", "Salt &quot pepper", "&copyright", "&notit;", "Salt &amp;amp", "&amp;lt; &lt;b&gt; &#39;&quot;&middot;&copy;", "&&amp;&", "plain"]
    pages = [(i * 55 + k, f"https://a.example.com/{i}/{k}", f"<html><title>{h}</title><article><h1>{h}</h1> and {h} so</article></html>") for i, h in enumerate(heads) for k in range(5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["fetched_pages"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(duck.sql(ORACLE["fetched_pages"]).df())
    assert {"Salt &amp", "&notit;", "&lt; <b> '\"·©"} <= set(got["title"])
