"""The pipeline against the stages' rules in plain Python."""

import re
from collections import Counter

import corpus_pipeline
from evidra.llm import mixing, quality
from test_models import brute_classes


def test_run_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.classify(documents, labels).collect()}
    docs = {r.doc_id: r for r in documents.collect() if scores[r.doc_id] >= quality.THRESHOLD}
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i].text or ""), i)
    docs = {i: docs[i] for i in first.values()}
    classes = brute_classes({i: d.text for i, d in docs.items()})
    docs = {i: d for i, d in docs.items() if classes[i] == i}
    kept = documents.filter(documents.doc_id.isin(list(docs)))
    times = {r.doc_id: 1 if r["size"] == 0 else -(-r.taken // r["size"]) for r in mixing.mix_sources(kept).collect()}
    want = Counter({i: t for i, t in times.items() if t})
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_stages_keep_columns_and_odd_rows(spark, odd, empty, sf):
    for frame in (odd, empty):
        docs = frame.select("doc_id", "text", "lang", "source", "n_chars")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert name == "bpe" or docs.columns == columns
