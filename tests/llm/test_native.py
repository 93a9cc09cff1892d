"""Exact dedup, sharding, mixing and line dedup against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import exact_dedup, line_dedup, mixing, quality, queries, sharding


def same(frame, other):
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    return key(frame) == key(other)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert same(queries.QUERIES[name](spark, sf).toPandas(), c.sql(queries.ORACLE[name]).df())


def test_exact_dedup(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    given = [(r.doc_id, norm(r.text)) for r in odd.collect()]
    for i, t in given:
        groups[t].append(i)
    want = Counter()
    for i, t in given:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_tree_has_no_effect_on_the_result(documents):
    a = exact_dedup.exact_dedup(documents, digits=16, rounds=3).toPandas()
    b = exact_dedup.exact_dedup(documents, digits=2, rounds=3).toPandas()
    assert same(a, b)


def test_runs_merge_level_by_level(documents):
    rows = exact_dedup.digest_rows(documents, digits=2, rounds=3)
    run = exact_dedup.first_runs(rows)
    given = Counter(bytes(r.digest) for r in rows.collect())
    start = {(r.piece, bytes(r.digest)) for r in rows.select("piece", "digest").collect()}
    counts = [run.count()]
    assert counts == [len(start)]
    for level in range(3):
        run = exact_dedup.exchange(run, level, 2)
        plan = run._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" in plan and "HashAggregate" not in plan.split("Exchange")[0]
        found = run.collect()
        counts.append(len(found))
        # a run now has one row per digest, in the piece that the digest's digits name: runs that still differ do so in higher digits
        assert len({(r.piece >> (level + 1), bytes(r.digest)) for r in found}) == len(found)
        assert len(found) == len({(p >> (level + 1), d) for p, d in start})
    assert counts[-1] == len(given) < counts[0] and counts == sorted(counts, reverse=True)
    assert {bytes(r.digest): r.group_size for r in found} == given


def test_a_large_group_of_copies(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 1 THEN 'same  text' ELSE concat('own ', id) END AS text", "'s' AS source")
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(rows).collect()}
    assert len(found) == 3000 and found[7].keep_id == 1 and found[7].group_size == 1000 and found[1].kept and not found[4].kept
    assert exact_dedup.drop_copies(rows).count() == 2001
    shards = sharding.assign_shards(rows.selectExpr("7L AS doc_id", "text"), shards=5).collect()  # one key for all rows
    assert len({r.shard for r in shards}) == 1 and sorted(r.slot for r in shards) == list(range(3000))


def test_rows_alike_in_id_and_text_give_the_same_one_again(spark):
    rows = [(1, "a  b", f"s{i}", {"k": i}) for i in range(20)]
    schema = "doc_id long, text string, source string, m map<string,int>"
    once = [tuple(r) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, schema)).collect()]
    again = [tuple(r) for r in exact_dedup.drop_copies(spark.createDataFrame(rows[::-1], schema).repartition(5)).collect()]
    assert once == again and len(once) == 1


def test_sharding(odd, empty):
    rows = sharding.assign_shards(odd, shards=3).collect()
    assert len(rows) == odd.count() and sharding.assign_shards(empty).count() == 0
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 3) and 0 <= r.shard < 3 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3]["size"] == 1 and by_id[3].text_crc32 is None
    assert by_id[7].text_crc32 == zlib.crc32(b"le chat noir dort sur la table")


def test_shards_grow_one_by_one(documents):
    parts = {n: {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(documents, n).collect()} for n in (7, 8)}
    assert all(parts[7][i][1] == parts[8][i][0] for i in parts[7])
    assert max(Counter(s for s, _ in parts[8].values()).values()) < 2 * len(parts[8]) / 8


def fill(sizes, weights, epochs):
    """Targets by giving out what is left again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        whole, extra = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / whole
            if target[s] >= epochs * sizes[s]:
                extra += target[s] - epochs * sizes[s]
                target[s] = epochs * sizes[s]
                open_.discard(s)
        left = extra
    return target


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_mixing(odd, empty, block):
    rows = mixing.mix_sources(odd, block_words=block).collect()
    assert len(rows) == odd.count() and mixing.mix_sources(empty).count() == 0
    sizes, taken = Counter(), Counter()
    source = {r.doc_id: r.source for r in odd.collect()}
    for r in odd.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = fill(sizes, (5, 2, 1), 3)
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_mix_is_applied(odd):
    mixed = mixing.apply_mix(odd)
    assert mixed.columns == odd.columns
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 6  # id 8 has two rows


def test_line_dedup(odd, empty, spark):
    rows = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(odd).collect()}
    assert line_dedup.dedup_lines(empty).count() == 0 and len(rows) >= 10
    passage = "\n".join(f"this is line number {i} of a shared passage" for i in range(5))
    docs = spark.createDataFrame([(1, f"own start\n{passage}\nown end"), (2, f"other\n\n{passage}\nlast line"), (3, "nothing shared")], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1].n_removed == 0 and out[2].text == "other\n\nlast line" and out[2].n_removed == 5 and out[3].n_removed == 0


def test_line_dedup_of_short_lines(spark):
    words = "\n".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"first\n{words}"), (2, f"second\n{words}\nend"), (3, "ok"), (4, "ok"), (5, "a\nb"), (6, "a\nb")], "doc_id long, text string")
    out = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {1: (0, f"first\n{words}"), 2: (60, "second\nend"), 3: (0, "ok"), 4: (1, ""), 5: (0, "a\nb"), 6: (2, "")}


def test_unequal_windows_with_the_same_first_hash_stay_apart(spark):
    rows = spark.createDataFrame([(i, f"line {i}\nnext {i}\nlast {i}") for i in range(50)], "doc_id long, text string")
    found = line_dedup.windows(rows).collect()
    assert len({r.w2 for r in found}) == 50
    # the second hash does not follow from the first
    again = spark.createDataFrame([(r.w1, r.w2) for r in found], "w1 long, w2 long").selectExpr("xxhash64(w1) AS a", "w2", "xxhash64(1, w1) AS b", "xxhash64(w1, 1) AS c").collect()
    assert not any(r.w2 in (r.a, r.b, r.c) for r in again)
    # and where the first hash agrees, the others still tell windows apart
    same_first = line_dedup.repeated_windows(spark.createDataFrame([(i, 0, 0, 7, i, 20) for i in range(9)] + [(9, 0, 0, 7, 3, 20), (10, 0, 0, 7, 3, 21)], "doc_id long, crc long, line int, w1 long, w2 long, n_bytes long"))
    assert [(r.w2, r.n_bytes) for r in same_first.collect()] == [(3, 20)]


#: Every name that an operator of this part uses inside, as a caller's column.
INNER = [
    "row", "sha", "keep", "piece", "digest", "n_bytes", "check", "text_sha256", "keep_id", "kept", "crc", "lines", "line", "w1", "w2", "first", "covered", "raw", "places", "gone", "part", "_spread", "_deal", "_group",
    "times", "copy", "taken", "size", "start", "goal", "slot", "rank", "words", "target", "source_no", "_text", "_score", "_id", "_of", "_raw", "_crc", "_places", "_gone", "_sha", "_times", "_copy", "n_lines", "n_removed", "quality", "node", "class_id",
]


def test_columns_with_the_names_of_working_columns_pass_through(spark, odd):
    rows = odd.select("doc_id", "text", "source", "lang", *(F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in INNER))
    given = {r.doc_id: r.asDict() for r in rows.collect()}
    forest = quality.train(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    from evidra.llm import near_dedup

    for frame in (exact_dedup.drop_copies(rows), mixing.apply_mix(rows), near_dedup.drop_near_copies(rows), quality.keep_scored(rows, forest, 0.0)):
        assert frame.columns == rows.columns
        found = frame.collect()
        assert found and all(r.asDict() == given[r.doc_id] for r in found)
    lines = line_dedup.dedup_lines(rows)
    assert lines.columns == [*(c for c in rows.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    skip = {"text", "n_lines", "n_removed"}
    found = lines.collect()
    assert len(found) == rows.count() and all({k: v for k, v in r.asDict().items() if k not in skip} == {k: v for k, v in given[r.doc_id].items() if k not in skip} for r in found)
