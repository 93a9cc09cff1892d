"""The models, media and pipeline against plain Python that shares no code with them."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidra.llm import language_id, media, quality, queries
from evidra.llm.common import tokenizer_path
from test_models import brute_classes

SF = "/root/testdata/sf0.001"

# --- Quality --------------------------------------------------------------


def plain_statistics(text):
    data = (text or "").encode()
    if not data:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    words = re.split("[\x20\x09-\x0d]+", text.strip(" \t\n\v\f\r"))
    lines, n = text.split("\n"), len(words)
    share = lambda kinds: sum(chr(b) in kinds for b in data) / len(data)
    out = {
        "log_bytes": math.log1p(len(data)), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": share("abcdefghijklmnopqrstuvwxyz"), "digits": share("0123456789"), "blanks": share(" \t"),
        "line_breaks": share("\n\r"), "high_bytes": sum(b > 127 for b in data) / len(data), "marks": share("!?"), "stops": share(".,;:'\"-()"), "symbols": share("#$%&*+/<=>@[\\]^_`{}~"), "pipes": share("|"),
        "word_length": sum(map(len, words)) / n, "distinct_words": len(set(words)) / n, "same_as_before": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "same_as_two_before": sum(a == b for a, b in zip(words, words[2:], strict=False)) / n, "upper_words": sum(bool(re.search("[A-Z]{2}", w)) for w in words) / n,
        "words_without_letters": sum(not any(c.isalpha() for c in w) for w in words) / n, "distinct_lines": len(set(lines)) / len(lines), "line_bytes": math.log1p(len(data) / len(lines)),
        "word_tail_symbols": sum(bool(re.search("[#$%&*!@^~|]$", w)) for w in words) / n, "byte_entropy": -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()),
    }
    return out


def plain_score(forest, row):
    total = forest.start
    for root in forest.roots:
        at = root
        while forest.below[at] != at:
            at = forest.below[at] if row[forest.feature[at]] <= forest.border[at] else forest.above[at]
        total += forest.value[at]
    return 1 / (1 + math.exp(-total))


def test_quality_is_plain_statistics_and_plain_trees(spark, odd):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.fit(documents, labels)
    given = {r.doc_id: r.text for r in documents.collect()} | {f"odd {i}": r.text for i, r in enumerate(odd.collect())}
    rows = {k: plain_statistics(t) for k, t in given.items()}
    assert all(list(r) == quality.STATISTICS for r in rows.values())
    x = np.array([list(r.values()) for r in rows.values()])
    assert np.allclose(quality.statistics(pa.array(given.values(), pa.string())), x)
    scores = {r.doc_id: r for r in quality.score_documents(documents, forest).collect()}
    for (key, row) in zip(rows, x, strict=True):
        if key in scores:
            assert scores[key].score == pytest.approx(plain_score(forest, row)) and scores[key].predicted == int(scores[key].score >= 0.7)
            assert scores[key].held_out == (zlib.crc32(str(key).encode()) % 4 == 2)


def test_histogram_splits_are_the_best_ones():
    rng = np.random.default_rng(9)
    x = np.round(rng.random((300, 4)), 2)
    y = (x[:, 2] + 0.2 * rng.random(300) > 0.6).astype(float)
    forest = quality.train(x, y, trees=1, depth=1, rate=1.0, bins=64)
    p = (y.sum() + 0.5) / 301
    g, h = p - y, np.full(300, p * (1 - p))
    gains = {}
    for f in range(4):
        for border in np.unique(np.quantile(x[:, f], np.arange(1, 64) / 64)):
            left = x[:, f] <= border
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gains[f, border] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    root = forest.roots[0]
    assert gains[forest.feature[root], forest.border[root]] == pytest.approx(max(gains.values()))
    left = x[:, forest.feature[root]] <= forest.border[root]
    assert forest.value[forest.below[root]] == pytest.approx(-g[left].sum() / (h[left].sum() + 1))


def test_labels_that_disagree_and_rows_that_repeat(spark):
    text = lambda i: "good words stand here " * 5 if i % 2 else "### $$$ !!! " * 9
    documents = spark.createDataFrame([(i, text(i)) for i in range(60)] + [(3, "other text of the same id"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (5, None), (6, 7), (None, 1)], "doc_id long, quality int")
    one = quality.fit(documents, labels)
    two = quality.fit(documents.repartition(7), labels.repartition(3))
    assert np.array_equal(one.value, two.value) and np.array_equal(one.border, two.border)
    got = {r.doc_id: r.predicted for r in quality.score_documents(documents.filter("text like 'good%' or text like '#%'"), one).collect()}
    assert got == {i: i % 2 for i in range(60)}


# --- Language -------------------------------------------------------------

PIECES = [b"a", b"b", b"ab", b"ba", b"aba", b"c"]


def segmentations(word):
    if not word:
        return [[]]
    return [[p, *rest] for p in PIECES if word.startswith(p) for rest in segmentations(word[len(p) :])]


def plain_estimate(words, rounds):
    p = dict.fromkeys(PIECES, 1 / len(PIECES))
    for _ in range(rounds):
        uses = dict.fromkeys(PIECES, 0.01)
        for word, n in words.items():
            ways = [(s, math.prod(p[x] for x in s)) for s in segmentations(word)]
            for s, weight in ways:
                for x in s:
                    uses[x] += n * weight / sum(w for _, w in ways)
        p = {x: v / sum(uses.values()) for x, v in uses.items()}
    return p


def test_language_is_every_segmentation_counted(spark):
    texts = {"x": ["abab aba b", "ba ab abab"], "y": ["cab bb cc", "bab cc a"]}
    plain = {lang: plain_estimate(Counter(w.encode() for t in own for w in t.split()), language_id.ROUNDS) for lang, own in texts.items()}
    pieces = language_id.Pieces.of(PIECES)
    known = language_id.learn([t for own in texts.values() for t in own], [lang for lang, own in texts.items() for _ in own], pieces)
    for k, lang in enumerate(known.names):
        for piece, v in plain[lang].items():
            assert known.table[pieces.find(np.array([language_id._key(piece)]))[0], k] == pytest.approx(v)
    asked = ["abab", "cc bb", "A, b! c", "abababababab cab", "", "123", None, "aba aba cc"]
    rows = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), known).collect()
    for r in rows:
        words = re.findall("[a-z]+", (asked[r.doc_id] or "").lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {lang: sum(math.log(sum(math.prod(p[x] for x in s) for s in segmentations(w.encode()))) for w in words) for lang, p in plain.items()}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))


def test_training_takes_the_smallest_hashes_of_each_language(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'rare' ELSE 'often' END AS lang").union(spark.range(3000).selectExpr("5L", "'often'"))
    got = {(r.id, r.lang) for r in language_id.training_ids(rows, 100, "doc_id", "lang").collect()}
    hashed = {r.doc_id: r.h for r in spark.range(4000).selectExpr("id AS doc_id", "xxhash64(id) AS h").collect()}
    open_ = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = set()
    for lang, own in (("rare", [i for i in open_ if i % 3 == 0]), ("often", [i for i in open_ if i % 3])):
        want |= {(i, lang) for i in sorted(own, key=hashed.get)[:100]}
    assert got == want and len(got) == 200


# --- Media ----------------------------------------------------------------


def chunks(data, at, end):
    while at + 8 <= end:
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + size % 2


def plain_frames(avi):
    """Frames in the order of the file's list, found without its index."""
    (kind, start, end), *_ = chunks(avi, 0, len(avi))
    assert kind == b"RIFF" and avi[start : start + 4] == b"AVI "
    for kind, a, b in chunks(avi, start + 4, end):
        if kind == b"LIST" and avi[a : a + 4] == b"movi":
            return [avi[c:d] for k, c, d in chunks(avi, a + 4, b) if k == b"00dc"]
    return []


def plain_coefficients(jpeg):
    """Quantised coefficients of a grey baseline picture in the order of the stream, and the quantisers, bit by bit."""
    at, codes, quant = 2, {}, None
    while True:
        marker, size = jpeg[at + 1], struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant = list(body[1:65])
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xC4:
            while body:
                lengths, code, i = body[1:17], 0, 17
                table = codes.setdefault(body[0], {})
                for bits, n in enumerate(lengths, 1):
                    for _ in range(n):
                        table[bits, code] = body[i]
                        code, i = code + 1, i + 1
                    code <<= 1
                body = body[i:]
        elif marker == 0xDA:
            break
    stream = jpeg[at:-2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in stream)
    place = 0

    def symbol(table):
        nonlocal place
        code = 0
        for n in range(1, 17):
            code = code * 2 + int(bits[place])
            place += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError

    def value(n):
        nonlocal place
        raw = int(bits[place : place + n] or "0", 2)
        place += n
        return raw if not n or raw >> (n - 1) else raw - (1 << n) + 1

    blocks, dc = [], 0
    for _ in range((height // 8) * (width // 8)):
        dc += value(symbol(codes[0]))
        block, k = [dc] + [0] * 63, 1
        while k < 64:
            s = symbol(codes[16])
            if not s:
                break
            k += s >> 4
            if s & 15:
                block[k] = value(s & 15)
            k += 1
        blocks.append(block)
    return blocks, quant


def plain_picture(blocks, quant):
    """Samples of a 24 x 24 picture by the cosine sums of the standard."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    basis = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    out = np.zeros((24, 24))
    for n, block in enumerate(blocks):
        square = np.zeros((8, 8))
        for (i, j), v, q in zip(order, block, quant, strict=True):
            square[i, j] = v * q
        out[n // 3 * 8 :, n % 3 * 8 :][:8, :8] = basis.T @ square @ basis + 128
    return np.clip(out, 0, 255)


def plain_shots(pictures):
    bars = [Counter((p.ravel() // 16).tolist()) for p in pictures]
    cuts, past = [0], []
    for i in range(1, len(bars)):
        d = sum(abs(bars[i][k] - bars[i - 1][k]) for k in range(16)) / (2 * 576)
        recent = past[-8:]
        mean = sum(recent) / len(recent) if recent else 0
        if d > 0.25 and d > mean + 3 * math.sqrt(sum((x - mean) ** 2 for x in recent) / max(1, len(recent))):
            cuts.append(i)
            past = []
        else:
            past.append(d)
    return list(zip(cuts, [*cuts[1:], len(bars)], strict=True))


def test_media_files_are_read_by_a_plain_decoder(spark, odd):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(12).select("doc_id", "text").union(odd.filter("length(text) < 1000 or text is null").select("doc_id", "text"))
    rows = media.media_digests(documents).collect()
    texts = {}
    for r in documents.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    for r in rows:
        raw = next(t for t in texts[r.doc_id] if len(t) == r.n_bytes)
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        avi = media.store_bytes([padded])[0]
        assert (r.media_bytes, r.media_sha256) == (len(avi), hashlib.sha256(avi).hexdigest())
        frames = plain_frames(avi)
        decoded = [plain_coefficients(f) for f in frames]
        stored = b"".join(bytes(v - 1 for block in blocks for v in block) for blocks, _ in decoded)
        assert stored == padded and (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-32:]))
        own = [p for _, p in media.decode_frames(frames)]
        assert all(np.abs(a.reshape(24, 24) - plain_picture(*d)).max() <= 1 for a, d in zip(own, decoded, strict=True))
        clips = ",".join(f"{a * 40}-{b * 40}:{int(sum(p.astype(int).sum() for p in own[a:b])) // ((b - a) * 576)}" for a, b in plain_shots([p.reshape(24, 24) for p in own]))
        assert r.feature == f"frames={len(frames)} clips_ms_luma={clips}"


# --- Pipeline -------------------------------------------------------------


def test_pipeline_is_its_rules(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.fit(documents, labels)
    docs = {r.doc_id: r for r in documents.collect() if plain_score(forest, list(plain_statistics(r.text).values())) >= 0.7}
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", docs[i].text or ""), i)
    docs = {i: docs[i] for i in first.values()}
    classes = brute_classes({i: d.text for i, d in docs.items()})
    docs = {i: d for i, d in docs.items() if classes[i] == i}
    frame = pa.table({c: [d[c] for d in docs.values()] for c in documents.columns})
    connection = duckdb.connect()
    connection.register("documents", frame)
    mixed = connection.sql(queries.ORACLE["op4_source_mix"]).df()
    times = {int(r.doc_id): 1 if r["size"] == 0 else -(-int(r.taken) // int(r["size"])) for _, r in mixed.iterrows()}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for i, n in times.items():
        ids = library.encode(docs[i].text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and 0 < len(got) < documents.count()


def test_stages_give_the_rows_they_should_on_odd_rows(spark, odd, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(columns), SF).count() == 0, name
    given = odd.select(columns)
    by = dict(corpus_pipeline.STAGES)
    ids = lambda rows: sorted((str(r.doc_id), r.text or "") for r in rows.collect())
    every = ids(given)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    exact = [min((i for i, _ in group), key=lambda i: (i == "None", len(i), i)) for _, group in groupby(sorted(every, key=lambda r: norm(r[1])), key=lambda r: norm(r[1]))]
    assert sorted(i for i, _ in ids(by["exact_dedup"](spark, given, SF))) == sorted(exact)
    near = ids(by["near_dedup"](spark, given, SF))
    assert len(near) == len(every) - 2 and {"0", "3", "4", "5", "6", "7", "8", "10", "None"} == {i for i, _ in near}
    assert set(ids(by["quality"](spark, given, SF))) <= set(every)
    assert set(ids(by["mix"](spark, given, SF))) <= set(every)
    assert by["bpe"](spark, given, SF).count() == len(every)
    assert given.select(F.count("*")).first()[0] == len(every)
