"""Near dedup, classifiers, tokens and media against brute force, libraries and round trips."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from evidra.llm import bpe, language_id, media, near_dedup, quality, token_counts
from evidra.llm.common import cut, tokenizer_path


def brute_classes(texts, least=0.8):
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def test_near_dedup_is_brute_force(documents):
    want = brute_classes({r.doc_id: r.text for r in documents.collect()})
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(documents).collect()}
    assert got == want


def test_near_dedup_odd(odd, empty):
    got = {}
    rows = near_dedup.near_dedup(odd).collect()
    for r in rows:
        got[r.doc_id] = r
    assert len(rows) == odd.count() and near_dedup.near_dedup(empty).count() == 0
    assert got[1].class_id == 0 and got[2].class_id == 0 and got[2].class_size == 3 and not got[2].kept
    assert got[3].kept and got[4].kept and got[6].kept and got[3].class_size == 1


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.gamma(1.0, 1.0, 300), rng.gamma(1.0, 1.0, 300)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    both = near_dedup.dart_signatures(np.r_[elements, elements], np.r_[a, b], np.repeat([0, 1], 300), 2, 2000)
    assert abs((both[0] == both[1]).mean() - want) < 0.05


def test_tiles_find_every_link_of_a_large_bucket():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, 100, dtype=np.uint32)
    sets = [np.unique(np.r_[base[: 100 - i % 12], rng.integers(0, 2**32, i % 12, dtype=np.uint32)]) for i in range(60)]
    group = near_dedup.tile_groups(sets, np.zeros(60, dtype=int), 0.8)
    want = sum(len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for x, y in combinations(sets, 2))
    assert want > 60 and not group.any()
    links = near_dedup._star([bytes([59 - i]) for i in range(60)], group)
    assert sorted(links) == [(b"\0", bytes([i])) for i in range(1, 60)]
    two = near_dedup.tile_groups([base, base[:90], base[:85], base[5:]], np.array([0, 1, 1, 0]), 0.8)
    assert two.tolist() == [0, 0, 0, 0]
    assert near_dedup.tile_groups([base, base[:50], base[50:]], np.array([0, 1, 1]), 0.8).tolist() == [0, 1, 2]


def chains(n):
    """Texts of which neighbours are near copies, so that the ends of a chain are unlike: they all hang together only through those between."""
    words = [f"w{i}" for i in range(100 + 2 * n)]
    return [" ".join(words[2 * i : 2 * i + 100]) for i in range(n)]


def test_blocks_and_nodes_left_over_lose_no_link(spark, monkeypatch):
    texts = chains(70) + [t + " and more" for t in chains(70)[:30]] + [f"quite another text number {i} with words of its own" for i in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 3)
    want = brute_classes(dict(enumerate(texts)))
    assert len(set(want.values())) == 11
    drawn = near_dedup.sketch(rows).cache()
    names = {bytes(r.node): r.doc_id for r in drawn.collect()}
    buckets = drawn.selectExpr("node", "explode(array(1L, 2L)) AS bucket")  # all nodes in one bucket, twice
    links = near_dedup.find_links(buckets, lambda some: drawn.join(some, "node", "left_semi").select("node", "shingles"), 0.8)
    roots = {bytes(r.node): bytes(r.root) for r in near_dedup.components(links).collect()}
    found = {i: roots.get(n, n) for n, i in names.items()}
    assert all((found[i] == found[j]) == (want[i] == want[j]) for i, j in combinations(found, 2))
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(rows).collect()} == want


def test_components_of_long_chains(spark):
    pairs = [(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(300) if i % 100 != 99]
    links = spark.createDataFrame(pairs, "lo binary, hi binary")
    found = {int.from_bytes(r.node): int.from_bytes(r.root) for r in near_dedup.components(cut(links)).collect()}
    assert found == {i: i // 100 * 100 for i in range(301) if i % 100 and i < 300}
    assert near_dedup.components(cut(links.limit(0))).count() == 0


def test_quality(spark, sf, odd, empty):
    documents, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and held.predicted[held.quality == 1].mean() > 0.98
    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]
    forest = quality.fit(documents, labels)
    out = quality.score_documents(odd, forest).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all()
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).toPandas().score.eq(0.5).all()
    assert quality.keep_scored(odd, forest, 0.0).columns == odd.columns and quality.keep_scored(odd, forest, 0.0).count() == odd.count()


def test_trees_fit_what_lines_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((800, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.train(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_language_pieces_and_words_of_any_length():
    all_pieces = language_id.load_pieces(language_id.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    pieces = language_id.Pieces.of(all_pieces)
    assert max(map(len, all_pieces)) == 33 and len(pieces.keys) > 45_000
    known = language_id.learn(["漢字" * 30, "かな" * 30], ["zh", "ja"], pieces)
    assert known.table[:-1].max() > 100 / len(all_pieces)  # not the uniform start
    assert known.scores(pa.array(["漢字" * 40, "かな" * 40]))[0] == ["zh", "ja"]
    few = language_id.Pieces.of([b"a", b"b", b"abababab"])
    uses = language_id._expected(np.array([[98 - (i + 1) % 2 + 1 for i in range(8)]]), 8, few, np.array([0.25, 0.25, 0.5]), np.ones(1))
    whole = 0.5 / (0.5 + 0.25**8)
    assert uses == pytest.approx([4 * (1 - whole), 4 * (1 - whole), whole])


def test_language_id(spark, odd, empty):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and rows.score.between(0, 1).all()
    known = language_id.fit(documents)
    out = language_id.identify(odd, known).toPandas()
    assert len(out) == odd.count() and out[out.doc_id.isin([3, 4, 6])].lang_pred.eq("und").all()
    assert language_id.identify(empty).count() == 0
    names, scores = known.scores(pa.array(["a" * 100_000, "é" * 3000, None]))
    assert names[2] == "und" and all(0 <= s <= 1 for s in scores)


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces.of([b"a", b"b", b"ab", b"ba"])
    p = dict(zip([b"a", b"b", b"ab", b"ba"], [0.4, 0.3, 0.2, 0.1], strict=True))
    table = np.zeros((5, 1))
    for piece, v in p.items():
        table[pieces.find(np.array([language_id._key(piece)]))[0]] = v

    def total(word):
        return 1.0 if not word else sum(v * total(word[len(piece) :]) for piece, v in p.items() if word.startswith(piece))

    for word in (b"abab", b"bba", b"ab" * 40):
        matrix = np.array([[c + 1 for c in word]])
        assert language_id.forward(matrix, len(word), pieces, table)[0, 0] == pytest.approx(np.log(total(word) if len(word) < 10 else dynamic(word, p)))


def dynamic(word, p):
    sums = [1.0]
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[end - len(piece)] * v for piece, v in p.items() if word[:end].endswith(piece)))
    return sums[-1]


def test_token_counts(documents, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for frame in (documents, odd):
        texts = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in frame.collect())
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame).collect()) == texts
    assert token_counts.count_tokens(empty).count() == 0
    path = tokenizer_path("piece_bpe_32k.model")
    lengths, blanks = token_counts.load_lengths(path), token_counts.blanks_of(path)
    assert blanks == " ▁" and token_counts.blanks_of(tokenizer_path("word_bpe_49k.json")) is None
    strange = ["", " ", "a  b", " a b ", "a\n b", "x▁y z", "▁ 1", "▁ ▁", "a ▁ b", "<s> a </s>", "　a b", "é è  ", "tab\t tab"]
    rng = np.random.default_rng(11)
    bits = [" ", "▁", "  ", "a", "1", "the", "\u3000", "\n", "é", "<s>", "。", "\u00a0", "\U0001f600", "\u200b", "▁▁▁", "."]
    strange += ["".join(rng.choice(bits, size)) for size in rng.integers(1, 12, 20_000)]
    assert token_counts.count_batch(pa.array(strange), lengths, blanks).tolist() == [len(library.encode(t)) for t in strange]


def test_bpe(documents, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for frame in (documents, odd):
        want = []
        for r in frame.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(frame).collect()]
        assert sorted(got) == sorted(want)
    assert bpe.encode_digests(empty).count() == 0
    whole = {r.doc_id: r for r in bpe.encode_documents(odd).collect()}
    assert whole[7].decoded == library.decode(np.frombuffer(whole[7].ids, dtype="<u4").tolist(), skip_special_tokens=False)


def test_bpe_of_blocks_in_parts(spark):
    """More text than ``PART_BYTES``: numbers of words must agree between the parts of a block."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    given = {r.doc_id: r.text or "" for r in frame.collect()}
    assert sum(map(len, given.values())) > bpe.PART_BYTES
    rows = {r.doc_id: r for r in bpe.encode_digests(frame).collect()}
    assert rows.keys() == given.keys()
    for i, encoded in zip(given, library.encode_batch(list(given.values()), add_special_tokens=False), strict=True):
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(encoded.ids, dtype="<u4").tobytes()).hexdigest()


def test_bpe_words_are_safe():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    strange = ["Ünder... İx. don't, 'S o'clock! áb. İ. x\x0by z<|startoftext|>! ﬁne; ÀÖ|| 12,3. é, J̌. ẞ!"]
    words = bpe.Words(pa.array(strange))
    ids = [i for c in words.codes for i in library.encode(words.units[int(c)].as_py(), add_special_tokens=False).ids]
    assert ids == library.encode(strange[0], add_special_tokens=False).ids


def test_decode_by_join(spark):
    path = tokenizer_path("word_bpe_49k.json")
    pieces = bpe.piece_array(path)
    rows = spark.createDataFrame([(1, [320, 5, 320]), (2, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode_ids(rows, "k", bpe.piece_table(spark, path)).collect()}
    assert got == {1: " ".join(pieces[i] for i in (320, 5, 320)), 2: ""}


def test_media_round_trip(odd, empty):
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes() for n in (1, 3, 7)] + [b"\xff" * 576, b"\0" * 576]
    for payload, data in zip(payloads, media.store_bytes(payloads), strict=True):
        _, frames = media.read_avi(data)
        stored = b"".join((c.ravel() - 1).astype(np.uint8).tobytes() for c, _ in media.decode_frames(frames))
        assert stored == payload
    rows = media.media_digests(odd).collect()
    assert len(rows) == odd.count() and media.media_digests(empty).count() == 0
    for r in rows:
        raw = next(((x.text or "").encode() for x in odd.collect() if x.doc_id == r.doc_id), b"")
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def test_clips(spark):
    dark, light = np.full((6, 576), 3, dtype=np.uint8), np.full((5, 576), 3, dtype=np.uint8)
    light[:, ::64] = 200
    good = media.write_avi(media.encode_frames(np.r_[dark, light]))
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "media_id long, content binary")
    out = media.media_clips(rows).collect()
    first = sorted((r.clip, r.start_frame, r.end_frame, r.end_s) for r in out if r.media_id == 1)
    assert first == [(0, 0, 6, 0.24), (1, 6, 11, 0.44)]
    assert all(r.error for r in out if r.media_id != 1)


def test_more_kinds_of_files(spark, monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, (6, 576), dtype=np.uint8)
    stored = lambda frames: [(c.ravel() - 1).astype(np.uint8).tobytes() for c, _ in media.decode_frames(frames)]
    frames = media.encode_frames(data)
    listed = lambda part: b"".join(media._chunk(b"00dc", f) for f in part)
    more = media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + listed(frames[2:4])))
    last = media._chunk(b"RIFF", b"AVIX" + media._chunk(b"LIST", b"movi" + media._chunk(b"LIST", b"rec " + listed(frames[4:5])) + media._chunk(b"LIST", b"rec " + listed(frames[5:]))))
    assert media.read_avi(media.write_avi(frames[:2]) + more + last)[1] == frames
    # a frame without data shows the one before it once more
    again = media.write_avi([frames[0], b"", b"", frames[1]])
    assert stored(media.read_avi(again)[1]) == [data[i].tobytes() for i in (0, 0, 0, 1)]
    assert media.media_clips(spark.createDataFrame([(1, bytearray(media.write_avi([b"", frames[0]])))], "media_id long, content binary")).first().error == "the first frame is empty"
    # two pictures below each other, with a restart between them
    head = media._HEADER.replace(media.struct.pack(">HH", 24, 24), media.struct.pack(">HH", 48, 24))
    head = head[:2] + media._segment(0xDD, b"\0\x09") + head[2:]
    coded = [f[len(media._HEADER) : -2] for f in frames]
    tall = head + coded[0] + b"\xff\xd0" + coded[1] + b"\xff\xd9"
    assert stored([tall]) == [data[:2].tobytes()]
    # the standard's tables, and none in the file
    codes = [media._canonical(*map(list, media._STANDARD[t])) for t in (0, 16)]
    monkeypatch.setattr(media, "_DC_CODES", codes[0])
    monkeypatch.setattr(media, "_AC_CODES", {k: v for k, v in codes[1].items() if k < 16})
    tables = media._HEADER[media._HEADER.index(b"\xff\xc4") : media._HEADER.index(b"\xff\xda")]
    bare = [f.replace(tables, b"") for f in media.encode_frames(data)]
    assert len(bare[0]) < len(media.encode_frames(data)[0]) and stored(bare) == [d.tobytes() for d in data]
    for number in (16, 17):
        lengths, symbols = media._STANDARD[number]
        assert sum(lengths) == len(symbols) == len(set(symbols)) == 162
    rows = spark.createDataFrame([(1, bytearray(media.write_avi(bare)))], "media_id long, content binary")
    assert all(r.error is None for r in media.media_clips(rows).collect())


def test_cosine_transform():
    block = np.zeros((1, 9, 64), dtype=np.int32)
    block[0, :, 0] = 80  # 80 / 8 above the middle
    header = media.read_header(media.encode_frames(np.zeros((1, 576), dtype=np.uint8))[0])
    assert (media._pictures(header, block, (3, 3)) == 138).all()
    assert media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(media.ZIGZAG) == list(range(64))
