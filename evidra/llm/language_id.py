"""Language identification by segmentation-marginalised unigram models.

A fixed public vocabulary gives pieces (byte strings of any length, the
single bytes among them). Every language has a probability for each piece, learned by expectation maximisation: the
expected uses of a piece, over all segmentations of the training words.
The probability of a word under a language is the sum over all its
segmentations, by the forward algorithm; the words of a text multiply.

Words are runs of letters, in lower case, encoded as UTF-8. In a batch of
texts each distinct word is scored once, and all words of about the same
length go through the algorithm together.

Training takes at most ``SAMPLE`` documents of each language, those with the
smallest hashes of their id, from rows that are not held out, and all words
of their whole texts (one text an id); scoring takes every row and its whole text. Language, source and id are never
inputs of a prediction.

Defined results: a text that is null or has no letter is ``und`` with
score 0, and so is every text if nothing could be learned; of languages
that score alike the first by name wins; equal texts get equal results;
rows alike stay separate rows; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_batches, tokenizer_path
from .quality import held_out

#: Texts of a language that training takes at most.
SAMPLE = 400
ROUNDS = 4
BATCH_BYTES = 8 << 20
#: Words longer than this go through the algorithm in one group, with scaling in every step.
LONG = 48


def load_pieces(path: str) -> list[bytes]:
    """Distinct pieces of a ``.tiktoken`` file, and all single bytes, sorted."""
    with open(path, "rb") as file:
        pieces = {base64.b64decode(line.split()[0]) for line in file if line.strip()}
    return sorted({p.strip(b" ") for p in pieces if p.strip(b" ")} | {bytes([i]) for i in range(256)})


@dataclass
class Pieces:
    """Pieces as numbers (bytes in base 257, so that lengths differ) in sorted order, and the tree of their prefixes.

    Node 0 is the empty prefix; the others are in the order of ``edges``,
    the number of the shorter prefix * 257 + last byte + 1.
    """

    keys: np.ndarray
    edges: np.ndarray
    #: Per node the number of the piece that ends there, or the number of pieces.
    ends: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        ordered = sorted(set(pieces), key=lambda p: (len(p), p))
        prefixes = sorted({p[:n] for p in ordered for n in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        node = {b"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        edges = np.array([node[p[:-1]] * 257 + p[-1] + 1 for p in prefixes], dtype=np.int64)
        ends = np.full(len(node), len(ordered), dtype=np.int64)
        ends[[node[p] for p in ordered]] = np.arange(len(ordered))
        return cls(np.array([_key(p) for p in ordered], dtype=object), edges, ends, max(map(len, ordered)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces' numbers; those of other strings are the number of pieces."""
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys, at, len(self.keys))


def _key(piece: bytes) -> int:
    key = 0
    for byte in piece:
        key = key * 257 + byte + 1
    return key


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and the text of each word."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^\\pL]+", " ")
    split = pc.split_pattern(pc.ascii_trim_whitespace(clean), " ")
    words = split.flatten().dictionary_encode()
    owner = pc.list_parent_indices(split).to_numpy()
    codes = words.indices.to_numpy()
    some = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    return words.dictionary, codes[some], owner[some]


def _groups(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Numbers of words of about the same length, their bytes as a matrix, and its width."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(w.as_buffer() for w in words), dtype=np.uint8)
    begins = np.cumsum(sizes) - sizes
    width = np.where(sizes <= LONG, -(-sizes // 4) * 4, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for w in np.unique(width[sizes > 0]):
        rows = np.flatnonzero((width == w) & (sizes > 0))
        step = max(1, 1_000_000 // int(w))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            longest = int(sizes[part].max())
            inside = np.arange(longest) < sizes[part][:, None]
            matrix = np.zeros((len(part), longest), dtype=np.int64)
            matrix[inside] = data[(begins[part][:, None] + np.arange(longest))[inside]].astype(np.int64) + 1
            yield part, matrix, longest


@dataclass
class Uses:
    """Where pieces of one length stand: word, first column and number, in order of columns."""

    length: int
    rows: np.ndarray
    begins: np.ndarray
    numbers: np.ndarray
    #: For each column the first use that begins there, and the number of uses.
    bounds: list[int]

    def at(self, begin: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[begin], self.bounds[begin + 1])
        return self.rows[part], self.numbers[part]


def _uses(matrix: np.ndarray, width: int, pieces: Pieces) -> list[Uses]:
    """All places of all pieces in the words, by length; the tree is followed from every byte."""
    out = []
    begins, rows = np.nonzero(matrix.T)
    node = np.zeros(len(rows), dtype=np.int64)
    for length in range(1, min(pieces.longest, width) + 1):
        inside = begins + length <= width
        rows, begins, node = rows[inside], begins[inside], node[inside]
        key = node * 257 + matrix[rows, begins + length - 1]
        at = np.searchsorted(pieces.edges, key)
        known = pieces.edges[np.minimum(at, len(pieces.edges) - 1)] == key
        rows, begins, node = rows[known], begins[known], at[known] + 1
        if not len(rows):
            break
        number = pieces.ends[node]
        whole = number < len(pieces.keys)
        if whole.any():
            out.append(Uses(length, rows[whole], begins[whole], number[whole], np.searchsorted(begins[whole], np.arange(width + 1)).tolist()))
    return out


def forward(matrix: np.ndarray, width: int, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probabilities of the words (rows of ``matrix``) under each language.

    ``table`` has a row of probabilities for each piece, and a row of zeros.
    For words above ``LONG`` every step divides the last sums by the largest
    one, whose logarithm is kept.
    """
    uses = _uses(matrix, width, pieces)
    most_bytes = max((u.length for u in uses), default=1)
    n, languages = len(matrix), table.shape[1]
    sums = [np.ones((n, languages))]  # the last ones first
    scale = np.zeros(n)
    logs = np.zeros((n, languages))
    for end in range(1, width + 1):
        total = np.zeros((n, languages))
        for u in uses:
            if u.length <= end and u.bounds[end - u.length] < u.bounds[end - u.length + 1]:
                rows, numbers = u.at(end - u.length)
                total[rows] += sums[u.length - 1][rows] * table[numbers]
        if width > LONG:
            most = np.maximum(total.max(axis=1), 1e-300)
            total /= most[:, None]
            sums = [s / most[:, None] for s in sums]
            scale += np.where(matrix[:, end - 1] > 0, np.log(most), 0.0)
        sums = [total, *sums[: most_bytes - 1]]
        here = matrix[:, end - 1] > 0
        logs[here] = np.log(np.maximum(total[here], 1e-300)) + scale[here][:, None]
    return logs


def _expected(matrix: np.ndarray, width: int, pieces: Pieces, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words (each counted ``weight`` times) under one language, by logarithms for words of any length."""
    log = np.log(probability)
    uses = _uses(matrix, width, pieces)
    n = len(matrix)
    ahead = np.full((n, width + 1), -np.inf)
    ahead[:, 0] = 0
    for end in range(1, width + 1):
        for u in uses:
            if u.length <= end and u.bounds[end - u.length] < u.bounds[end - u.length + 1]:
                rows, numbers = u.at(end - u.length)
                ahead[rows, end] = np.logaddexp(ahead[rows, end], ahead[rows, end - u.length] + log[numbers])
    sizes = (matrix > 0).sum(axis=1)
    back = np.full((n, width + 1), -np.inf)
    back[np.arange(n), sizes] = 0
    for begin in range(width - 1, -1, -1):
        for u in uses:
            if u.bounds[begin] < u.bounds[begin + 1]:
                rows, numbers = u.at(begin)
                back[rows, begin] = np.logaddexp(back[rows, begin], back[rows, begin + u.length] + log[numbers])
    whole = ahead[np.arange(n), sizes]
    found = np.zeros(len(pieces.keys))
    for u in uses:
        share = np.exp(ahead[u.rows, u.begins] + log[u.numbers] + back[u.rows, u.begins + u.length] - whole[u.rows])
        found += np.bincount(u.numbers, weights=share * weight[u.rows], minlength=len(found))
    return found


@dataclass
class Languages:
    """Names in order and the table of piece probabilities (a row per piece, a last row of zeros)."""

    names: list[str]
    pieces: Pieces
    table: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        words, codes, owner = words_of(texts)
        if not self.names or not len(codes):
            return ["und"] * len(texts), np.zeros(len(texts))
        per_word = np.zeros((len(words), len(self.names)))
        for part, matrix, width in _groups(words):
            per_word[part] = forward(matrix, width, self.pieces, self.table)
        total = np.stack([np.bincount(owner, weights=c[codes], minlength=len(texts)) for c in per_word.T], axis=1)
        best = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        score = 1 / share.sum(axis=1)
        some = np.bincount(owner, minlength=len(texts)) > 0
        return [self.names[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def estimate(words: pa.Array, count: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words and how often each occurs."""
    probability = np.full(len(pieces.keys), 1 / len(pieces.keys))
    for _ in range(rounds):
        uses = np.full(len(pieces.keys), 0.01)  # every piece stays possible in every language
        for part, matrix, width in _groups(words):
            uses += _expected(matrix, width, pieces, probability, count[part].astype(float))
        probability = uses / uses.sum()
    return probability


def languages_of(tables: dict[str, np.ndarray], pieces: Pieces) -> Languages:
    names = sorted(tables)
    table = np.stack([tables[n] for n in names], axis=1) if names else np.zeros((len(pieces.keys), 0))
    return Languages(names, pieces, np.r_[table, np.zeros((1, table.shape[1]))])


def count_words(texts: pa.Array, langs: pa.Array) -> pa.Table:
    """(lang, word, n): how often each word occurs in the texts of each language."""
    words, codes, owner = words_of(texts)
    kinds = langs.dictionary_encode()
    kind = kinds.indices.to_numpy()[owner] if len(codes) else np.zeros(0, dtype=np.int64)
    keys, number = np.unique(kind.astype(np.int64) * max(1, len(words)) + codes, return_counts=True)
    return pa.table({"lang": kinds.dictionary.take(pa.array(keys // max(1, len(words)))), "word": words.take(pa.array(keys % max(1, len(words)))), "n": pa.array(number, pa.int64())})


def learn(texts: list[str], langs: list[str], pieces: Pieces, rounds: int = ROUNDS) -> Languages:
    """Piece probabilities of every language from its texts."""
    counted = count_words(pa.array(texts, pa.string()), pa.array(langs, pa.string()))
    own = {lang: counted.filter(pc.equal(counted["lang"], lang)).sort_by("word").combine_chunks() for lang in set(langs)}
    return languages_of({lang: estimate(t["word"].combine_chunks(), t["n"].to_numpy(), pieces, rounds) for lang, t in own.items()}, pieces)


def training_ids(documents: DataFrame, sample: int, doc_id: str, lang: str) -> DataFrame:
    """(id, lang) of at most ``sample`` documents of each language that are not held out, those with the smallest hashes.

    Only ids whose hash is among the smallest for their language, by twice
    the share that is wanted and some more, are ever sorted together.
    """
    ids = documents.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND id IS NOT NULL")
    ids = ids.filter(~held_out(F.col("id"))).distinct().withColumn("hash", F.xxhash64("id"))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # the languages are the classes of the model, whose table goes to all tasks anyway
    share = ids.join(F.broadcast(sizes), "lang").filter((F.col("hash").cast("double") + 2.0**63) / 2.0**64 * F.col("n") < 2 * sample + 50)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    return share.withColumn("nth", nth).filter(F.col("nth") <= sample).select("id", "lang")


def fit(documents: DataFrame, sample: int = SAMPLE, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> Languages:
    """Languages from at most ``sample`` documents each, of rows that are not held out.

    Words are counted where the texts are; a task then estimates a language
    from the words and their numbers, and only the tables reach the driver.
    """
    pieces = Pieces.of(load_pieces(vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    chosen = training_ids(documents, sample, doc_id, lang).withColumnRenamed("lang", "of")
    found = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    # at most ``sample`` ids a language; of several texts of one id the one with the smallest hash
    found = found.join(F.broadcast(chosen), "id").filter("lang = of").groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            yield from count_words(batch["text"], batch["lang"]).to_batches()

    def learn_one(given: pa.Table) -> pa.Table:
        ordered = given.sort_by("word").combine_chunks()
        table = estimate(ordered["word"].combine_chunks(), ordered["n"].to_numpy(), pieces)
        return pa.table({"lang": [given["lang"][0].as_py()], "probability": pa.array([table.tobytes()], pa.binary())})

    counted = found.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = counted.groupBy("lang").applyInArrow(learn_one, "lang string, probability binary").collect()
    return languages_of({r.lang: np.frombuffer(bytes(r.probability)) for r in learned}, pieces)


def identify(documents: DataFrame, languages: Languages | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    known = languages or fit(documents, text=text, doc_id=doc_id)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            names, score = known.scores(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
