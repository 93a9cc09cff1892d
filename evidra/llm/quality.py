"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from the whole text in an Arrow function: shares
of character classes from byte counts, word lengths, and how often words,
pairs of words and lines repeat. The trees are grown on histograms of at
most ``BINS`` bins a statistic with Newton steps of the logistic loss, then
flattened into arrays, in which all rows of a batch walk down together.

Training takes a bounded sample of the labelled rows, ``SAMPLE`` of them
with the smallest hashes of their id; scoring takes every row. Labels,
language, source and id are never statistics.

Defined results: a null text counts as empty; an empty text has all
statistics 0 and gets the score that the trees give such a row; with no
labelled row at all every score is 0.5; with one class only, every score
is near that class; of several labels of one id the largest counts, labels
that are null or neither 0 nor 1 count nothing; of several rows with one
labelled id the one with the smallest statistics trains; equal texts get
equal scores; rows alike stay separate rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_batches, field, flat, nested

#: Labelled rows that training takes at most.
SAMPLE = 6000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
#: Score from which a document is predicted to be good.
THRESHOLD = 0.7
BATCH_BYTES = 2 << 20

STATISTICS = [
    "log_bytes", "upper", "lower", "digits", "blanks", "line_breaks", "high_bytes", "marks", "stops", "symbols", "pipes",
    "word_length", "distinct_words", "same_as_before", "same_as_two_before", "upper_words", "words_without_letters",
    "distinct_lines", "line_bytes", "word_tail_symbols", "byte_entropy",
]

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digits": range(48, 58),
    "blanks": [32, 9],
    "line_breaks": [10, 13],
    "high_bytes": range(128, 256),
    "marks": b"!?",
    "stops": b".,;:'\"-()",
    "symbols": b"#$%&*+/<=>@[\\]^_`{}~",
    "pipes": b"|",
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _n, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes), _n] = 1


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``starts``."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.float64)][starts])


def _distinct(codes: np.ndarray, starts: np.ndarray, known: int) -> np.ndarray:
    """Numbers of distinct codes between neighbouring ``starts``."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys = np.unique(owner * np.int64(max(known, 1)) + codes)
    return np.bincount(keys // max(known, 1), minlength=len(starts) - 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text, null like empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros((0, len(STATISTICS)))
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    begins = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(x.as_buffer() for x in texts), dtype=np.uint8)
    counts = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(begins[:-1], begins[1:], strict=True)])
    per_byte = 1 / np.maximum(sizes, 1)
    shares = (counts @ _CLASS_OF) * per_byte[:, None]
    p = counts * per_byte[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    split = pc.split_pattern_regex(pc.ascii_trim_whitespace(texts), "[\\x20\\x09-\\x0D]+")
    starts = split.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    words = split.flatten().dictionary_encode()
    distinct, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
    number = np.maximum(np.diff(starts), 1)
    has_upper = pc.match_substring_regex(distinct, "[A-Z]{2}").to_numpy(zero_copy_only=False)
    letterless = pc.invert(pc.match_substring_regex(distinct, "\\pL")).to_numpy(zero_copy_only=False)
    tail = pc.match_substring_regex(distinct, "[#$%&*!@^~|]$").to_numpy(zero_copy_only=False)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    first = np.zeros(len(codes), dtype=bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    same1 = np.r_[False, codes[1:] == codes[:-1]] & ~first
    same2 = np.r_[[False] * min(2, len(codes)), codes[2:] == codes[:-2]] & ~first & ~np.r_[False, first[:-1]]

    lines = pc.split_pattern(texts, "\n")
    line_starts = lines.offsets.to_numpy().astype(np.int64)
    line_starts = line_starts - line_starts[0]
    line_codes = lines.flatten().dictionary_encode()
    line_number = np.diff(line_starts)
    line_distinct = _distinct(line_codes.indices.to_numpy().astype(np.int64), line_starts, len(line_codes.dictionary))

    columns = [
        np.log1p(sizes), *shares.T,
        _sums(length[codes], starts) / number, _distinct(codes, starts, len(distinct)) / number, _sums(same1, starts) / number, _sums(same2, starts) / number,
        _sums(has_upper[codes], starts) / number, _sums(letterless[codes], starts) / number,
        line_distinct / line_number, np.log1p(sizes / line_number), _sums(tail[codes], starts) / number, entropy,
    ]
    out = np.stack(columns, axis=1)
    out[sizes == 0] = 0
    return out


@dataclass
class Forest:
    """Trees as parallel arrays; a leaf points to itself."""

    feature: np.ndarray
    border: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows walk down each tree together."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.border[at], self.below[at], self.above[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, smooth: float = 1.0, least: float = 1.0) -> Forest:
    """Grow trees on (x, y), y in 0 and 1."""
    n = len(y)
    feature, border, below, above, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(value)
        for array, item in ((feature, 0), (border, 0.0), (below, k), (above, k), (value, v)):
            array.append(item)
        return k

    positive = (y.sum() + 0.5) / (n + 1) if n else 0.5
    start = float(np.log(positive / (1 - positive)))
    borders = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T] if n else []
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T, strict=True)], axis=1) if n else np.zeros((0, 0), dtype=int)
    margin = np.full(n, start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        for f in range(binned.shape[1] if left else 0):
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, weights=g[rows], minlength=bins))[:-1]
            hl = np.cumsum(np.bincount(b, weights=h[rows], minlength=bins))[:-1]
            gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
            gain[(hl < least) | (hs - hl < least)] = 0
            if (k := int(gain.argmax())) < len(borders[f]) and gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] < 0:
            k = leaf(-rate * gs / (hs + smooth))
            margin[rows] += value[k]
            return k
        _, f, k = best
        node = leaf(0.0)
        feature[node], border[node] = f, float(borders[f][k])
        down = binned[rows, f] <= k
        below[node] = grow(rows[down], g, h, left - 1)
        above[node] = grow(rows[~down], g, h, left - 1)
        return node

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), depth))
    if not value:
        leaf(0.0)
    return Forest(np.array(feature), np.array(border), np.array(below), np.array(above), np.array(value), np.array(roots, dtype=int), start, depth)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Forest:
    """Trees from at most ``sample`` labelled rows that are not held out.

    The rows with the smallest hashes of their id are taken; their texts
    become statistics on the executors, and only these reach the driver.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).filter("_id IS NOT NULL AND quality IN (0, 1)")
    marked = marked.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    given = documents.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.join(F.broadcast(chosen), "_id")  # at most ``sample`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            x = statistics(batch["text"])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["quality"], lists], names=["id", "quality", "x"])

    id_type = given.schema["_id"].dataType.simpleString()
    drawn = given.mapInArrow(run, f"id {id_type}, quality int, x array<double>")
    # of several rows with one id the one with the smallest statistics, so that there are at most ``sample`` and reruns agree
    found = drawn.groupBy("id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("id")
    if not len(found):
        return train(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return train(np.array(found["x"].tolist()), found["quality"].to_numpy(dtype=float))


def _scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` (any columns, with ``body``, the text) with ``score`` in place of the text."""
    schema = StructType([f for f in rows.schema.fields if f.name != "body"]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "body", BATCH_BYTES):
            score = pa.array(forest.score(statistics(batch["body"])))
            rest = batch.drop_columns(["body"])
            yield pa.RecordBatch.from_arrays([*rest.columns, score], names=[*rest.schema.names, "score"])

    return rows.mapInArrow(run, schema)


def score_documents(documents: DataFrame, forest: Forest, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores of every row: doc_id, held_out, score, predicted."""
    scored = _scored(documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")), forest)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_scored(documents: DataFrame, forest: Forest, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents with a score of ``threshold`` or more, with their columns."""
    scored = _scored(nested(documents).withColumn("body", F.coalesce(field(text), F.lit(""))), forest)
    return flat(scored.filter(F.col("score") >= threshold), documents.columns)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return score_documents(documents, fit(documents, labels), threshold)


def drop_rejected(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted to be good, with their columns."""
    return keep_scored(documents, fit(documents, labels), threshold)
