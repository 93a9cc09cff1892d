"""BPE encoding and decoding by a table of distinct words.

Texts are split at white space, and a word of Latin letters that ends in
common marks once more between letters and marks: the tokenizer's own
splitting never joins these sides. Every distinct word of the corpus is
encoded once (again at the border of two Arrow batches). The ids that a task
came upon meet their pieces in a join with the id-to-piece table; with these
its words are decoded, and ids and decoded words go back to their places.

A common word stands in very many texts, so places are not rows of their
own: texts are dealt by a hash into blocks of about ``BLOCK_BYTES`` bytes,
packed and compressed, a block asks for each of its distinct words once,
and the answers, packed alike, meet its texts by block. A word that is a
third of all places is one row per block. Blocks are dealt to as many
partitions as the session has, and a task takes its blocks one by one, so
that a block is what it holds, however large the input. Neither words nor
texts are broadcast; only the vocabulary, which is fixed, goes to every task.

Decoding joins the pieces the way the tokenizers library does for a file
without a decoder: with a blank between them. Special strings inside texts
are read as the library reads them, since a word goes through it whole.

Defined results: a null text counts as empty; a text without words has no
ids and decodes to an empty text; rows alike are encoded one by one (those
alike in id and text share a block); ids are passed on unchanged; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, tokenizer_path

#: Bytes of text in a block of texts, and in what a task works on at a time.
BLOCK_BYTES = 32 << 20
PART_BYTES = 1 << 20
#: Words that are handed to the library at a time.
WORDS = 20_000
#: How hard packed batches are compressed.
LEVEL = 5
#: Places of words that are gathered before they are packed by block.
PLACES = 200_000

#: Letters that stay single letters when normalised, and marks that stay what they are.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PARTS = f"^(?P<stem>[{_LETTERS}]+)(?P<tail>[.,;:!?#$%&*|]*)$"


class Words:
    """The words of a batch of texts.

    ``units`` are the distinct ones; ``codes`` their numbers at all places
    in order; text i has the places ``starts[i]`` to ``starts[i + 1]``.
    """

    def __init__(self, texts: pa.Array) -> None:
        split = pc.split_pattern_regex(texts, "[\\x20\\x09-\\x0D]+")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        chunks = split.flatten().dictionary_encode()
        parts = pc.extract_regex(chunks.dictionary, _PARTS)
        stems = pc.utf8_lower(pc.struct_field(parts, [0]))
        tails = pc.fill_null(pc.struct_field(parts, [1]), "")
        stems = pc.coalesce(stems, chunks.dictionary)
        both = pa.concat_arrays([stems, tails])
        units = pc.unique(both)
        self.units = units.filter(pc.not_equal(units, ""))
        number = pc.fill_null(pc.index_in(both, value_set=self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = chunks.indices.to_numpy()
        # stem and tail of every chunk side by side, those that are empty left out
        pairs = np.stack([number[: len(stems)][code], number[len(stems) :][code]], axis=1).ravel()
        some = pairs >= 0
        self.codes = pairs[some]
        self.starts = np.r_[0, np.cumsum(some)][2 * offsets]


def _load(path: str) -> object:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def piece_array(path: str) -> list[str]:
    """The pieces of the vocabulary with its added tokens, by id."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    pieces = {i: piece for piece, i in content["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"] for t in content["added_tokens"]}
    return [pieces.get(i, "") for i in range(max(pieces) + 1)]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the vocabulary."""
    return spark.createDataFrame(list(enumerate(piece_array(path))), "id int, piece string")


def decode_ids(rows: DataFrame, key: str, pieces: DataFrame, ids: str = "ids") -> DataFrame:
    """(key, decoded) for rows with an array of ids: a join with the id-to-piece table, pieces in order with blanks between."""
    each = rows.select(key, F.posexplode(ids).alias("at", "id"))
    joined = each.join(F.broadcast(pieces), "id")  # as many rows as the vocabulary has, whatever the input
    in_order = F.array_sort(F.collect_list(F.struct("at", "piece")))
    found = joined.groupBy(key).agg(F.array_join(F.transform(in_order, lambda s: s["piece"]), " ").alias("decoded"))
    return rows.select(key).distinct().join(found, key, "left").select(key, F.coalesce("decoded", F.lit("")).alias("decoded"))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(payloads: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The batches of the payloads."""
    for payload in payloads:
        with pa.ipc.open_stream(payload.as_buffer()) as source:
            yield from source


_ANSWER = pa.schema([("at", pa.int32()), ("ids", pa.list_(pa.uint32())), ("decoded", pa.string())])


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted (block, at, word) to a task's words, packed, and its distinct ids, one a row.

    A payload has a row per distinct word of a batch: its ids, and the
    blocks that ask for it with its number there.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, used = _load(path), TaskContext.get().partitionId(), np.zeros(0, dtype=bool)  # type: ignore[union-attr]
        for batch in batches:
            words = batch["word"].dictionary_encode()
            found = []
            for start in range(0, len(words.dictionary), WORDS):
                given = words.dictionary.slice(start, WORDS).to_pylist()
                found += [e.ids for e in tokenizer.encode_batch_fast(given, add_special_tokens=False)]  # type: ignore[attr-defined]
            ids = pa.array(found, pa.list_(pa.uint32()))
            flat = ids.flatten().to_numpy()
            used = np.pad(used, (0, max(0, int(flat.max(initial=0)) + 1 - len(used))))
            used[flat] = True
            code = words.indices.to_numpy()
            order = pa.array(np.argsort(code, kind="stable"))
            edges = pa.array(np.searchsorted(code[order.to_numpy()], np.arange(len(words.dictionary) + 1)).astype(np.int32))
            blocks, ats = (pa.ListArray.from_arrays(edges, batch[c].take(order)) for c in ("block", "at"))
            payload = _packed(pa.RecordBatch.from_arrays([ids, blocks, ats], names=["ids", "blocks", "ats"]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([payload], pa.binary()), pa.array([None], pa.int32())], names=["part", "payload", "id"])
        seen = np.flatnonzero(used).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part, pa.int32()), len(seen)), pa.nulls(len(seen), pa.binary()), pa.array(seen)], names=["part", "payload", "id"])

    return encode


def _decode(part: pa.Table) -> pa.Table:
    """Packed answers of blocks (at, ids, and the pieces with blanks between) from one task's words and the pieces of its ids."""
    known = part.filter(pc.is_valid(part["id"]))
    place_of = np.zeros(int(pc.max(known["id"]).as_py() or 0) + 1 if len(known) else 1, dtype=np.int64)
    place_of[known["id"].to_numpy()] = np.arange(len(known))
    piece = known["piece"].combine_chunks()
    held: list[pa.RecordBatch] = []
    out: list[tuple[int, bytes]] = []
    size = 0
    for batch in _unpacked(part["payload"].drop_null()):
        ids = batch["ids"]
        pieces = pa.ListArray.from_arrays(ids.offsets, piece.take(pa.array(place_of[ids.values.to_numpy()])))
        decoded = pc.binary_join(pieces, " ")
        word = pc.list_parent_indices(batch["ats"])
        held.append(pa.RecordBatch.from_arrays([batch["blocks"].flatten(), batch["ats"].flatten(), ids.take(word), decoded.take(word)], names=["block", *_ANSWER.names]))
        size += len(word)
        if size >= PLACES:
            out += _by_block(held)
            held, size = [], 0
    out += _by_block(held)
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "payload": pa.array([p for _, p in out], pa.binary())})


def _by_block(held: list[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    if not held:
        return
    table = pa.Table.from_batches(held)
    table = table.take(pc.sort_indices(table, [("block", "ascending"), ("at", "ascending")])).combine_chunks()
    block = table["block"].to_numpy()
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(block[a]), _packed(table.select(_ANSWER.names).slice(a, b - a).to_batches()[0])


def encode_documents(documents: DataFrame, model: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian binary), decoded."""
    return _encode(documents, model, text, doc_id, digests=False)


def encode_digests(documents: DataFrame, model: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _encode(documents, model, text, doc_id, digests=True)


def _encode(documents: DataFrame, model: str | None, text: str, doc_id: str, digests: bool) -> DataFrame:
    path = model or tokenizer_path("word_bpe_49k.json")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(blocks)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BLOCK_BYTES):
            order = np.argsort(batch["block"].to_numpy(), kind="stable")
            number = batch["block"].to_numpy()[order]
            edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                payload = _packed(batch.select(["doc_id", "text"]).take(pa.array(order[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array([number[a]], pa.int32()), pa.array([payload], pa.binary())], names=["block", "payload"])

    # one shuffle of the texts serves the asking and the answering below
    dealt = rows.withColumn("block", block).mapInArrow(pack, "block int, payload binary").repartition("block")

    def ask(key: tuple, packed: pa.Table) -> pa.Table:
        parts = [Words(batch["text"]).units for batch in byte_batches(_unpacked(packed["payload"]), "text", PART_BYTES)]
        units = pc.unique(pa.chunked_array(parts, pa.string()))
        units = units.take(pc.sort_indices(units))
        return pa.table({"block": pa.repeat(pa.scalar(key[0].as_py(), pa.int32()), len(units)), "at": pa.array(np.arange(len(units), dtype=np.int32)), "word": units})

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, at int, word string")
    words = asked.repartition("word").sortWithinPartitions("word").mapInArrow(_encoder(path), "part int, payload binary, id int")
    # as many rows as the vocabulary has, whatever the input
    known = words.join(F.broadcast(piece_table(documents.sparkSession, path)), "id", "left").select("part", "payload", "id", "piece")
    answers = known.groupBy("part").applyInArrow(_decode, "block int, payload binary")

    schema = f"doc_id {id_type}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]

    def place(packed: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list[pa.Array]] = [[], [], [], []]
        # of each part only its ids, the numbers of its words and its distinct words are held
        parts, found = [], []
        for batch in byte_batches(_unpacked(packed["payload"]), "text", PART_BYTES):
            words = Words(batch["text"])
            parts.append((batch["doc_id"], words.codes.astype(np.int32), words.starts))
            found.append(words.units)
        numbers, units = [len(x) for x in found], pa.concat_arrays(found)
        del found
        units = units.dictionary_encode()
        rank = np.empty(len(units.dictionary), dtype=np.int64)
        rank[pc.sort_indices(units.dictionary).to_numpy()] = np.arange(len(rank))
        number_of = rank[units.indices.to_numpy()]
        del units
        answer = pa.Table.from_batches(_unpacked(known["payload"]), _ANSWER).combine_chunks()
        answer = answer.take(pc.sort_indices(answer["at"]))
        if not np.array_equal(answer["at"].to_numpy(), np.arange(len(rank))):
            raise ValueError("a block's answers do not match its words")
        lists = answer["ids"].combine_chunks()
        begin, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        begin, size = begin[:-1], np.diff(begin)
        pieces = answer["decoded"].combine_chunks()
        del answer, lists
        first = 0
        for (doc_ids, codes, starts), own in zip(parts, numbers, strict=True):
            code = number_of[first : first + own][codes]
            first += own
            number = size[code]
            ends = np.r_[0, np.cumsum(number)]
            ids = flat[np.repeat(begin[code] - ends[:-1], number) + np.arange(ends[-1])]
            bounds = ends[starts]
            # words that have no ids leave no blank
            some = number > 0
            spots = np.r_[0, np.cumsum(some)][starts]
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(spots.astype(np.int32)), pieces.take(pa.array(code[some]))), " ")
            raw = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            out[0].append(doc_ids)
            out[1].append(pa.array(np.diff(bounds), pa.int64()))
            if digests:
                out[2].append(pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()))
                out[3].append(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()))
            else:
                out[2].append(pa.array(raw, pa.binary()))
                out[3].append(decoded)
        return pa.table([pa.chunked_array(c) for c in out], names=names)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, schema)
