"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are gathered into batches of about ``BATCH_BYTES`` bytes, whatever
their number. Each text is split at safe boundaries, where the encoder
cannot join what stands on both sides, so that a very long text becomes
many short pieces and a piece that occurs often in a batch is encoded
once. Only lengths leave the Arrow function.

* sentencepiece models: a single blank between two other characters is
  safe if no piece of the model has the blank's mark behind another
  character, and the model puts a blank before a text and leaves white
  space alone. Both are read from the model; otherwise texts stay whole.
  Next to the mark itself, and to what the model's normaliser turns into it,
  a blank is no boundary, since there are pieces of several marks.
* tokenizers files: texts stay whole.

Defined results: a null text counts as empty; an empty text has no tokens;
rows alike are counted one by one; ids are passed on unchanged; an empty
table gives an empty table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, tokenizer_path

#: Bytes of text in one batch.
BATCH_BYTES = 16 << 20
#: Pieces that are handed to the library at a time, so that their ids never fill the memory.
PIECES = 50_000

_MARK = "▁"


def blanks_of(path: str) -> str | None:
    """The characters that the tokenizer treats as a blank, the blank first, if single blanks are safe boundaries; else null.

    Safe means that tokens(a + " " + b) = tokens(a) + tokens(b) where a ends
    and b begins with another character than these.
    """
    if not path.endswith(".model"):
        return None
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(_MARK in processor.id_to_piece(i).lstrip(_MARK) for i in range(processor.get_piece_size())):
        return None
    probe = lambda text: processor.encode(text, out_type=str)
    if "".join(probe("  a  b ")) != f"{_MARK * 3}a{_MARK * 2}b{_MARK}" or probe("a b") != probe("a") + probe("b"):
        return None
    marked = lambda points: _MARK in processor.normalize("".join(f"a{c}b" for c in points)).lstrip(_MARK)
    points = [chr(i) for i in range(33, 0x110000) if not 0xD800 <= i < 0xE000]
    some = [points[i : i + 1000] for i in range(0, len(points), 1000)]
    return " " + "".join(c for part in some if marked(part) for c in part if marked(c))


def load_lengths(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def count_batch(texts: pa.Array, lengths: Callable[[list[str]], list[int]], blanks: str | None) -> np.ndarray:
    """Numbers of tokens of the texts of one batch; ``blanks`` as from ``blanks_of``."""
    if blanks is None:
        out: list[int] = []
        for text in texts.to_pylist():
            out += lengths([text])
        return np.array(out, dtype=np.int64)
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    owner = pc.list_parent_indices(split).to_numpy()
    # an empty word next to a blank marks a run of blanks, or one at an end: such texts are split more carefully, as are those with other blanks
    odd = np.zeros(len(texts), dtype=bool)
    if blanks[1:]:
        odd |= pc.match_substring_regex(texts, f"[{re.escape(blanks[1:])}]").to_numpy(zero_copy_only=False)
    empty = words.dictionary.index("").as_py()
    codes = words.indices.to_numpy()
    if empty >= 0:
        odd[owner[codes == empty]] = True
    used = np.zeros(len(words.dictionary), dtype=bool)
    used[codes[~odd[owner]]] = True
    known = np.zeros(len(words.dictionary), dtype=np.int64)
    numbers = np.flatnonzero(used)
    for start in range(0, len(numbers), PIECES):
        part = numbers[start : start + PIECES]
        known[part] = lengths(words.dictionary.take(pa.array(part)).to_pylist())
    counts = np.bincount(owner, weights=known[codes] * ~odd[owner], minlength=len(texts)).astype(np.int64)
    memo: dict[str, int] = {"": 0}
    safe = re.compile(f"(?<=[^{re.escape(blanks)}]) (?=[^{re.escape(blanks)}])")
    for i in np.flatnonzero(odd):
        pieces = safe.split(texts[i].as_py())
        new = [p for p in dict.fromkeys(pieces) if p not in memo]
        memo.update(zip(new, lengths(new), strict=True))
        counts[i] = sum(map(memo.__getitem__, pieces))
    return counts


def count_tokens(documents: DataFrame, model: str | None = None, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    blanks = blanks_of(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = load_lengths(path)
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            texts = batch["text"]
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            tokens = pa.array(count_batch(texts, lengths, blanks))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
