"""Which passages may stand in a text, whatever stands before them: a scan of every position.

Every passage is known by its head, as many of its first characters as
the largest of ``WIDTHS`` that it is long. Rolling hashes of all windows
of these widths are looked up among the hashes of the heads; the windows
found are given back as text, so a chance hit meets no passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Lengths of heads, in characters; each is twice the one before it.
WIDTHS = (1, 2, 4, 8, 16, 32, 64)
_BASE = 0x9E3779B97F4A7C15
_BITS = 20
#: Characters of a text that are hashed at a time.
PART = 1 << 18


def window_hashes(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Each width and the hashes of all windows of that width, by the character where they begin."""
    found = (np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    power = _BASE
    for width in WIDTHS:
        if len(text) < width:
            return
        yield width, found
        # the hash of a window twice as wide, modulo 2**64
        found = found[:-width] * np.uint64(power) + found[width:]
        power = power * power % (1 << 64)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def head_scanner(heads: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches (doc_id, text): the rows in which heads stand, with a list of these."""
    by_width = {w: [h for h in heads if len(h) == w] for w in WIDTHS}
    known: dict[int, np.ndarray] = {}
    for width, of in by_width.items():
        if of:
            known[width] = np.unique(np.concatenate([dict(window_hashes(h))[width] for h in of]))
    always = [""] if "" in heads else []
    widest = max(known, default=0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {}
        for width, hashes in known.items():
            marks[width] = np.zeros(1 << _BITS, dtype=bool)
            marks[width][_places(hashes)] = True
        for batch in batches:
            rows, lists = [], []
            for row, text in enumerate(batch["text"]):
                value = text.as_py()
                if value is None:
                    continue
                found = set(always)
                for start in range(0, len(value) if known else 0, PART):
                    part = value[start : start + PART + widest - 1]
                    for width, hashes in window_hashes(part):
                        if width > widest:
                            break
                        if width in known:
                            likely = np.flatnonzero(marks[width][_places(hashes)])
                            likely = likely[np.isin(hashes[likely], known[width])]
                            found.update(part[i : i + width] for i in likely.tolist())
                if found:
                    rows.append(row)
                    lists.append(sorted(found))
            kept = batch.select(["doc_id", "text"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "text", "heads"])

    return scan
