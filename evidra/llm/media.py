"""Media columns: AVI motion-JPEG files in a binary column become timed clip rows.

Reading a file: the RIFF lists give the frame time and the index the place
of every frame; each frame is a baseline JPEG picture (sequential, Huffman
coded, 8 bits, one to three components, any sampling). Frames with the same
header are decoded together: one step reads one symbol of each frame, so
the work is in arrays, not in bytes. Luminance pictures give histograms of
``BINS`` bins; a shot ends where the difference of neighbouring histograms
exceeds ``FLOOR`` and the mean of the last ``MEMORY`` differences of the
shot by ``SPREAD`` standard deviations. Shots are the clips.

Bytes can be stored in such a file without loss. A picture of 24 x 24
samples has 9 blocks of 64 quantised coefficients, which the format itself
codes without loss: coefficient = byte + 1, quantiser 1, so that 576 bytes
are one frame. The unit of the format that holds a byte is thus the
quantised coefficient, and the samples follow from it by the cosine
transform. All arithmetic is on whole numbers below 2**53, so that equal
bytes give equal features whatever the batch.

Defined results: a null text counts as empty and becomes one frame of
bytes 255; a null or unreadable file gives one clip row with ``error``
filled and no times; a file without frames gives no row but that; rows
alike are handled one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches

SIDE = 24
FRAME_BYTES = SIDE * SIDE
FRAME_MICROS = 40_000
BINS = 16
FLOOR = 0.25
SPREAD = 3.0
MEMORY = 8
BATCH_BYTES = 2 << 20


def _zigzag() -> np.ndarray:
    """The place in a block, row by row, of each coefficient in zigzag order."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    return np.array([8 * i + j for i, j in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))])


ZIGZAG = _zigzag()
#: Cosine transform in whole numbers: row u, column x, times 2**12.
_COS = np.array([[round(4096 * (np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)) for x in range(8)] for u in range(8)], dtype=np.float64)


def _canonical(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol; ``lengths`` counts the codes of 1, 2, ... bits."""
    codes, code, at = {}, 0, 0
    for bits, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[symbols[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return codes


# Own code tables: differences of the first coefficients have 4-bit codes, and the sizes of the others
# (bits of byte + 1) go from 1 bit for the most frequent one in text to 9 bits.
_DC_LENGTHS, _DC_SYMBOLS = [0, 0, 0, 10] + [0] * 12, list(range(10))
_AC_LENGTHS, _AC_SYMBOLS = [1] * 9 + [0] * 7, [7, 6, 8, 5, 4, 9, 3, 2, 1]
_DC_CODES, _AC_CODES = _canonical(_DC_LENGTHS, _DC_SYMBOLS), _canonical(_AC_LENGTHS, _AC_SYMBOLS)


#: Code tables of annex K by number (16 on: all but the first coefficients): counts of codes by length, symbols.
_STANDARD = {
    0: (bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))),
    1: (bytes.fromhex("00030101010101010101010000000000"), bytes(range(12))),
    16: (
        bytes.fromhex("0002010303020403050504040000017d"),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    17: (
        bytes.fromhex("00020102040403040705040400010277"),
        bytes.fromhex(
            "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
            "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
            "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}
_RESTART = re.compile(b"\xff[\xd0-\xd7]")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\0" + bytes(_DC_LENGTHS) + bytes(_DC_SYMBOLS))
    + _segment(0xC4, b"\x10" + bytes(_AC_LENGTHS) + bytes(_AC_SYMBOLS))
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def encode_frames(data: np.ndarray) -> list[bytes]:
    """JPEG pictures of rows of 576 bytes."""
    n = len(data)
    values = data.reshape(n, -1, 64).astype(np.int64) + 1
    values[:, 1:, 0] -= data.reshape(n, -1, 64)[:, :-1, 0].astype(np.int64) + 1
    values = values.reshape(n, FRAME_BYTES)
    size = np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)
    first = np.arange(FRAME_BYTES) % 64 == 0
    code_of = np.zeros((2, 16), dtype=np.int64)
    bits_of = np.zeros((2, 16), dtype=np.int64)
    for row, codes in enumerate((_DC_CODES, _AC_CODES)):
        for symbol, (code, bits) in codes.items():
            code_of[row, symbol], bits_of[row, symbol] = code, bits
    kind = np.where(first, 0, 1)[None, :]
    extra = np.where(values >= 0, values, values + (1 << size) - 1)
    code = (code_of[kind, size] << size) | extra
    bits = bits_of[kind, size] + size
    # each frame ends in one-bits up to a whole byte
    pad = -bits.sum(axis=1) % 8
    code = np.c_[code, (1 << pad) - 1]
    bits = np.c_[bits, pad]
    length = bits.sum(axis=1) // 8
    words = -(-length // 8)
    begin = np.cumsum(words) - words
    at = (np.cumsum(bits, axis=1) - bits + begin[:, None] * 64).ravel()
    code, bits = code.ravel().astype(np.uint64), bits.ravel()
    code, at, bits = code[bits > 0], at[bits > 0], bits[bits > 0]
    word, free = at >> 6, 64 - (at & 63) - bits
    over = free < 0
    head = np.where(over, code >> np.where(over, -free, 0).astype(np.uint64), code << np.where(over, 0, free).astype(np.uint64))
    buffer = np.zeros(int(words.sum()) + 1, dtype=np.uint64)
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    buffer[word[start]] = np.bitwise_or.reduceat(head, start)
    buffer[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
    raw = buffer.astype(">u8").view(np.uint8)
    # a byte 255 is followed by 0
    inside = np.arange(len(raw)) < 0
    for b, k in zip(begin * 8, length, strict=True):
        inside[b : b + k] = True
    raw = raw[inside]
    full = raw == 255
    out = np.zeros(len(raw) + int(full.sum()), dtype=np.uint8)
    out[np.arange(len(raw)) + np.cumsum(full) - full] = raw
    ends = np.cumsum(length)
    ends = ends + np.r_[0, np.cumsum(full)][ends]
    data_bytes = out.tobytes()
    return [_HEADER + data_bytes[a:b] + b"\xff\xd9" for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, micros: int = FRAME_MICROS) -> bytes:
    """An AVI file of JPEG pictures with an index."""
    largest = max(map(len, frames), default=0)
    head = _chunk(b"avih", struct.pack("<14I", micros, 0, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0))
    stream = _chunk(b"strh", struct.pack("<4s4sIHHIIIIIIiI4h", b"vids", b"MJPG", 0, 0, 0, 0, micros, 1_000_000, 0, len(frames), largest, -1, 0, 0, 0, width, height))
    stream += _chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0))
    index, movi, at = [], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(chunk)
        at += len(chunk)
    lists = _chunk(b"LIST", b"hdrl" + head + _chunk(b"LIST", b"strl" + stream)) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + lists)


def _segment_frames(data: bytes, movi: tuple[int, int], index: bytes | None) -> list[bytes]:
    """The frames of one RIFF segment, by its index or, without one, as they stand in its list and the ``rec`` lists in it."""
    frames = []
    if index is not None:
        entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
        shown = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        # offsets count from the list's name, in some files from the file's start
        base = movi[0] if not shown or data[movi[0] + shown[0][2] : movi[0] + shown[0][2] + 4] == shown[0][0] else 0
        for _, _, offset, size in shown:
            frames.append(data[base + offset + 8 : base + offset + 8 + size])
        return frames
    at, end = movi[0] + 4, movi[0] + movi[1]
    while at + 8 <= end:
        if data[at : at + 4] == b"LIST" and data[at + 8 : at + 12] == b"rec ":
            at += 12
            continue
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return frames


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds of a frame, and the frames in the order of the index (of the file, if it has none)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, at = FRAME_MICROS, 12
    # per RIFF segment the place and size of its list of frames, and its index
    movi: list[tuple[int, int] | None] = [None]
    index: list[bytes | None] = [None]
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"RIFF" and data[at + 8 : at + 12] == b"AVIX":
            movi.append(None)
            index.append(None)
            at += 12
            continue
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            micros = int.from_bytes(data[at + 20 : at + 24], "little") or FRAME_MICROS
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi[-1] = (at + 8, size)
        elif name == b"idx1":
            index[-1] = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not any(movi):
        raise ValueError("no list of frames")
    frames = [f for m, x in zip(movi, index, strict=True) if m for f in _segment_frames(data, m, x)]
    return micros, frames


@dataclass
class Header:
    """What a picture's markers say, up to its coded data at ``begin``."""

    begin: int
    height: int
    width: int
    #: Per component: columns and rows of blocks in a unit, quantisers in zigzag order, and its two code tables.
    parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    #: Units after which the coded data starts afresh; 0 if it never does.
    restart: int = 0


def _lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For the next 16 bits: length of the code * 256 + symbol; 0 where there is none."""
    table = np.zeros(1 << 16, dtype=np.int64)
    for symbol, (code, bits) in _canonical(list(lengths), list(symbols)).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits * 256 + symbol
    return table


@functools.cache
def _standard(number: int) -> np.ndarray:
    """The standard's own code table (annex K) that pictures in AVI files may leave out."""
    return _lookup(*_STANDARD[number])


def read_header(frame: bytes) -> Header:
    """Parse a baseline picture's markers."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    quants: dict[int, np.ndarray] = {}
    tables: dict[int, np.ndarray] = {}
    components: dict[int, tuple[int, int, int]] = {}
    height = width = restart = 0
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples of 8 bits expected")
            height, width = struct.unpack(">HH", body[1:5])
            components = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline pictures are read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if body[0] != len(components):
                raise ValueError("one scan of all components expected")
            parts = []
            for i in range(body[0]):
                h, v, q = components[body[1 + 2 * i]]
                dc, ac = body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)
                parts.append((h, v, quants[q], *(tables[t] if t in tables else _standard(t) for t in (dc, ac))))
            if len(parts) == 1:
                parts = [(1, 1, *parts[0][2:])]
            return Header(at, height, width, parts, restart)
    raise ValueError("no picture data")


def decode_group(header: Header, frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frame, block, 64 in zigzag order, blocks as coded) and luminance pictures."""
    n = len(frames)
    across = max(p[0] for p in header.parts)
    down = max(p[1] for p in header.parts)
    units = (-(-header.width // (8 * across)), -(-header.height // (8 * down)))
    order = [c for c, p in enumerate(header.parts) for _ in range(p[0] * p[1])]
    blocks = len(order) * units[0] * units[1]
    # coded data is decoded in pieces: from restart to restart, or whole frames
    step = min(header.restart or units[0] * units[1], units[0] * units[1])
    starts = -(-units[0] * units[1] // step)
    part_of = np.array(order * step)
    span = len(part_of)
    coded = [f[header.begin : f.rindex(b"\xff\xd9")] for f in frames]
    split = [_RESTART.split(c) if header.restart else [c] for c in coded]
    if any(len(c) != starts for c in split):
        raise ValueError("coded data is damaged")
    pieces = [p for c in split for p in c]
    wanted = np.tile(np.r_[np.full(starts - 1, span), blocks - (starts - 1) * span], n)
    tables = np.concatenate([t for p in header.parts for t in p[3:5]])
    # coded data of all pieces, without the zeros behind 255, and 8 bytes of ones after each
    raw = np.frombuffer(b"".join(p + b"\xff\xff\xff\xff\xff\xff\xff\xff" for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p) + 8 for p in pieces])
    zero = np.r_[False, (raw[:-1] == 255) & (raw[1:] == 0)]
    zero[np.cumsum(sizes)[:-1]] = False  # a piece that begins with 0 keeps it
    ends = np.cumsum(sizes) - np.cumsum(zero)[np.cumsum(sizes) - 1]
    clean = raw[~zero].astype(np.uint64)
    begin = np.r_[0, ends[:-1]]
    window = np.zeros(len(clean) + 8, dtype=np.uint64)
    for i in range(6):
        window[: len(clean) - i] |= clean[i:] << np.uint64(8 * (5 - i))  # 48 bits from each byte on
    coefficients = np.zeros((len(pieces), span * 64 + 64), dtype=np.int32)
    live = np.arange(len(pieces))
    at, block, k = begin * 8, np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
    while len(live):
        table = part_of[block] * 2 + (k > 0)
        w = window[at >> 3].astype(np.int64)
        shift = at & 7
        found = tables[(table << 16) | ((w >> (32 - shift)) & 0xFFFF)]
        bits, symbol = found >> 8, found & 255
        size = symbol & 15
        if not bits.all() or (at > ends[live] * 8).any():
            raise ValueError("coded data is damaged")
        extra = (w >> (48 - shift - bits - size)) & ((1 << size) - 1)
        value = np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
        value = np.where(size == 0, 0, value)
        at = at + bits + size
        run = symbol >> 4
        place = np.where(k > 0, k + run, 0)
        if (place > 63 + 16 * (size == 0)).any():
            raise ValueError("coded data is damaged")
        coefficients[live, np.where(size > 0, block * 64 + place, span * 64)] = value
        k = np.where((k > 0) & (symbol == 0), 64, place + 1)
        done = k >= 64
        block, k = block + done, np.where(done, 0, k)
        stay = block < wanted[live]
        if not stay.all():
            live, at, block, k = live[stay], at[stay], block[stay], k[stay]
    coefficients = coefficients[:, : span * 64].reshape(len(pieces), span, 64)
    for c in range(len(header.parts)):
        mine = part_of == c
        coefficients[:, mine, 0] = np.cumsum(coefficients[:, mine, 0], axis=1)
    coefficients = coefficients.reshape(n, starts * span, 64)[:, :blocks]
    return coefficients, _pictures(header, coefficients[:, np.resize(part_of, blocks) == 0], units)


def _pictures(header: Header, coefficients: np.ndarray, units: tuple[int, int]) -> np.ndarray:
    """Luminance samples of the first component's blocks."""
    h, v, quants = header.parts[0][:3]
    n, blocks = coefficients.shape[:2]
    square = np.zeros((n * blocks, 64))
    square[:, ZIGZAG] = (coefficients * quants.astype(np.int32)).reshape(n * blocks, 64)
    square = square.reshape(-1, 8, 8)
    samples = np.matmul(_COS.T, np.matmul(square, _COS))
    samples = np.clip(np.floor((samples + (1 << 23)) / (1 << 24)) + 128, 0, 255).astype(np.uint8)
    grid = samples.reshape(n, units[1], units[0], v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(n, units[1] * v * 8, units[0] * h * 8)
    return grid[:, : header.height, : header.width]


def decode_frames(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coefficients and luminance of each frame; frames with equal headers are decoded together, and an empty frame is the one before it again."""
    if frames and not frames[0]:
        raise ValueError("the first frame is empty")
    groups: dict[bytes, list[int]] = {}
    headers: dict[bytes, Header] = {}
    last = b""
    for i, frame in enumerate(frames):
        if not frame:
            continue
        if not last or not frame.startswith(last):
            header = read_header(frame)
            last = frame[: header.begin]
            headers[last] = header
        groups.setdefault(last, []).append(i)
    out: list = [None] * len(frames)
    for key, numbers in groups.items():
        coefficients, pictures = decode_group(headers[key], [frames[i] for i in numbers])
        for j, i in enumerate(numbers):
            out[i] = (coefficients[j], pictures[j])
    for i, frame in enumerate(frames):
        if not frame:
            out[i] = out[i - 1]
    return out


def store_bytes(payloads: list[bytes]) -> list[bytes]:
    """Files that hold the payloads, whose lengths are multiples of 576 bytes."""
    counts = [len(p) // FRAME_BYTES for p in payloads]
    frames = encode_frames(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME_BYTES))
    files, at = [], 0
    for n in counts:
        files.append(write_avi(frames[at : at + n]))
        at += n
    return files


def histograms(pictures: np.ndarray) -> np.ndarray:
    """Counts of samples per bin, a row for each picture."""
    n = len(pictures)
    bins = pictures.reshape(n, -1) >> 4
    return np.bincount((np.arange(n)[:, None] * BINS + bins).ravel(), minlength=n * BINS).reshape(n, BINS)


def shots(counts: np.ndarray) -> list[tuple[int, int, float]]:
    """First frame, frame after the last, and the difference with which each shot begins."""
    if not len(counts):
        return []
    change = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2 * np.maximum(counts[1:].sum(axis=1), 1))
    out, start, opening, past = [], 0, 0.0, []
    for i, d in enumerate(change.tolist(), 1):
        recent = past[-MEMORY:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > FLOOR and d > mean + SPREAD * spread:
            out.append((start, i, opening))
            start, opening, past = i, d, []
        else:
            past.append(d)
    return [*out, (start, len(counts), opening)]


def media_clips(media: DataFrame, content: str = "content", media_id: str = "media_id") -> DataFrame:
    """Clip rows of AVI files in a binary column: media_id, clip, start_frame, end_frame, start_s, end_s, luma, change, error."""
    rows = media.select(F.col(media_id).alias("media_id"), F.col(content).alias("content"))
    id_type = rows.schema["media_id"].dataType.simpleString()
    schema = f"media_id {id_type}, clip int, start_frame int, end_frame int, start_s double, end_s double, luma double, change double, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "content", BATCH_BYTES):
            out: list[tuple] = []
            for key, data in zip(batch["media_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("no content")
                    micros, frames = read_avi(data)
                    pictures = [p for _, p in decode_frames(frames)]
                except (ValueError, KeyError, IndexError, struct.error) as problem:
                    out.append((key, None, None, None, None, None, None, None, str(problem) or type(problem).__name__))
                    continue
                if not pictures:
                    out.append((key, None, None, None, None, None, None, None, "no frames"))
                    continue
                counts = np.concatenate([histograms(p[None]) for p in pictures])
                for clip, (a, b, change) in enumerate(shots(counts)):
                    luma = float(np.mean([p.mean() for p in pictures[a:b]]))
                    out.append((key, clip, a, b, a * micros / 1e6, b * micros / 1e6, luma, change, None))
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate(names)}, schema=_arrow(batch.schema.field("media_id").type))

    return rows.mapInArrow(run, schema)


def _arrow(id_type: pa.DataType) -> pa.Schema:
    kinds = [("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64()), ("change", pa.float64()), ("error", pa.string())]
    return pa.schema([("media_id", id_type), *kinds])


def media_digests(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Texts stored as files, read back, with digests and clips: a row per document."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            texts = [x.as_buffer().to_pybytes() for x in batch["text"]]
            files = store_bytes([t + b"\xff" * ((-len(t)) % FRAME_BYTES or (0 if t else FRAME_BYTES)) for t in texts])
            # read back: everything from here on comes from the files
            frames, counts, micros = [], [], []
            for data in files:
                m, own = read_avi(data)
                frames += own
                counts.append(len(own))
                micros.append(m)
            header = read_header(frames[0])
            coefficients, pictures = decode_group(header, frames)
            stored = (coefficients.reshape(len(frames), FRAME_BYTES) - 1).astype(np.uint8)
            bars = histograms(pictures)
            light = pictures.reshape(len(frames), -1).sum(axis=1, dtype=np.int64)
            columns: list[list] = [[] for _ in names[1:]]
            at = 0
            for text, data, n, m in zip(texts, files, counts, micros, strict=True):
                payload = stored[at : at + n].tobytes()
                clips = [f"{a * m // 1000}-{b * m // 1000}:{int(light[at + a : at + b].sum()) // ((b - a) * FRAME_BYTES)}" for a, b, _ in shots(bars[at : at + n])]
                values = len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={n} clips_ms_luma=" + ",".join(clips)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
                at += n
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
