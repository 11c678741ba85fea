"""Words of whole Arrow batches with numpy: byte positions, 64-bit hashes, and rows of words with code-point offsets.

Two kinds of words are told apart: runs of bytes outside ``\\x20\\x09-\\x0D`` (``Words``), and runs outside the Unicode white space
(``tokens``), which are those of ``functions.text.words``. Long buffers are worked through in pieces, so the memory needed does not follow the
length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            up, down = np.full(n, _PRIME, np.uint64), np.full(n, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts (null: empty), and where each text's begin."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def _wide_space(data: np.ndarray) -> np.ndarray:
    """The bytes of white-space characters, those beyond ASCII too."""
    out = _SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = lead[general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                out[at + k] = True
    return out


class Words:
    """The words of a batch of texts: hashes, byte positions in ``data``, and where each text's words and bytes begin. ``wide``: words end at any Unicode
    white space, not just that of ASCII."""

    __slots__ = ("data", "at", "start", "end", "hash", "first")

    def __init__(self, texts: pa.Array, lower: bool = False, wide: bool = False):
        data, at = buffers(texts)
        inside = ~(_wide_space(data) if wide else _SPACE[data])
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[at] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.data, self.at, self.start, self.end = data, at, start, end
        self.first = np.searchsorted(start, at)
        self.hash = span_hashes(data, start, end, lower)

    def __len__(self) -> int:
        return len(self.at) - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte ranges data[start:end], which ascend and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
            lo, hi = int(start[i]), int(end[j - 1])
            piece = data[lo:hi]
            up, down = _power(max(hi - lo + 1, _PIECE + 1))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[piece] if lower else piece] * up[: hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a hash sequence; window i begins at word i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = acc * np.uint64(0xFF51AFD7ED558CCD) + h[i : i + n]
    return mix(acc)


def whole(h: np.ndarray) -> np.uint64:
    """Hash of a whole hash sequence, its length included."""
    with np.errstate(over="ignore"):
        up = _power(max(len(h) + 1, 1024))[0][: len(h)]
        return mix(np.array([np.sum(mix(h) * up, dtype=np.uint64) + np.uint64(len(h)) * np.uint64(0xC2B2AE3D27D4EB4F)], np.uint64))[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most ``most`` bytes of text (or one row), so that numpy's arrays stay small."""
    size = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(size)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


# ---------------------------------------------------------------------------------------------------------------------
# rows

#: Bytes that begin a character.
LEAD = (np.arange(256) & 0xC0) != 0x80


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges data[start:end] as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())


def word_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, start, end): a row for each white-space token with its code-point offsets, in one pass over the bytes of each batch."""
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                w = Words(part.column(1), wide=True)
                before = np.concatenate([[0], np.cumsum(LEAD[w.data], dtype=np.int64)])
                owner = np.repeat(np.arange(len(w)), np.diff(w.first))
                base = before[w.at[owner]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), _cut(w.data, w.start, w.end), pa.array(before[w.start] - base), pa.array(before[w.end] - base)], names=["k", "text", "start", "end"])

    out = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, text string, start bigint, end bigint")
    return out.withColumnRenamed("k", key)


def _clear(w: Words, at: int) -> bool:
    """Whether no word has the byte at this place."""
    k = int(np.searchsorted(w.end, at, "right"))
    return k == len(w.end) or bool(w.start[k] > at) or at in w.at


#: Phrases up to this many, and this many characters, go to all tasks (some 100 MB at most); more are joined by shuffle.
MOST_PHRASES, MOST_CHARS = 1_000_000, 64_000_000


def phrase_rows(docs: DataFrame, phrases: list[tuple], kind: str, key: str = "doc_id", text: str = "text", lead: int = 4) -> DataFrame:
    """(key, phrase_id, start, end): where phrases (id, text) stand in texts, word by word and sign by sign. Places are found by the hashes of a phrase's first
    ``lead`` words (all of a shorter one), and then the bytes are compared."""
    ids, raw = [p[0] for p in phrases], [p[1].encode() for p in phrases]
    held = Words(pa.array([p[1] for p in phrases], pa.string()), wide=True)
    n = np.minimum(np.diff(held.first), lead)
    tables = {}
    for size in sorted(set(n[n > 0].tolist())):
        which = np.flatnonzero(n == size)
        h = np.array([rolling(held.hash[held.first[i] : held.first[i] + size], size)[0] for i in which], np.uint64)
        order = np.argsort(h, kind="stable")
        tables[size] = (h[order], which[order])
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast((ids, raw, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, tables = sent.value
        for batch in batches:
            for part in slices(batch, "t"):
                w = Words(part.column(1), wide=True)
                owner = np.repeat(np.arange(len(w)), np.diff(w.first))
                rows, found, first, last = [], [], [], []
                for size, (h, which) in tables.items():
                    grams = rolling(w.hash, size)
                    lo, hi = np.searchsorted(h, grams), np.searchsorted(h, grams, "right")
                    for i in np.flatnonzero(hi > lo).tolist():
                        for x in which[lo[i] : hi[i]].tolist():
                            a = int(w.start[i])
                            b, end = a + len(raw[x]), int(w.at[owner[i] + 1])
                            if b <= end and w.data[a:b].tobytes() == raw[x] and _clear(w, b):
                                rows.append(int(owner[i]))
                                found.append(ids[x])
                                first.append(a)
                                last.append(b)
                if rows:
                    before = np.concatenate([[0], np.cumsum(LEAD[w.data], dtype=np.int64)])
                    base = before[w.at[rows]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(found, _TYPES.get(kind)), pa.array(before[first] - base), pa.array(before[last] - base)], names=["k", "p", "start", "end"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, p {kind}, start bigint, end bigint")


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
