"""Vectorised text kernels shared by the operators: Arrow string columns in, NumPy arrays out.

Everything here works on slices of a few megabytes (`slices`), so a worker's memory is set by the
slice and by the longest single text, never by the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True
_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * _P & _M
    return out


_POW = _powers(256)


def trimmed(run):
    """A function over batches that gives the memory it has freed back to the system when its task is done: workers live on, and what they keep counts."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that `column` holds about `most` bytes in each part. Only whole rows."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n + 1 offsets of each text's words).

    A word is a run of ASCII letters and digits and of non-ASCII bytes, lower-cased. Its hash is a
    polynomial over its bytes, mixed; it is the same in every process.
    """
    raw, offs = buffers(pc.utf8_lower(pc.fill_null(texts, "")) if lower else texts)
    starts, lens = spans(raw, offs)
    return hash_spans(raw, starts, lens), np.searchsorted(starts, offs).astype(np.int64)


def spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words; a text's end also ends a word."""
    is_word = _WORD[raw]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    inner = offs[1:-1]
    inner = inner[inner < len(raw)]
    begin[inner] = is_word[inner]
    starts = np.flatnonzero(begin)
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:]
    before = inner[inner > 0] - 1
    stop[before] = is_word[before]
    return starts, np.flatnonzero(stop) + 1 - starts


def hash_spans(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that lie one after the other and are not empty."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    total = int(lens.sum())
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    ends = np.cumsum(lens)
    within = np.arange(total, dtype=kind) - np.repeat((ends - lens).astype(kind), lens)
    place = np.repeat(starts.astype(kind), lens) + within
    longest = int(lens.max())
    powers = _POW if longest <= 256 else _powers(min(longest, 1 << 16))
    value = raw[place].astype(np.uint64)
    value += np.uint64(1)
    value *= powers[within if longest <= len(powers) else within % len(powers)]
    return mix(np.add.reduceat(value, ends - lens) + lens.astype(np.uint64))


_STEP = np.array([(_P * (2 * i + 1) ^ (0xD1B54A32D192ED03 >> i)) & _M | 1 for i in range(64)], dtype=np.uint64)


def ngrams(words: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, the number of its text). A text of fewer than n words is one n-gram; one of no words has none."""
    count = np.diff(offs)
    grams = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    text = np.repeat(np.arange(len(count)), grams)
    at = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams) + offs[:-1][text]
    end = offs[1:][text]
    padded = np.concatenate([words, np.zeros(n, dtype=np.uint64)])
    value = np.zeros(len(text), dtype=np.uint64)
    for j in range(n):
        part = padded[at + j]
        if j:
            part = np.where(at + j < end, part, np.uint64(0))
        value += part * _STEP[j]
    return mix(value), text


def unique_per_text(grams: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, gram) rows, sorted by text and gram."""
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], text[new]
