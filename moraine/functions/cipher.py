"""Name hashes, the block cipher and file keys of the archive format, on whole columns or many blocks at once.

Keys of a block repeat after a few steps (with a period of six), so they are tables. Encrypting is a linear recurrence over known words, hence a running
sum. Decrypting isn't linear, but bit b of a seed depends on bits below b of the one before (those at b cancel out), so after 32 words a seed doesn't depend on
where it began: a block is cut into pieces that begin some words earlier, and NumPy runs over the pieces of all blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, NAME_A, NAME_B, FILE_KEY, _MIX = 0x000, 0x100, 0x200, 0x300, 0x400
_M = 0xFFFFFFFF


def _make_table() -> np.ndarray:
    seed, table = 0x00100001, np.zeros(0x500, dtype=np.uint32)

    def half() -> int:
        nonlocal seed
        seed = (seed * 125 + 3) % 0x2AAAAB
        return seed & 0xFFFF

    for i in range(0x100):
        for group in range(5):
            table[group * 0x100 + i] = (half() << 16) | half()
    return table


TABLE = _make_table()
_LIST = [int(x) for x in TABLE]
_FOLD = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\\")


#: Padded cells that are worked on at once.
_CELLS = 1 << 20


def hash_name(name: str | bytes, kind: int) -> int:
    """A name's hash; ASCII case and the kind of slash don't matter."""
    a, b = 0x7FED7FED, 0xEEEEEEEE
    for c in (name.encode() if isinstance(name, str) else name).translate(_FOLD):
        a = _LIST[kind + c] ^ (a + b & _M)
        b = c + a + b * 33 + 3 & _M
    return a


def _slices(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Places by falling length, in slices of bounded size when padded to the first of each."""
    order, at = np.argsort(-lens, kind="stable"), 0
    while at < len(order):
        n = max(1, _CELLS // max(1, int(lens[order[at]])))
        yield order[at : at + n]
        at += n


def hash_names(names: list[bytes], kinds: tuple[int, ...] = (START, NAME_A, NAME_B)) -> np.ndarray:
    """(name, kind) hashes of many names, a character of all of them at a time."""
    out = np.zeros((len(names), len(kinds)), dtype=np.uint32)
    for order in _slices(np.array([len(n) for n in names], dtype=np.int64)):
        lens = np.array([len(names[i]) for i in order], dtype=np.int64)
        a = np.full((len(kinds), len(order)), 0x7FED7FED, dtype=np.uint32)
        b = np.full((len(kinds), len(order)), 0xEEEEEEEE, dtype=np.uint32)
        chars = np.zeros((len(order), int(lens[0])), dtype=np.uint8)
        chars[np.arange(chars.shape[1]) < lens[:, None]] = np.frombuffer(b"".join([names[i] for i in order]).translate(_FOLD), np.uint8)
        for at in range(chars.shape[1]):
            live = int(np.searchsorted(-lens, -at, "left"))
            c = chars[:live, at].astype(np.uint32)
            for k, kind in enumerate(kinds):
                a[k, :live] = TABLE[kind + c] ^ (a[k, :live] + b[k, :live])
                b[k, :live] = c + a[k, :live] + b[k, :live] * np.uint32(33) + np.uint32(3)
        out[order] = a.T
    return out


def _step(key: int) -> int:
    return ((~key << 21) + 0x11111111 & _M) | key >> 11


def _one(data: bytes, key: int, encrypt: bool) -> bytes:
    words = np.frombuffer(data, "<u4", len(data) // 4).tolist()
    seed = 0xEEEEEEEE
    for i, w in enumerate(words):
        seed = seed + _LIST[_MIX + (key & 0xFF)] & _M
        other = w ^ (key + seed & _M)
        words[i] = other
        key = _step(key)
        seed = (w if encrypt else other) + seed * 33 + 3 & _M
    return np.array(words, dtype="<u4").tobytes() + data[len(words) * 4 :]


_SEED, _PERIOD, _FIRST, _WARM, _PIECES = 0xEEEEEEEE, 6, 12, 36, 2048
#: Powers of 33 and of its inverse modulo 2**32.
_CHUNK = 1 << 14
_POWERS = np.cumprod(np.r_[1, np.full(_CHUNK, 33)].astype(np.uint32), dtype=np.uint32)
_INVERSE = np.cumprod(np.r_[1, np.full(_CHUNK, pow(33, -1, 1 << 32))].astype(np.uint32), dtype=np.uint32)


def _tables(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the first words of each key add before and after the word, and whether the keys repeat from there on as they should."""
    rows, k = [], keys
    for _ in range(_FIRST):
        rows.append(k)
        k = ((~k << np.uint32(21)) + np.uint32(0x11111111)) | (k >> np.uint32(11))
    all_keys = np.array(rows)
    mixed = TABLE[_MIX + (all_keys & np.uint32(0xFF))]
    return all_keys + mixed, mixed * np.uint32(33) + np.uint32(3), k == rows[_FIRST - _PERIOD]


def _places(a: int, b: int) -> np.ndarray:
    """Which rows of the tables words a to b use."""
    i = np.arange(a, b)
    return np.where(i < _FIRST, i, _PERIOD + i % _PERIOD)


def _encrypt_rows(words: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """words: (blocks, words), in place; seeds by running sums, a chunk of words at a time."""
    seed = np.full((len(words), 1), _SEED, dtype=np.uint32)
    for a in range(0, words.shape[1], _CHUNK):
        w = words[:, a : a + _CHUNK]
        n, at = w.shape[1], _places(a, a + w.shape[1])
        sums = np.cumsum((w + after[at].T) * _INVERSE[1 : n + 1], axis=1, dtype=np.uint32)
        sums += seed
        seeds = np.empty_like(w)
        seeds[:, :1] = seed
        seeds[:, 1:] = sums[:, :-1] * _POWERS[1:n]
        seed = sums[:, -1:] * _POWERS[n]
        w ^= before[at].T + seeds


def _decrypt_rows(words: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """words: (blocks, words), in place; in pieces whose length is a multiple of the period, each begun _WARM words before it."""
    blocks, n = words.shape
    count = max(1, min(_PIECES // blocks, n // (2 * _WARM)))
    size = -(-n // count // _PERIOD) * _PERIOD
    count = -(-n // size)
    padded = np.zeros((blocks, _WARM + count * size), dtype=np.uint32)
    padded[:, _WARM : _WARM + n] = words
    pieces = np.lib.stride_tricks.as_strided(padded, (blocks, count, size + _WARM), (padded.strides[0], 4 * size, 4))
    steps = np.ascontiguousarray(pieces.transpose(2, 1, 0))  # (step, piece, block)
    seed = np.full((count, blocks), _SEED, dtype=np.uint32)
    for j in range(size + _WARM):
        row = _PERIOD + j % _PERIOD
        if j == _WARM:
            seed[0] = _SEED
        x, y = before[row], after[row]
        if _WARM <= j < _WARM + _PERIOD:  # the first words of a block have keys of their own
            x, y = np.tile(x, (count, 1)), np.tile(y, (count, 1))
            x[0], y[0] = before[j - _WARM], after[j - _WARM]
        plain = steps[j]
        plain ^= x + seed
        seed *= np.uint32(33)
        seed += plain
        seed += y
    words[:] = steps[_WARM:].transpose(2, 1, 0).reshape(blocks, count * size)[:, :n]


def _blocks(blocks: list[bytes], keys: list[int], encrypt: bool) -> list[bytes]:
    lens = np.array([len(d) // 4 for d in blocks], dtype=np.int64)
    if lens.sum() < 64 or (not encrypt and lens.sum() < 4096):  # fewer than pay for NumPy
        return [_one(d, k & _M, encrypt) for d, k in zip(blocks, keys, strict=True)]
    out: list[bytes] = [b""] * len(blocks)
    for order in _slices(lens):
        sizes = lens[order]
        words = np.zeros((len(order), int(sizes[0])), dtype=np.uint32)
        inside = np.arange(words.shape[1]) < sizes[:, None] if len(order) > 1 else 0
        words[inside] = np.frombuffer(b"".join([blocks[i][: 4 * n] for i, n in zip(order.tolist(), sizes.tolist(), strict=True)]), "<u4")
        before, after, repeat = _tables(np.array([keys[i] & _M for i in order], dtype=np.uint32))
        (_encrypt_rows if encrypt else _decrypt_rows)(words, before, after)
        for row, i in enumerate(order.tolist()):
            n = int(sizes[row])
            out[i] = words[row, :n].astype("<u4").tobytes() + blocks[i][4 * n :] if repeat[row] else _one(blocks[i], keys[i] & _M, encrypt)
    return out


def encrypt_block(data: bytes, key: int) -> bytes:
    """Encrypts whole 32-bit words; up to three bytes at the end stay as they are."""
    return _blocks([data], [key], True)[0]


def decrypt_block(data: bytes, key: int) -> bytes:
    return _blocks([data], [key], False)[0]


def encrypt_blocks(blocks: list[bytes], keys: list[int]) -> list[bytes]:
    return _blocks(blocks, keys, True)


def decrypt_blocks(blocks: list[bytes], keys: list[int]) -> list[bytes]:
    return _blocks(blocks, keys, False)


def plain_name(name: str) -> str:
    return re.split(r"[\\/]", name)[-1]


def file_key(name: str, file_pos: int, file_size: int, fix: bool) -> int:
    """The key of a file: the hash of its name without folders, tied to place and size where `fix` is set."""
    key = hash_name(plain_name(name), FILE_KEY)
    return (key + file_pos & _M) ^ file_size if fix else key


def _candidates(first: int, plain: int):
    """Keys that decrypt a first word to `plain`, with the seed after it."""
    both = (first ^ plain) - 0xEEEEEEEE & _M
    for low in range(0x100):
        key = both - _LIST[_MIX + low] & _M
        seed = 0xEEEEEEEE + _LIST[_MIX + (key & 0xFF)] & _M
        if first ^ (key + seed & _M) == plain:
            yield key, plain + seed * 33 + 3 & _M


def _second(word: int, key: int, seed: int) -> int:
    key = _step(key)
    return word ^ (key + (seed + _LIST[_MIX + (key & 0xFF)] & _M) & _M)


def key_from_content(data: bytes, sector_size: int, file_size: int) -> int | None:
    """The key of encrypted data that begins as RIFF, an executable or XML; None if none fits."""
    if len(data) < 8:
        return None
    first, second = (int(x) for x in np.frombuffer(data, "<u4", 2))
    known = ((0x0C, 0x46464952, file_size - 8 & _M), (0x41, 0x00905A4D, 3), (0x05, 0x6D783F3C, 0x6576206C))
    for least, a, b in known:
        if sector_size >= least:
            for key, seed in _candidates(first, a):
                if _second(second, key, seed) == b:
                    return key
    return None


def key_from_offsets(data: bytes, sector_size: int, first_offset: int) -> int | None:
    """The key of a file whose encrypted sector offsets begin with a known number (or up to 3 more)."""
    if len(data) < 8:
        return None
    first, second = (int(x) for x in np.frombuffer(data, "<u4", 2))
    for begin in range(first_offset, first_offset + 4):
        for key, seed in _candidates(first, begin):
            if _second(second, key, seed) <= (sector_size + begin & _M):
                return key + 1 & _M
    return None


_HASHES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "hash_a", "hash_b", "file_key")])


@F.pandas_udf(_HASHES)
def name_hashes(names: pd.Series) -> pd.DataFrame:
    """The four hashes of each name (null: those of the empty name are 0), from Arrow batches."""
    given = names.notna().to_numpy()
    out = np.zeros((len(names), 4), dtype=np.int64)
    if given.any():
        out[given] = hash_names([n.encode() for n in names[given]], (START, NAME_A, NAME_B, FILE_KEY))
    return pd.DataFrame(out, columns=["start", "hash_a", "hash_b", "file_key"])


@F.pandas_udf(T.BinaryType())
def encrypted(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(encrypt_blocks([bytes(d) for d in data], [int(k) for k in key]))


@F.pandas_udf(T.BinaryType())
def decrypted(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(decrypt_blocks([bytes(d) for d in data], [int(k) for k in key]))
