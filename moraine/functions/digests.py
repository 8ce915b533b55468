"""Checksums: built-in where Spark has them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc32(data: Column) -> Column:
    return F.crc32(data)


def md5(data: Column) -> Column:
    return F.md5(data)


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else zlib.adler32(bytes(d)) for d in data], dtype="Int64")


def encode_sector_checksums(words: list[int]) -> bytes:
    """Checksums of sectors as stored: big-endian, deflated where that is shorter."""
    raw = np.array(words, dtype=">u4").tobytes()
    packed = zlib.compress(raw)
    return packed if len(packed) < len(raw) else raw


def decode_sector_checksums(data: bytes, count: int) -> list[int]:
    """Checksums of `count` sectors; those that aren't there are 0."""
    if len(data) != 4 * count:
        try:
            data = zlib.decompress(data)
        except zlib.error:
            return [0] * count
    words = np.frombuffer(data, ">u4", min(len(data) // 4, count)).tolist()
    return words + [0] * (count - len(words))
