"""Binary patches: payloads that turn a file of one archive into that of the next."""

from __future__ import annotations

import bz2
import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError

HEAD = 68
COPY, BSD0 = 0x59504F43, 0x30445342
_PTCH, _MD5, _XFRM = (int.from_bytes(x, "little") for x in (b"PTCH", b"MD5_", b"XFRM"))


def _offset(data: bytes, at: int = 0) -> int:
    """A 64-bit number as sign and magnitude."""
    value = int.from_bytes(data[at : at + 8], "little")
    return -(value & (1 << 63) - 1) if value >> 63 else value


def _offset_bytes(value: int) -> bytes:
    return (abs(value) | (1 << 63 if value < 0 else 0)).to_bytes(8, "little")


def parse_header(payload: bytes) -> dict | None:
    """The header of a patch; None for a payload that isn't one."""
    if len(payload) < HEAD:
        return None
    names = ("signature", "size", "before", "after", "md5_signature", "md5_size")
    h = dict(zip(names, struct.unpack_from("<6I", payload), strict=True))
    if h["signature"] != _PTCH:
        return None
    h["md5_before"], h["md5_after"] = payload[24:40], payload[40:56]
    xfrm, h["xfrm_size"], h["kind"] = struct.unpack_from("<3I", payload, 56)
    if h["md5_signature"] != _MD5 or xfrm != _XFRM:
        raise FormatError("invalid patch metadata signatures")
    if not HEAD <= h["size"] <= len(payload):
        raise FormatError("invalid patch size")
    if h["md5_size"] < 40:
        raise FormatError("invalid patch md5 block size")
    if h["xfrm_size"] < 12 or h["xfrm_size"] - 12 > h["size"] - HEAD:
        raise FormatError("patch xfrm block exceeds patch data")
    return h


def bsdiff40(old: bytes, patch: bytes, size: int) -> bytes:
    """Applies a BSDIFF40 patch; bytes beyond the old data count as 0."""
    if len(patch) < 32 or patch[:8] != b"BSDIFF40":
        raise FormatError("invalid BSD0 patch payload")
    control_size, diff_size, new_size = (_offset(patch, at) for at in (8, 16, 24))
    if min(control_size, diff_size, new_size) < 0 or 32 + control_size + diff_size > len(patch):
        raise FormatError("BSDIFF sections exceed patch payload")
    if new_size != size:
        raise FormatError("patch size_after mismatch")
    cut = 32 + control_size
    try:
        control, diff, extra = (bz2.decompress(x) for x in (patch[32:cut], patch[cut : cut + diff_size], patch[cut + diff_size :]))
    except (OSError, ValueError, EOFError) as e:
        raise FormatError("invalid BSDIFF stream") from e
    source, out = np.frombuffer(old, np.uint8), bytearray()
    at = d = x = c = 0
    while len(out) < size:
        if c + 24 > len(control):
            raise FormatError("invalid BSDIFF control block")
        add, copy, seek = (_offset(control, c + i) for i in (0, 8, 16))
        c += 24
        if add < 0 or copy < 0:
            raise FormatError("invalid BSDIFF control tuple")
        if len(out) + add + copy > size or d + add > len(diff) or x + copy > len(extra):
            raise FormatError("BSDIFF segment exceeds its data")
        base = np.zeros(add, np.uint8)
        lo, hi = max(at, 0), min(at + add, len(source))
        if hi > lo:
            base[lo - at : hi - at] = source[lo:hi]
        out += (base + np.frombuffer(diff, np.uint8, add, d)).tobytes() + extra[x : x + copy]
        at, d, x = at + add + seek, d + add, x + copy
    return bytes(out)


def make_bsdiff40(old: bytes, new: bytes) -> bytes:
    """A valid patch of the simplest kind: one difference over the common length, the rest as it is."""
    n = min(len(old), len(new))
    diff = (np.frombuffer(new, np.uint8, n) - np.frombuffer(old, np.uint8, n)).tobytes()
    control = b"".join(map(_offset_bytes, (n, len(new) - n, 0)))
    parts = [bz2.compress(x) for x in (control, diff, new[n:])]
    return b"BSDIFF40" + b"".join(map(_offset_bytes, (len(parts[0]), len(parts[1]), len(new)))) + b"".join(parts)


def make_patch(old: bytes, new: bytes, kind: int = BSD0) -> bytes:
    """A payload that `apply` turns old into new with."""
    data = make_bsdiff40(old, new) if kind == BSD0 else new
    head = struct.pack("<6I", _PTCH, HEAD + len(data), len(old), len(new), _MD5, 40)
    return head + hashlib.md5(old).digest() + hashlib.md5(new).digest() + struct.pack("<3I", _XFRM, len(data) + 12, kind) + data


def apply(base: bytes | None, payload: bytes) -> bytes:
    """The next version of a file. A payload without a patch header replaces the base; with no base the payload stays as it is."""
    if base is None or (h := parse_header(payload)) is None:
        return payload
    if len(base) != h["before"]:
        raise FormatError("patch size_before mismatch")
    if hashlib.md5(base).digest() != h["md5_before"]:
        raise FormatError("patch md5_before mismatch")
    if h["kind"] == BSD0:
        out = bsdiff40(base, payload[HEAD : HEAD + h["xfrm_size"] - 12], h["after"])
    elif h["kind"] == COPY:
        out = base
    else:
        raise FormatError("unsupported patch type")
    if len(out) != h["after"]:
        raise FormatError("patch size_after mismatch")
    if hashlib.md5(out).digest() != h["md5_after"]:
        raise FormatError("patch md5_after mismatch")
    return out


def fold(payloads: list[bytes]) -> bytes | None:
    out: bytes | None = None
    for p in payloads:
        out = apply(out, p)
    return out


@F.pandas_udf(T.BinaryType())
def folded(payloads: pd.Series) -> pd.Series:
    """A column of arrays of payloads, each applied to what the ones before it made."""
    return pd.Series([None if p is None else fold([bytes(x) for x in p]) for p in payloads])
