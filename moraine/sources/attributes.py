"""The `(attributes)` file: CRC-32, FILETIME, MD5 and patch bit of every block."""

from __future__ import annotations

import hashlib
import struct
import zlib

from ..errors import FormatError, InvalidInputError

VERSION, CRC, TIME, MD5, PATCH = 100, 1, 2, 4, 8
ALL = CRC | TIME | MD5 | PATCH


def _sizes(flags: int, n: int) -> set[int]:
    """Sizes that a file of n rows may have: with the patch bits rounded up either way, as words, or left out."""
    fixed = 8 + n * ((flags & CRC and 4) + (flags & TIME and 8) + (flags & MD5 and 16))
    return {fixed, *((fixed + (n + 6) // 8, fixed + (n + 7) // 8, fixed + 4 * n) if flags & PATCH else ())}


def rows_of(size: int, flags: int, blocks: int) -> int | None:
    """How many rows a file of this size has for so many blocks: one for each, or one less."""
    return next((n for n in (blocks, blocks - 1) if n >= 0 and size in _sizes(flags, n)), None)


def parse(data: bytes, blocks: int | None = None) -> tuple[int, list[dict]]:
    """(flags, rows); without the number of blocks it is inferred. Columns that the flags leave out are None."""
    if len(data) < 8:
        raise FormatError("(attributes) file too small")
    version, flags = struct.unpack_from("<II", data)
    if version != VERSION:
        raise FormatError("unsupported (attributes) version")
    if flags & ~ALL:
        raise FormatError("unsupported (attributes) flags")
    n = next((k for k in range(len(data) + 1) if len(data) in _sizes(flags, k)), None) if blocks is None else rows_of(len(data), flags, blocks)
    if n is None:
        raise FormatError("invalid (attributes) size for block table")
    rows: list[dict] = [dict.fromkeys(("crc32", "filetime", "md5", "patch_bit")) for _ in range(n)]
    at = 8
    for flag, name, form, width in ((CRC, "crc32", "<I", 4), (TIME, "filetime", "<Q", 8), (MD5, "md5", "16s", 16)):
        if flags & flag:
            for row, (value,) in zip(rows, struct.iter_unpack(form, data[at : at + width * n]), strict=True):
                row[name] = value
            at += width * n
    left = data[at:]
    if flags & PATCH and left:
        for i, row in enumerate(rows):
            if len(left) == 4 * n and n > 1:
                row["patch_bit"] = any(left[4 * i : 4 * i + 4])
            else:
                row["patch_bit"] = bool(left[i // 8] >> 7 - i % 8 & 1) if i // 8 < len(left) else False
    return flags, rows


def serialize(flags: int, rows: list[dict], blocks: int | None = None) -> bytes:
    if flags & ~ALL:
        raise InvalidInputError("attributes flags contain unsupported bits")
    rows = rows + [{}] * ((blocks or 0) - len(rows))
    out = [struct.pack("<II", VERSION, flags)]
    for flag, name, form, empty in ((CRC, "crc32", "<I", 0), (TIME, "filetime", "<Q", 0), (MD5, "md5", "16s", bytes(16))):
        if flags & flag:
            out += [struct.pack(form, r.get(name) or empty) for r in rows]
    if flags & PATCH:
        bits = bytearray((len(rows) + 7) // 8)
        for i, r in enumerate(rows):
            bits[i // 8] |= bool(r.get("patch_bit")) << 7 - i % 8
        out.append(bytes(bits))
    return b"".join(out)


def row_of(entry) -> dict:
    return {"crc32": zlib.crc32(entry.data), "md5": hashlib.md5(entry.data).digest(), "patch_bit": entry.patch}


def stub(rows: list[dict]) -> bytes:
    """Attributes of files about to be written; the row of the attributes themselves is zero."""
    return serialize(CRC | TIME | MD5, rows, len(rows) + 1)


def default_stub(entries: list) -> bytes:
    return stub([row_of(e) for e in entries])
