"""Bytes of an archive: header, tables, file data; reading and writing them. No Spark here."""

from __future__ import annotations

import io
import itertools
import math
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from .. import schemas as S
from ..errors import BoundsError, FormatError, NotFoundError, UnsupportedFeatureError
from ..functions import cipher, codecs
from ..functions.digests import encode_sector_checksums

SIGNATURE = b"MPQ\x1a"
HASH_ROW = np.dtype([("hash_a", "<u4"), ("hash_b", "<u4"), ("locale", "<u2"), ("platform", "u1"), ("flags", "u1"), ("block_index", "<u4")])
BLOCK_ROW = np.dtype([("file_pos", "<u4"), ("compressed_size", "<u4"), ("file_size", "<u4"), ("flags", "<u4")])
LISTFILE, ATTRIBUTES, SIGNATURE_FILE = "(listfile)", "(attributes)", "(signature)"
HASH_KEY, BLOCK_KEY = cipher.hash_name("(hash table)", cipher.FILE_KEY), cipher.hash_name("(block table)", cipher.FILE_KEY)


class Region:
    """Positional reads within a file or a buffer; nothing is read beyond its end."""

    def __init__(self, file, size: int | None = None):
        self.file = file
        if isinstance(file, (bytes, bytearray, memoryview)):
            self.size = len(file)
            self._read = lambda at, n: bytes(file[at : at + n])
        elif hasattr(file, "read_at"):
            self.size = file.size() if size is None else size
            self._read = lambda at, n: file.read_at(n, at)
        else:
            self.size = file.seek(0, 2)

            def read(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(n)

            self._read = read

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise BoundsError("read beyond the end of the archive")
        return self._read(at, n)

    def integer(self, at: int, width: int) -> int:
        return int.from_bytes(self.read(at, width), "little")


def read_header(region: Region) -> dict:
    """The header at the file's beginning. Fields of later versions are None where the version or the size leaves them out."""
    if region.size < S.HEADER_SIZES[0]:
        raise FormatError("file is too small for a header")
    if region.read(0, 4) != SIGNATURE:
        raise FormatError("no archive signature")
    header, at = {"archive_offset": 0}, 4
    for name, width in S.HEADER_V1:
        header[name] = region.integer(at, width)
        at += width
    for name, width, place, version in S.HEADER_MORE:
        there = header["format_version"] >= version and header["header_size"] >= place + width
        header[name] = region.integer(place, width) if there and place + width <= region.size else None
    header["sector_size"] = sector_size(header["sector_size_shift"])
    header["file_length"] = region.size
    for high, low in (("hash_table_pos_hi", "hash_table_pos"), ("block_table_pos_hi", "block_table_pos")):
        header[low] += (header[high] or 0) << 32
    return header


def sector_size(shift: int) -> int:
    return min(512 << shift, 0xFFFFFFFF) if shift < 32 else 0xFFFFFFFF


def header_problem(h: dict) -> tuple[str, str] | None:
    """(kind, message) of what is wrong with a header, None if nothing is."""
    version, size = h["format_version"], h["header_size"]
    if size < S.HEADER_SIZES[0]:
        return "Format", "header too small"
    if version in S.HEADER_SIZES and size < S.HEADER_SIZES[version]:
        return "Format", f"v{min(version + 1, 4)} header too small"
    if version > 4:
        return "UnsupportedFeature", "unknown header format version"
    n = h["hash_table_entries"]
    if n == 0 or n & n - 1:
        return "Format", "hash table entry count must be non-zero power of two"
    if h["block_table_entries"] == 0:
        return "Format", "block table entry count must be non-zero"
    if max(h["hash_table_pos"] + 16 * n, h["block_table_pos"] + 16 * h["block_table_entries"]) > h["file_length"]:
        return "Format", "table range exceeds file length"
    if version >= 3:
        for kind in ("het", "bet"):
            pos, length = h[f"{kind}_table_pos_64"] or 0, h[f"{kind}_table_size_64"] or 0
            if pos and length and pos + length > h["file_length"]:
                return "Format", "extended table range exceeds file length"
    return None


def parse_hash_rows(data: bytes) -> np.ndarray:
    if len(data) % 16:
        raise FormatError("hash table length is no multiple of 16")
    return np.frombuffer(data, HASH_ROW)


def parse_block_rows(data: bytes) -> np.ndarray:
    if len(data) % 16:
        raise FormatError("block table length is no multiple of 16")
    return np.frombuffer(data, BLOCK_ROW)


def read_tables(region: Region, header: dict) -> tuple[np.ndarray, np.ndarray]:
    hashes = region.read(header["hash_table_pos"], 16 * header["hash_table_entries"])
    blocks = region.read(header["block_table_pos"], 16 * header["block_table_entries"])
    return parse_hash_rows(cipher.decrypt_block(hashes, HASH_KEY)), parse_block_rows(cipher.decrypt_block(blocks, BLOCK_KEY))


def find_slot(hashes: np.ndarray, blocks: int, name: str, locale: int | None = None) -> int | None:
    """The slot of a name: probing from its own place to the first free slot. With a locale: that one, else the neutral one, else the first."""
    raw = name.encode()
    start, a, b = (cipher.hash_name(raw, kind) for kind in (cipher.START, cipher.NAME_A, cipher.NAME_B))
    size = len(hashes)
    mask, first, neutral = size - 1, None, None
    for step in range(size):
        slot = (start & mask) + step & mask
        hash_a, hash_b, its, _, _, block = hashes[slot].item()
        if block == S.FREE:
            break
        if hash_a == a and hash_b == b and block < blocks:
            if locale is None or its == locale:
                return slot
            if its == 0 and neutral is None:
                neutral = slot
            first = slot if first is None else first
    return neutral if neutral is not None else first


class Finder:
    """`find_slot` of many names: a step of the probing of all of them at a time, and only of those that are there."""

    def __init__(self, hashes: np.ndarray, blocks: int):
        self.index, self.blocks = hashes["block_index"], blocks
        self.keys = hashes["hash_a"].astype(np.uint64) << np.uint64(32) | hashes["hash_b"]
        self.there = np.unique(self.keys[self.index < blocks])

    def find(self, names: list[str]) -> np.ndarray:
        """The slot of each name, -1 where it has none."""
        wanted = cipher.hash_names([n.encode() for n in names])
        mine = wanted[:, 1].astype(np.uint64) << np.uint64(32) | wanted[:, 2]
        mask, out = len(self.keys) - 1, np.full(len(names), -1)
        slots = wanted[:, 0].astype(np.int64) & mask
        place = np.searchsorted(self.there, mine)
        left = np.flatnonzero(place < len(self.there))
        left = left[self.there[place[left]] == mine[left]]
        for _ in range(len(self.keys)):
            left = left[self.index[slots[left]] != S.FREE]
            if not len(left):
                break
            at = slots[left]
            found = (self.keys[at] == mine[left]) & (self.index[at] < self.blocks)
            out[left[found]] = at[found]
            left = left[~found]
            slots[left] = slots[left] + 1 & mask
        return out


def find_slots(hashes: np.ndarray, blocks: int, names: list[str]) -> list[int | None]:
    return [None if x < 0 else x for x in Finder(hashes, blocks).find(names).tolist()] if names else []


def fill_slots(hashes: np.ndarray, names: list[str], locales: list[int], platforms: list[int]) -> None:
    """Enters the files of an archive, in order, into a table of free slots: each in the first free one, or in that of the same name and locale."""
    if not names:
        return
    keys = cipher.hash_names([n.encode() for n in names])
    mask, taken, slots = len(hashes) - 1, [-1] * len(hashes), []
    starts, pairs = (keys[:, 0].astype(np.int64) & mask).tolist(), (keys[:, 1].astype(np.uint64) << np.uint64(32) | keys[:, 2]).tolist()
    for i, slot in enumerate(starts):
        begin = slot
        while (other := taken[slot]) >= 0 and not (pairs[other] == pairs[i] and locales[other] == locales[i]):
            slot = slot + 1 & mask
            if slot == begin:
                raise FormatError("hash table is full")
        taken[slot] = i
        slots.append(slot)
    at = np.array(slots)
    last = np.array(taken)[at] == np.arange(len(names))  # a file may have taken the slot of one before
    for column, values in (("hash_a", keys[:, 1]), ("hash_b", keys[:, 2]), ("locale", locales), ("platform", platforms), ("flags", 0), ("block_index", np.arange(len(names)))):
        hashes[column][at[last]] = values if np.isscalar(values) else np.asarray(values)[last]


def multi_sector(flags: int) -> bool:
    return not flags & S.SINGLE_UNIT


def has_offsets(flags: int) -> bool:
    return bool(flags & (S.COMPRESS | S.IMPLODE))


def decode(region: Region, header: dict, block, name: str | None) -> bytes:
    """A file's content from its row of the block table. An encrypted file without a name is tried by what it may begin with."""
    parts, keys, finish = _stored(region, header, block, name)
    return finish(cipher.decrypt_blocks(parts, keys) if keys else parts)


def decode_many(region: Region, header: dict, wanted: list[tuple]) -> list[bytes | Exception]:
    """`decode` of many (row of the block table, name), whose sectors are decrypted together; what is wrong with a file is in its place."""
    stored: list = []
    for block, name in wanted:
        try:
            stored.append(_stored(region, header, block, name))
        except Exception as e:
            stored.append(e)
    secret = [x for x in stored if isinstance(x, tuple) and x[1]]
    plain = iter(cipher.decrypt_blocks([p for x in secret for p in x[0]], [k for x in secret for k in x[1]]) if secret else ())
    out: list[bytes | Exception] = []
    for x in stored:
        if isinstance(x, tuple):
            parts, keys, finish = x
            parts = [next(plain) for _ in keys] if keys else parts
            try:
                x = finish(parts)
            except Exception as e:
                x = e
        out.append(x)
    return out


def _stored(region: Region, header: dict, block, name: str | None) -> tuple[list[bytes], list[int], Callable[[list[bytes]], bytes]]:
    """(parts of a file as stored, a key for each if they are encrypted, what makes the content of the decrypted parts)."""
    pos, packed, size, flags = block.item() if isinstance(block, np.void) else block
    if not flags & S.EXISTS:
        raise NotFoundError("block is not present")
    if flags & S.DELETE_MARKER:
        raise NotFoundError("block is a delete marker")
    base = header["archive_offset"] + pos
    if base + packed > region.size:
        raise BoundsError("file block exceeds archive length")
    secret = bool(flags & S.ENCRYPTED)
    key = cipher.file_key(name, pos, size, bool(flags & S.FIX_KEY)) if secret and name is not None else None
    if not multi_sector(flags):
        data = region.read(base, packed)
        keys = [_need(cipher.key_from_content(data, size, size) if key is None else key)] if secret else []
        return [data], keys, lambda parts: _unit(parts[0], packed, size, flags)
    if size == 0:
        return [], [], lambda parts: b""
    step = header["sector_size"]
    count = math.ceil(size / step)
    if not has_offsets(flags):
        data = region.read(base, packed)
        if not secret:
            return [data], [], lambda parts: _whole(parts, size)
        key = _need(cipher.key_from_content(data, step, size) if key is None else key)
        parts = [data[i : i + step] for i in range(0, len(data), step)]
        return parts, [key + i for i in range(len(parts))], lambda parts: _whole(parts, size)
    words = count + 1 + bool(flags & S.SECTOR_CRC)
    table = region.read(base, 4 * words)
    if secret:
        key = _need(cipher.key_from_offsets(table, step, 4 * words) if key is None else key)
        table = cipher.decrypt_block(table, key - 1)
    offsets = struct.unpack(f"<{words}I", table)[: count + 1]
    if any(b < a for a, b in zip(offsets, offsets[1:], strict=False)):
        raise FormatError("sector offsets not monotonic")
    stored = region.read(base + offsets[0], offsets[-1] - offsets[0])
    parts = [stored[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets, offsets[1:], strict=False)]
    return parts, [key + i for i in range(count)] if secret else [], lambda parts: _sectors(parts, step, size, flags)


def _unit(data: bytes, packed: int, size: int, flags: int) -> bytes:
    if flags & S.COMPRESS:
        return data if packed == size else codecs.decompress_masked(data, size)
    if flags & S.IMPLODE:
        return data if packed == size else codecs.decompress("pkware", data, size)
    if len(data) < size:
        raise FormatError("single-unit file data shorter than file size")
    return data[:size]


def _whole(parts: list[bytes], size: int) -> bytes:
    data = b"".join(parts)
    if len(data) < size:
        raise FormatError("file data shorter than file size")
    return data[:size]


def _sectors(parts: list[bytes], step: int, size: int, flags: int) -> bytes:
    out = []
    for i, part in enumerate(parts):
        expected = min(step, size - i * step)
        if len(part) < expected:
            part = _unpack_sector(part, expected, flags)
        if len(part) < expected:
            raise FormatError("sector shorter than expected")
        out.append(part[:expected])
    return b"".join(out)


def _unpack_sector(part: bytes, size: int, flags: int) -> bytes:
    if flags & S.COMPRESS:
        return codecs.decompress_masked(part, size)
    try:
        return codecs.decompress("pkware", part, size)
    except FormatError:
        raise
    except Exception:
        if part[:1] == bytes([codecs.MASKS["pkware"]]):  # as some writers store it, behind a mask byte
            return codecs.decompress("pkware", part[1:], size)
        raise


def _need(key: int | None) -> int:
    if key is None:
        raise UnsupportedFeatureError("encrypted file read requires file name or a detectable key")
    return key


@dataclass
class Entry:
    """A file to be written."""

    name: str
    data: bytes
    compression: str = "none"
    encrypted: bool = False
    fix_key: bool = False
    locale: int = 0
    platform: int = 0
    single_unit: bool = False
    sector_crc: bool = False
    patch: bool = False


@dataclass
class Policy:
    """How an archive is written."""

    sector_size_shift: int = 3
    hash_entries: int = 0
    block_entries: int = 4
    listfile: bool = True
    attributes: bool = False
    format_version: int = 0
    header_size: int = 32
    extra: dict = field(default_factory=dict)


def _encrypt_flags(e: Entry) -> int:
    return (S.ENCRYPTED | (S.FIX_KEY if e.fix_key else 0)) if e.encrypted else 0


@dataclass
class Packed:
    """A file as it is stored but for the cipher, which needs its place; `sums` is its row of attributes."""

    name: str
    stored: bytes
    size: int
    flags: int
    locale: int = 0
    platform: int = 0
    sums: dict | None = None


def pack(e: Entry, step: int, described: bool = False) -> Packed:
    """What doesn't depend on where a file stands. A single unit only where nothing is compressed; sectors each kept raw where packing doesn't shorten them."""
    from .attributes import row_of

    flags = S.EXISTS | _encrypt_flags(e) | (S.PATCH_FILE if e.patch else 0)
    stored = e.data
    if e.compression == "none":
        flags |= S.SINGLE_UNIT if e.single_unit else 0
    else:
        imploded = e.compression == "pkware"
        flags |= S.IMPLODE if imploded else S.COMPRESS
        parts = [e.data[i : i + step] for i in range(0, len(e.data), step)]
        packed = [codecs.compress_masked(e.compression, p)[0] for p in parts]
        if imploded:  # the flag says it: no mask byte
            packed = [s[1:] if len(s) < len(p) else p for s, p in zip(packed, parts, strict=True)]
        sizes = [len(s) for s in packed]
        sums = b""
        if e.sector_crc:
            flags |= S.SECTOR_CRC
            sums = encode_sector_checksums([zlib.adler32(s) for s in packed])
            sizes.append(len(sums))
        offsets = [*itertools.accumulate(sizes, initial=4 * (len(sizes) + 1))]
        stored = b"".join([struct.pack(f"<{len(offsets)}I", *offsets), *packed, sums])
    return Packed(e.name, stored, len(e.data), flags, e.locale, e.platform, row_of(e) if described else None)


def seal(files: list[tuple[Packed, int]], step: int) -> list[bytes]:
    """The bytes of files at their places: those to be encrypted go through the cipher together."""
    parts: list[bytes] = []
    keys: list[int] = []
    cuts: list[int] = []
    for f, at in files:
        begin = len(parts)
        if f.flags & S.ENCRYPTED:
            key = cipher.file_key(f.name, at, f.size, bool(f.flags & S.FIX_KEY))
            if f.flags & S.SINGLE_UNIT:
                parts.append(f.stored)
                keys.append(key)
            elif not has_offsets(f.flags):
                parts += [f.stored[i : i + step] for i in range(0, len(f.stored), step)]
                keys += range(key, key + len(parts) - begin)
            else:
                count = math.ceil(f.size / step)
                words = count + 1 + bool(f.flags & S.SECTOR_CRC)
                offsets = struct.unpack_from(f"<{words}I", f.stored)
                parts += [f.stored[: 4 * words], *(f.stored[a:b] for a, b in zip(offsets[:count], offsets[1 : count + 1], strict=True))]
                keys += range(key - 1, key + count)
        cuts.append(len(parts) - begin)
    secret = iter(cipher.encrypt_blocks(parts, keys) if parts else ())
    out = []
    for (f, _), n in zip(files, cuts, strict=True):
        if n:
            data = b"".join([next(secret) for _ in range(n)])
            out.append(data + f.stored[len(data) :])  # the checksums of sectors stay as they are
        else:
            out.append(f.stored)
    return out


def encode(e: Entry, file_pos: int, step: int) -> tuple[bytes, int]:
    """(stored bytes, flags)."""
    packed = pack(e, step)
    return seal([(packed, file_pos)], step)[0], packed.flags


_SORT_KEY = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def listfile_text(names: list[str]) -> bytes:
    ordered = sorted(names, key=lambda n: n.encode().translate(_SORT_KEY))
    return b"".join(n.encode() + b"\r\n" for n in ordered)


def same_name(a: str, b: str) -> bool:
    return a.encode().translate(_SORT_KEY) == b.encode().translate(_SORT_KEY)


def table_sizes(files: int, policy: Policy) -> tuple[int, int]:
    least = 1 << (max(8, 2 * files) - 1).bit_length()
    return max(policy.hash_entries, least), max(policy.block_entries, files, 1)


class Assembly:
    """An archive in the making: files are added one after another and given back as stored; tables and header come last, so that what is held is a row for each file."""

    def __init__(self, policy: Policy):
        self.policy, self.step = policy, sector_size(policy.sector_size_shift)
        self.head = self.at = max(policy.header_size, S.HEADER_SIZES[policy.format_version])
        self.blocks = array("Q")
        self.names: list[str] = []
        self.locales, self.platforms = array("q"), array("q")
        self.sums: list[dict] = []
        self.listed = self.described = False

    def add(self, e: Entry) -> bytes:
        return self.put([pack(e, self.step, self.policy.attributes)])

    def put(self, files: list[Packed]) -> bytes:
        """The bytes of files that come next."""
        placed = []
        for f in files:
            self.names.append(f.name)
            self.locales.append(f.locale)
            self.platforms.append(f.platform)
            self.blocks.extend((self.at, len(f.stored), f.size, f.flags))
            self.listed |= f.name[:1] == "(" and same_name(f.name, LISTFILE)
            self.described |= f.name[:1] == "(" and same_name(f.name, ATTRIBUTES)
            if self.policy.attributes:
                self.sums.append(f.sums)
            placed.append((f, self.at))
            self.at += len(f.stored)
            if self.at > 0xFFFFFFFF:
                raise UnsupportedFeatureError("archives beyond 4 GiB")
        return b"".join(seal(placed, self.step))

    def finish(self) -> tuple[bytes, bytes, bytes]:
        """(header, the files that are made from the others, tables)."""
        from .attributes import stub

        policy, more = self.policy, []
        if policy.listfile and not self.listed:
            more.append(self.add(Entry(LISTFILE, listfile_text(self.names), "zlib", True, True, single_unit=True)))
        if policy.attributes and not self.described:
            more.append(self.add(Entry(ATTRIBUTES, stub(self.sums), "zlib", True, True)))
        hash_size, block_size = table_sizes(len(self.names), policy)
        hashes, blocks = np.full(hash_size, 0xFFFFFFFF, "<u4").repeat(4).view(HASH_ROW), np.zeros(block_size, BLOCK_ROW)
        blocks.view("<u4")[: len(self.blocks)] = np.frombuffer(self.blocks, np.uint64) if self.blocks else 0
        fill_slots(hashes, self.names, self.locales, self.platforms)
        at, head = self.at, self.head
        values = (head, at + 16 * (hash_size + block_size), policy.format_version, policy.sector_size_shift, at, at + 16 * hash_size, hash_size, block_size)
        header = bytearray(SIGNATURE + b"".join(v.to_bytes(w, "little") for v, (_, w) in zip(values, S.HEADER_V1, strict=True)))
        header += bytes(head - len(header))
        for name, width, place, version in S.HEADER_MORE:
            if policy.format_version >= version and place + width <= head:
                header[place : place + width] = int(policy.extra.get(name) or 0).to_bytes(width, "little")
        return bytes(header), b"".join(more), cipher.encrypt_block(hashes.tobytes(), HASH_KEY) + cipher.encrypt_block(blocks.tobytes(), BLOCK_KEY)


#: Files go through the cipher in groups of so many bytes, or so many files.
GROUP_BYTES, GROUP_FILES = 8 << 20, 1024


def grouped(files: Iterable, size: Callable) -> Iterator[list]:
    """Files in lists of bounded size."""
    group: list = []
    held = 0
    for f in files:
        group.append(f)
        held += size(f)
        if held >= GROUP_BYTES or len(group) >= GROUP_FILES:
            yield group
            group, held = [], 0
    if group:
        yield group


def write(out, entries: Iterable[Entry], policy: Policy) -> None:
    """A whole archive: header, files in order, hash table, block table; into a file that can be sought in, a group of files at a time."""
    archive = Assembly(policy)
    out.seek(archive.head)
    for group in grouped((pack(e, archive.step, policy.attributes) for e in entries), lambda f: f.size):
        out.write(archive.put(group))
    header, more, tables = archive.finish()
    out.write(more + tables)
    out.seek(0)
    out.write(header)


def serialize(entries: Iterable[Entry], policy: Policy) -> bytes:
    """The bytes of a whole archive."""
    out = io.BytesIO()
    write(out, entries, policy)
    return out.getvalue()
