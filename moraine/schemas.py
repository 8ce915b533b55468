"""Schemas of the tables that an archive is, fixed by the format. Unsigned 32-bit fields are longs."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _I, _B, _X = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.BinaryType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


#: name, bytes, first byte, version from which it is there
HEADER_V1 = (("header_size", 4), ("archive_size_32", 4), ("format_version", 2), ("sector_size_shift", 2), ("hash_table_pos", 4), ("block_table_pos", 4), ("hash_table_entries", 4), ("block_table_entries", 4))
HEADER_MORE = (
    ("hi_block_table_pos_64", 8, 0x20, 1), ("hash_table_pos_hi", 2, 0x28, 1), ("block_table_pos_hi", 2, 0x2A, 1),
    ("archive_size_64", 8, 0x2C, 2), ("bet_table_pos_64", 8, 0x34, 2), ("het_table_pos_64", 8, 0x3C, 2),
    ("hash_table_size_64", 8, 0x44, 3), ("block_table_size_64", 8, 0x4C, 3), ("hi_block_table_size_64", 8, 0x54, 3), ("het_table_size_64", 8, 0x5C, 3), ("bet_table_size_64", 8, 0x64, 3), ("raw_chunk_size", 4, 0x6C, 3),
)
HEADER_SIZES = {0: 0x20, 1: 0x2C, 2: 0x44, 3: 0xD0, 4: 0xD0}

ARCHIVES = _struct(
    ("archive", _S), ("archive_offset", _L), *((n, _I if n in ("format_version", "sector_size_shift") else _L) for n, _ in HEADER_V1), ("sector_size", _L), ("file_length", _L),
    *((n, _L) for n, *_ in HEADER_MORE), ("error_kind", _S), ("error_message", _S),
)
HASH_ENTRIES = _struct(("archive", _S), ("hash_index", _L), ("hash_a", _L), ("hash_b", _L), ("locale", _I), ("platform", _I), ("flags", _I), ("block_index", _L))
BLOCK_ENTRIES = _struct(("archive", _S), ("block_index", _L), ("file_pos", _L), ("compressed_size", _L), ("file_size", _L), ("flags", _L))
NAMES = _struct(("archive", _S), ("block_index", _L), ("name", _S))
LIST_ITEMS = _struct(("archive", _S), ("hash_index", _L), ("block_index", _L), ("name", _S), ("locale", _I), ("platform", _I), ("flags", _L))
FILES = _struct(("archive", _S), ("hash_index", _L), ("block_index", _L), ("name", _S), ("locale", _I), ("platform", _I), ("flags", _L), ("content", _X), ("error_kind", _S), ("error_message", _S))
MANIFEST = _struct(("archive", _S), ("ord", _L), ("name", _S), ("data", _X), ("compression", _S), ("encrypted", _B), ("fix_key", _B), ("locale", _I), ("platform", _I), ("single_unit", _B), ("sector_crc", _B))
ATTRIBUTES = _struct(("archive", _S), ("block_index", _L), ("crc32", _L), ("filetime", _L), ("md5", _X), ("patch_bit", _B))
RAW_RANGES = _struct(("archive", _S), ("label", _S), ("chunk_size", _L), ("data", _X), ("digests", _X))
TRAILERS = _struct(("archive", _S), ("trailer", _X), ("weak_size", _L))
VERIFY_REPORT = _struct(("archive", _S), ("scope", _S), ("idx", _L), ("message", _S))

TABLES = {"archives": ARCHIVES, "hash_entries": HASH_ENTRIES, "block_entries": BLOCK_ENTRIES, "names": NAMES, "list_items": LIST_ITEMS, "files": FILES, "attributes": ATTRIBUTES, "raw_ranges": RAW_RANGES, "trailers": TRAILERS}

FREE, DELETED = 0xFFFFFFFF, 0xFFFFFFFE
IMPLODE, COMPRESS, ENCRYPTED, FIX_KEY = 0x100, 0x200, 0x10000, 0x20000
PATCH_FILE, SINGLE_UNIT, DELETE_MARKER, SECTOR_CRC, EXISTS = 0x100000, 0x1000000, 0x2000000, 0x4000000, 0x80000000
