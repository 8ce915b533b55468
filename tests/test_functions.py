import math
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.errors import CompressionError, FormatError, UnsupportedFeatureError
from moraine.functions import cipher, codecs, digests, huffman, patches, pkware

DATA = st.one_of(st.binary(min_size=4, max_size=600), st.lists(st.sampled_from([0, 0, 0, 1, 65, 255]), min_size=4, max_size=900).map(bytes))


def test_hashes_of_known_names():
    assert cipher.hash_name("(hash table)", cipher.FILE_KEY) == 0xC3AF3770
    assert cipher.hash_name("(block table)", cipher.FILE_KEY) == 0xEC83B3A3
    want = [0x5326889B, 0xB0B79012, 0xB499FCF9]
    assert [int(x) for x in cipher.hash_names([b"Foo/Bar.txt", b"", b"longer than the first"])[0]] == want
    assert [cipher.hash_name("foo\\BAR.TXT", k) for k in (cipher.START, cipher.NAME_A, cipher.NAME_B)] == want


def test_cipher_vector():
    key = cipher.file_key("fixtures\\models\\footman.mdx", 0, 12, False)
    assert cipher.encrypt_block(bytes.fromhex("11223344cafebabeaabbccdd"), key).hex() == "cceec7070e38b6b2800230fa"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=8, max_size=20), st.integers(0, 2**32 - 1))
def test_many_blocks_are_as_one_by_one(blocks, key):
    keys = [key + i for i in range(len(blocks))]
    secret = cipher.encrypt_blocks(blocks, keys)
    assert secret == [cipher.encrypt_block(b, k) for b, k in zip(blocks, keys, strict=True)]
    assert cipher.decrypt_blocks(secret, keys) == blocks


def test_key_recovery():
    wave = b"RIFF" + struct.pack("<I", 92) + bytes(range(92))
    assert cipher.key_from_content(cipher.encrypt_block(wave, 0x12345678), 100, 100) == 0x12345678
    assert cipher.key_from_content(b"x" * 40, 100, 100) is None
    table = struct.pack("<3I", 12, 500, 900)
    assert cipher.key_from_offsets(cipher.encrypt_block(table, 0xCAFE - 1), 4096, 12) == 0xCAFE


@settings(max_examples=40, deadline=None)
@given(DATA)
def test_codecs_round_trip(data):
    for method in ("zlib", "bzip2", "lzma", "pkware", "huffman", "sparse"):
        assert codecs.decompress(method, codecs.compress(method, data), len(data)) == data
    for kind in range(9):
        assert huffman.decompress(huffman.compress(data, kind)) == data
    packed, smaller = codecs.compress_masked("zlib", data)
    assert (codecs.decompress_masked(packed, len(data)) if smaller else packed) == data


def test_public_explode_vector():
    assert pkware.explode(bytes.fromhex("00048224258f807f")) == b"AIAIAIAIAIAIA"


def test_sparse_with_a_short_tail():
    for data in (b"\0\0\0\0\x01", bytes(131), bytes(132) + b"x", b"abc" + bytes(5)):
        assert codecs.decompress("sparse", codecs.compress("sparse", data), len(data)) == data


@pytest.mark.parametrize("channels", [1, 2])
def test_adpcm_is_close(channels):
    samples = [int(9000 * math.sin(i / 9)) for i in range(2000)]
    raw = struct.pack("<2000h", *samples)
    method = ("adpcm_mono", "adpcm_stereo")[channels - 1]
    back = struct.unpack("<2000h", codecs.decompress(method, codecs.compress(method, raw), len(raw)))
    assert max(abs(a - b) for a, b in zip(samples, back, strict=True)) < 400


def test_chains_of_codecs():
    data = b"abcabcabc" * 40
    inner = codecs.compress("sparse", data)
    assert codecs.decompress_masked(bytes([0x22]) + zlib.compress(inner), len(data)) == data
    with pytest.raises(UnsupportedFeatureError):
        codecs.decompress_masked(bytes([0x22]) + zlib.compress(inner), len(data), strict=True)
    with pytest.raises(CompressionError):
        codecs.decompress_masked(b"", 3)
    with pytest.raises(UnsupportedFeatureError):
        codecs.decompress_masked(b"\x04abc", 3)


def test_digests():
    assert zlib.adler32(b"abc") == 0x024D0127
    words = [1, 0xDEADBEEF, 0, 7] * 9
    assert digests.decode_sector_checksums(digests.encode_sector_checksums(words), len(words)) == words


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_patches(old, new):
    assert patches.apply(old, patches.make_patch(old, new)) == new
    assert patches.apply(None, b"x") == b"x" and patches.apply(old, b"replaced") == b"replaced"
    assert patches.apply(old, patches.make_patch(old, old, patches.COPY)) == old


def test_patch_for_another_base():
    with pytest.raises(FormatError):
        patches.apply(b"other", patches.make_patch(b"old", b"new"))
    with pytest.raises(FormatError):
        patches.apply(b"same size", patches.make_patch(b"size same", b"new"))
