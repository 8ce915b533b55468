import random
import zlib

import pytest

from moraine import archive as A
from moraine import errors as E
from moraine.sources import attributes
from moraine.sources import layout as L

R = random.Random(1)
ENTRIES = [
    L.Entry("a\\alpha.txt", b"hello alpha" * 900, "zlib"), L.Entry("beta.bin", R.randbytes(9000), "zlib", True, True, sector_crc=True), L.Entry("c.txt", b"Z" * 12000, "bzip2", True),
    L.Entry("empty", b""), L.Entry("e/raw.bin", R.randbytes(5000), "none", True, True), L.Entry("single", b"secret payload", "none", True, single_unit=True), L.Entry("pk.txt", b"abc def " * 3000, "pkware", True),
    L.Entry("huff", b"hhhhuuufff" * 600, "huffman"), L.Entry("sparse", bytes(6000) + b"x", "sparse"), L.Entry("lz", b"q" * 9000, "lzma"),
]


@pytest.fixture
def made(tmp_path):
    return A.Archive.create(str(tmp_path / "x.mpq"), L.Policy(attributes=True), ENTRIES)


def test_round_trip_after_reopening(made):
    again = A.Archive.open(made.path)
    for e in ENTRIES:
        assert again.read_file(e.name.upper().replace("\\", "/")) == e.data
    assert again.verify().ok() and again.signature() == "none"
    assert {i.name for i in again.find("*.TXT")} == {"a\\alpha.txt", "c.txt", "pk.txt"}
    assert again.has_file("BETA.BIN") and not again.has_file("nothing")
    flags, rows = again.read_attributes()
    assert flags == again.attribute_flags() == 7 and rows[0]["crc32"] == zlib.crc32(ENTRIES[0].data)


def test_changes(made):
    made.add_file("new", b"xx", locale=7)
    made.remove_file("EMPTY")
    made.rename_file("new", "newer")
    made.set_file_locale("newer", 1031, 1)
    assert made.locales("newer") == [1031] and made.read_file("newer", 1031) == b"xx"
    writer = made.create_file("w", 4)
    writer.write(b"ab")
    with pytest.raises(E.InvalidInputError):
        writer.finish()
    with pytest.raises(E.InvalidInputError):
        writer.write(b"cde")
    writer.write(b"cd")
    writer.finish()
    assert made.read_file("W") == b"abcd"
    with pytest.raises(E.InvalidInputError):
        made.rename_file("w", "NEWER")
    with pytest.raises(E.NotFoundError):
        made.remove_file("empty")
    made.set_max_files(256, 64)
    made.compact()
    assert len(made.hashes) == 256 and made.has_file(L.ATTRIBUTES)
    for e in ENTRIES:
        assert e.name == "empty" or made.read_file(e.name) == e.data
    made.sync_attributes()
    assert made.read_attributes()[0] == attributes.ALL


def test_list_of_names_has_the_known_text():
    assert zlib.crc32(L.listfile_text(["beta.bin", "alpha.txt"])) == 272706041


def test_unnamed_files(tmp_path):
    wave = b"RIFF" + (992).to_bytes(4, "little") + bytes(992)
    a = A.Archive.create(str(tmp_path / "y.mpq"), L.Policy(listfile=False), [L.Entry("k.wav", wave, "none", True, single_unit=True), L.Entry("k2", b"aaaa" * 5000, "zlib", True)])
    assert [i.name for i in a.list()] == [None, None] and a.list(A.NAMED) == [] and len(a.find("*", A.ALL)) == 2 and a.find("k*", A.ALL) == []
    assert {a.read_block(0), a.read_block(1)} == {wave, b"aaaa" * 5000}
    with pytest.raises(E.UnsupportedFeatureError):
        a.add_file("z", b"")
    assert a.add_names(b"k.wav\r\n k2 \r\nmissing\r\n") == 2


def test_patches_overlay(tmp_path, made):
    one = A.Archive.create(str(tmp_path / "p1.mpq"), L.Policy(), [L.Entry("single", b"patched"), L.Entry("new", b"n")])
    two = A.Archive.create(str(tmp_path / "p2.mpq"), L.Policy(), [L.Entry("base\\(patch_metadata)", b""), L.Entry("base\\single", b"again")])
    made.attach_patch(one.path)
    made.attach_patch(one.path)
    assert made.read_file("single") == b"patched" and made.read_file("new") == b"n" and len(made.patches) == 1
    made.attach_patch(two.path)
    assert made.read_file("SINGLE") == b"again" and made.has_file_any("new") and made.is_patched()
    assert "single" in [i.name for i in made.list_all()]


def test_extraction_stays_below_the_folder(tmp_path):
    a = A.Archive.create(str(tmp_path / "z.mpq"), L.Policy(), [L.Entry("..\\..\\evil", b"1"), L.Entry("d/./e", b"2")])
    paths = a.extract_all(str(tmp_path / "out"))
    assert {p.replace(str(tmp_path), "") for p in paths} == {"/out/evil", "/out/d/e", "/out/(listfile)"}


@pytest.mark.parametrize("version,size", [(0, 0x20), (1, 0x2C), (2, 0x44), (3, 0xD0)])
def test_header_versions(tmp_path, version, size):
    a = A.Archive.create(str(tmp_path / "v.mpq"), L.Policy(format_version=version, header_size=size), [L.Entry("f", b"data")])
    assert a.header["header_size"] == size and a.read_file("f") == b"data"
    assert (a.header["raw_chunk_size"] is not None) == (version == 3)


@pytest.mark.parametrize("change,kind", [((0, b"XXXX"), "Format"), ((12, b"\x09\0"), "UnsupportedFeature"), ((24, b"\x07\0\0\0"), "Format"), ((28, b"\0\0\0\0"), "Format"), ((16, b"\xff\xff\xff\x7f"), "Format")])
def test_damaged_headers(made, change, kind):
    data = bytearray(made.region.read(0, made.region.size))
    data[change[0] : change[0] + len(change[1])] = change[1]
    with pytest.raises(E.ArchiveError) as e:
        A.Archive(bytes(data))
    assert e.value.kind == kind
    with pytest.raises(E.FormatError):
        A.Archive(bytes(data[:10]))


def test_damaged_tables(made):
    made.hashes, made.blocks = made.hashes.copy(), made.blocks.copy()
    made.hashes["block_index"][made.slot("c.txt")] = 99
    made.blocks["compressed_size"][0] = 0xFFFFFFF0
    report = made.verify()
    assert any("points to invalid block index 99" in m for m in report.table_errors)
    assert report.file_errors == ["block[0] data range exceeds archive length"] and not report.ok()
    assert not made.verify_file("a\\alpha.txt").ok() and made.verify_file("beta.bin").ok()


def test_raw_chunks(made):
    assert made.verify_raw("file").ok()  # no digests: nothing to say
    made.header["raw_chunk_size"] = 64
    with pytest.raises(E.InvalidInputError):
        made.verify_raw("file")
    assert not made.verify_raw("file", "c.txt").ok() and made.verify_raw("header").ok() and made.verify_raw("het").ok()


def test_handles_and_modes(made):
    assert made.open_file("C.TXT").read_all() == b"Z" * 12000
    with pytest.raises(E.NotFoundError):
        made.open_file("nothing")
    assert all(made.verify_mode(*m).ok() for m in (("archive",), ("file", "c.txt"), ("raw", "c.txt")))
    for bad in (("file",), ("other",)):
        with pytest.raises(E.InvalidInputError):
            made.verify_mode(*bad)


def test_attribute_sizes():
    rows = [{"crc32": i, "filetime": 0, "md5": bytes([i]) * 16, "patch_bit": i % 3 == 0} for i in range(17)]
    data = attributes.serialize(attributes.ALL, rows)
    assert attributes.parse(data, 17)[1] == rows and attributes.parse(data, 18)[1] == rows
    assert attributes.parse(data)[1][:17] == rows
    for bad in (data[:5], b"\1" + data[1:], data + b"xyz"):
        with pytest.raises(E.FormatError):
            attributes.parse(bad, 17)
