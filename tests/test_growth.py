"""Work that must grow no faster than the input: calls counted on small archives."""

import tracemalloc
from collections import Counter

import pytest

from moraine import archive as A
from moraine.functions import cipher
from moraine.operators import manifests
from moraine.plans import archives as plans
from moraine.plans import sessions
from moraine.sources import datasource as D
from moraine.sources import layout as L

ROWS = [(8 * i, f"http://example.net/{i}", f"<p>{i}</p>" * 50) for i in range(200)]


@pytest.fixture
def calls(monkeypatch):
    """How often functions are called."""
    seen = Counter()

    def count(owner, name):
        inner = getattr(owner, name)

        def counted(*args, **options):
            seen[name] += 1
            return inner(*args, **options)

        monkeypatch.setattr(owner, name, counted)

    seen.count = count
    return seen


def test_files_in_pieces_are_written_together(tmp_path, calls):
    calls.count(A, "_replace")
    rows = list(sessions.written_in_pieces(str(tmp_path), ROWS))
    assert len(rows) == len(ROWS) and calls["_replace"] == 3


def test_changes(tmp_path):
    a = A.Archive.create(str(tmp_path / "x.mpq"), L.Policy(), [L.Entry("a", b"1"), L.Entry("b", b"2")])
    with a.changes():
        a.add_file("A", b"3")
        a.add_file("c", b"4")
        a.add_file("a", b"5")
        with pytest.raises(A.InvalidInputError):
            a.remove_file("b")
    assert a.read_file("a") == b"5" and a.read_file("c") == b"4" and len(a.list()) == 4
    with pytest.raises(KeyError), a.changes():
        a.add_file("d", b"6")
        raise KeyError
    assert not a.has_file("d") and a.read_file("b") == b"2"


def test_an_archive_is_verified_once(tmp_path, calls):
    calls.count(A.Archive, "verify")
    rows = list(sessions.verification_reports(str(tmp_path), ROWS))
    assert [r[1:] for r in rows] == [(p % 5 != 0, True) for p, _, _ in ROWS] and calls["verify"] == 1


def test_plain_names_are_looked_up(tmp_path, calls):
    calls.count(A.Archive, "list")
    assert list(sessions.tool_commands(str(tmp_path), ROWS)) == [(0, 200, 0, 1, 6, 200)]
    assert calls["list"] < 10


def test_plain_patterns_find_what_a_search_finds(tmp_path):
    names = ["Ab.txt", "aB.TXT.x", "\u00c9t\u00e9", "d\\e", "d/f"]
    a = A.Archive.create(str(tmp_path / "x.mpq"), L.Policy(), [L.Entry(n, b"1") for n in names])
    for pattern in (*names, "ab.TXT", "\u00e9t\u00e9", "D\\E", "d/e", "none", ""):
        found = a.find(pattern)
        A.observers["list"] = lambda done, total: None
        try:
            assert found == a.find(pattern)
        finally:
            A.observers["list"] = None
    assert len(a.find("ab.txt")) == 1
    a.add_file("late", b"2")
    assert len(a.find("LATE")) == 1


def test_names_are_hashed_together(calls):
    names = [f"p\\{i}.bin" for i in range(500)]
    data = L.serialize([L.Entry(n, b"x") for n in names], L.Policy())
    region = L.Region(data)
    hashes, blocks = L.read_tables(region, L.read_header(region))
    calls.count(cipher, "hash_names")
    slots = L.find_slots(hashes, len(blocks), [*names, "none", names[3].upper()])
    assert slots[-2] is None and slots[-1] == slots[3] and slots[:-2] == [L.find_slot(hashes, len(blocks), n) for n in names]
    L.serialize([L.Entry(n, b"x") for n in names], L.Policy())
    assert calls["hash_names"] == 2


def test_entries_are_made_as_they_are_written(tmp_path):
    made = []

    def entries():
        for i in range(3 * L.GROUP_FILES):
            made.append(sum(f.stat().st_size for f in tmp_path.iterdir()))
            yield L.Entry(f"{i}", b"x" * 99)

    a = A.Archive.create(str(tmp_path / "x.mpq"), L.Policy(), entries())
    assert made[-1] > 0 and a.read_file("17") == b"x" * 99 and len(a.list()) == 3 * L.GROUP_FILES + 1


def test_folders_are_read_in_few_partitions(spark, tmp_path):
    (tmp_path / "d" / "_e").mkdir(parents=True)
    wanted = {f"d/{i}": b"x" * i for i in range(300)} | {"d/_e/f": b"1", "g": b""}
    for name, data in wanted.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "d" / ".aside").write_bytes(b"2")
    rows = manifests.with_contents(manifests.folder_listing(spark, f"file://{tmp_path}"), f"file://{tmp_path}")
    assert {r.path: bytes(r.content) for r in rows.collect()} == wanted
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_large_archives_are_read_in_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(D, "OPEN_BYTES", 1)
    monkeypatch.setattr(D, "PARTITION_BYTES", 1 << 12)
    entries = [L.Entry(f"{i}", b"%d" % i * 50, "zlib", True, True) for i in range(900)]
    A.Archive.create(str(tmp_path / "a.mpq"), L.Policy(), entries)
    (tmp_path / "b.mpq").write_bytes((tmp_path / "a.mpq").read_bytes()[:-100])
    reader = D.ArchiveReader({"path": str(tmp_path), "table": "files", "minpartitions": "2"})
    shares = reader.partitions()
    assert 4 <= len(shares) <= 2 * (D.SPLITS + 1) * 2
    rows = [r for share in shares for batch in reader.read(share) for r in batch.to_pylist()]
    found = {r["name"]: r["content"] for r in rows if r["archive"] == "a.mpq"}
    assert len(rows) == 902 and found | {"(listfile)": b""} == {e.name: e.data for e in entries} | {"(listfile)": b""}
    assert [r["error_kind"] for r in rows if r["archive"] == "b.mpq"] == ["Format"]


def test_tables_of_archives_are_spread(tmp_path):
    for i in range(8):
        A.Archive.create(str(tmp_path / f"{i}.mpq"), L.Policy(), [L.Entry("x", b"1")])
    reader = D.ArchiveReader({"path": str(tmp_path), "table": "names", "minpartitions": "8"})
    assert [len(s.paths) for s in reader.partitions()] == [1] * 8


def test_one_long_block_doesnt_widen_the_others():
    blocks = [b"12345678"] * 300 + [bytes(1 << 20)]
    tracemalloc.start()
    secret = cipher.encrypt_blocks(blocks, [*range(301)])
    assert cipher.decrypt_blocks(secret, [*range(301)]) == blocks
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and secret[:300:100] == [cipher.encrypt_block(b"12345678", k) for k in (0, 100, 200)]


def test_ciphers_and_writers_bound_their_batches(spark, small):
    name, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(name, "10000")
        plans.cipher_roundtrip(spark, small)
        assert spark.conf.get(name) == "2000"
    finally:
        spark.conf.set(name, was)


def test_key_recovery_bounds_its_batches(spark, small):
    from moraine.plans import vectors

    name, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(name, "10000")
        vectors.key_recovery(spark, small)
        assert spark.conf.get(name) == "2000"
    finally:
        spark.conf.set(name, was)


def test_an_archive_of_many_files_enters_names_together(calls):
    calls.count(cipher, "hash_name")
    archive = L.Assembly(L.Policy())
    archive.put([L.pack(L.Entry(f"{i}", b"x"), 4096) for i in range(500)])
    header, more, tables = archive.finish()
    assert calls["hash_name"] < 10 and len(tables) == 16 * (2048 // 2 + 501)


def test_packed_files_keep_their_attributes():
    e = L.Entry("x", b"abc" * 3000, "zlib", True, True, sector_crc=True)
    packed = L.pack(e, 4096, True)
    archive = L.Assembly(L.Policy(attributes=True))
    body = archive.put([packed])
    header, more, tables = archive.finish()
    a = A.Archive(header + body + more + tables)
    assert a.read_file("X") == e.data and a.read_attributes()[1][0]["md5"] == packed.sums["md5"] and body == L.encode(e, archive.head, 4096)[0]


def test_contents_come_as_they_stand_in_the_file(tmp_path):
    A.Archive.create(str(tmp_path / "a.mpq"), L.Policy(), [L.Entry(f"{i}", b"1") for i in range(100)])
    reader = D.ArchiveReader({"path": str(tmp_path), "table": "files"})
    rows = [r for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist()]
    assert [r["block_index"] for r in rows] == [*range(101)]


def test_names_of_a_range_are_those_of_all(tmp_path):
    A.Archive.create(str(tmp_path / "a.mpq"), L.Policy(), [L.Entry(f"{i}", b"1") for i in range(100)])
    scan = D._Scan(str(tmp_path / "a.mpq"), b"none\r77")
    scan.tables()
    names = scan.names()
    assert names == {i: f"{i}" for i in range(100)} | {100: "(listfile)"}
    assert scan.names(10, 20) | scan.names(20) == {b: n for b, n in names.items() if b >= 10} and len(scan.names(10, 20)) == 10


def test_extraction_moves_contents_only_for_paths_that_meet(spark, tmp_path):
    archives = tmp_path / "in"
    archives.mkdir()
    A.Archive.create(str(archives / "a.mpq"), L.Policy(), [L.Entry("d\\x", b"1"), L.Entry("y", b"2")])
    A.Archive.create(str(archives / "b.mpq"), L.Policy(), [L.Entry("z", b"3")])

    def run(out, wanted):
        files, items = (plans._named(D.read_archives(spark, str(archives), t)) for t in ("files", "list_items"))
        rows = D.extract_files(files, str(tmp_path / out), items)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert {r.path for r in rows.collect()} == set(wanted) and all((tmp_path / out / p).read_bytes() == d for p, d in wanted.items())
        return "Join" in plan

    assert not run("one", {"d/x": b"1", "y": b"2", "z": b"3"})
    A.Archive.create(str(archives / "b.mpq"), L.Policy(), [L.Entry("d/./x", b"3"), L.Entry("z", b"3")])
    assert run("two", {"d/x": b"1", "y": b"2", "z": b"3"})


def test_attributes_of_many_archives_are_spread(tmp_path):
    for i in range(20):
        A.Archive.create(str(tmp_path / f"{i}.mpq"), L.Policy(attributes=True), [L.Entry("x", b"1")])
    reader = D.ArchiveReader({"path": str(tmp_path), "table": "attributes", "minpartitions": "4"})
    assert [len(s.paths) for s in reader.partitions()] == [5] * 4
    assert sum(len(b) for s in reader.partitions() for b in reader.read(s)) == 20 * 3


def test_many_files_are_decoded_together_and_errors_stay_in_their_places(calls):
    names = [f"{i}" for i in range(100)]
    data = L.serialize([L.Entry(n, n.encode() * 3000, "zlib", True) for n in names], L.Policy())
    region = L.Region(data)
    header = L.read_header(region)
    _, blocks = L.read_tables(region, header)
    calls.count(cipher, "decrypt_blocks")
    found = L.decode_many(region, header, [*zip(blocks, names), ((0, 1 << 31, 1, 1 << 31), "beyond"), ((0, 0, 0, 0), None), (blocks[7], "other")])
    assert found[:100] == [n.encode() * 3000 for n in names] and calls["decrypt_blocks"] == 1
    assert [type(x).__name__ for x in found[100:102]] == ["BoundsError", "NotFoundError"] and isinstance(found[102], Exception)


def test_small_files_are_encrypted_together(calls):
    entries = [L.Entry(f"{i}", b"%d" % i * 900, "zlib", True, True, sector_crc=i % 2 == 0) for i in range(300)]
    archive = L.Assembly(L.Policy())
    calls.count(cipher, "encrypt_blocks")
    body = archive.put([L.pack(e, 4096) for e in entries])
    assert calls["encrypt_blocks"] == 1
    header, more, tables = archive.finish()
    a = A.Archive(header + body + more + tables)
    assert all(a.read_file(e.name) == e.data for e in entries)


def test_packed_files_are_written_as_they_are(tmp_path, calls):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    packed = [L.pack(L.Entry(f"{i}", b"abc" * 2000, "zlib"), 4096) for i in range(5)]
    rows = [("a", f.name, f.stored, f.size, f.flags, 0, 0, None, None) for f in packed]
    schema = to_arrow_schema(D.PACKED)
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    writer = D.ArchiveWriter({"path": str(tmp_path)}, D.PACKED, True)
    calls.count(D.L, "pack")
    writer.commit([writer.write(iter([batch]))])
    assert calls["pack"] == 1  # the list of names
    a = A.Archive.open(str(tmp_path / "a.mpq"))
    assert all(a.read_file(f"{i}") == b"abc" * 2000 for i in range(5))


def test_checksums_of_sectors_stay_behind_encrypted_ones():
    import zlib

    from moraine.functions import digests

    e = L.Entry("x", bytes(range(256)) * 100, "zlib", True, sector_crc=True)
    stored, flags = L.encode(e, 32, 4096)
    plain = L.pack(e, 4096)
    count = -(-plain.size // 4096)
    offsets = [int.from_bytes(plain.stored[4 * i : 4 * i + 4], "little") for i in range(count + 2)]
    sums = digests.decode_sector_checksums(stored[offsets[-2] : offsets[-1]], count)
    assert sums == [zlib.adler32(plain.stored[a:b]) for a, b in zip(offsets[:count], offsets[1:])] and len(stored) == offsets[-1]


def test_bzip2_is_packed_before_files_move(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"{k}", b"%d" % k * 4000) for k in range(8)], "name string, data binary").repartition(4)
    seen = []
    inner = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: seen.append(self.columns) or inner(self, *a))
    D.write_archives(rows.selectExpr("'a' AS archive", "name", "data", "'bzip2' AS compression"), str(tmp_path))
    assert "stored" in seen[0] and "data" not in seen[0]
    a = A.Archive.open(str(tmp_path / "a.mpq"))
    assert all(a.read_file(f"{k}") == b"%d" % k * 4000 for k in range(8)) and a.header["archive_size_32"] < 8000
