import pytest
from pyspark.sql import functions as F

from moraine.functions import names as N
from moraine.functions.cipher import hash_names
from moraine.operators import integrity, listing, manifests, overlay
from moraine.sources.datasource import extract_files, read_archives, write_archives


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archives"))
    rows = spark.range(20).select(
        F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("archive"), F.col("id").alias("ord"), F.concat(F.lit("dir\\f"), F.col("id").cast("string"), F.lit(".txt")).alias("name"),
        F.encode(F.repeat(F.lit("text "), (F.col("id") * 500).cast("int")), "UTF-8").alias("data"), F.lit("zlib").alias("compression"),
    )
    write_archives(rows, path)
    return path


def test_tables_agree(spark, folder):
    t = {n: read_archives(spark, folder, n) for n in ("archives", "hash_entries", "block_entries", "names", "list_items")}
    assert t["archives"].count() == 3
    joined = listing.list_items(t["hash_entries"], t["block_entries"], t["names"])
    key = ["archive", "hash_index"]
    assert joined.orderBy(key).collect() == t["list_items"].orderBy(key).collect()
    assert joined.count() == 23  # with the lists of names
    assert integrity.verify(t["archives"], t["hash_entries"], t["block_entries"]).isEmpty()


def test_contents_and_block_ranges(spark, folder):
    whole = read_archives(spark, folder, "files").orderBy("archive", "hash_index").collect()
    parts = read_archives(spark, folder, "files", blocksPerPartition=2)
    assert parts.rdd.getNumPartitions() > 3 and parts.orderBy("archive", "hash_index").collect() == whole
    assert all(r.error_kind is None for r in whole)
    assert {r.name: len(r.content) for r in whole if r.name.startswith("dir")} == {f"dir\\f{i}.txt": 2500 * i for i in range(20)}
    assert {r.archive for r in read_archives(spark, folder, archives="a1.mpq").collect()} == {"a1.mpq"}


def test_extraction(spark, folder, tmp_path):
    files = read_archives(spark, folder, "files").where("name not like '(%'")
    out = extract_files(files.union(files), str(tmp_path)).collect()
    assert {r.path for r in out} == {f"dir/f{i}.txt" for i in range(20)}
    assert all((tmp_path / f"dir/f{i}.txt").stat().st_size == 2500 * i for i in range(20)) and len([*tmp_path.rglob("*")]) == 21


def test_damaged_archive_is_a_row(spark, tmp_path):
    (tmp_path / "bad.mpq").write_bytes(b"MPQ\x1a" + bytes(60))
    (tmp_path / "none.mpq").write_bytes(b"")
    rows = read_archives(spark, str(tmp_path), "archives").collect()
    assert {(r.archive, r.error_kind) for r in rows} == {("bad.mpq", "Format"), ("none.mpq", "Format")}
    assert {r.error_kind for r in read_archives(spark, str(tmp_path), "files").collect()} == {"Format"}
    with pytest.raises(Exception, match="header too small|too small"):
        read_archives(spark, str(tmp_path), "files", strict="true").collect()


def test_rows_of_an_archive_must_be_together(spark, tmp_path):
    rows = spark.range(4).select(F.lit("one").alias("archive"), F.col("id").cast("string").alias("name"), F.lit(b"").alias("data")).repartition(4, "name")
    with pytest.raises(Exception, match="more than one partition"):
        rows.write.format("mpq").mode("append").save(str(tmp_path))
    assert not [p for p in tmp_path.iterdir()]


def test_look_up_stops_at_free_slots(spark):
    start, a, b = (int(x) for x in hash_names([b"name"])[0])
    free = 0xFFFFFFFF

    def table(blocks):
        rows = [("x", i, a if blk < 9 else 0, b if blk < 9 else 0, loc, 0, 0, blk) for i, (blk, loc) in enumerate(blocks)]
        return spark.createDataFrame(rows, "archive string, hash_index long, hash_a long, hash_b long, locale int, platform int, flags int, block_index long")

    wanted = spark.createDataFrame([("x", "name"), ("x", "other")], "archive string, name string")
    blocks = spark.range(9).select(F.lit("x").alias("archive"), F.col("id").alias("block_index"))
    at = start & 7
    slots = [(free, 0)] * 8
    slots[at], slots[(at + 1) & 7], slots[(at + 3) & 7] = (0xFFFFFFFE, 0), (3, 7), (4, 0)
    found = listing.look_up(wanted, table(slots), blocks).collect()
    assert [(r.name, r.block_index) for r in found] == [("name", 3)]
    assert listing.look_up(wanted, table(slots), blocks, 0).first().block_index == 3  # the neutral one isn't reached
    slots[(at + 2) & 7] = (5, 0)
    assert listing.look_up(wanted, table(slots), blocks, 0).first().block_index == 5
    assert listing.look_up(wanted, table(slots), blocks, 7).first().block_index == 3
    slots[at] = (free, 0)
    assert listing.look_up(wanted, table(slots), blocks).isEmpty()


@pytest.mark.parametrize("pattern,fits", [("*", "a.txt b c\n é x*y abx"), ("*x", "abx"), ("?", "b c"), ("??", "é"), ("A.T?T", "a.txt"), ("x*y", "x*y"), ("", "")])
def test_globs(spark, pattern, fits):
    names = spark.createDataFrame([("a.txt",), ("b",), ("c\n",), ("é",), ("x*y",), ("abx",), (None,)], "name string")
    got = {r.name for r in names.where(N.matches(F.col("name"), pattern)).collect()}
    if pattern == "??":
        assert got == {"é", "c\n"}
    elif pattern == "?":
        assert got == {"b"}
    else:
        assert got == set(fits.split(" ")) - {""}


def test_names(spark):
    row = spark.range(1).select(
        N.safe_path(F.lit("..\\ a /./b\\..")).alias("path"), N.safe_path(F.lit("//..")).alias("none"), N.patch_prefix(F.lit(" base/x// ")).alias("prefix"), N.patch_prefix(F.lit("//")).alias("empty"),
        N.ascii_lower(F.lit("ÀB")).alias("lower"), N.base_name(F.lit("a/b\\c.d")).alias("base"),
    ).first()
    assert tuple(row) == ("a/b", "unnamed.bin", "base\\x\\", None, "Àb", "c.d")


def test_changes_of_manifests(spark):
    base = spark.createDataFrame([("a", "One", 1), ("a", "two", 2)], "archive string, name string, locale int")
    new = spark.createDataFrame([("a", "ONE", 9)], "archive string, name string, locale int")
    assert {tuple(r) for r in manifests.upsert(base, new, ["archive", "name"], True).collect()} == {("a", "ONE", 9), ("a", "two", 2)}
    assert manifests.delete(base, new, ["archive", "name"], True).count() == 1 and manifests.delete(base, new, ["archive", "name"]).count() == 2
    clash = spark.createDataFrame([("a", "one", "two")], "archive string, old string, new string")
    with pytest.raises(Exception, match="there is a file of the name"):
        manifests.rename(base.withColumn("locale", F.lit(0)), clash).collect()


def test_folder_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"abc")
    (tmp_path / "(listfile)").write_bytes(b"x")
    rows = manifests.folder_manifest(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.path, r.size) for r in rows] == [("(listfile)", 1), ("d/x.bin", 3)]
    assert [r.name for r in manifests.folder_entries(spark, str(tmp_path), "a").collect()] == ["d\\x.bin"]
    other = manifests.folder_manifest(spark, str(tmp_path)).where("size = 3").withColumn("size", F.lit(4))
    assert {tuple(r) for r in manifests.compare(manifests.folder_manifest(spark, str(tmp_path)), other).collect()} == {("(listfile)", "missing"), ("d/x.bin", "mismatch")}


def test_raw_chunks(spark):
    import hashlib

    data = bytes(range(200))
    sums = b"".join(hashlib.md5(data[i : i + 64]).digest() for i in range(0, 200, 64))
    rows = spark.createDataFrame([("a", "good", 64, data, sums), ("a", "bad", 64, data, sums[:32] + bytes(32)), ("a", "empty", 64, b"", b"")], "archive string, label string, chunk_size int, data binary, digests binary")
    assert [tuple(r) for r in integrity.raw_chunks(rows).collect()] == [("a", "bad", 2)]


def test_merged_names(spark):
    items = spark.createDataFrame(
        [("b", 0, 0, "x/y", 0, 0, 1), ("p", 0, 0, "base/x\\y", 0, 0, 2), ("p", 1, 1, "base\\new", 0, 0, 3), ("p", 2, 2, "other\\z", 0, 0, 4), ("p", 3, 3, None, 0, 0, 5)],
        "archive string, hash_index long, block_index long, name string, locale int, platform int, flags long",
    )
    chain = spark.createDataFrame([("b", 0, None), ("p", 1, "base")], "archive string, ord long, prefix string")
    assert {(r.name, r.flags) for r in overlay.list_all(items, chain).collect()} == {("x/y", 1), ("x\\y", 2), ("new", 3)}
    names = spark.createDataFrame([("x/y",), ("new",), ("gone",)], "name string")
    assert {(r.name, r.archive) for r in overlay.has_any(names, items, chain).collect()} == {("x/y", "p"), ("new", "p")}
