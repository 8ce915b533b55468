import json

from moraine import tools
from moraine.archive import Archive
from moraine.sources import layout as L
from moraine.sources import texts
from moraine.streaming.arrivals import arrivals, totals


def test_commands(tmp_path, capsys):
    archive = str(tmp_path / "a.mpq")
    Archive.create(archive, L.Policy(), [L.Entry("d\\x.txt", b"abc" * 2000, "zlib", True, True), L.Entry("y.bin", b"1234")])
    assert tools.main(["list", archive, "--pattern", "*.txt"]) == 0 and capsys.readouterr().out == "d\\x.txt\n"
    assert tools.main(["listfile", archive]) == 0 and capsys.readouterr().out.split() == ["d\\x.txt", "y.bin"]
    out, expected = str(tmp_path / "out"), str(tmp_path / "e.json")
    assert tools.main(["extract", archive, out]) == 0 and tools.main(["manifest", out, expected]) == 0
    assert tools.main(["run", archive, expected, str(tmp_path / "again")]) == 0
    assert tools.main(["repack", out, str(tmp_path / "b.mpq"), "--like", archive]) == 0
    again = Archive.open(str(tmp_path / "b.mpq"))
    assert again.read_file("d/x.txt") == b"abc" * 2000 and next(i for i in again.list() if i.name == "d\\x.txt").flags == next(i for i in Archive.open(archive).list() if i.name == "d\\x.txt").flags
    rows = json.loads((tmp_path / "e.json").read_text())
    (tmp_path / "f.json").write_text(json.dumps([dict(r, size=0) if r["path"] == "y.bin" else r for r in rows if r["path"] != "d/x.txt"]))
    capsys.readouterr()
    assert tools.main(["compare", expected, str(tmp_path / "f.json"), "--allow", "d/x.txt"]) == 1
    assert json.loads(capsys.readouterr().out) == {"missing": [], "mismatch": ["y.bin"], "allowed": ["d/x.txt"], "extra": []}
    assert tools.main(["vectors", str(tmp_path / "out" / "d" / "x.txt"), str(tmp_path / "v")]) == 0
    assert {p.stem for p in (tmp_path / "v").iterdir()} == {"input", "huffman", "adpcm_mono", "adpcm_stereo", "sparse", "pkware"}


def test_checklist_and_sources(spark, tmp_path, capsys):
    features = [{"id": f"f{i}", "area": "x", "description": "d", "status": s, "evidence": "e"} for i, s in enumerate(("implemented", "implemented", "partial"))]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "features": features}, indent=1))
    assert tools.main(["checklist", str(tmp_path / "m.json")]) == 0 and "total=3 implemented=2 partial=1" in capsys.readouterr().out
    assert {(r.status, r["count"]) for r in texts.checklist(spark, str(tmp_path / "m.json")).groupBy("status").count().collect()} == {("implemented", 2), ("partial", 1)}
    (tmp_path / "api.h").write_text("#define X\nbool   WINAPI XFileOpen(const char * n,   int f);\nint Other(void);\nDWORD XCompress (void * p);\n")
    found = texts.c_declarations(spark, str(tmp_path / "api.h"), ("XFile", "XComp")).orderBy("name").collect()
    assert [(r.name, r.return_type, r.args) for r in found] == [("XCompress", "DWORD", "void * p"), ("XFileOpen", "bool", "const char * n, int f")]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("pub fn free() {\n}\nimpl Thing {\n    pub fn inner(&self) {\n    }\n    fn hidden() {}\n}\npub fn late() {}\n")
    there = texts.public_functions(spark, str(tmp_path / "src"), "Thing")
    assert {r.name for r in there.collect()} == {"free", "Thing::inner", "late"}
    wanted = spark.createDataFrame([("free",), ("gone",)], "name string")
    assert {tuple(r) for r in texts.coverage(wanted, there.where("name <> 'late'")).collect()} == {("free", "covered"), ("gone", "missing"), ("Thing::inner", "extra")}


def test_archives_that_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    Archive.create(str(folder / "a.mpq"), L.Policy(), [L.Entry("x", b"abc")])
    (folder / "bad.mpq").write_bytes(b"nothing")
    stream = totals(arrivals(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        stream.processAllAvailable()
        assert {(r.archive, r.files) for r in spark.table("arrived").collect()} == {("a.mpq", 2)}
        Archive.create(str(folder / "b.mpq"), L.Policy(listfile=False), [L.Entry("x", b"abc"), L.Entry("y", b"")])
        stream.processAllAvailable()
        assert {(r.archive, r.files, r.bytes) for r in spark.table("arrived").where("archive = 'b.mpq'").collect()} == {("b.mpq", 2, 3)}
    finally:
        stream.stop()
