"""Queries that use archives as a program does, through `Archive` and the commands: a session for each of eight archives, in the executors."""

from __future__ import annotations

import contextlib
import hashlib
import io
import itertools
import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import archive as A
from .. import tools
from ..sources import layout as L
from ..storage import shared_folder

COUNT, ROWS = 8, 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _mounted(folder: str) -> str:
    """The shared folder as a path: sessions open files as programs do."""
    return "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder


class Pages:
    """The pages of one archive by page_id, as often as they are asked for: they wait in a file, of which a batch is held at a time."""

    def __init__(self, path: str, batches: Iterable[pa.RecordBatch]):
        self.path, self.count = path, 0
        with pa.OSFile(path, "wb") as f, contextlib.ExitStack() as stack:
            out = None
            for batch in batches:
                out = out or stack.enter_context(pa.ipc.new_stream(f, batch.schema))
                out.write_batch(batch)
                self.count += len(batch)

    def __iter__(self) -> Iterator[tuple[int, str, str]]:
        with pa.OSFile(self.path) as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                for a in range(0, len(batch), ROWS):
                    part = batch.slice(a, ROWS)
                    yield from zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "html")), strict=True)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, place: int) -> tuple[int, str, str]:
        return next(itertools.islice(self, place, None))


def _by_archive(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(k, its batches) of batches sorted by k."""
    def cut() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            yield from ((int(k[a]), batch.slice(a, b - a)) for a, b in itertools.pairwise(cuts) if b > a)

    for k, group in itertools.groupby(cut(), lambda x: x[0]):
        yield k, (batch for _, batch in group)


def session(schema: str, sql: str):
    """Registers f(folder of its own, pages of one archive), which yields rows."""

    def add(f: Callable):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            base = _mounted(shared_folder(spark))
            types = to_arrow_schema(_parse_datatype_string(schema))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for _, its in _by_archive(batches):
                    folder = f"{base}/{uuid.uuid4().hex}"
                    os.makedirs(folder)
                    rows = iter(f(folder, Pages(f"{folder}/pages.arrow", its)))
                    while part := list(itertools.islice(rows, ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), types, strict=True)], schema=types)
                    os.unlink(f"{folder}/pages.arrow")

            pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.pmod("page_id", F.lit(COUNT)).cast("int").alias("k"), "page_id", "url", "html")
            return pages.repartitionById(COUNT, "k").sortWithinPartitions("k", "page_id").mapInArrow(run, schema)

        QUERIES[f.__name__] = query
        ORACLE[f.__name__] = sql
        return f

    return add


def _name(page: int) -> str:
    return f"p\\{page}.bin"


def _entries(rows, **options) -> Iterator[L.Entry]:
    return (L.Entry(_name(p), url.encode(), **options) for p, url, _ in rows)


def _md5(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()


@session("page_id long, md5 string", "SELECT page_id, md5(url) AS md5 FROM pages")
def handle_reads(folder, rows):
    """Handles, opened by names in another case and with other slashes."""
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(), _entries(rows, compression="zlib", encrypted=True))
    for p, _, _ in rows:
        yield p, _md5(a.open_file(f"P/{p}.BIN").read_all())


@session("page_id long, md5 string", "SELECT page_id, md5(url) AS md5 FROM pages")
def written_in_pieces(folder, rows):
    """An empty archive is created; a tenth of the files come in pieces, the others at once. It is written when all of those that come in pieces are there."""
    a = A.Archive.create(f"{folder}/a.mpq")
    a.rewrite([*_entries(r for r in rows if r[0] % 10)])
    with a.changes():
        for p, url, _ in rows:
            if p % 10 == 0:
                data = url.encode()
                writer = a.create_file(_name(p), len(data), compression="zlib")
                writer.write(data[:7])
                writer.write(data[7:])
                writer.finish()
    again = A.Archive.open(a.path)
    for p, _, _ in rows:
        yield p, _md5(again.read_file(_name(p)))


@session(
    "k long, hash_entries long, files long, kept long",
    """SELECT k, greatest(1024, CAST(pow(2, ceil(log2(2 * (n + 1)))) AS BIGINT)) AS hash_entries, n + 1 AS files, n AS kept FROM (SELECT page_id % 8 AS k, count(*) AS n FROM pages GROUP BY 1)""",
)
def tables_grown(folder, rows):
    """Larger tables, then a compacted archive: the files stay."""
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(), _entries(rows))
    a.set_max_files(1024, 700)
    a.compact()
    yield rows[0][0] % COUNT, len(a.hashes), len(a.list()), sum(a.read_file(_name(p)) == url.encode() for p, url, _ in rows)


@session("k long, listed long, added long, compacted long, last string", "SELECT page_id % 8 AS k, count(*) + 1 AS listed, count(*) AS added, CAST(1 AS BIGINT) AS compacted, count(*) || '/' || count(*) AS last FROM pages GROUP BY 1")
def observer_calls(folder, rows):
    """How often observers are called while files are listed, written and an archive is compacted."""
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(), _entries(rows))
    calls: dict[str, list[tuple[int, int]]] = {"list": [], "add": [], "compact": []}
    a.list()
    try:
        for what in calls:
            A.observers[what] = lambda done, total, what=what: calls[what].append((done, total))
        a.list()
        listed = len(calls["list"])
        A.observers["list"] = None
        a.compact()
    finally:
        A.observers.update(dict.fromkeys(calls))
    yield rows[0][0] % COUNT, listed, len(calls["add"]), len(calls["compact"]), "/".join(map(str, calls["add"][-1]))


@session("k long, before long, added long, again long, named long", "SELECT page_id % 8 AS k, CAST(0 AS BIGINT) AS before, count(*) AS added, CAST(0 AS BIGINT) AS again, count(*) AS named FROM pages WHERE page_id % 3 <> 0 GROUP BY 1")
def names_given(folder, rows):
    """An archive without a list of names gets one: how many names are new, at first and when they come again."""
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(listfile=False), _entries(rows))
    before = len(a.list(A.NAMED))
    text = "".join(f" {_name(p)} \r\n" for p, _, _ in rows if p % 3) + "not\\there.bin\r\n"
    added = a.add_names(text.encode())
    yield rows[0][0] % COUNT, before, added, a.add_names(text.encode()), len(a.list(A.NAMED))


@session("page_id long, ok boolean, structure boolean", "SELECT page_id, page_id % 5 <> 0 AS ok, true AS structure FROM pages")
def verification_reports(folder, rows):
    """Reports on archives in which the first sector of every fifth file is overwritten."""
    entries = (L.Entry(_name(p), html.encode() + b" " * 64, "zlib") for p, _, html in rows)
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(), entries)
    with open(a.path, "r+b") as f:
        for i, (p, _, _) in enumerate(rows):
            if p % 5 == 0:
                f.seek(int(a.blocks[i]["file_pos"]) + 4 * (-(-int(a.blocks[i]["file_size"]) // a.header["sector_size"]) + 1))
                f.write(b"\xff" * 8)
    a = A.Archive.open(a.path)
    structure = a.verify_mode("archive").ok()
    for p, _, _ in rows:
        yield p, a.verify_mode("file", _name(p)).ok(), structure


@session("k long, ok boolean, errors string", "SELECT DISTINCT page_id % 8 AS k, page_id % 2 = 0 AS ok, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'v4 header raw-data raw-data md5 mismatch' END AS errors FROM pages")
def raw_header_digests(folder, rows):
    """Headers with digests of their raw chunks behind them, of every second archive a wrong one."""
    k = rows[0][0] % COUNT
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(format_version=3, header_size=0x100, extra={"raw_chunk_size": 64}), _entries(rows))
    data = bytearray(Path(a.path).read_bytes())
    data[0xC0:0xF0] = b"".join(hashlib.md5(data[i : i + 64]).digest() for i in range(0, 0xC0, 64))
    data[0xD5] ^= k % 2
    Path(a.path).write_bytes(data)
    report = A.Archive.open(a.path).verify_mode("raw", target="header")
    yield k, report.ok(), "; ".join(report.table_errors)


@session("k long, none boolean, first long, synced long", "SELECT DISTINCT page_id % 8 AS k, true AS none, CAST(7 AS BIGINT) AS first, CAST(15 AS BIGINT) AS synced FROM pages")
def attribute_flags(folder, rows):
    """The flags of attributes: of none, of those written with the archive, and of those made from the contents."""
    none = A.Archive.create(f"{folder}/none.mpq", L.Policy(), _entries(rows)).attribute_flags() is None
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(attributes=True), _entries(rows))
    first = a.attribute_flags()
    a.sync_attributes()
    yield rows[0][0] % COUNT, none, first, A.Archive.open(a.path).attribute_flags()


@session("page_id long, neutral string, german string", "SELECT page_id, md5(url) AS neutral, md5(CASE WHEN page_id % 2 = 0 THEN html ELSE url END) AS german FROM pages")
def locale_sessions(folder, rows):
    """A session's preferred locale: half of the files have a version of it, the others only the neutral one."""
    entries = itertools.chain(_entries(rows), (L.Entry(_name(p), html.encode(), "zlib", locale=1031) for p, _, html in rows if p % 2 == 0))
    path = A.Archive.create(f"{folder}/a.mpq", L.Policy(), entries).path
    neutral, german = A.Archive.open(path), A.Archive.open(path, locale=1031)
    for p, _, _ in rows:
        yield p, _md5(neutral.read_file(_name(p), 0)), _md5(german.read_file(_name(p), german.locale))


@session(
    "page_id long, md5 string, patches long",
    "SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN url || '!' WHEN page_id % 3 = 1 THEN html ELSE url END) AS md5, CAST(2 AS BIGINT) AS patches FROM pages",
)
def attached_patches(folder, rows):
    """Overlays attached, one of them twice; the second one tells its prefix by a metadata file."""
    a = A.Archive.create(f"{folder}/a.mpq", L.Policy(), _entries(rows))
    one = (L.Entry(_name(p), html.encode(), "zlib") for p, _, html in rows if p % 3 < 2)
    two = itertools.chain([L.Entry("base\\(patch_metadata)", b"")], (L.Entry(f"base\\{_name(p)}", f"{url}!".encode()) for p, url, _ in rows if p % 3 == 0))
    paths = [A.Archive.create(f"{folder}/{n}.mpq", L.Policy(), e).path for n, e in (("one", one), ("two", two))]
    for path in (*paths, paths[0]):
        a.attach_patch(path)
    for p, _, _ in rows:
        yield p, _md5(a.read_file(_name(p).upper())), len(a.patches)


@session(
    "k long, listed long, same long, changed long, vectors long, repacked long",
    "SELECT page_id % 8 AS k, count(*) AS listed, CAST(0 AS BIGINT) AS same, CAST(1 AS BIGINT) AS changed, CAST(6 AS BIGINT) AS vectors, count(*) AS repacked FROM pages GROUP BY 1",
)
def tool_commands(folder, rows):
    """The commands over an archive: what they list, their exit codes, and the files they write."""
    path = A.Archive.create(f"{folder}/a.mpq", L.Policy(), _entries(rows, compression="zlib", encrypted=True)).path
    out, said = f"{folder}/out", io.StringIO()
    with contextlib.redirect_stdout(said):
        tools.main(["list", path, "--pattern", "*.bin"])
        listed = len(said.getvalue().split())
        tools.main(["extract", path, out])
        tools.main(["manifest", out, f"{folder}/e.json"])
        same = tools.main(["run", path, f"{folder}/e.json", f"{folder}/again"])
        found = json.loads(Path(f"{folder}/e.json").read_text())
        Path(f"{folder}/f.json").write_text(json.dumps(found[:-1]))
        changed = tools.main(["compare", f"{folder}/e.json", f"{folder}/f.json"])
        Path(f"{folder}/even.bin").write_bytes(rows[0][1].encode() * 4)
        tools.main(["vectors", f"{folder}/even.bin", f"{folder}/v"])
        tools.main(["repack", out, f"{folder}/b.mpq", "--like", path])
    again = A.Archive.open(f"{folder}/b.mpq")
    kept = sum(again.read_file(_name(p)) == url.encode() and bool(next(i for i in again.find(_name(p))).flags & 0x10000) for p, url, _ in rows)
    yield rows[0][0] % COUNT, listed, same, changed, len(os.listdir(f"{folder}/v")), kept
