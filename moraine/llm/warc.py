"""WARC captures with a two-level index.

Writing: every page becomes a `response` record, a gzip member of its own in a WARC file; a line for each capture goes to
the index, keyed by the URL with its host reversed. The lines are range-partitioned and sorted by key and written as
blocks of `BLOCK_LINES`, each compressed by itself; a directory keeps each block's first key, place and length.

Reading: a key is searched by bisection among the shards' first keys, then among the first keys of a shard's
blocks; one range read gets the block, bisection finds the lines, and one range read for each gets the record. Look-ups come sorted, so a
task reads a block once for all keys in it. Memory is a directory (a line for each `BLOCK_LINES` captures of a shard), a block and one
key's captures. Each run of a task writes files of its own, and its rows name them: whichever run counts, rows and files agree.
"""

from __future__ import annotations

import bisect
import gzip
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .exchange import saved, workspace

BLOCK_LINES = 3_000
LEVEL = 3
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def url_key(url: Column) -> Column:
    """The URL with its host reversed, without scheme, user, port and fragment: `https://a.b.org:1/x?y#z` is `org,b,a)/x?y`."""
    host = F.lower(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    rest = F.regexp_replace(F.regexp_replace(url, _SCHEME + r"[^/?#]*", ""), r"#.*$", "")
    rest = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


class Store:
    """A folder on any file system that Arrow knows; the same for all workers."""

    def __init__(self, folder: str):
        self.folder = folder

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder if ":" in self.folder else f"file://{self.folder}")

    def write(self, name: str, parts) -> None:
        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        aside = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside, compression=None) as out:
            for p in parts:
                out.write(p)
        fs.move(aside, f"{root}/{name}")

    def opened(self):
        fs, root = self._fs()
        files: dict[str, pa.NativeFile] = {}

        def read(name: str, offset: int = 0, length: int | None = None) -> bytes:
            if name not in files:
                if len(files) >= 256:
                    files.pop(next(iter(files))).close()
                files[name] = fs.open_input_file(f"{root}/{name}")
            f = files[name]
            return f.read_at(f.size() if length is None else length, offset)

        return read


def record(ident: str, url: str, body: bytes) -> bytes:
    """A WARC/1.0 response record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{ident}>\r\nWARC-Target-URI: {target}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def payload(member: bytes) -> bytes:
    """The body of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return rest[:size].partition(b"\r\n\r\n")[2]


_LINE = "key string, page string, file string, offset long, length long"


def _capture(folder: str):
    def run(batches):
        name = f"captures-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        lines: list[tuple] = []
        at = 0

        def parts():
            nonlocal at
            for batch in batches:
                for key, page, url, html in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    member = record(page, url, (html or "").encode())
                    lines.append((key, page, name, at, len(member)))
                    at += len(member)
                    yield member

        Store(folder).write(name, parts())
        for a in range(0, len(lines), 10_000):
            c = list(zip(*lines[a : a + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:3]), *(pa.array(x, pa.int64()) for x in c[3:])], names=["key", "page", "file", "offset", "length"])

    return run


def _blocks(folder: str):
    """Writes a partition's sorted lines as blocks with their directory; one row for the shard."""

    def run(batches):
        shard = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        directory: list[bytes] = []
        first: list[str] = []
        count = 0

        def parts():
            nonlocal count
            held: list[bytes] = []
            at = 0

            def block():
                data = zlib.compress(b"\n".join(held), 6)
                directory.append(b"%s\t%d\t%d" % (held[0].split(b"\t", 1)[0], at, len(data)))
                return data

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not first:
                        first.append(row[0])
                    held.append("\t".join(map(str, (_escaped(row[0]), *row[1:]))).encode())
                    count += 1
                    if len(held) == BLOCK_LINES:
                        yield (data := block())
                        at += len(data)
                        held = []
            if held:
                yield block()

        store = Store(folder)
        store.write(f"{shard}.z", parts())
        if count:
            store.write(f"{shard}.dir", [b"\n".join(directory)])
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array(first), pa.array([count])], names=["shard", "first", "lines"])

    return run


def _escaped(key: str) -> str:
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


class Index:
    """The shards in key order, a few bytes for each; what a reader needs to begin with."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.folder = folder
        shards = sorted(shards, key=lambda s: s[1].encode())
        self.names = [s[0] for s in shards]
        self.firsts = [s[1].encode() for s in shards]


class Reader:
    def __init__(self, index: Index):
        self.index, self.read = index, Store(index.folder).opened()
        self._directory: tuple[str, list[bytes], list[tuple[int, int]]] | None = None
        self._block: tuple[str, int, list[bytes], list[bytes]] | None = None

    def _open(self, shard: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        if not self._directory or self._directory[0] != shard:
            rows = [line.split(b"\t") for line in self.read(f"{shard}.dir").split(b"\n")]
            self._directory = shard, [_plain(r[0]) for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        return self._directory[1:]

    def _lines(self, shard: str, place: tuple[int, int]) -> tuple[list[bytes], list[bytes]]:
        if not self._block or self._block[:2] != (shard, place[0]):
            lines = zlib.decompress(self.read(f"{shard}.z", *place)).split(b"\n")
            self._block = shard, place[0], [_plain(x.split(b"\t", 1)[0]) for x in lines], lines
        return self._block[2:]

    def captures(self, key: str) -> list[tuple[str, str, int, int]]:
        """(page, file, offset, length) of every capture of the key."""
        wanted, found = key.encode(), []
        s = max(bisect.bisect_left(self.index.firsts, wanted) - 1, 0)  # a key can begin at a shard's end
        while s < len(self.index.names) and self.index.firsts[s] <= wanted:
            shard = self.index.names[s]
            firsts, places = self._open(shard)
            b = max(bisect.bisect_left(firsts, wanted) - 1, 0)
            while b < len(firsts) and firsts[b] <= wanted:
                keys, lines = self._lines(shard, places[b])
                for line in lines[bisect.bisect_left(keys, wanted) : bisect.bisect_right(keys, wanted)]:
                    _, page, file, offset, length = line.decode().split("\t")
                    found.append((page, file, int(offset), int(length)))
                b += 1
            s += 1
        return found


def _plain(key: bytes) -> bytes:
    return key.replace(b"%09", b"\t").replace(b"%0A", b"\n").replace(b"%0D", b"\r").replace(b"%25", b"%") if b"%" in key else key


def _page_text() -> Column:
    """The page_id as the index has it; none and an empty one differ. Control characters, which separate what a line holds, are escaped."""
    text = F.col("page_id").cast("string")
    for c, code in (("%", "%25"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        text = F.replace(text, F.lit(c), F.lit(code))
    return F.when(text.isNull(), F.lit("%")).otherwise(text)


def build(pages: DataFrame) -> Index:
    """Writes captures and index of the pages to the shared folder. Rows with a null url have no key and aren't captured; a null html is an empty body."""
    spark = pages.sparkSession
    folder = workspace(spark)
    rows = pages.where("url is not null").select(url_key(F.col("url")).alias("key"), _page_text().alias("page"), F.col("url"), F.col("html").cast("string").alias("html"))
    lines = saved(rows.mapInArrow(tk.trimmed(_capture(f"{folder}/store")), _LINE), folder, "lines")
    ordered = lines.repartitionByRange("key", "page", "file", "offset").sortWithinPartitions("key", "page", "file", "offset")
    shards = ordered.mapInArrow(tk.trimmed(_blocks(f"{folder}/store")), "shard string, first string, lines long").collect()
    return Index(f"{folder}/store", [(r.shard, r.first) for r in shards])


def _look_up(index: Index):
    import hashlib

    def run(batches):
        reader = Reader(index)
        last: tuple[str | None, dict] = (None, {})
        for batch in batches:
            out = []
            for key, page, url in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key != last[0]:
                    last = key, {}
                    for p, *place in reader.captures(key):
                        last[1].setdefault(p, []).append(place)
                own = last[1].get(page, [])
                body = payload(reader.read(own[0][0], *own[0][1:])) if own else None
                out.append((url, key, sum(map(len, last[1].values())), None if body is None else hashlib.md5(body).hexdigest(), None if body is None else len(body)))
            if out:
                c = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(x, k) for x, k in zip(c, kinds, strict=True))], names=["page_id", "url", "url_key", "n_captures", "html_md5", "html_bytes"])

    return run


def look_up(queries: DataFrame, index: Index) -> DataFrame:
    """(page_id, url, url_key, n_captures, html_md5, html_bytes) for every row of queries (page_id, url).

    n_captures: how many captures the URL's key has. Digest and size are of the body read back from the capture of this page_id (the
    first, where a page_id was captured more than once under the key); null where there is none. A page_id of any type that has a text keeps it; a null one finds
    the captures without page_id. A null url has no key: no row. Repeated rows give repeated rows. Other columns are not read.
    """
    rows = queries.where("url is not null").select(url_key(F.col("url")).alias("key"), _page_text().alias("page"), F.col("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "page")
    kind = queries.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(tk.trimmed(_look_up(index)), f"page_id {kind}, url string, url_key string, n_captures long, html_md5 string, html_bytes long")


def op5_warc_index(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return look_up(pages, build(pages))


_KEY_SQL = rf"""
array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(lower(regexp_extract(url, '{_SCHEME}([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '.')), ',') || ')' ||
CASE WHEN rest = '' OR rest LIKE '?%' THEN '/' || rest ELSE rest END"""

QUERIES = {"op5_warc_index": op5_warc_index}
ORACLE = {
    "op5_warc_index": f"""
SELECT page_id, url, url_key, count(*) OVER (PARTITION BY url_key) AS n_captures, md5(coalesce(html, '')) AS html_md5, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS html_bytes
FROM (SELECT *, {_KEY_SQL} AS url_key FROM (SELECT *, regexp_replace(regexp_replace(url, '{_SCHEME}[^/?#]*', ''), '#.*$', '') AS rest FROM pages WHERE url IS NOT NULL))"""
}
