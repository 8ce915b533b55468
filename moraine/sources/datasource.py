"""Archives as a Spark data source: `spark.read.format("mpq").option("table", ...)` and `df.write.format("mpq")`.

Reading: a partition is a share of the archives for tables of metadata; for contents archives of about `PARTITION_BYTES` together (of fewer where
there would be less than `minPartitions`), or a range of the blocks of a larger one. As each range reads the archive's tables, there are at most `SPLITS` times
`minPartitions` of them, however large the archives are; `blocksPerPartition` sets their size. Rows come as Arrow batches of bounded size; the table of hash and block entries are columns of their bytes. What is wrong with an archive or file is in the columns error_kind and
error_message; with `strict` it is raised. The option `archives` names those to be read; the others' partitions aren't made (Spark refuses
filter pushdown in a Python source unless the session allows it, so an option does that).

Writing: the manifest's rows of an archive must be in one partition, in order (`write_archives` sees to that, and packs the files before, wherever they are,
so that the task that writes an archive only places and encrypts them). Each is written
aside in the target folder, file by file, so a task holds one file and a row for each; the driver renames them when all tasks are done, and removes what an
aborted job left.
"""

from __future__ import annotations

import io
import itertools
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas as S
from ..errors import ArchiveIOError, FormatError, InvalidInputError, UnsupportedFeatureError, kind_of
from ..functions.names import safe_path
from ..storage import bounded_batches
from . import attributes as attrs
from . import layout as L

BATCH_ROWS, BATCH_BYTES = 4_096, 32 << 20
ARCHIVES_PER_PARTITION, PARTITION_BYTES, SPLITS = 32, 64 << 20, 3
#: Opening a file counts as so many bytes of it.
OPEN_BYTES = 4 << 20
TRAILER, COPY_BYTES, MOST_FOLDERS, NAMES = 260, 8 << 20, 256, 1 << 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def archive_paths(path: str) -> list[tuple[str, int]]:
    """(path, size) of the archives at a path: a file, a folder of *.mpq, or several of both with commas between."""
    out = []
    for part in path.split(","):
        fs, at = file_system(part.strip())
        info = fs.get_file_info(at)
        scheme = part.strip()[: len(part.strip()) - len(at)] if part.strip().endswith(at) else ""
        if info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
            out += [(scheme + f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".mpq") and not f.base_name.startswith(".")]
        elif info.is_file:
            out.append((scheme + at, info.size))
        else:
            raise ArchiveIOError(f"no such file or folder: {part}")
    return sorted(out)


@dataclass
class Share(InputPartition):
    paths: list[str]
    first: int = 0
    last: int | None = None


class _Scan:
    """An open archive and the tables in it."""

    def __init__(self, path: str, listfile: bytes | None):
        fs, at = file_system(path)
        self.archive = posixpath.basename(at)
        self.region = L.Region(fs.open_input_file(at))
        self.header = L.read_header(self.region)
        self.problem = L.header_problem(self.header)
        self.listfile = listfile

    def tables(self) -> None:
        if self.problem:
            raise (UnsupportedFeatureError if self.problem[0] == "UnsupportedFeature" else FormatError)(self.problem[1])
        self.hashes, self.blocks = L.read_tables(self.region, self.header)

    def content(self, name: str) -> bytes | None:
        slot = L.find_slot(self.hashes, len(self.blocks), name)
        return None if slot is None else L.decode(self.region, self.header, self.blocks[int(self.hashes[slot]["block_index"])], name)

    def names(self, first: int = 0, last: int | None = None) -> dict[int, str]:
        """Names of a range of blocks: special files, the archive's own list, then the one given; the first of a block stays."""
        special = [L.LISTFILE, L.ATTRIBUTES, L.SIGNATURE_FILE]
        try:
            own = self.content(L.LISTFILE) or b""
        except Exception as e:  # an unreadable list leaves files unnamed
            kind_of(e)
            own = b""
        lines = (x.strip() for text in (own, self.listfile or b"") for x in io.StringIO(text.decode(errors="replace").replace("\r", "\n"), "\n"))
        out: dict[int, str] = {}
        finder, index = L.Finder(self.hashes, len(self.blocks)), self.hashes["block_index"]
        for names in itertools.batched(itertools.chain(special, filter(None, lines)), NAMES):
            slots = finder.find(names)
            blocks = np.where(slots < 0, -1, index[slots].astype(np.int64))
            for i in np.flatnonzero((blocks >= first) & ((blocks < last) if last is not None else True)).tolist():
                out.setdefault(int(blocks[i]), names[i])
        return out

    def columns(self, table: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The entries of a table as Arrow columns of its fields."""
        self.tables()
        rows = self.hashes if table == "hash_entries" else self.blocks
        for a in range(0, len(rows), 16 * BATCH_ROWS):
            part = rows[a : a + 16 * BATCH_ROWS]
            values = [pa.array([self.archive]).take(pa.array(np.zeros(len(part), np.int8))), np.arange(a, a + len(part)), *(part[n] for n in part.dtype.names)]
            yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v.astype(f.type.to_pandas_dtype())) for v, f in zip(values, schema, strict=True)], schema=schema)

    def raw_ranges(self) -> Iterator[tuple]:
        """Ranges whose raw chunks have digests behind them: the header of version 4 and the extended tables; digests are null where the file ends before them."""
        h = self.header
        if not (chunk := h["raw_chunk_size"] or 0):
            return
        ranges = [("v4 header raw-data", 0, 0xC0)] if h["header_size"] >= 0xC0 else []
        ranges += [(f"{kind.upper()} table", h[f"{kind}_table_pos_64"], h[f"{kind}_table_size_64"]) for kind in ("het", "bet") if h[f"{kind}_table_pos_64"] and h[f"{kind}_table_size_64"]]
        for label, pos, size in ranges:
            sums = 16 * -(-size // chunk)
            inside = pos + size + sums <= self.region.size
            yield self.archive, label, chunk, self.region.read(pos, size) if inside else b"", self.region.read(pos + size, sums) if inside else None

    def rows(self, table: str, share: Share) -> Iterator[tuple]:
        if table == "archives":
            h = self.header
            names = [f.name for f in S.ARCHIVES.fields[1:-2]]
            yield (self.archive, *(h[n] for n in names), *(self.problem or (None, None)))
            return
        self.tables()
        if table == "raw_ranges":
            yield from self.raw_ranges()
        elif table == "trailers":
            end = self.header["archive_size_32"]
            trailer = self.region.read(end, min(TRAILER, self.region.size - end)) if self.region.size > end else b""
            slot = L.find_slot(self.hashes, len(self.blocks), L.SIGNATURE_FILE)
            yield self.archive, trailer, None if slot is None else int(self.blocks[int(self.hashes[slot]["block_index"])]["file_size"])
        elif table == "names":
            for b, n in sorted(self.names().items()):
                yield self.archive, b, n
        elif table == "attributes":
            data = self.content(L.ATTRIBUTES)
            if data is not None:
                for i, r in enumerate(attrs.parse(data, len(self.blocks))[1]):
                    yield self.archive, i, r["crc32"], r["filetime"], r["md5"], r["patch_bit"]
        else:
            names, index = self.names(share.first, share.last), self.hashes["block_index"]
            active = (index < S.DELETED) & (index >= share.first)
            active &= True if share.last is None else index < share.last
            if table == "list_items":
                yield from self.items(np.flatnonzero(active), names)
                return
            slots = np.flatnonzero(active)
            slots = slots[np.argsort(index[slots], kind="stable")]  # as they stand in the file
            sizes = np.zeros(len(slots), np.int64)
            inside = index[slots] < len(self.blocks)
            sizes[inside] = np.maximum(self.blocks["file_size"], self.blocks["compressed_size"])[index[slots][inside]]
            for group in L.grouped(zip(slots.tolist(), sizes.tolist(), strict=True), lambda x: x[1]):
                items = [*self.items(np.array([i for i, _ in group]), names)]
                found = L.decode_many(self.region, self.header, [(self.blocks[b] if b < len(self.blocks) else (0, 0, 0, 0), n) for _, _, b, n, *_ in items])
                for item, content in zip(items, found, strict=True):
                    if item[2] >= len(self.blocks):
                        content = FormatError(f"hash[{item[1]}] points to invalid block index {item[2]}")
                    yield (*item, None, kind_of(content), str(content)) if isinstance(content, Exception) else (*item, content, None, None)

    def items(self, slots: np.ndarray, names: dict[int, str]) -> Iterator[tuple]:
        rows = self.hashes[slots]
        blocks, n = rows["block_index"].astype(np.int64), len(self.blocks)
        flags = self.blocks["flags"][np.minimum(blocks, n - 1)].tolist()
        for i, b, locale, platform, f in zip(slots.tolist(), blocks.tolist(), rows["locale"].tolist(), rows["platform"].tolist(), flags, strict=True):
            yield self.archive, i, b, names.get(b), locale, platform, f if b < n else None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise InvalidInputError("a path is needed")
        self.table = options.get("table", "list_items")
        if self.table not in S.TABLES:
            raise InvalidInputError(f"no table {self.table}; there are {', '.join(S.TABLES)}")
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.blocks = int(options.get("blockspartition", options.get("blocksperpartition", 0)))
        self.least = max(1, int(options.get("minpartitions", 1)))
        self.listfile = None
        if options.get("listfile"):
            fs, at = file_system(options["listfile"])
            self.listfile = fs.open_input_file(at).read()
        self.archives = {a.strip() for a in options["archives"].split(",")} if options.get("archives") else None

    def partitions(self) -> list[Share]:
        sized = [(p, n) for p, n in archive_paths(self.path) if self.archives is None or posixpath.basename(p) in self.archives]
        paths = [p for p, _ in sized]
        if self.table != "files":
            each = max(1, min(ARCHIVES_PER_PARTITION, -(-len(paths) // self.least)))
            return [Share(paths[i : i + each]) for i in range(0, len(paths), each)] or [Share([])]
        if self.blocks:
            return [s for p in paths for s in self._ranges(p, self.blocks)] or [Share([])]
        total = sum(n + OPEN_BYTES for _, n in sized)
        most = max(min(PARTITION_BYTES, max(OPEN_BYTES, total / self.least)), total / (SPLITS * self.least))
        shares, ranges, held = [Share([])], [], 0
        for p, n in sized:
            if n > 2 * most and (found := self._ranges(p, parts=math.ceil(n / most))):
                ranges += found
                continue
            if shares[-1].paths and held + n + OPEN_BYTES > most:  # small archives share a partition, as small files do in Spark's own sources
                shares.append(Share([]))
                held = 0
            shares[-1].paths.append(p)
            held += n + OPEN_BYTES
        return ranges + (shares if shares[0].paths or not ranges else [])

    def _ranges(self, path: str, size: int = 0, parts: int = 1) -> list[Share]:
        """An archive in ranges of blocks; in one where it can't be read, which the task will tell."""
        try:
            n = max(1, _Scan(path, None).header["block_table_entries"])
        except Exception as e:
            kind_of(e)
            return [Share([path])]
        # blocks that entries wrongly refer to lie beyond the table: the last range is open
        cuts = [*range(0, n, size or math.ceil(n / parts))]
        return [Share([path], a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(S.TABLES[self.table])
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for path in partition.paths:
            if self.table in ("hash_entries", "block_entries"):
                yield from _Scan(path, None).columns(self.table, schema)
                continue
            try:
                for row in _Scan(path, self.listfile).rows(self.table, partition):
                    if self.strict and self.table in ("archives", "files") and row[-2]:
                        raise FormatError(f"{path}: {row[-1]}")
                    held.append(row)
                    size += len(row[7] or b"") if self.table == "files" else 0
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
            except Exception as e:
                if self.strict or self.table not in ("archives", "files"):
                    raise
                if partition.first:  # the archive's first range tells
                    continue
                held.append((posixpath.basename(path), *[None] * (len(schema) - 3), kind_of(e), str(e)))
        if held:
            yield batch()


#: Files as `write_archives` packs them before they go to the tasks that write.
PACKED = S._struct(("archive", T.StringType()), ("name", T.StringType()), ("stored", T.BinaryType()), ("size", T.LongType()), ("flags", T.LongType()), ("locale", T.IntegerType()), ("platform", T.IntegerType()), ("crc32", T.LongType()), ("md5", T.BinaryType()))
_FIELDS = ("encrypted", "fix_key", "locale", "platform", "single_unit", "sector_crc", "compression")


def _policy(options: dict) -> L.Policy:
    policy = {k: options.get(k.lower().replace("_", ""), options.get(k)) for k in ("sector_size_shift", "hash_entries", "block_entries", "listfile", "attributes", "format_version")}
    given = {k: v for k, v in policy.items() if v is not None}
    out = L.Policy(**{k: str(v).lower() == "true" if k in ("listfile", "attributes") else int(v) for k, v in given.items()})
    out.header_size = S.HEADER_SIZES[out.format_version]
    return out


def _pack(row: dict, step: int, described: bool) -> L.Packed:
    if row["archive"] is None or row["name"] is None:
        raise InvalidInputError("archive and name can't be null")
    if "stored" in row:
        return L.Packed(row["name"], row["stored"], row["size"], row["flags"], row["locale"], row["platform"], {"crc32": row["crc32"], "md5": row["md5"]})
    given = {k: row[k] for k in _FIELDS if row.get(k) is not None}
    return L.pack(L.Entry(row["name"], row["data"] or b"", **given), step, described)


def _rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield from batch.slice(a, rows).to_pylist()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.schema, self.overwrite = options.get("path"), schema, overwrite
        if not self.path:
            raise InvalidInputError("a path is needed")
        names = set(schema.fieldNames())
        if not {"archive", "name", "data"} <= names and not set(PACKED.fieldNames()) <= names:
            raise InvalidInputError("a manifest has the columns archive, name and data")
        self.policy = _policy(options)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        current, seen = None, set()
        archive, body, stream = None, "", None

        def begin(name: str) -> None:
            nonlocal current, archive, body, stream
            if name in seen:
                raise InvalidInputError(f"the rows of archive {name} aren't together")
            if "/" in name or "\\" in name or name.startswith("."):
                raise InvalidInputError(f"{name} can't be a file's name")
            seen.add(name)
            current, archive, body = name, L.Assembly(self.policy), f"{root}/.{self.job}-{uuid.uuid4().hex}"
            stream = fs.open_output_stream(body)

        def close() -> None:
            """Header, files, tables: the header says where the tables are, so the files wait in a file of their own."""
            header, more, tables = archive.finish()
            stream.close()
            aside = f"{root}/.{self.job}-{uuid.uuid4().hex}"
            with fs.open_output_stream(aside) as out, fs.open_input_stream(body) as stored:
                out.write(header)
                while piece := stored.read(COPY_BYTES):
                    out.write(piece)
                out.write(more + tables)
            fs.delete_file(body)
            name = current if current.lower().endswith(".mpq") else f"{current}.mpq"
            files.append((aside, f"{root}/{name}"))

        step, described = L.sector_size(self.policy.sector_size_shift), self.policy.attributes
        files_of = ((row["archive"], _pack(row, step, described)) for row in _rows(iterator))
        for group in L.grouped(files_of, lambda x: len(x[1].stored)):
            for name, its in itertools.groupby(group, lambda x: x[0]):
                if name != current:
                    if current is not None:
                        close()
                    begin(name)
                stream.write(archive.put([f for _, f in its]))
        if current is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        made = [f for m in messages if m for f in m.files]
        if len({name for _, name in made}) < len(made):
            self.abort(messages)
            raise InvalidInputError("rows of an archive were in more than one partition; use write_archives")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.is_file and f.path.lower().endswith(".mpq"):
                    fs.delete_file(f.path)
        for aside, name in made:
            fs.move(aside, name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mpq"

    def schema(self):
        table = self.options.get("table", "list_items")
        if table not in S.TABLES:
            raise InvalidInputError(f"no table {table}; there are {', '.join(S.TABLES)}")
        return S.TABLES[table]

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str, table: str = "list_items", **options) -> DataFrame:
    register(spark)
    return spark.read.format("mpq").option("table", table).option("minPartitions", spark.sparkContext.defaultParallelism).options(**options).load(path)


def write_archives(manifest: DataFrame, path: str, **options) -> None:
    """Writes a manifest as one file for each archive; the files in it in the order of `ord` (and name)."""
    register(manifest.sparkSession)
    bounded_batches(manifest.sparkSession)
    policy = _policy(options)
    step, described, order = L.sector_size(policy.sector_size_shift), policy.attributes, [c for c in ("ord", "name") if c in manifest.columns]
    kept = [f for f in manifest.schema.fields if f.name == "ord"]
    types = T.StructType([*PACKED.fields, *kept])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(types)

        def made(row: dict) -> tuple:
            f = _pack(row, step, described)
            sums = f.sums or {}
            return (row["archive"], f.name, f.stored, f.size, f.flags, f.locale, f.platform, sums.get("crc32"), sums.get("md5"), *(row[k.name] for k in kept))

        for group in L.grouped(map(made, _rows(batches)), lambda x: len(x[2])):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group, strict=True), schema, strict=True)], schema=schema)

    rows = manifest.mapInArrow(pack, types).repartition("archive").sortWithinPartitions("archive", *order)
    rows.write.format("mpq").mode("overwrite").options(**options).save(path)


def extract_files(files: DataFrame, folder: str, items: DataFrame | None = None) -> DataFrame:
    """Writes files read from archives below a folder, in parallel; (archive, name, path) of those written.

    Paths are safe ones; of files that have the same one the first entry of the first archive is written. Files that couldn't be read have no row.
    Each is written aside and renamed. The rows are computed, and so the files written, when the result is used. With the entries of the same archives
    (items) it is known at once whether there are such files; where there are none, no content is moved.
    """
    path = safe_path(F.col("name")).alias("path")
    rows = files.where(F.col("content").isNotNull() & F.col("name").isNotNull()).select("archive", "name", "hash_index", path, "content")
    if items is None or not items.where("name is not null").select(path).groupBy("path").count().where("count > 1").isEmpty():
        first = rows.groupBy("path").agg(F.min(F.struct("archive", "hash_index")).alias("__first"))
        rows = rows.join(first, "path").where((F.col("archive") == F.col("__first.archive")) & (F.col("hash_index") == F.col("__first.hash_index")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        there: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at = f"{root.rstrip('/')}/{path}"
                if posixpath.dirname(at) not in there:
                    fs.create_dir(posixpath.dirname(at), recursive=True)
                    there = {*there, posixpath.dirname(at)} if len(there) < MOST_FOLDERS else {posixpath.dirname(at)}
                aside = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(aside, compression=None) as out:
                    out.write(content.as_buffer())
                fs.move(aside, at)
            yield batch.select(["archive", "name", "path"])

    return rows.select("archive", "name", "path", "content").mapInArrow(write, "archive string, name string, path string")
