"""Manifests: the files of archives or folders as rows, changed and compared by set operations and joins."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas as S
from ..functions import names as N
from .listing import has_flag, method

#: Contents of a batch.
_READ_BYTES = 16 << 20
_DEFAULTS = {"compression": "none", "encrypted": False, "fix_key": False, "locale": 0, "platform": 0, "single_unit": False, "sector_crc": False}


def manifest(rows: DataFrame, archive: Column, ord: Column, name: Column, data: Column, **options) -> DataFrame:  # noqa: A002
    """A manifest from any table. options: constants or columns for the other fields."""
    given = {k: options.get(k, v) for k, v in _DEFAULTS.items()}
    cols = [F.lit(v) if not isinstance(v, Column) else v for v in given.values()]
    types = {f.name: f.dataType for f in S.MANIFEST.fields}
    values = [archive, ord, name, data, *cols]
    names = ["archive", "ord", "name", "data", *given]
    return rows.select(*(v.cast(types[n]).alias(n) for v, n in zip(values, names, strict=True)))


def capture(files: DataFrame) -> DataFrame:
    """The manifest of archives read with their contents. Lists of names and attributes are left out: they are made anew. An entry
    without a name is an error: it couldn't be written again."""
    rows = files.where(F.col("name").isNull() | ~N.ascii_lower(F.col("name")).isin("(listfile)", "(attributes)"))
    name = F.when(F.col("name").isNull(), F.raise_error(F.lit("unsupported feature: an entry without a name can't be written again"))).otherwise(F.col("name"))
    flags = F.col("flags")
    return manifest(
        rows, F.col("archive"), F.col("block_index"), name, F.col("content"), compression=F.when(method(flags) == "compress", "zlib").when(method(flags) == "implode", "pkware").otherwise("none"),
        encrypted=has_flag(flags, S.ENCRYPTED), fix_key=has_flag(flags, S.FIX_KEY), locale=F.col("locale"), platform=F.col("platform"), single_unit=has_flag(flags, S.SINGLE_UNIT), sector_crc=has_flag(flags, S.SECTOR_CRC),
    )


def upsert(base: DataFrame, changes: DataFrame, key: list[str], fold: bool = False) -> DataFrame:
    """The rows of base whose key isn't among the changes, and the changes. fold: string keys match without ASCII case."""
    left, right = _folded(base, key, fold), _folded(changes, key, fold)
    marks = [f"__{k}" for k in key]
    return left.join(right.select(*marks), marks, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def delete(base: DataFrame, gone: DataFrame, key: list[str], fold: bool = False) -> DataFrame:
    """The rows of base whose key isn't among those to go."""
    marks = [f"__{k}" for k in key]
    return _folded(base, key, fold).join(_folded(gone, key, fold).select(*marks), marks, "left_anti").select(*base.columns)


def _folded(df: DataFrame, key: list[str], fold: bool) -> DataFrame:
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.withColumns({f"__{k}": N.ascii_lower(F.col(k)) if fold and k in text else F.col(k) for k in key})


def rename(base: DataFrame, names: DataFrame) -> DataFrame:
    """names: (archive, old, new). Two files that would have one name are an error."""
    joined = base.join(names, (base["archive"] == names["archive"]) & N.same_name(F.col("name"), F.col("old")), "left").drop(names["archive"])
    renamed = joined.withColumn("name", F.coalesce("new", "name")).drop("old", "new")
    n = F.count("*").over(W.partitionBy("archive", N.ascii_lower(F.col("name")), "locale"))
    checked = renamed.withColumn("__n", n)
    name = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("invalid input: there is a file of the name "), F.col("name")))).otherwise(F.col("name"))
    return checked.withColumn("name", name).select(*base.columns)


def set_locale(base: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (archive, name, locale, platform)."""
    c = changes.select(F.col("archive").alias("__a"), F.col("name").alias("__n"), F.col("locale").alias("__l"), F.col("platform").alias("__p"))
    joined = base.join(c, (F.col("archive") == F.col("__a")) & N.same_name(F.col("name"), F.col("__n")), "left")
    return joined.withColumns({"locale": F.coalesce("__l", "locale"), "platform": F.coalesce("__p", "platform")}).select(*base.columns)


def compare(expected: DataFrame, actual: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(path, status): `missing` and `extra` paths, `mismatch` of size or sha256, `allowed` for missing paths that may be. Equal ones have no row.

    Both have path, size, sha256. One full outer join.
    """
    e = expected.select("path", F.col("size").alias("e_size"), F.col("sha256").alias("e_sum"), F.lit(True).alias("__e"))
    a = actual.select("path", F.col("size").alias("a_size"), F.col("sha256").alias("a_sum"), F.lit(True).alias("__a"))
    may = F.col("path").isin(*allowed) if allowed else F.lit(False)
    same = F.col("e_size").eqNullSafe(F.col("a_size")) & F.col("e_sum").eqNullSafe(F.col("a_sum"))
    status = F.when(F.col("__a").isNull(), F.when(may, "allowed").otherwise("missing")).when(F.col("__e").isNull(), "extra").when(~same, "mismatch")
    return e.join(a, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def _files(fs: pafs.FileSystem, root: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files below a folder; of a mounted one as they are found, without a list of all."""
    if not isinstance(fs, pafs.LocalFileSystem):
        yield from ((f.path[len(root) + 1 :], f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file)
        return
    folders = [""]
    while folders:
        inside = folders.pop()
        with os.scandir(f"{root}/{inside}") as found:
            for f in found:
                if f.is_dir(follow_symlinks=False):
                    folders.append(f"{inside}{f.name}/")
                elif f.is_file():
                    yield f"{inside}{f.name}", f.stat().st_size


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the files below a folder, paths relative to it, in as many partitions as pay for reading them; hidden ones (that begin with a dot) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (pafs.LocalFileSystem(), folder)
        root = root.rstrip("/")
        for _ in batches:
            found = ((p, n) for p, n in _files(fs, root) if not any(x.startswith(".") for x in p.split("/")))
            for rows in itertools.batched(found, 4096):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "size"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "path string, size long")


def with_contents(listing: DataFrame, folder: str) -> DataFrame:
    """The rows of a listing (path and any other columns) with the files' contents, read in parallel."""
    spark, schema = listing.sparkSession, T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (pafs.LocalFileSystem(), folder)
        fields = to_arrow_schema(schema)
        for batch in batches:
            held: list[bytes] = []
            size, begin = 0, 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                with fs.open_input_file(f"{root.rstrip('/')}/{path}") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= _READ_BYTES or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], schema=fields)
                    held, size, begin = [], 0, i + 1

    return listing.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, schema)


def folder_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of the files below a folder, paths relative to it."""
    return with_contents(folder_listing(spark, folder), folder).select("path", "size", F.sha2("content", 256).alias("sha256"))


def folder_entries(spark: SparkSession, folder: str, archive: str, flags: DataFrame | None = None) -> DataFrame:
    """The manifest of a folder's files, the list of names left out. flags: (name, flags) of the files in an archive that is repacked."""
    rows = folder_listing(spark, folder).withColumn("name", N.archive_path(F.col("path"))).where(~N.ascii_lower(F.col("name")).isin("(listfile)"))
    f = F.lit(0).cast("long")
    if flags is not None:  # before there are contents to be moved
        rows = rows.join(flags.select("name", "flags"), "name", "left")
        f = F.coalesce("flags", F.lit(0))
    rows = with_contents(rows, folder)
    return manifest(
        rows, F.lit(archive), F.lit(0), F.col("name"), F.col("content"), compression=F.when(method(f) == "none", "none").when(method(f) == "implode", "pkware").otherwise("zlib"),
        encrypted=has_flag(f, S.ENCRYPTED), fix_key=has_flag(f, S.FIX_KEY), single_unit=has_flag(f, S.SINGLE_UNIT), sector_crc=has_flag(f, S.SECTOR_CRC),
    )


def status_counts(rows: DataFrame, status: str, valid: list[str] | None = None) -> DataFrame:
    """(status, n, known): how many rows each status has, and whether it is one of the valid ones."""
    known = F.col("status").isin(*valid) if valid else F.lit(True)
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")).withColumn("known", known)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def duplicates(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Every row after the first of its key, in the order given."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def dangling(rows: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows that refer to nothing."""
    return rows.join(target.select(*key).distinct(), key, "left_anti")


def sorted_names(rows: DataFrame) -> DataFrame:
    """By name without ASCII case, equal ones bytewise."""
    return rows.orderBy(N.ascii_lower(F.col("name")), "name")


def listfile_text(names: DataFrame) -> DataFrame:
    """(archive, text): the list of an archive's names as it is stored."""
    pair = F.struct(N.ascii_lower(F.col("name")).alias("k"), "name")
    ordered = F.transform(F.sort_array(F.collect_list(pair)), lambda p: F.concat(p["name"], F.lit("\r\n")))
    return names.groupBy("archive").agg(F.array_join(ordered, "").alias("text"))


def output_paths(names: DataFrame) -> DataFrame:
    """(path, ord): the distinct safe paths of names (name, ord), each with its first place."""
    return names.groupBy(N.safe_path(F.col("name")).alias("path")).agg(F.min("ord").alias("ord"))
