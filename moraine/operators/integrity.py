"""Checks of archives, and the positions of their parts, as filters, joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from .listing import has_flag, is_active
from .manifests import duplicates


def header_problem(sizes: dict[int, int] = S.HEADER_SIZES) -> Column:
    """struct(kind, message) of what is wrong with a row of `archives`, null if nothing is; the first rule that fails."""
    c = F.col
    problem = lambda kind, message: F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message"))
    out = F.when(c("header_size") < sizes[0], problem("Format", "header too small"))
    for version, size in sizes.items():
        out = out.when((c("format_version") == version) & (c("header_size") < size), problem("Format", f"v{min(version + 1, 4)} header too small"))
    out = out.when(c("format_version") > 4, problem("UnsupportedFeature", "unknown header format version"))
    n = c("hash_table_entries")
    out = out.when((n <= 0) | (n.bitwiseAND(n - 1) != 0), problem("Format", "hash table entry count must be non-zero power of two"))
    out = out.when(c("block_table_entries") == 0, problem("Format", "block table entry count must be non-zero"))
    ends = F.greatest(c("hash_table_pos") + 16 * n, c("block_table_pos") + 16 * c("block_table_entries"))
    out = out.when(ends > c("file_length"), problem("Format", "table range exceeds file length"))
    for kind in ("het", "bet"):
        pos, size = c(f"{kind}_table_pos_64"), c(f"{kind}_table_size_64")
        out = out.when((c("format_version") >= 3) & (pos > 0) & (size > 0) & (pos + size > c("file_length")), problem("Format", "extended table range exceeds file length"))
    return out


def verify(archives: DataFrame, hash_entries: DataFrame, block_entries: DataFrame) -> DataFrame:
    """(archive, scope, idx, message): everything that is wrong with the structure; no rows, all is well."""
    index = F.col("hash_index")
    line = lambda df, scope, idx, message: df.select("archive", F.lit(scope).alias("scope"), idx.alias("idx"), message.alias("message"))
    active = hash_entries.where(is_active(F.col("block_index"))).drop("flags")
    joined = active.join(block_entries.select("archive", "block_index", "flags"), ["archive", "block_index"], "left")
    invalid = line(joined.where("flags is null"), "table", index, F.format_string("hash[%d] points to invalid block index %d", index, F.col("block_index")))
    missing = line(joined.where(~has_flag(F.col("flags"), S.EXISTS)), "file", index, F.format_string("hash[%d] points to non-existing block %d", index, F.col("block_index")))
    repeated = line(duplicates(active, ["archive", "hash_a", "hash_b", "locale"], ["hash_index"]), "table", index, F.format_string("duplicate hash tuple at hash[%d]", index))
    blocks = block_entries.where(has_flag(F.col("flags"), S.EXISTS)).join(archives.select("archive", "file_length", "archive_offset"), "archive")
    at = F.col("block_index")
    beyond = blocks.where(F.col("archive_offset") + F.col("file_pos") + F.col("compressed_size") > F.col("file_length"))
    beyond = line(beyond, "file", at, F.format_string("block[%d] data range exceeds archive length", at))
    empty = line(blocks.where("compressed_size = 0 and file_size <> 0"), "file", at, F.format_string("block[%d] zero compressed size with non-zero file size", at))
    n = F.col("hash_table_entries")
    sizes = line(archives.where((n == 0) | (n.bitwiseAND(n - 1) != 0)), "table", F.lit(None).cast("long"), F.lit("hash table length must be non-zero power of two"))
    none = line(archives.where("block_table_entries = 0"), "table", F.lit(None).cast("long"), F.lit("block table length must be non-zero"))
    return sizes.unionByName(none).unionByName(invalid).unionByName(missing).unionByName(beyond).unionByName(empty).unionByName(repeated)


def unreadable(files: DataFrame) -> DataFrame:
    """Files that can't be read, with the reason."""
    return files.where("error_kind is not null").select("archive", "name", "block_index", "error_kind", "error_message")


def checksums(files: DataFrame) -> DataFrame:
    """(archive, name, size, crc32, md5) of files."""
    return files.where("content is not null").select("archive", "name", F.length("content").cast("long").alias("size"), F.crc32("content").alias("crc32"), F.md5("content").alias("md5"))


def build_attributes(files: DataFrame) -> DataFrame:
    """The rows that the attributes of archives should have."""
    named = F.col("name").isNotNull() & F.col("content").isNotNull()
    return files.select(
        "archive", "block_index", F.when(named, F.crc32("content")).otherwise(F.lit(0)).alias("crc32"), F.lit(0).cast("long").alias("filetime"),
        F.when(named, F.unhex(F.md5("content"))).otherwise(F.unhex(F.lit("00" * 16))).alias("md5"), has_flag(F.col("flags"), S.PATCH_FILE).alias("patch_bit"),
    )


def check_attributes(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """Files whose contents differ from their stored checksums; rows of zeros and columns that aren't stored say nothing."""
    a = attributes.select("archive", "block_index", F.col("crc32").alias("stored_crc32"), F.hex("md5").alias("stored_md5"))
    joined = files.where("content is not null").join(a, ["archive", "block_index"])
    bad = ((F.col("stored_crc32") != 0) & (F.col("stored_crc32") != F.crc32("content"))) | ((F.col("stored_md5") != "0" * 32) & (F.lower("stored_md5") != F.md5("content")))
    return joined.where(bad).select("archive", "block_index", "name")


def raw_chunks(ranges: DataFrame) -> DataFrame:
    """(archive, label, chunk): the first raw chunk of each range that differs from its stored digest.

    ranges: archive, label, chunk_size, data, digests (16 bytes for each chunk).
    """
    count = F.ceil(F.length("data") / F.col("chunk_size")).cast("int")
    rows = ranges.where(F.length("data") > 0).select("archive", "label", "chunk_size", "data", "digests", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    own = F.md5(F.expr("substring(data, cast(chunk * chunk_size as int) + 1, cast(chunk_size as int))"))
    stored = F.lower(F.hex(F.expr("substring(digests, chunk * 16 + 1, 16)")))
    return rows.where(own != stored).groupBy("archive", "label").agg(F.min("chunk").alias("chunk"))


def signature(trailer: Column, weak_size: Column) -> Column:
    """Which kind of signature there is, from the bytes after the archive and the size of the signature file (null: none)."""
    strong = (F.hex(F.substring(trailer, 1, 4)) == "4E474953") & (F.length(trailer) >= 260)
    return F.when(weak_size == 72, "weak").when(strong, "strong").otherwise("none")


# positions

def running_offsets(parts: DataFrame, group: list[str], order: list[str], size: str, base: Column | int = 0) -> DataFrame:
    """Adds where each part begins (`begin`) and ends (`end`) when they are laid one after another."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(size).over(w) + (F.lit(base) if isinstance(base, int) else base)
    return parts.withColumn("end", end).withColumn("begin", F.col("end") - F.col(size))


def not_monotonic(offsets: DataFrame, group: list[str], order: list[str], offset: str) -> DataFrame:
    """Rows whose offset is less than the one before."""
    w = W.partitionBy(*group).orderBy(*order)
    return offsets.withColumn("before", F.lag(offset).over(w)).where(F.col(offset) < F.col("before"))


def lengths(offsets: DataFrame, group: list[str], order: list[str], offset: str) -> DataFrame:
    """Adds each part's length, the distance to the next offset; null for the last."""
    return offsets.withColumn("length", F.lead(offset).over(W.partitionBy(*group).orderBy(*order)) - F.col(offset))
