"""Queries that pack a table into archives, read it back through the data source and compare with the table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cipher, codecs, patches
from ..operators import integrity, listing, manifests, overlay
from ..sources.datasource import read_archives, write_archives
from ..storage import bounded_batches, shared_folder

ARCHIVES, SHARDS = 8, 32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pack(rows: DataFrame, ident: str, data: Column, prefix: str, count: int = ARCHIVES, **options) -> str:
    """Writes rows as files named `prefix\\<id>.bin` over `count` archives; the folder."""
    folder = shared_folder(rows.sparkSession)
    policy = {k: options.pop(k) for k in ("attributes", "format_version") if k in options}
    archive = F.concat(F.lit(f"{prefix}-"), F.pmod(F.col(ident), F.lit(count)).cast("string"))
    name = F.concat(F.lit(f"{prefix}\\"), F.col(ident).cast("string"), F.lit(".bin"))
    write_archives(manifests.manifest(rows, archive, F.col(ident), name, data, **options), folder, **policy)
    return folder


def _ident(name: str = "name") -> Column:
    return F.regexp_extract(name, r"\\([0-9]+)\.bin$", 1).try_cast("bigint")


def _named(df: DataFrame) -> DataFrame:
    return df.where(~F.col("name").startswith("("))


def _text(column: str) -> Column:
    return F.coalesce(F.encode(column, "UTF-8"), F.lit(b""))


def _roundtrip(table: str, ident: str, column: str, prefix: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _pack(_table(spark, sf_dir, table), ident, _text(column), prefix, **options)
        files = _named(read_archives(spark, folder, "files"))
        return files.select(_ident().alias(ident), F.length("content").cast("bigint").alias("file_size"), F.md5("content").alias("md5"))

    return query


def _roundtrip_sql(table: str, ident: str, column: str) -> str:
    return f"SELECT {ident}, CAST(octet_length(encode(coalesce({column}, ''))) AS BIGINT) AS file_size, md5(coalesce({column}, '')) AS md5 FROM {table}"


def archive_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing from the tables of archives alone: entries joined to blocks and names, sizes and sectors derived."""
    folder = _pack(_table(spark, sf_dir, "documents"), "doc_id", _text("text"), "docs")
    tables = {t: read_archives(spark, folder, t) for t in ("archives", "hash_entries", "block_entries", "names")}
    items = _named(listing.list_items(tables["hash_entries"], tables["block_entries"], tables["names"], listing.NAMED))
    blocks = tables["block_entries"].select("archive", "block_index", "file_size")
    sizes = tables["archives"].select("archive", listing.sector_size(F.col("sector_size_shift")).alias("step"))
    rows = items.join(blocks, ["archive", "block_index"]).join(F.broadcast(sizes), "archive")
    return rows.select(_ident().alias("doc_id"), F.col("archive"), "file_size", listing.sector_count(F.col("file_size"), F.col("step")).cast("bigint").alias("sectors"))


def archive_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("url"), "pages")
    return listing.find(read_archives(spark, folder), "PAGES/*1?.bin".replace("/", "\\")).select(_ident().alias("page_id"))


def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up by hash and probing; half of the names aren't there."""
    pages = _table(spark, sf_dir, "pages")
    folder = _pack(pages, "page_id", _text("url"), "pages")
    names = pages.select(
        F.concat(F.lit("pages-"), F.pmod("page_id", F.lit(ARCHIVES)).cast("string"), F.lit(".mpq")).alias("archive"),
        F.explode(F.array(F.concat(F.lit("PAGES/"), F.col("page_id").cast("string"), F.lit(".BIN")), F.concat(F.lit("none/"), F.col("page_id").cast("string")))).alias("name"),
    )
    found = listing.look_up(names, read_archives(spark, folder, "hash_entries"), read_archives(spark, folder, "block_entries"))
    return found.select(F.lower(F.replace("name", F.lit("/"), F.lit("\\"))).alias("name"), "archive")


def archive_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored checksums of attributes files, by name."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("html"), "pages", attributes="true")
    rows = read_archives(spark, folder, "attributes").join(_named(read_archives(spark, folder, "names")), ["archive", "block_index"])
    return rows.select(_ident().alias("page_id"), F.lower(F.hex("md5")).alias("md5"))


def archive_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("html"), "pages", compression="bzip2", encrypted=True, fix_key=True)
    return _named(integrity.checksums(read_archives(spark, folder, "files"))).select(_ident().alias("page_id"), "size", "md5")


def archive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of version 4 archives and what is wrong with them, which is nothing."""
    folder = _pack(_table(spark, sf_dir, "region").withColumn("r_regionkey", F.col("r_regionkey").cast("bigint")), "r_regionkey", _text("r_name"), "region", count=2, format_version=3)
    rows = read_archives(spark, folder, "archives")
    return rows.select("archive", "format_version", "header_size", "sector_size", integrity.header_problem()["kind"].alias("problem"))


def archive_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives captured as a manifest, one file replaced, some deleted and renamed, written again and read."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("url"), "pages")
    base = manifests.capture(read_archives(spark, folder, "files"))
    name = F.concat(F.lit("PAGES\\"), F.lit("0.BIN"))
    change = manifests.manifest(spark.range(1), F.lit("pages-0.mpq"), F.lit(0), name, F.encode(F.lit("replaced"), "UTF-8"))
    kept = manifests.upsert(base, change, ["archive", "name"], fold=True)
    gone = kept.where(F.pmod(_ident(), F.lit(10)) == 3).select("archive", "name")
    kept = manifests.delete(kept, gone, ["archive", "name"], fold=True)
    names = spark.createDataFrame([("pages-1.mpq", "pages\\1.bin", "moved\\1.bin")], "archive string, old string, new string")
    again = shared_folder(spark)
    write_archives(manifests.rename(kept, names), again)
    return _named(read_archives(spark, again, "files")).select(F.lower("name").alias("name"), F.decode("content", "UTF-8").alias("content"))


def verify_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each archive has, which is none."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("html"), "pages")
    archives, hashes, blocks = (read_archives(spark, folder, t) for t in ("archives", "hash_entries", "block_entries"))
    found = integrity.verify(archives, hashes, blocks).groupBy("archive").agg(F.count("*").alias("n"))
    return archives.select("archive", "hash_table_entries").join(found, "archive", "left").select("archive", F.coalesce("n", F.lit(0)).alias("findings"))


def patch_chain_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation is an overlay on the one before: the last one shows."""
    rows = _table(spark, sf_dir, "conversations").withColumn("__turn", F.col("turn"))
    folder = shared_folder(spark)
    name = F.concat(F.lit("c\\"), F.col("conv_id").cast("string"), F.lit(".bin"))
    write_archives(manifests.manifest(rows, F.concat(F.lit("turn-"), F.col("turn").cast("string")), F.col("conv_id"), name, _text("text")), folder)
    files = read_archives(spark, folder, "files")
    chain = files.select("archive").distinct().select("archive", F.regexp_extract("archive", "([0-9]+)", 1).cast("long").alias("ord"), F.lit(None).cast("string").alias("prefix"))
    merged = overlay.patched_files(files, chain)
    return _named(merged).select(_ident().alias("conv_id"), F.decode("content", "UTF-8").alias("text"))


@F.pandas_udf(T.BinaryType())
def _patch(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([patches.make_patch(bytes(a), bytes(b)) for a, b in zip(old, new, strict=True)])


def patch_bsdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base archives of upper-case texts and patch archives of differences that restore them, in shards."""
    rows = _table(spark, sf_dir, "documents").where("text is not null")
    name = F.concat(F.lit("d\\"), F.col("doc_id").cast("string"), F.lit(".bin"))
    old = F.encode(F.upper("text"), "UTF-8")
    shard = F.pmod("doc_id", F.lit(SHARDS)).cast("string")
    base = manifests.manifest(rows, F.concat(F.lit("base-"), shard), F.col("doc_id"), name, old)
    patch = manifests.manifest(rows, F.concat(F.lit("patch-"), shard), F.col("doc_id"), F.concat(F.lit("base\\"), name), _patch(old, F.encode("text", "UTF-8")))
    folder = shared_folder(spark)
    write_archives(base.unionByName(patch), folder)
    chain = spark.createDataFrame([(f"{kind}-{k}.mpq", i, prefix) for k in range(SHARDS) for i, (kind, prefix) in enumerate((("base", None), ("patch", "base")))], "archive string, ord long, prefix string")
    merged = overlay.patched_files(read_archives(spark, folder, "files"), chain)
    return _named(merged).select(_ident().alias("doc_id"), F.md5("content").alias("md5"))


def merged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlays listed as one: of each name the size in the last archive that has it."""
    rows = _table(spark, sf_dir, "pages")
    name = F.concat(F.lit("p\\"), F.col("page_id").cast("string"), F.lit(".bin"))
    base = manifests.manifest(rows, F.lit("m0"), F.col("page_id"), name, _text("url"))
    over = manifests.manifest(rows.where("page_id % 3 = 0"), F.lit("m1"), F.col("page_id"), name, _text("html"))
    folder = shared_folder(spark)
    write_archives(base.unionByName(over), folder)
    chain = spark.createDataFrame([("m0.mpq", 0, None), ("m1.mpq", 1, None)], "archive string, ord long, prefix string")
    items = overlay.list_all(_named(read_archives(spark, folder)), chain)
    return items.select(_ident().alias("page_id"), "archive")


def _codec(method: str, table: str, ident: str, column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        rows = _table(spark, sf_dir, table).select(ident, _text(column).alias("data")).where("length(data) >= 4")
        back = codecs.decompressed(codecs.compressed(F.col("data"), method), method, F.length("data").cast("long"))
        return rows.select(ident, F.md5(back).alias("md5"))

    return query


def _codec_sql(table: str, ident: str, column: str) -> str:
    return f"SELECT {ident}, md5({column}) AS md5 FROM {table} WHERE octet_length(encode({column})) >= 4"


def cipher_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = _table(spark, sf_dir, "pages").select("page_id", _text("html").alias("data"), cipher.name_hashes(F.col("url"))["file_key"].alias("key"))
    back = cipher.decrypted(cipher.encrypted(F.col("data"), F.col("key")), F.col("key"))
    return rows.select("page_id", F.md5(back).alias("md5"))


_PAGES, _DOCS, _CONV = ("pages", "page_id", "html"), ("documents", "doc_id", "text"), ("conversations", "conv_id", "text")

QUERIES = {
    "archive_roundtrip_md5": _roundtrip(*_PAGES, "pages"),
    "archive_list_sizes": archive_list_sizes,
    "archive_zlib_roundtrip": _roundtrip(*_DOCS, "docs", compression="zlib"),
    "archive_bzip2_roundtrip": _roundtrip(*_DOCS, "docs", compression="bzip2"),
    "archive_lzma_roundtrip": _roundtrip(*_PAGES, "pages", compression="lzma"),
    "archive_pkware_roundtrip": _roundtrip("benchmark", "item_id", "text", "bench", compression="pkware"),
    "archive_huffman_roundtrip": _roundtrip("benchmark", "item_id", "text", "bench", compression="huffman"),
    "archive_encrypted_roundtrip": _roundtrip(*_DOCS, "docs", compression="zlib", encrypted=True, fix_key=True),
    "archive_sector_crc_roundtrip": _roundtrip(*_DOCS, "docs", compression="zlib", sector_crc=True),
    "archive_single_unit_roundtrip": _roundtrip(*_PAGES, "pages", single_unit=True, encrypted=True),
    "archive_find": archive_find,
    "archive_lookup": archive_lookup,
    "archive_attributes": archive_attributes,
    "archive_checksums": archive_checksums,
    "archive_headers": archive_headers,
    "archive_rewrite": archive_rewrite,
    "verify_clean": verify_clean,
    "patch_chain_replace": patch_chain_replace,
    "patch_bsdiff": patch_bsdiff,
    "merged_listing": merged_listing,
    "codec_sparse": _codec("sparse", *_DOCS),
    "codec_huffman": _codec("huffman", "benchmark", "item_id", "text"),
    "codec_pkware": _codec("pkware", "benchmark", "item_id", "text"),
    "codec_zlib": _codec("zlib", *_DOCS),
    "cipher_roundtrip": cipher_roundtrip,
}

_PAGE_NAME = "'pages\\' || page_id || '.bin'"
ORACLE = {
    "archive_roundtrip_md5": _roundtrip_sql(*_PAGES),
    **{f"archive_{k}_roundtrip": _roundtrip_sql(*_DOCS) for k in ("zlib", "bzip2", "encrypted", "sector_crc")},
    **{f"archive_{k}_roundtrip": _roundtrip_sql(*_PAGES) for k in ("lzma", "single_unit")},
    **{f"archive_{k}_roundtrip": _roundtrip_sql("benchmark", "item_id", "text") for k in ("pkware", "huffman")},
    "archive_list_sizes": f"""SELECT doc_id, 'docs-' || (doc_id % {ARCHIVES}) || '.mpq' AS archive, CAST(octet_length(encode(text)) AS BIGINT) AS file_size,
        CAST(ceil(octet_length(encode(text)) / 4096.0) AS BIGINT) AS sectors FROM documents""",
    "archive_find": "SELECT page_id FROM pages WHERE regexp_matches(CAST(page_id AS VARCHAR), '1.$')",
    "archive_lookup": f"SELECT {_PAGE_NAME} AS name, 'pages-' || (page_id % {ARCHIVES}) || '.mpq' AS archive FROM pages",
    "archive_attributes": "SELECT page_id, md5(html) AS md5 FROM pages",
    "archive_checksums": "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS md5 FROM pages",
    "archive_headers": "SELECT 'region-' || k || '.mpq' AS archive, CAST(3 AS INTEGER) AS format_version, CAST(208 AS BIGINT) AS header_size, CAST(4096 AS BIGINT) AS sector_size, CAST(NULL AS VARCHAR) AS problem FROM (VALUES (0), (1)) t(k)",
    "archive_rewrite": f"""SELECT CASE WHEN page_id = 1 THEN 'moved\\1.bin' ELSE {_PAGE_NAME} END AS name, CASE WHEN page_id = 0 THEN 'replaced' ELSE url END AS content
        FROM pages WHERE page_id % 10 <> 3""",
    "verify_clean": "SELECT DISTINCT 'pages-' || (page_id % 8) || '.mpq' AS archive, CAST(0 AS BIGINT) AS findings FROM pages",
    "patch_chain_replace": "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
    "patch_bsdiff": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL",
    "merged_listing": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'm1.mpq' ELSE 'm0.mpq' END AS archive FROM pages",
    "codec_sparse": _codec_sql(*_DOCS),
    "codec_zlib": _codec_sql(*_DOCS),
    "codec_huffman": _codec_sql("benchmark", "item_id", "text"),
    "codec_pkware": _codec_sql("benchmark", "item_id", "text"),
    "cipher_roundtrip": "SELECT page_id, md5(html) AS md5 FROM pages",
}
