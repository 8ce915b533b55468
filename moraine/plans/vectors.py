"""Queries of byte functions and of tables around archives, each with SQL that computes the same in its own way or has the known values."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cipher, codecs, digests, patches
from ..operators import integrity, listing, manifests, overlay
from ..sources import texts
from ..sources.datasource import extract_files, file_system, read_archives, write_archives
from ..storage import bounded_batches, shared_folder
from ..streaming.arrivals import arrivals, totals
from .archives import ARCHIVES, _ident, _named, _pack, _table, _text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


#: The cipher's table in SQL: a sequence of 2,560 numbers, two for each word.
_CIPHER_TABLE = """WITH RECURSIVE seq(k, s) AS (SELECT 0, ((1048577 * 125 + 3) % 2796203)::BIGINT UNION ALL SELECT k + 1, (s * 125 + 3) % 2796203 FROM seq WHERE k < 2559),
words AS (SELECT a.k // 2 AS n, ((a.s & 65535) << 16) | (b.s & 65535) AS w FROM seq a JOIN seq b ON b.k = a.k + 1 WHERE a.k % 2 = 0),
t AS (SELECT list(w ORDER BY n % 5, n // 5) AS w FROM words),"""


def _hash_sql(kind: int) -> str:
    """A fold over the characters; the state (two numbers) and the characters are one kind of struct."""
    step = f"t.w[{kind * 256} + x.c + 1]"
    first = f"xor({step}, (a.s + a.z) & 4294967295)"
    return (
        f"list_reduce(list_prepend({{'c': 0::BIGINT, 's': 2146271213::BIGINT, 'z': 4008636142::BIGINT}}, list_transform(string_split(u, ''), lambda y: {{'c': ord(y)::BIGINT, 's': 0::BIGINT, 'z': 0::BIGINT}})),"
        f" lambda a, x: {{'c': 0::BIGINT, 's': {first}::BIGINT, 'z': ((x.c + {first} + a.z * 33 + 3) & 4294967295)::BIGINT}}).s"
    )


@query(
    f"""{_CIPHER_TABLE} names AS (SELECT page_id, replace(upper(url), '/', '\\') AS u FROM pages)
SELECT page_id, {_hash_sql(0)} AS start, {_hash_sql(1)} AS hash_a, {_hash_sql(2)} AS hash_b, {_hash_sql(3)} AS file_key FROM names, t"""
)
def name_hashes(spark, sf_dir):
    """The four hashes of each URL as a name (they are ASCII)."""
    return _table(spark, sf_dir, "pages").select("page_id", cipher.name_hashes(F.col("url")).alias("h")).select("page_id", "h.*")


@query(
    """SELECT * FROM (VALUES ('(hash table)', 'file_key', 3283040112), ('(block table)', 'file_key', 3968054179), ('Foo/Bar.txt', 'start', 1395034267), ('Foo/Bar.txt', 'hash_a', 2964819986),
    ('Foo/Bar.txt', 'hash_b', 3029990649), ('foo\\BAR.TXT', 'start', 1395034267)) t(name, kind, hash)"""
)
def known_name_hashes(spark, sf_dir):
    """Hashes with published values."""
    wanted = [("(hash table)", "file_key"), ("(block table)", "file_key"), ("Foo/Bar.txt", "start"), ("Foo/Bar.txt", "hash_a"), ("Foo/Bar.txt", "hash_b"), ("foo\\BAR.TXT", "start")]
    rows = spark.createDataFrame(wanted, "name string, kind string").withColumn("h", cipher.name_hashes(F.col("name")))
    pick = F.when(F.col("kind") == "file_key", F.col("h.file_key")).when(F.col("kind") == "start", F.col("h.start")).when(F.col("kind") == "hash_a", F.col("h.hash_a")).otherwise(F.col("h.hash_b"))
    return rows.select("name", "kind", pick.alias("hash"))


@query("SELECT 'cceec7070e38b6b2800230fa' AS secret, '11223344cafebabeaabbccdd' AS plain")
def known_cipher(spark, sf_dir):
    key = cipher.file_key("fixtures\\models\\footman.mdx", 0, 12, False)
    rows = spark.createDataFrame([("11223344cafebabeaabbccdd", key)], "plain string, key long").withColumn("data", F.unhex("plain"))
    secret = rows.withColumn("secret", cipher.encrypted("data", "key"))
    return secret.select(F.lower(F.hex("secret")).alias("secret"), F.lower(F.hex(cipher.decrypted("secret", "key"))).alias("plain"))


_BYTES = "list_transform(range(0, octet_length(encode({0})), 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"
#: CRC-32 by its table of 256 and a fold; Adler-32 in closed form.
_CHECKSUMS = f"""WITH t AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
b AS (SELECT item_id, {_BYTES.format("text")} AS b FROM benchmark)
SELECT item_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(t.c[(xor(a, x) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS crc32,
    ((len(b) + list_sum(list_transform(b, lambda x, i: (len(b) - i + 1) * x))) % 65521)::BIGINT * 65536 + ((1 + list_sum(b)) % 65521)::BIGINT AS adler32 FROM b, t"""


@query(_CHECKSUMS)
def crc32_adler32_items(spark, sf_dir):
    data = F.encode("text", "UTF-8")
    return _table(spark, sf_dir, "benchmark").select("item_id", digests.crc32(data).alias("crc32"), digests.adler32(data).alias("adler32"))


@query(
    """SELECT * FROM (VALUES ('abc', 891568578, 38600999, '900150983cd24fb0d6963f7d28e17f72'), ('Wikipedia', 2913648686, 300286872, '9c677286866aad38f8e9b660f5411814'),
    ('alpha.txt' || chr(13) || chr(10) || 'beta.bin' || chr(13) || chr(10), 272706041, 1366099654, '8561a3fad8a9333c0f8e8862a7433c96')) t(text, crc32, adler32, md5)"""
)
def known_digests(spark, sf_dir):
    """Digests with published values; the last text is that of a list of names."""
    rows = spark.createDataFrame([("abc",), ("Wikipedia",), ("alpha.txt\r\nbeta.bin\r\n",)], "text string")
    data = F.encode("text", "UTF-8")
    return rows.select("text", digests.crc32(data).alias("crc32"), digests.adler32(data).alias("adler32"), digests.md5(data).alias("md5"))


@query("SELECT * FROM (VALUES (0, 100), (1, 130), (2, 607), (3, 635), (4, 610), (5, 610), (6, 589)) t(place, sample)")
def adpcm_samples(spark, sf_dir):
    """Codes unpacked by the public table of steps, from 494 on: up by 494 >> 4, by 449 + (449 >> 4), by 449 >> 4, down by 408 >> 4, a code that only lowers the step, and down by 337 >> 4."""
    codes = bytes([0, 4, 100, 0, 0x00, 0x01, 0x00, 0x40, 0x80, 0x40])
    rows = spark.createDataFrame([(codes, 14)], "data binary, size long")
    samples = codecs.decompressed(F.col("data"), "adpcm_mono", F.col("size"))
    byte = lambda i: F.conv(F.hex(F.substring("s", i, 1)), 16, 10).cast("int")
    each = rows.select(samples.alias("s")).select("s", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("place"))
    return each.select("place", F.expr("cast(conv(hex(substring(s, 2 * place + 2, 1)), 16, 10) as int) * 256 + cast(conv(hex(substring(s, 2 * place + 1, 1)), 16, 10) as int)").alias("sample"))


def _chain(data: bytes, kind: int) -> bytes:
    if kind == 0:
        return bytes([0x22]) + zlib.compress(codecs.compress("sparse", data))
    if kind == 1:
        return bytes([0x30]) + codecs.compress("bzip2", codecs.compress("sparse", data))
    return bytes([0x03]) + zlib.compress(codecs.compress("huffman", data))


@F.pandas_udf(T.BinaryType())
def _chained(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([_chain(bytes(d), int(k)) for d, k in zip(data, kind, strict=True)])


@F.pandas_udf(T.BinaryType())
def _unchained(data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([codecs.decompress_masked(bytes(d), int(n)) for d, n in zip(data, size, strict=True)])


@query("SELECT item_id, k AS chain, md5(text) AS md5 FROM benchmark, range(3) t(k)")
def codec_chains(spark, sf_dir):
    """Two codecs one after the other, named by one mask byte: sparse and zlib, sparse and bzip2, Huffman and zlib."""
    rows = _table(spark, sf_dir, "benchmark").crossJoin(spark.range(3).withColumnRenamed("id", "chain")).withColumn("data", F.encode("text", "UTF-8"))
    back = _unchained(_chained("data", "chain"), F.length("data").cast("long"))
    return rows.select("item_id", "chain", F.md5(back).alias("md5"))


@query("SELECT * FROM (VALUES ('adpcm_mono', 64), ('adpcm_stereo', 128), ('bzip2', 16), ('huffman', 1), ('lzma', 18), ('none', 0), ('pkware', 8), ('sparse', 32), ('zlib', 2)) t(method, mask)")
def codec_features(spark, sf_dir):
    """The codecs that are there, which is all of them: each packs and unpacks a text."""
    text = b"abcdefgh" * 8
    rows = []
    for name, mask in codecs.MASKS.items():
        back = codecs.decompress(name, codecs.compress(name, text), len(text))
        if len(back) == len(text):
            rows.append((name, mask))
    return spark.createDataFrame(rows, "method string, mask int")


@F.pandas_udf(T.LongType())
def _recovered(data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([cipher.key_from_content(bytes(d), 4096, int(n)) for d, n in zip(data, size, strict=True)], dtype="Int64")


@query("SELECT page_id, page_id % 3 AS kind, page_id % 3 <> 2 AS found FROM pages")
def key_recovery(spark, sf_dir):
    """Keys told from how an encrypted file begins (XML, RIFF); other contents give none."""
    bounded_batches(spark)
    pages = _table(spark, sf_dir, "pages").withColumn("key", cipher.name_hashes(F.col("url"))["file_key"]).withColumn("kind", F.col("page_id") % 3)
    body, size = F.encode("html", "UTF-8"), F.octet_length("html") + 8
    little = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(size - 8, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))
    head = F.when(F.col("kind") == 0, F.encode(F.lit("<?xml ve"), "UTF-8")).when(F.col("kind") == 1, F.concat(F.encode(F.lit("RIFF"), "UTF-8"), little)).otherwise(F.encode(F.lit("nothing "), "UTF-8"))
    rows = pages.withColumn("secret", cipher.encrypted(F.concat(head, body), F.col("key"))).withColumn("size", size.cast("long"))
    return rows.select("page_id", "kind", F.coalesce(_recovered("secret", "size") == F.col("key"), F.lit(False)).alias("found"))


@F.pandas_udf(T.BinaryType())
def _copies(old: pd.Series) -> pd.Series:
    return pd.Series([patches.make_patch(bytes(a), bytes(a), patches.COPY) for a in old])


@F.pandas_udf(T.BinaryType())
def _differences(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([patches.make_patch(bytes(a), bytes(b)) for a, b in zip(old, new, strict=True)])


@query("SELECT item_id, md5(text) AS md5 FROM benchmark")
def patch_steps(spark, sf_dir):
    """A base, a patch that copies it, one that changes it and one that copies the change, applied in order."""
    new = F.encode("text", "UTF-8")
    old = F.encode(F.upper("text"), "UTF-8")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.array(old, _copies(old), _differences(old, new), _copies(new)).alias("steps"))
    return rows.select("item_id", F.md5(patches.folded("steps")).alias("md5"))


# tables of archives

@query(
    """SELECT * FROM (VALUES ('pages-0.mpq', 'Format', 'header too small'), ('pages-1.mpq', 'Format', 'v4 header too small'), ('pages-2.mpq', 'UnsupportedFeature', 'unknown header format version'),
    ('pages-3.mpq', 'Format', 'hash table entry count must be non-zero power of two'), ('pages-4.mpq', 'Format', 'block table entry count must be non-zero'), ('pages-5.mpq', 'Format', 'table range exceeds file length'),
    ('pages-6.mpq', 'Format', 'extended table range exceeds file length'), ('pages-7.mpq', NULL, NULL)) t(archive, kind, message)"""
)
def header_problems(spark, sf_dir):
    """Headers damaged in one way each."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("url"), "pages", format_version=3)
    damage = {"header_size": {0: 10, 1: 32}, "format_version": {2: 9}, "hash_table_entries": {3: 3}, "block_table_entries": {4: 0}, "hash_table_pos": {5: 1 << 40}, "het_table_pos_64": {6: 1 << 40}, "het_table_size_64": {6: 5}}
    rows = read_archives(spark, folder, "archives")
    for column, values in damage.items():
        changed = F.col(column)
        for k, value in values.items():
            changed = F.when(F.col("archive") == f"pages-{k}.mpq", F.lit(value)).otherwise(changed)
        rows = rows.withColumn(column, changed)
    return rows.select("archive", integrity.header_problem().alias("p")).select("archive", "p.kind", "p.message")


def _unnamed(spark, sf_dir: str, **options) -> str:
    pages = _table(spark, sf_dir, "pages")
    folder = shared_folder(spark)
    archive = F.concat(F.lit("pages-"), F.pmod("page_id", F.lit(ARCHIVES)).cast("string"))
    name = F.concat(F.lit("pages\\"), F.col("page_id").cast("string"), F.lit(".bin"))
    write_archives(manifests.manifest(pages, archive, F.col("page_id"), name, _text("url"), **options), folder, listfile="false")
    return folder


@query("SELECT page_id, 'pages-' || (page_id % 8) || '.mpq' AS archive FROM pages WHERE page_id % 3 <> 0")
def external_names(spark, sf_dir):
    """Archives without lists of names get names from a table of them, which knows two thirds and some that aren't there."""
    folder = _unnamed(spark, sf_dir)
    pages = _table(spark, sf_dir, "pages").where("page_id % 3 <> 0")
    lines = F.array(F.concat(F.lit("Pages/"), F.col("page_id").cast("string"), F.lit(".bin")), F.concat(F.lit("none\\"), F.col("page_id").cast("string")))
    listed = pages.select(F.concat(F.lit("pages-"), F.pmod("page_id", F.lit(ARCHIVES)).cast("string"), F.lit(".mpq")).alias("archive"), F.col("page_id").alias("ord"), F.explode(lines).alias("name"))
    found = listing.name_blocks(listed, read_archives(spark, folder, "hash_entries"), read_archives(spark, folder, "block_entries"))
    return found.select(F.regexp_extract("name", "([0-9]+)[.]bin$", 1).cast("long").alias("page_id"), "archive")


@query("SELECT page_id, md5(url) AS md5 FROM pages WHERE page_id % 2 = 0")
def listfile_option(spark, sf_dir):
    """The same by a file with the names, given to the scan as an option."""
    folder = _unnamed(spark, sf_dir)
    names = _table(spark, sf_dir, "pages").where("page_id % 2 = 0").agg(F.array_join(F.transform(F.collect_list("page_id"), lambda p: F.concat(F.lit("pages\\"), p.cast("string"), F.lit(".bin\r\n"))), "").alias("t"))
    fs, root = file_system(shared_folder(spark))
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/names.txt") as out:
        out.write(names.first().t.encode())
    files = read_archives(spark, folder, "files", listfile=f"{root}/names.txt").where("name is not null")
    return _named(files).select(_ident().alias("page_id"), F.md5("content").alias("md5"))


@query("SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN html ELSE url END) AS md5, CAST(CASE WHEN page_id % 2 = 0 THEN 1031 ELSE 0 END AS INTEGER) AS locale FROM pages")
def locale_lookup(spark, sf_dir):
    """Names looked up in a locale that half of them have, given to those files by a change of the manifest."""
    pages = _table(spark, sf_dir, "pages")
    archive, name = F.concat(F.lit("pages-"), F.pmod("page_id", F.lit(ARCHIVES)).cast("string")), F.concat(F.lit("pages\\"), F.col("page_id").cast("string"), F.lit(".bin"))
    neutral = manifests.manifest(pages, archive, F.col("page_id"), name, _text("url"))
    even = pages.where("page_id % 2 = 0")
    changes = even.select(archive.alias("archive"), F.upper(name).alias("name"), F.lit(1031).alias("locale"), F.lit(0).alias("platform"))
    german = manifests.set_locale(manifests.manifest(even, archive, F.col("page_id"), name, _text("html")), changes)
    folder = shared_folder(spark)
    write_archives(neutral.unionByName(german), folder)
    wanted = pages.select(F.concat(archive, F.lit(".mpq")).alias("archive"), name.alias("name"))
    found = listing.look_up(wanted, read_archives(spark, folder, "hash_entries"), read_archives(spark, folder, "block_entries"), locale=1031)
    content = read_archives(spark, folder, "files").select("archive", "hash_index", "content")
    return found.join(content, ["archive", "hash_index"]).select(_ident().alias("page_id"), F.md5("content").alias("md5"), "locale")


@query("SELECT page_id, md5(html) AS md5, true AS crc_fits FROM pages")
def attributes_built(spark, sf_dir):
    """The rows of attributes made from contents, beside those stored."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("html"), "pages", attributes="true")
    built = integrity.build_attributes(_named(read_archives(spark, folder, "files")))
    stored = read_archives(spark, folder, "attributes").select("archive", "block_index", F.col("crc32").alias("stored"))
    rows = built.join(stored, ["archive", "block_index"]).join(read_archives(spark, folder, "names"), ["archive", "block_index"])
    return rows.select(_ident().alias("page_id"), F.lower(F.hex("md5")).alias("md5"), (F.col("crc32") == F.col("stored")).alias("crc_fits"))


@query("SELECT page_id FROM pages WHERE page_id % 4 = 0")
def attributes_checked(spark, sf_dir):
    """Files that differ from their stored checksums: every fourth content is changed after reading."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("html"), "pages", attributes="true")
    files = _named(read_archives(spark, folder, "files"))
    files = files.withColumn("content", F.when(_ident() % 4 == 0, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")))
    return integrity.check_attributes(files, read_archives(spark, folder, "attributes")).select(_ident().alias("page_id"))


@query("SELECT 'pages-' || (page_id % 8) || '.mpq' AS archive, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) - 1 AS block_index, 'UnsupportedFeature' AS error_kind FROM pages")
def unreadable_files(spark, sf_dir):
    """Encrypted files without names whose beginning tells no key."""
    folder = _unnamed(spark, sf_dir, single_unit=True, encrypted=True)
    return integrity.unreadable(read_archives(spark, folder, "files")).select("archive", "block_index", "error_kind")


@query("SELECT * FROM (VALUES ('empty.mpq', 'Format'), ('none.mpq', 'Format'), ('short.mpq', 'Format'), ('region-0.mpq', NULL)) t(archive, error_kind)")
def damaged_archives(spark, sf_dir):
    """Files that are no archives, beside one that is: rows with the kind of error."""
    region = _table(spark, sf_dir, "region").withColumn("r_regionkey", F.col("r_regionkey").cast("bigint"))
    folder = _pack(region, "r_regionkey", _text("r_name"), "region", count=1)
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/region-0.mpq") as f:
        good = f.read()
    for name, data in (("empty", b""), ("none", b"no archive at all" * 9), ("short", good[: len(good) // 2])):
        with fs.open_output_stream(f"{root}/{name}.mpq") as out:
            out.write(data)
    return read_archives(spark, folder, "archives").select("archive", "error_kind")


@query(
    r"""SELECT name, CASE WHEN n % 3 = 0 THEN 'over.mpq' ELSE 'base.mpq' END AS archive FROM (SELECT n_nationkey AS n, 'nations\' || lower(n_name) AS name FROM nation) WHERE n % 2 = 0 OR n % 3 = 0"""
)
def chain_has(spark, sf_dir):
    """Which archive of a chain has a name: the overlay holds it below its prefix; names of neither aren't there."""
    nation = _table(spark, sf_dir, "nation").withColumn("ord", F.col("n_nationkey").cast("long"))
    name = F.concat(F.lit("Nations\\"), F.col("n_name"))
    base = manifests.manifest(nation.where("ord % 2 = 0"), F.lit("base"), F.col("ord"), name, _text("n_name"))
    over = manifests.manifest(nation.where("ord % 3 = 0"), F.lit("over"), F.col("ord"), F.concat(F.lit("root\\"), name), _text("n_name"))
    folder = shared_folder(spark)
    write_archives(base.unionByName(over), folder)
    chain = spark.createDataFrame([("base.mpq", 0, None), ("over.mpq", 1, "root")], "archive string, ord long, prefix string")
    wanted = nation.select(F.lower(name).alias("name"))
    return overlay.has_any(wanted, read_archives(spark, folder), chain).select("name", "archive")


@query(
    """SELECT 'd' || doc_id AS archive, 'text' AS label, CAST((doc_id % ceil(octet_length(encode(text)) / 1000.0)::BIGINT) AS INTEGER) AS chunk FROM documents WHERE doc_id % 7 = 0 AND length(text) > 0"""
)
def raw_chunk_digests(spark, sf_dir):
    """Ranges of 1,000 bytes a chunk held against digests, of which one in every seventh range is wrong."""
    docs = _table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    count = F.ceil(F.length("data") / 1000).cast("int")
    digest = lambda i: F.md5(F.substring("data", i * 1000 + 1, F.lit(1000)))
    wrong = lambda i: (F.col("doc_id") % 7 == 0) & (i == F.col("doc_id") % count)
    sums = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(wrong(i), F.lit("00" * 16)).otherwise(digest(i)))
    ranges = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("archive"), F.lit("text").alias("label"), F.lit(1000).cast("long").alias("chunk_size"), "data", F.unhex(F.array_join(sums, "")).alias("digests"))
    return integrity.raw_chunks(ranges)


@query("SELECT 'pages-' || k || '.mpq' AS archive, CASE WHEN k = 1 THEN 'weak' WHEN k = 2 THEN 'strong' ELSE 'none' END AS signature FROM range(8) t(k)")
def archive_signatures(spark, sf_dir):
    """Which kind of signature archives have: a signature file in one, a trailer behind another."""
    pages = _table(spark, sf_dir, "pages")
    folder = shared_folder(spark)
    archive, name = F.concat(F.lit("pages-"), F.pmod("page_id", F.lit(ARCHIVES)).cast("string")), F.concat(F.lit("pages\\"), F.col("page_id").cast("string"))
    weak = manifests.manifest(spark.range(1), F.lit("pages-1"), F.lit(-1), F.lit("(signature)"), F.unhex(F.lit("00" * 72)))
    write_archives(manifests.manifest(pages, archive, F.col("page_id"), name, _text("url")).unionByName(weak), folder)
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/pages-2.mpq") as f:
        data = f.read()
    with fs.open_output_stream(f"{root}/pages-2.mpq") as out:
        out.write(data + b"NGIS" + bytes(256))
    rows = read_archives(spark, folder, "trailers")
    return rows.select("archive", integrity.signature(F.col("trailer"), F.col("weak_size")).alias("signature"))


@query("SELECT 'pages-' || k || '.mpq' AS archive, CASE WHEN k % 2 = 1 THEN 'v4 header raw-data' END AS label FROM range(8) t(k)")
def archive_raw_ranges(spark, sf_dir):
    """Raw chunks of the headers of archives, of which every second has a wrong digest."""
    pages = _table(spark, sf_dir, "pages").select(F.pmod("page_id", F.lit(ARCHIVES)).alias("k")).distinct()
    folder = shared_folder(spark)

    def write(batches):
        import hashlib

        from ..sources import layout as L

        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for k in batch.column("k").to_pylist():
                data = bytearray(L.serialize([L.Entry("x", b"y")], L.Policy(format_version=3, header_size=0x100, extra={"raw_chunk_size": 64})))
                data[0xC0:0xF0] = b"".join(hashlib.md5(data[i : i + 64]).digest() for i in range(0, 0xC0, 64))
                data[0xD5] ^= k % 2
                with fs.open_output_stream(f"{root}/pages-{k}.mpq") as out:
                    out.write(bytes(data))
            yield batch

    pages.mapInArrow(write, pages.schema).count()
    wrong = integrity.raw_chunks(read_archives(spark, folder, "raw_ranges")).select("archive", "label")
    return read_archives(spark, folder, "archives").select("archive").join(wrong, "archive", "left")


# folders, texts, streams

def _extracted(spark, sf_dir: str, **options) -> tuple[str, str]:
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("html"), "pages", **options)
    out = shared_folder(spark)
    extract_files(_named(read_archives(spark, folder, "files")), out, _named(read_archives(spark, folder))).count()
    return folder, out


@query("SELECT 'pages/' || page_id || '.bin' AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256 FROM pages")
def extracted_folder(spark, sf_dir):
    """Archives extracted in parallel, and the manifest of the folder."""
    return manifests.folder_manifest(spark, _extracted(spark, sf_dir, compression="zlib")[1])


@query("SELECT page_id, md5(html) AS md5, true AS encrypted FROM pages")
def repacked_folder(spark, sf_dir):
    """A folder's files packed again, each with the flags that it had before."""
    folder, out = _extracted(spark, sf_dir, compression="zlib", encrypted=True)
    flags = _named(read_archives(spark, folder)).select("name", "flags")
    again = shared_folder(spark)
    write_archives(manifests.folder_entries(spark, out, "again", flags), again)
    files = _named(read_archives(spark, again, "files"))
    return files.select(_ident().alias("page_id"), F.md5("content").alias("md5"), listing.has_flag(F.col("flags"), 0x10000).alias("encrypted"))


@query("SELECT 'Nat' || n_nationkey || 'Get' AS name, 'unsigned long' AS return_type, 'const char * ' || lower(n_name[1:1]) || ', int n' AS args FROM nation")
def declarations(spark, sf_dir):
    """Declarations in C, written from a table and read again."""
    nation = _table(spark, sf_dir, "nation").coalesce(1)
    line = F.concat(F.lit("unsigned   long WINAPI Nat"), F.col("n_nationkey").cast("string"), F.lit("Get(const char *  "), F.lower(F.substring("n_name", 1, 1)), F.lit(",   int n);\nint Other(void);"))
    folder = shared_folder(spark)
    nation.select(line.alias("value")).write.text(folder)
    return texts.c_declarations(spark, folder, ("Nat",)).select("name", "return_type", "args")


@query("SELECT CASE WHEN k % 3 = 0 THEN 'Thing::f' ELSE 'f' END || k AS name, CASE WHEN k % 2 = 0 THEN 'covered' ELSE 'extra' END AS status FROM (SELECT n_nationkey AS k FROM nation) UNION ALL SELECT 'gone', 'missing'")
def api_coverage(spark, sf_dir):
    """Public functions of sources, written from a table, against a list of those wanted."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), (F.col("n_nationkey") % 3 == 0).alias("inner"))
    plain = F.concat(F.lit("pub fn f"), F.col("k"), F.lit("() {\n}\nfn hidden() {}"))
    inner = F.concat(F.lit("impl Thing {\n    pub fn f"), F.col("k"), F.lit("(&self) {\n    }\n}"))
    folder = shared_folder(spark)
    nation.select(F.when(F.col("inner"), inner).otherwise(plain).alias("value")).write.text(folder)
    there = texts.public_functions(spark, folder, "Thing", ".txt")
    wanted = nation.where("k % 2 = 0").select(F.concat(F.when(F.col("inner"), "Thing::f").otherwise("f"), F.col("k")).alias("name"))
    return texts.coverage(wanted.unionByName(spark.createDataFrame([("gone",)], "name string")), there)


@query("SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'partial' ELSE 'implemented' END AS status, count(*) AS n, true AS known FROM nation GROUP BY 1")
def checklist_status(spark, sf_dir):
    """A checklist in JSON, written from a table, and its features by status."""
    status = F.when(F.col("n_nationkey") % 4 == 0, "partial").otherwise("implemented")
    feature = F.struct(F.col("n_name").alias("id"), F.lit("a").alias("area"), F.lower("n_name").alias("description"), status.alias("status"), F.lit("e").alias("evidence"))
    folder = shared_folder(spark)
    _table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(feature).alias("features"))).alias("value")).write.text(folder)
    return manifests.status_counts(texts.checklist(spark, folder), "status", ["implemented", "partial", "missing", "out_of_scope"])


@query("SELECT 'pages-' || (page_id % 8) || '.mpq' AS archive, count(*) AS files, CAST(sum(octet_length(encode(url))) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def archives_that_arrive(spark, sf_dir):
    """A stream of the entries of archives, all there are, kept in a table; its totals."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("url"), "pages")
    out = shared_folder(spark)
    stream = arrivals(spark, folder).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/entries")
    stream.awaitTermination()
    return totals(_named(spark.read.parquet(f"{out}/entries")))


@query(
    """WITH b AS (SELECT 'pages-' || (page_id % 8) || '.mpq' AS archive, page_id % 8 AS k, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) - 1 AS i FROM pages),
    r AS (SELECT archive, 'table' AS scope, 'hash[#] points to invalid block index #' AS message FROM b WHERE i = 1 AND k = 0 UNION ALL SELECT archive, 'table', 'duplicate hash tuple at hash[#]' FROM b WHERE i = 2
        UNION ALL SELECT archive, 'file', 'block[#] data range exceeds archive length' FROM b WHERE i = 3 UNION ALL SELECT archive, 'file', 'block[#] zero compressed size with non-zero file size' FROM b WHERE i = 4
        UNION ALL SELECT archive, 'file', 'hash[#] points to non-existing block #' FROM b WHERE i = 5)
    SELECT archive, scope, message, count(*) AS n FROM r GROUP BY ALL"""
)
def structural_findings(spark, sf_dir):
    """Damaged tables: an entry beyond the block table, a repeated entry, a block beyond the archive, an empty block, one that doesn't exist; by kind of message."""
    folder = _pack(_table(spark, sf_dir, "pages"), "page_id", _text("html"), "pages")
    archives, hashes, blocks = (read_archives(spark, folder, t) for t in ("archives", "hash_entries", "block_entries"))
    hashes = hashes.withColumn("block_index", F.when((F.col("block_index") == 1) & (F.col("archive") == "pages-0.mpq"), 99_999).otherwise(F.col("block_index")))
    again = hashes.where("block_index = 2").withColumn("hash_index", F.col("hash_index") + 1_000_000)
    blocks = blocks.withColumns(
        {
            "compressed_size": F.when(F.col("block_index") == 3, 0xFFFFFFF0).when(F.col("block_index") == 4, 0).otherwise(F.col("compressed_size")),
            "flags": F.when(F.col("block_index") == 5, 0).otherwise(F.col("flags")),
        }
    )
    found = integrity.verify(archives, hashes.unionByName(again), blocks)
    return found.groupBy("archive", "scope", F.regexp_replace("message", "[0-9]+", "#").alias("message")).agg(F.count("*").alias("n"))
