"""Queries of the relational operators straight on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import digests
from ..functions import names as N
from ..operators import integrity, listing, manifests, overlay


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE[f.__name__] = sql
        return f

    return add


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '\A.*EXAMPLE.net/.n/.*\z', 'is')")
def wildcard_find(t: Tables) -> DataFrame:
    return t.pages.where(N.matches(F.col("url"), "*EXAMPLE.net/?n/*")).select("page_id", "url")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def scope_named(t: Tables) -> DataFrame:
    """Entries with a name, as an inner instead of a left join."""
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id")


@query(
    """SELECT l_orderkey, l_linenumber, CAST(f AS BIGINT) AS flags, f & 65536 <> 0 AS encrypted, f & 16777216 = 0 AS multi_sector, f & 16777216 = 0 AND f & 768 <> 0 AS offsets,
       CASE WHEN f & 512 <> 0 THEN 'compress' WHEN f & 256 <> 0 THEN 'implode' ELSE 'none' END AS method FROM (SELECT *,
       (CASE l_returnflag WHEN 'A' THEN 512 WHEN 'R' THEN 256 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 65536 ELSE 0 END) + (CASE WHEN l_quantity > 25 THEN 16777216 ELSE 0 END) AS f FROM lineitem)"""
)
def flag_predicates(t: Tables) -> DataFrame:
    c = F.col
    bits = F.when(c("l_returnflag") == "A", S.COMPRESS).when(c("l_returnflag") == "R", S.IMPLODE).otherwise(0)
    bits = bits + F.when(c("l_linestatus") == "O", S.ENCRYPTED).otherwise(0) + F.when(c("l_quantity") > 25, S.SINGLE_UNIT).otherwise(0)
    flags = bits.cast("long")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", flags.alias("flags"), listing.has_flag(flags, S.ENCRYPTED).alias("encrypted"), listing.is_multi_sector(flags).alias("multi_sector"),
        listing.uses_sector_offsets(flags).alias("offsets"), listing.method(flags).alias("method"),
    )


@query(r"SELECT page_id, replace(url, '/', '\') AS path, regexp_extract(url, '[^/\\]*$', 0) AS base, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM pages")
def name_normalise(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.archive_path(F.col("url")).alias("path"), N.base_name(F.col("url")).alias("base"), N.ascii_lower(F.col("url")).alias("folded"))


@query(r"SELECT page_id, coalesce(nullif(array_to_string(list_filter(list_transform(string_split(replace('..\' || url || '/ . /', '\', '/'), '/'), lambda x: trim(x)), lambda x: x NOT IN ('', '.', '..')), '/'), ''), 'unnamed.bin') AS path FROM pages")
def safe_path(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.safe_path(F.concat(F.lit("..\\"), F.col("url"), F.lit("/ . /"))).alias("path"))


@query("SELECT p_partkey, nullif(regexp_replace(replace(trim(p_type), '/', '\\'), '\\\\+$', ''), '') || '\\' AS prefix FROM part")
def patch_prefix(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.patch_prefix(F.col("p_type")).alias("prefix"))


@query("SELECT doc_id, lang, 'Docs/D' || doc_id AS name FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_exists(t: Tables) -> DataFrame:
    """Which names are among the items, whatever their case and slashes."""
    named = t.documents.select("doc_id", "lang", F.concat(F.lit("Docs/D"), F.col("doc_id").cast("string")).alias("name"))
    return listing.has_names(named, t.labels.select(F.concat(F.lit("docs\\d"), F.col("doc_id").cast("string")).alias("name")))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_dangling(t: Tables) -> DataFrame:
    return manifests.dangling(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query(
    """SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'de' THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END, doc_id) AS r FROM documents) WHERE r = 1"""
)
def ranked_pick(t: Tables) -> DataFrame:
    preference = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).otherwise(2)
    return listing.ranked_pick(t.documents.select("source", "doc_id", "lang"), ["source"], preference, F.col("doc_id"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_wins_merge(t: Tables) -> DataFrame:
    return overlay.last_wins(t.conversations, ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


_ALL = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ALL}) AS r FROM lineitem) WHERE r > 1")
def dup_keys(t: Tables) -> DataFrame:
    return manifests.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], _ALL.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    """SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN CASE WHEN e.path IN ('d1', 'd7') THEN 'allowed' ELSE 'missing' END WHEN e.path IS NULL THEN 'extra' ELSE 'mismatch' END AS status
    FROM (SELECT 'd' || doc_id AS path, length(text) AS size, sha256(text) AS s FROM documents WHERE doc_id % 3 <> 0) e
    FULL JOIN (SELECT 'd' || doc_id AS path, length(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS size, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 4 <> 1) a USING (path)
    WHERE a.path IS NULL OR e.path IS NULL OR e.size <> a.size OR e.s <> a.s"""
)
def manifest_compare(t: Tables) -> DataFrame:
    def view(where: str, text):
        return t.documents.where(where).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"))

    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return manifests.compare(view("doc_id % 3 <> 0", F.col("text")), view("doc_id % 4 <> 1", changed), ["d1", "d7"])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'updated' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 11 <> 2
    UNION ALL SELECT c_custkey + 10000000, 'updated' FROM customer WHERE c_custkey % 50 = 0 AND (c_custkey + 10000000) % 11 <> 2"""
)
def upsert_delete(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_name")
    new = base.where("c_custkey % 5 = 0").select("c_custkey", F.lit("updated").alias("c_name"))
    more = base.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("updated").alias("c_name"))
    merged = manifests.upsert(base, new.unionByName(more), ["c_custkey"])
    return manifests.delete(merged, merged.where("c_custkey % 11 = 2"), ["c_custkey"])


@query("SELECT source AS archive, lang AS name, array_to_string(list_sort(list(DISTINCT doc_id % 9)), ',') AS locales FROM documents WHERE lang IS NOT NULL GROUP BY source, lang")
def distinct_sorted(t: Tables) -> DataFrame:
    """Every name's locales."""
    items = t.documents.select(F.col("source").alias("archive"), F.col("lang").alias("name"), (F.col("doc_id") % 9).cast("int").alias("locale"))
    return listing.locales(items).select("archive", "name", F.array_join(F.transform("locales", lambda x: x.cast("string")), ",").alias("locales"))


@query("SELECT o_orderstatus AS status, count(*) AS n, o_orderstatus IN ('F', 'O') AS known FROM orders GROUP BY o_orderstatus")
def status_counts(t: Tables) -> DataFrame:
    return manifests.status_counts(t.orders, "o_orderstatus", ["F", "O"])


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: Tables) -> DataFrame:
    return manifests.in_both(t.customer.select(F.col("c_nationkey").alias("nationkey")), t.supplier.select(F.col("s_nationkey").alias("nationkey")))


@query("SELECT o_orderkey % 1000 AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT l_orderkey % 1000 FROM lineitem WHERE l_quantity > 49")
def set_difference(t: Tables) -> DataFrame:
    """Numbers that open orders have and lines of large quantity don't."""
    first, second = t.orders.where("o_orderstatus = 'O'"), t.lineitem.where("l_quantity > 49")
    return manifests.only_in_first(first.select((F.col("o_orderkey") % 1000).alias("k")), second.select((F.col("l_orderkey") % 1000).alias("k")))


@query('SELECT source, doc_id, CAST(32 + sum(n_chars) OVER w AS BIGINT) AS "end", CAST(32 + sum(n_chars) OVER w - n_chars AS BIGINT) AS "begin" FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)')
def running_offsets(t: Tables) -> DataFrame:
    return integrity.running_offsets(t.documents.select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 32).select("source", "doc_id", "end", "begin")


@query("SELECT source, doc_id, n_chars, before FROM (SELECT source, doc_id, n_chars, lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE n_chars < before")
def monotonic_check(t: Tables) -> DataFrame:
    return integrity.not_monotonic(t.documents.select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars")


@query("SELECT * FROM (SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) - doc_id AS length FROM documents) WHERE length IS NOT NULL")
def offset_lengths(t: Tables) -> DataFrame:
    return integrity.lengths(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], "doc_id").select("source", "doc_id", "length").where("length is not null")


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def digest_md5_sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", digests.md5(F.col("text")).alias("md5"), digests.sha256(F.col("text")).alias("sha256"))


@query(
    r"""SELECT item_id, n, line FROM (SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM
    (SELECT item_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark))"""
)
def list_lines(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", F.posexplode(N.lines(F.col("text"))).alias("pos", "line"))
    return rows.select("item_id", (F.col("pos") + 1).cast("long").alias("n"), "line")


@query(
    """SELECT 'n' || n_regionkey AS archive, string_agg(n_name || chr(13) || chr(10), '' ORDER BY translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text FROM nation GROUP BY n_regionkey"""
)
def listfile_text(t: Tables) -> DataFrame:
    return manifests.listfile_text(t.nation.select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("archive"), F.col("n_name").alias("name")))


@query("SELECT p_type AS path, min(p_partkey) AS ord FROM part GROUP BY p_type")
def distinct_paths(t: Tables) -> DataFrame:
    return manifests.output_paths(t.part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("ord")))
