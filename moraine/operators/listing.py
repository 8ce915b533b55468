"""Listing and looking up entries: joins, windows and predicates over the tables of archives. Built-in expressions, but for the name hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import names as N
from ..functions.cipher import name_hashes

NAMED, ALL = "named", "all"


# predicates and derived columns of a row

def is_free(block_index: Column) -> Column:
    return block_index == F.lit(S.FREE)


def is_deleted(block_index: Column) -> Column:
    return block_index == F.lit(S.DELETED)


def is_active(block_index: Column) -> Column:
    return block_index < F.lit(S.DELETED)


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def is_multi_sector(flags: Column) -> Column:
    return ~has_flag(flags, S.SINGLE_UNIT)


def uses_sector_offsets(flags: Column) -> Column:
    return is_multi_sector(flags) & has_flag(flags, S.COMPRESS | S.IMPLODE)


def sector_size(shift: Column) -> Column:
    """512 << shift, at most 2**32 - 1."""
    return F.when(shift >= 23, F.lit(0xFFFFFFFF)).otherwise(F.expr("cast(512 as bigint)") * F.pow(F.lit(2), shift).cast("long"))


def sector_count(file_size: Column, size: Column) -> Column:
    return F.ceil(file_size / size)


def file_end(file_pos: Column, compressed_size: Column) -> Column:
    return file_pos + compressed_size


def method(flags: Column) -> Column:
    """The family of codecs that the flags of a block name."""
    return F.when(has_flag(flags, S.COMPRESS), "compress").when(has_flag(flags, S.IMPLODE), "implode").otherwise("none")


# tables

def list_items(hash_entries: DataFrame, block_entries: DataFrame, names: DataFrame, scope: str = ALL) -> DataFrame:
    """The active entries with their blocks' flags and names; flags are null where an entry points outside the block table."""
    key = ["archive", "block_index"]
    blocks = block_entries.select(*key, F.col("flags").alias("__flags"))
    out = hash_entries.where(is_active(F.col("block_index"))).drop("flags").join(blocks, key, "left").withColumnRenamed("__flags", "flags").join(names, key, "inner" if scope == NAMED else "left")
    return out.select(*S.LIST_ITEMS.fieldNames())


def find(items: DataFrame, pattern: str, scope: str = NAMED) -> DataFrame:
    """Entries whose name fits a wildcard pattern; one without a name fits `*` only, and only where all are asked for."""
    fits = N.matches(F.col("name"), pattern)
    return items.where(fits if scope == NAMED or pattern != "*" else fits | F.col("name").isNull())


def look_up(names: DataFrame, hash_entries: DataFrame, block_entries: DataFrame, locale: int | None = None) -> DataFrame:
    """The entry of each (archive, name): the first from its own slot on, before any free slot; of a locale, else neutral, else any.

    An equi-join on the hashes, then a ranked pick. A free slot between a name's own slot and the entry ends the probing: a
    running count of free slots over each archive's table, in slot order, tells how many there are, so nothing is joined by ranges.
    """
    sizes = hash_entries.groupBy("archive").agg((F.max("hash_index") + 1).alias("__size"))
    counts = block_entries.groupBy("archive").agg(F.count("*").alias("__blocks"))
    slots = hash_entries.withColumn("__is_free", is_free(F.col("block_index")).cast("long"))
    running = W.partitionBy("archive").orderBy("hash_index")
    slots = slots.withColumns({"__free_to": F.sum("__is_free").over(running), "__free_all": F.sum("__is_free").over(W.partitionBy("archive"))})
    wanted = names.select("archive", "name").distinct().withColumn("__h", name_hashes("name"))
    wanted = wanted.select("archive", "name", F.col("__h.start").alias("__start"), F.col("__h.hash_a").alias("hash_a"), F.col("__h.hash_b").alias("hash_b"))
    found = wanted.join(slots, ["archive", "hash_a", "hash_b"]).join(sizes, "archive").join(counts, "archive").where(F.col("block_index") < F.col("__blocks"))
    mask = F.col("__size") - 1
    found = found.withColumn("__begin", F.col("__start").bitwiseAND(mask)).withColumn("__distance", (F.col("hash_index") - F.col("__begin")).bitwiseAND(mask))
    # free slots up to the entry and up to the begin of the probing; around the end where the entry lies before it
    free = (F.col("__free_to") - F.col("__free_before")) + F.when(F.col("hash_index") < F.col("__begin"), F.col("__free_all")).otherwise(0)
    begins = slots.select("archive", F.col("hash_index").alias("__begin"), (F.col("__free_to") - F.col("__is_free")).alias("__free_before"))
    found = found.join(begins, ["archive", "__begin"]).where(free == 0)
    order = [F.col("__distance")]
    if locale is not None:
        order.insert(0, F.when(F.col("locale") == locale, 0).when(F.col("locale") == 0, 1).otherwise(2))
    w = W.partitionBy("archive", "name").orderBy(*order)
    ranked = found.withColumn("__rank", F.row_number().over(w)).where("__rank = 1")
    return ranked.select("archive", "name", "hash_index", "block_index", "locale", "platform")


def name_blocks(listed: DataFrame, hash_entries: DataFrame, block_entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(archive, block_index, name) for the lines of lists of names (archive, ord, name): the first name of a block, after those known."""
    found = look_up(listed, hash_entries, block_entries).select("archive", "name", "block_index").join(listed, ["archive", "name"])
    w = W.partitionBy("archive", "block_index").orderBy("ord", "name")
    first = found.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("archive", "block_index", "name")
    if known is None:
        return first
    return known.select("archive", "block_index", "name").unionByName(first.join(known, ["archive", "block_index"], "left_anti"))


def has_names(names: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of names that are among the named items, whatever their case and slashes."""
    key = lambda c: N.archive_path(N.ascii_lower(c))
    there = items.select(key(F.col("name")).alias("__key")).distinct()
    return names.join(there, key(names["name"]) == F.col("__key"), "left_semi")


def locales(items: DataFrame) -> DataFrame:
    """(archive, name, locales): every name's locales, distinct and ascending."""
    return items.where("name is not null").groupBy("archive", "name").agg(F.sort_array(F.collect_set("locale")).alias("locales"))


def ranked_pick(rows: DataFrame, key: list[str], preference: Column, *tie: Column) -> DataFrame:
    """One row of each key: the first by preference, then by the ties."""
    w = W.partitionBy(*key).orderBy(preference, *tie)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
