"""Patch chains: a base and overlays in order, merged by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.patches import folded

_SIGNATURE = "50544348"


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order given: one aggregation that combines on the map side, no sort."""
    others = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in others))


def chain_names(items: DataFrame, chain: DataFrame) -> DataFrame:
    """Named items of the archives of a chain (archive, ord, prefix), with the names that the base knows them by: a patch's slashes
    turned, its prefix taken off, special files and those outside the prefix left out."""
    rows = items.where("name is not null").join(chain, "archive")
    turned = N.archive_path(F.col("name"))
    prefix = F.coalesce(N.patch_prefix(F.col("prefix")), F.lit(""))
    inside = F.startswith(N.ascii_lower(turned), N.ascii_lower(prefix)) & (F.length(turned) > F.length(prefix))
    name = F.when(F.col("ord") == 0, F.col("name")).otherwise(F.expr("substring(__turned, length(__prefix) + 1)"))
    rows = rows.withColumns({"__turned": turned, "__prefix": prefix}).where((F.col("ord") == 0) | inside)
    return rows.withColumn("name", name).where((F.col("ord") == 0) | ~F.col("name").startswith("(")).drop("__turned", "__prefix", "prefix")


def list_all(items: DataFrame, chain: DataFrame) -> DataFrame:
    """The merged listing: of each name the entry of the last archive in the chain that has it."""
    return last_wins(chain_names(items, chain), ["name"], ["ord", "hash_index"])


def patched_files(files: DataFrame, chain: DataFrame) -> DataFrame:
    """(name, content): each file of the chain with its patches applied in order.

    One aggregation by name, which collects the versions that the chain has of a file. Where none is a binary patch the last one is the
    content; only the others go through Python.
    """
    rows = chain_names(files, chain).where("content is not null").select(N.ascii_lower(F.col("name")).alias("__key"), "name", "ord", "hash_index", "content")
    is_patch = (F.hex(F.substring("content", 1, 4)) == _SIGNATURE) & (F.col("ord") > 0)
    versions = F.sort_array(F.collect_list(F.struct("ord", "hash_index", "content")))
    found = rows.groupBy("__key").agg(F.bool_or(is_patch).alias("__patched"), F.max_by("name", F.struct("ord", "hash_index")).alias("name"), F.transform(versions, lambda v: v["content"]).alias("__versions"))
    patched = folded(F.when(F.col("__patched"), F.col("__versions")))
    return found.select("name", F.when(F.col("__patched"), patched).otherwise(F.element_at("__versions", -1)).alias("content"))


def has_any(names: DataFrame, items: DataFrame, chain: DataFrame) -> DataFrame:
    """The names that any archive of the chain has, under one of the forms a patch may hold it by (in its prefix or not; slashes don't matter);
    the first form that is there, of the last archive that has one. The items get the names they answer to, so that one equi-join finds them."""
    key = lambda c: N.archive_path(N.ascii_lower(c))
    there = items.where("name is not null").select("archive", key(F.col("name")).alias("__there")).distinct().join(chain, "archive")
    prefix = N.patch_prefix(F.col("prefix"))
    inside = F.startswith(F.col("__there"), N.ascii_lower(prefix)) & (F.length("__there") > F.length(prefix))
    answers = F.array(F.when(inside, F.expr("substring(__there, length(__prefix) + 1)")), F.col("__there"))
    there = there.withColumn("__prefix", prefix).select("archive", "ord", "__prefix", F.posexplode(answers).alias("place", "__key")).where("__key is not null")
    found = names.select("name").distinct().withColumn("__key", key(F.col("name"))).join(there, "__key")
    turned = N.archive_path(F.col("name"))
    found = found.withColumn("form", F.when(F.col("place") == 0, F.concat("__prefix", turned)).otherwise(F.col("name")))
    return found.groupBy("name").agg(F.max_by(F.struct("archive", "form"), F.struct("ord", -F.col("place"))).alias("__r")).select("name", "__r.archive", "__r.form")
