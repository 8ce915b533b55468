"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetition. Built-in expressions only.

A source of size S and weight w gets min(cap, level * w) characters, cap = max_epochs * S, with the level at which the budget is
spent: what a clamped source can't take goes to the others in proportion to their weights, until all fit. Sorted by cap / w,
the clamped sources are a prefix, so running sums find the level without iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = {"src0": 4.0, "src1": 8.0, "src2": 4.0, "src3": 2.0}
DEFAULT_WEIGHT, MAX_EPOCHS, BUDGET_SHARE, SEED = 1.0, 4.0, 1.0, 42
BROADCAST_SOURCES = 10_000


def _sizes(docs: DataFrame) -> DataFrame:
    """(source, size) in characters: n_chars, or the length of the text in rows where that is null (a scan that Parquet's statistics skip if there are none)."""
    source = F.col("source").cast("string").alias("source")
    known = docs.where("n_chars is not null").select(source, F.col("n_chars").cast("double").alias("size"))
    unknown = docs.where("n_chars is null").select(source, F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("size"))
    return known.unionByName(unknown).groupBy("source").agg(F.sum("size").alias("size"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget_share: float = BUDGET_SHARE) -> DataFrame:
    """(source, rate): how often each document of a source is taken, on average."""
    weights = WEIGHTS if weights is None else weights
    if default < 0 or any(w < 0 for w in weights.values()) or max_epochs < 0 or budget_share < 0:
        raise ValueError("weights, epochs and budget can't be negative")
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(float(default))) if pairs else F.lit(float(default))
    s = _sizes(docs).withColumn("weight", weight).withColumn("cap", F.col("size") * float(max_epochs)).where("size > 0 and weight > 0")
    s = s.withColumn("budget", F.sum("size").over(W.partitionBy()) * float(budget_share))
    order = W.orderBy(F.col("cap") / F.col("weight"), "source")
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_from", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("clamped", F.col("cap") / F.col("weight") * F.col("weights_from") <= F.col("budget") - F.col("caps_before"))
    everything = W.partitionBy()
    left = F.col("budget") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything)
    level = left / F.nullif(F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).over(everything), F.lit(0.0))
    return s.select("source", (F.when(F.col("clamped"), F.col("cap")).otherwise(level * F.col("weight")) / F.col("size")).alias("rate"))


def _draw(seed: int) -> Column:
    """A number in [0, 1) from the seed and the doc_id (the text where that is null)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, max_epochs: float = MAX_EPOCHS, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> DataFrame:
    """The documents repeated to the target weights: all columns, and `copy` from 1 on (in place of a column of that name).

    A document is taken floor(rate) times, and once more if its seeded draw is below the rest; the same input and seed give
    the same rows. A null source is a source of its own. Sources of weight 0, or without any
    characters, go; what a budget has beyond max_epochs of everything isn't spent. Equal doc_ids draw alike. An empty table gives no rows.
    Two scans, the first without texts; the documents aren't shuffled.
    """
    r = rates(docs, weights, default, max_epochs, budget_share).select(F.col("source").alias("__moraine_source"), F.col("rate").alias("__moraine_rate"))
    if r.count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    joined = docs.join(r, docs["source"].cast("string").eqNullSafe(F.col("__moraine_source")))
    copies = (F.floor("__moraine_rate") + F.when(_draw(seed) < F.col("__moraine_rate") - F.floor("__moraine_rate"), 1).otherwise(0)).cast("int")
    return joined.withColumn("__moraine_n", copies).where("__moraine_n > 0").select(*(f"`{c}`" for c in docs.columns if c != "copy"), F.explode(F.sequence(F.lit(1), F.col("__moraine_n"))).alias("copy"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "lang", "source", "n_chars", "copy")


def _case() -> str:
    return "CASE source " + " ".join(f"WHEN '{k}' THEN {v:.6f}::DOUBLE" for k, v in WEIGHTS.items()) + f" ELSE {DEFAULT_WEIGHT}::DOUBLE END"


def mix_sql(table: str = "documents") -> str:
    return f"""
WITH sizes AS (SELECT source, sum(coalesce(n_chars, length(text), 0)::DOUBLE) AS size FROM {table} GROUP BY source),
s AS (SELECT *, {_case()} AS weight, size * {MAX_EPOCHS}::DOUBLE AS cap FROM sizes WHERE size > 0),
b AS (SELECT *, sum(size) OVER () * {BUDGET_SHARE}::DOUBLE AS budget,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
        sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_from FROM s WHERE weight > 0),
c AS (SELECT *, cap / weight * weights_from <= budget - caps_before AS clamped FROM b),
r AS (SELECT source, (CASE WHEN clamped THEN cap ELSE weight * (budget - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER (), 0) END) / size AS rate FROM c),
d AS (SELECT t.*, rate, ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS draw FROM {table} t JOIN r ON t.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) + 1)) AS INTEGER) AS copy FROM d
"""


QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {"op4_mixing": mix_sql()}
