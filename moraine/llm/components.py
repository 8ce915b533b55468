"""Connected components of an undirected graph, as joins and aggregates with written tables in between."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .exchange import drop, saved, workspace


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that join the same nodes as the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    keep = nodes[label] != nodes
    return nodes[keep], nodes[label][keep]


def _local_forest(batches):
    u, v = [], []
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
    if u and sum(map(len, u)):
        a, b = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge to another.

    edges: two long columns; direction, repeats and self-loops don't matter, rows with a null are
    dropped; no edges give no rows. Alternates the public large-star and small-star steps: every
    round is two shuffles on a node, the number of rounds grows with the logarithm of the longest
    path. Before them each task thins its share of the edges to a spanning forest.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v").mapInArrow(tk.trimmed(_local_forest), "u long, v long")
    folder = workspace(spark)
    e = saved(e, folder, "0")

    def star(df: DataFrame, large: bool) -> DataFrame:
        """Large: joins each node's larger neighbours to its least one; small: its smaller ones and itself."""
        if large:
            df = df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            df = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = df.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = df.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    done, before = 0, None
    while True:
        done += 1
        e = saved(star(star(e, True), False), folder, str(done))
        now = tuple(e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        drop(spark, f"{folder}/{done - 1}")
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
