"""Moving packed NumPy arrays between Spark tasks: one row is one block for one target partition."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bounded_batches  # noqa: F401

_OWN: list[str] = []


def _murmur3(key: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of an int column (public Murmur3 x86_32 over one word)."""
    u = np.uint32
    rot = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    k = rot(key.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = rot(u(seed) ^ k, 13) * u(5) + u(0xE6546B64)
    h ^= u(4)
    h ^= h >> u(16)
    h *= u(0x85EBCA6B)
    h ^= h >> u(13)
    h *= u(0xC2B2AE35)
    return (h ^ (h >> u(16))).astype(np.int32)


def partition_keys(n: int) -> np.ndarray:
    """For each of n partitions an int that `repartition(n, key)` sends there, so that blocks spread evenly."""
    found = np.full(n, -1, dtype=np.int64)
    at, step = 0, max(1024, 4 * n)
    while (found < 0).any():
        keys = np.arange(at, at + step)
        target = np.mod(_murmur3(keys).astype(np.int64), n)
        first, where = np.unique(target, return_index=True)
        first, where = first[found[first] < 0], where[found[first] < 0]
        found[first] = keys[where]
        at += step
    return found.astype(np.int32)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width; everything that is spread by hash uses it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def target(hashes: np.ndarray, n: int) -> np.ndarray:
    """Partition of a 64-bit hash, by its upper bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 as differences in byte planes: the upper planes are zero and compress away."""
    if len(values) == 0:
        return b""
    delta = values.copy()
    delta[1:] -= values[:-1]
    return delta.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def workspace(spark: SparkSession) -> str:
    """A fresh folder that all executors share, under the cluster's spark.checkpoint.dir.

    A setting of our own is made only where the session has none (a local session, as in tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='moraine-')}")
        base = _OWN[0]
    return f"{base.rstrip('/')}/moraine-{uuid.uuid4().hex}"


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it back. The shuffle files of the job go with its end, not when the driver
    happens to collect its garbage; the setting for that is the session's own again afterwards."""
    spark = df.sparkSession
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.select("*").write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate tables that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids (one long column, written already); a null doc_id stays.

    Up to BROADCAST_IDS ids, which are counted first, go to every task, so that no text moves; more are joined by shuffles.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("__moraine_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == F.col("__moraine_id"), "left_anti").select(*(f"`{c}`" for c in docs.columns))
