"""Where jobs put files that all executors must see, and how many rows they move at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the session's spark.checkpoint.dir; below a temporary one of this machine only in a local session without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='moraine-')}")
        base = _OWN[0]
    return f"{base.rstrip('/')}/archives-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Lowers the rows of an Arrow batch where the session has Spark's default of 10,000: with whole texts in them, those take tens of
    megabytes in the JVM and again in each worker. A number that the session sets itself stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
