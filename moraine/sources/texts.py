"""Tables out of text files that describe an API: declarations in C headers, public functions in source trees, and a checklist in JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DECLARATION = r"^\s*([A-Za-z_][\w\s*]*?)\s+(?:WINAPI\s+)?((?:%s)\w+)\s*\(([^)]*)\)\s*;"


def c_declarations(spark: SparkSession, path: str, prefixes: tuple[str, ...]) -> DataFrame:
    """(file, name, return_type, args) of the one-line function declarations whose names begin with a prefix; blanks are single."""
    pattern = _DECLARATION % "|".join(prefixes)
    rows = _sources(spark, path).select("file", F.explode(F.split("content", "\r?\n")).alias("line")).where(F.col("line").rlike(pattern))
    part = lambda i: F.trim(F.regexp_replace(F.regexp_extract("line", pattern, i), r"\s+", " "))
    return rows.select("file", part(2).alias("name"), part(1).alias("return_type"), part(3).alias("args"))


def _sources(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        files = files.option("pathGlobFilter", f"*{suffix}")
    return files.load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))


def public_functions(spark: SparkSession, path: str, type_name: str, suffix: str = ".rs") -> DataFrame:
    """(name) of the public functions below a folder, distinct; those inside `impl <type_name> {` have the type in front.

    Which block a line is in depends on the lines before it: a pass over each file, files in parallel.
    """
    import re

    head, function = re.compile(rf"\s*impl\s+{re.escape(type_name)}\s*\{{"), re.compile(r"\s*pub\s+fn\s+(\w+)\s*\(")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = []
            for text in batch["content"]:
                inside = False
                for line in text.splitlines():
                    if head.match(line):
                        inside = True
                    elif line.strip() == "}" and inside and not line.startswith((" ", "\t")):
                        inside = False
                    elif m := function.match(line):
                        names.append(f"{type_name}::{m[1]}" if inside else m[1])
            yield pd.DataFrame({"name": names}, dtype="object")

    return _sources(spark, path, suffix).mapInPandas(scan, "name string").distinct()


def checklist(spark: SparkSession, path: str) -> DataFrame:
    """The features of a JSON checklist (`features`: id, area, description, status, evidence) as rows."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("features").alias("f")).select("f.*")


def coverage(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """(name, status) of names wanted and there: `covered`, `missing`, or `extra`."""
    w, t = wanted.select("name").distinct().withColumn("w", F.lit(True)), there.select("name").distinct().withColumn("t", F.lit(True))
    return w.join(t, "name", "full_outer").select("name", F.when(F.col("t").isNull(), "missing").when(F.col("w").isNull(), "extra").otherwise("covered").alias("status"))
