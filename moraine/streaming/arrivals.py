"""Archives as they arrive in a folder, listed and checked by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas as S
from ..errors import kind_of
from ..sources import layout as L

_ROWS = T.StructType([*S.LIST_ITEMS.fields, T.StructField("file_size", T.LongType()), T.StructField("error_kind", T.StringType()), T.StructField("error_message", T.StringType())])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_ROWS)
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name = path.rsplit("/", 1)[-1]
            try:
                region = L.Region(content.as_buffer().to_pybytes())
                header = L.read_header(region)
                hashes, blocks = L.read_tables(region, header)
                slot = L.find_slot(hashes, len(blocks), L.LISTFILE)
                text = L.decode(region, header, blocks[int(hashes[slot]["block_index"])], L.LISTFILE).decode(errors="replace") if slot is not None else ""
                names = [n.strip() for n in text.replace("\r", "\n").split("\n") if n.strip()] + [L.LISTFILE]
                known = {int(hashes[s]["block_index"]): n for n, s in zip(names, L.find_slots(hashes, len(blocks), names), strict=True) if s is not None}
                for i in np.flatnonzero(hashes["block_index"] < min(S.DELETED, len(blocks))).tolist():
                    _, _, locale, platform, _, b = hashes[i].tolist()
                    rows.append((name, i, b, known.get(b), locale, platform, int(blocks[b]["flags"]), int(blocks[b]["file_size"]), None, None))
            except Exception as e:
                rows.append((name, *[None] * 7, kind_of(e), str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the entries of archives that arrive as *.mpq files: the listing with sizes, an archive that can't be read as one row with its error.

    An archive is taken once, whole (files beyond 2 GiB can't come this way); without state, so any sink and output mode will do.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.mpq").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return files.schema(schema).load(folder).select("path", "content").mapInArrow(_list, _ROWS)


def totals(entries: DataFrame) -> DataFrame:
    """(archive, files, bytes) of a stream of entries, kept up to date."""
    return entries.where("error_kind is null").groupBy("archive").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
