"""File inventories: path, size and digest of every file below a folder, whatever its size."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds the pieces of each file, which lie in order, to a running digest; no file is ever held."""
    now = running = None
    seen = 0

    def done() -> pa.RecordBatch:
        # the separator behind the last piece is there if the size says so
        if seen < now[1]:
            running.update(b"\n")
        values = [[now[0]], [now[1]], [running.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["path", "bytes", "sha256"])

    for batch in batches:
        for path, size, piece in zip(*[c.to_pylist() for c in batch.columns]):
            if now != (path, size):
                if now is not None:
                    yield done()
                now, running, seen = (path, size), hashlib.sha256(), 0
            else:
                running.update(b"\n")
                seen += 1
            running.update(piece)
            seen += len(piece)
    if now is not None:
        yield done()


def read_inventory(spark: SparkSession, path) -> DataFrame:
    """(path, bytes, sha256), the digest in lower-case hex. Spark lists no files of zero bytes.

    A file is read in pieces and digested as they come, so its size has no limit but that of one stretch without a
    newline byte, which must stay below two gigabytes. A file of one block is digested where it is read; the blocks of a
    larger one are brought to one task in their order, since a digest has to see all bytes one after another.
    """
    pieces = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("bytes"),
            F.col("_metadata.file_block_start").alias("start"),
            (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("split"),
            F.monotonically_increasing_id().alias("number"),
            F.col("value").cast("binary").alias("value"),
        )
    )
    whole = pieces.filter(~F.col("split"))
    parts = pieces.filter("split").repartition("path").sortWithinPartitions("path", "start", "number")
    made = "path string, bytes bigint, sha256 string"
    found = whole.select("path", "bytes", "value").mapInArrow(_digests, made)
    return found.unionByName(parts.select("path", "bytes", "value").mapInArrow(_digests, made))


register_pickle_by_value(sys.modules[__name__])
