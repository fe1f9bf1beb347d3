"""Text corpora: file trees read whole, and lines of files of any size."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteferry.functions.scale import BROADCAST_ROWS
from siteferry.session import cut_lineage

# Folders that are not looked into, and the largest file read whole. Larger ones are read as lines.
SKIP_DIRS = ("node_modules", ".git", "vendor", "coverage", "dist", ".wrangler", "typedoc")
MAX_FILE_BYTES = 64 * 1024 * 1024


def list_files(spark: SparkSession, roots: Sequence[str], max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """(path, bytes, status, reason) for every file below the roots; contents are not read.

    Without `max_bytes` no file is skipped for its size, as where the corpus is read with `read_corpus_lines`.
    Spark does not list files of zero bytes, in which there is nothing to find.
    """
    frames = []
    for root in roots:
        try:
            files = _files(spark, root).select("path", F.col("length").alias("bytes"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            frames.append(
                spark.range(1).select(
                    F.lit(root).alias("path"),
                    F.lit(None).cast("bigint").alias("bytes"),
                    F.lit("skipped").alias("status"),
                    F.lit("does not exist").alias("reason"),
                )
            )
            continue
        large = F.col("bytes") > max_bytes if max_bytes is not None else F.lit(False)
        frames.append(
            files.select(
                "*",
                F.when(large, "skipped").otherwise("scanned").alias("status"),
                F.when(large, f"larger than {max_bytes} bytes").alias("reason"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def read_corpus(spark: SparkSession, roots: Sequence[str], max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, text) of every file up to `max_bytes`; the size filter reaches the scan, before contents."""
    found = []
    for root in roots:
        try:
            files = _files(spark, root)
        except AnalysisException as error:  # `list_files` reports a root that is not there
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(files.filter(F.col("length") <= max_bytes).select("path", F.decode("content", "UTF-8").alias("text")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "path string, text string")


def _outside(root: str):
    """Whether a path below the root lies in no folder that is left out."""
    root = root.rstrip("/") or "/"
    return ~F.col("path").rlike(rf"^.*?{re.escape(root)}(?:/[^/]+)*?/(?:{'|'.join(map(re.escape, SKIP_DIRS))})/")


def _files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/") or "/")
    return files.filter(_outside(root))


def read_corpus_lines(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, block, line, text): the lines of all files below the roots, of any size, with their numbers."""
    found = []
    for root in roots:
        try:
            found.append(read_lines(spark, root.rstrip("/") or "/").filter(_outside(root)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    empty = "path string, block bigint, line bigint, text string"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, block, line, text): every line of the files with its 1-based number, in parallel within a file.

    Lines are numbered inside each block of a file; the blocks before it are counted in a first pass whose
    result has one row per block. `block` is the byte at which the line's block begins. Lines of a block lie together,
    in their order.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("_id"),
            F.col("value").alias("text"),
        )
    )
    blocks = lines.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        blocks.select("path", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    line = (F.col("_id") + F.col("_shift") + 1).alias("line")
    if offsets.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(offsets), ["path", "block"]).select("path", "block", line, "text")
    joined = lines.join(offsets, ["path", "block"]).select("path", "block", line, "text")
    return joined.repartition("path", "block").sortWithinPartitions("path", "block", "line")
