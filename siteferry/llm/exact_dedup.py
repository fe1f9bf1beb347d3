"""Exact dedup by a sort of the contents.

Texts are normalised, dealt into ranges between sampled splitters, and sorted, so equal texts lie side by side; the
comparison of each row with its neighbour, on the whole text, starts a new run wherever they differ. The splitters
are made of the first characters and a hash of the text, so the sample of them stays small however long the texts
are. A text that very many rows share would fill one range, so a hash of the identifier is part of the sort key too: such a
text makes up to `salts` runs, spread over as many ranges. Runs are then put together by the digest of their text,
on rows that no longer carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteferry.session import cut_lineage

# White space that counts as one space.
SPACE = r"[\x20\x09-\x0D]+"

DEFAULT_SALTS = 64
HEAD_CHARS = 32


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = DEFAULT_SALTS
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal, and so are texts of white space alone to one another (they become one space).
    Of equal texts the smallest identifier stays. Of rows that repeat that identifier exactly one is kept. A null
    identifier is larger than any other; it stays, as keep_id null, only where all of a group are null. An
    empty table gives no rows; other columns are not read.
    """
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
    rows = documents.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text"), salt.alias("_salt"))
    split = ["_head", "_hash", "_salt"]
    keyed = rows.withColumn("_head", F.substring("_text", 1, HEAD_CHARS)).withColumn("_hash", F.xxhash64("_text"))
    # The sort is by all of these; the ranges satisfy it, so the texts are shuffled once.
    run = W.partitionBy(*split, "_text").orderBy(F.col("doc_id").asc_nulls_last())
    compared = keyed.repartitionByRange(*split).select(
        "doc_id",
        "_salt",
        F.sha2("_text", 256).alias("text_sha256"),
        F.row_number().over(run).alias("_place"),
    )
    # Written once: the sort of the texts would otherwise be done for the runs and again for the rows.
    placed = cut_lineage(compared)
    runs = placed.groupBy("text_sha256", "_salt").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    text = W.partitionBy("text_sha256")  # at most `salts` rows
    first_run = F.first("_salt").over(text.orderBy(F.col("_first").asc_nulls_last(), "_salt"))
    groups = runs.select(
        "text_sha256",
        "_salt",
        F.min("_first").over(text).alias("keep_id"),
        F.sum("_rows").over(text).alias("group_size"),
        (F.col("_salt") == first_run).alias("_holds_first"),
    )
    joined = placed.join(groups, ["text_sha256", "_salt"])
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("_holds_first") & (F.col("_place") == 1)).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents` that stay, with all their columns.

    Rows are found again by identifier, so of several rows with one identifier and one text all or none stay.
    """
    gone = exact_duplicates(documents, id_col, text_col).filter("not kept and doc_id <> keep_id")
    return documents.join(gone.select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
