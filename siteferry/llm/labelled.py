"""Bounded samples of labelled rows, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_FOLD, FOLDS = 2, 4


def held_out(doc_id: Column) -> Column:
    """Whether a row takes no part in learning: the CRC-32 of its identifier as text leaves 2 when divided by 4."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT_FOLD
    return F.coalesce(fold, F.lit(False))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[str, int]]:
    """At most `max_rows` (text, label) of each class that are not held out, in the order of a hash of the identifier.

    Of several labels of one identifier the largest counts; labels other than 0 and 1 and null identifiers do not.
    """
    known = _known(labels, label)
    order = F.xxhash64("_id")
    chosen = [known.filter(F.col("_label") == c).orderBy(order, "_id").limit(max_rows) for c in (0, 1)]
    # Both limits bound what is broadcast and what comes to the driver.
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")
    texts = found.groupBy("_id", "_label").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text")).collect()
    texts.sort(key=lambda row: row["_id"])
    return [(row["_text"], row["_label"]) for row in texts]


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many identifiers, not held out, have label 0 and label 1; the sample above may hold them in other shares."""
    rows = {row["_label"]: row["count"] for row in _known(labels, label).groupBy("_label").count().collect()}
    return rows.get(0, 0), rows.get(1, 0)


def _known(labels: DataFrame, label: str) -> DataFrame:
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    return known.groupBy("_id").agg(F.max("_label").alias("_label"))
