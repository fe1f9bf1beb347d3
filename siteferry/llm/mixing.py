"""Mixing sources to target weights by Pfair scheduling.

The texts of a source, in a fixed order, make a stream that is cut into blocks of `block_chars` characters. With
integer weights that sum to W, block k of a source of weight w is released at slot floor(k W / w) and due by slot
ceil((k + 1) W / w). Earliest deadline first among the released blocks serves every block in time, so at any slot
no source is a whole block ahead of its share or behind it. That schedule repeats every W slots, so one
period of at most `resolution` slots, worked out once, places block k of any source by arithmetic, however many
blocks there are. When a source ends, the others go on by their weights among themselves, from a new period.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteferry.session import cut_lineage

BLOCK_CHARS = 65_536
RESOLUTION = 1_000
BUCKETS = 1_024

_PHASES = "source string, phases array<struct<first_block: bigint, last_block: bigint, start: bigint, weight: bigint, total: bigint, slots: array<int>>>"


def period(weights: list[int]) -> list[list[int]]:
    """The slots of each source in one period of sum(weights) slots, by earliest deadline first among released blocks.

    Of equal deadlines the source listed first goes first. Weights are positive integers.
    """
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, s) for s in range(len(weights))]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(slot)
        if len(slots[s]) < weights[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // weights[s], s))
    return slots


def whole_weights(weights: Mapping[str | None, float], resolution: int = RESOLUTION) -> dict[str | None, int]:
    """Integers of the same proportions that sum to `resolution` (a little more if some would be 0 and are made 1)."""
    if len(weights) > resolution:
        raise ValueError(f"{len(weights)} sources need a resolution of at least as many slots")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("a weight must be positive")
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * resolution / total for s, w in weights.items()}
    whole = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: max(0, resolution - sum(whole.values()))]:
        whole[s] += 1
    return whole


def _phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple]:
    """Per source its phases: which blocks it gives from which slot on, by what period."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    found: dict[str, list[tuple]] = {s: [] for s in left}
    start = 0
    while left:
        names = sorted(left)
        total = sum(weights[s] for s in names)
        slots = dict(zip(names, period([weights[s] for s in names])))
        # The slot after the last block of the source that ends first.
        ends = {s: (left[s] - 1) // weights[s] * total + slots[s][(left[s] - 1) % weights[s]] + 1 for s in names}
        length = min(ends.values())
        for s in names:
            given = length // total * weights[s] + sum(x < length % total for x in slots[s])
            if given:
                found[s].append((done[s], done[s] + given - 1, start, weights[s], total, slots[s]))
            done[s] += given
            left[s] -= given
        left = {s: n for s, n in left.items() if n > 0}
        start += length
    return list(found.items())


def mix(
    documents: DataFrame,
    weights: Mapping[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    resolution: int = RESOLUTION,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document: doc_id, source, n_chars, block, release, deadline, slot, position.

    Every document has a place: sorting by (slot, position) gives the mixed stream. A document belongs to the block in which
    its first character lies; blocks that a longer one covers are its own. `position` orders the documents of a
    block and is the number of characters of the source before it. release and deadline hold within the phase of the
    schedule, counted from its first slot, as `slot` is counted over all. Without `weights` a source weighs the
    square root of its characters, which lifts small sources; with them, a source that is not named is an error.
    Null sources are one source, written as the empty text. Null texts have no characters but keep a place. Repeated
    rows have places of their own, next to each other. An empty table gives no rows. Other columns are not read.
    """
    bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_chars"),
        bucket.alias("_bucket"),
    )
    # Sums over a source go through hashed buckets: each is summed on its own, and only their totals meet.
    slim = cut_lineage(rows)
    totals = slim.groupBy("source", "_bucket").agg(F.sum("n_chars").alias("_chars"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(totals.withColumn("_before", F.coalesce(F.sum("_chars").over(earlier), F.lit(0))))
    sums = offsets.groupBy("source").agg(F.sum("_chars").alias("chars")).limit(resolution + 1).collect()
    if len(sums) > resolution:
        raise ValueError(f"more than {resolution} sources need a larger resolution")
    chars = {row["source"]: row["chars"] for row in sums}
    targets = {s: max(n, 1) ** 0.5 for s, n in chars.items()} if weights is None else {s: weights[s] for s in chars}
    blocks = {s: max(1, -(-n // block_chars)) for s, n in chars.items()}
    table = _phases(blocks, whole_weights(targets, resolution)) if chars else []

    within = W.partitionBy("source", "_bucket").orderBy(F.col("doc_id").asc_nulls_last(), "n_chars")
    running = F.sum("n_chars").over(within.rowsBetween(W.unboundedPreceding, -1))
    placed = (
        slim.withColumn("_own", F.coalesce(running, F.lit(0)))
        .join(offsets.select("source", "_bucket", "_before"), ["source", "_bucket"])
        .withColumn("position", F.col("_before") + F.col("_own"))
    )
    # A text without characters at the very end of a source belongs to its last block.
    last = F.element_at("phases", -1)["last_block"]
    # At most `resolution` rows, with at most as many slots in all for each phase.
    schedule = F.broadcast(documents.sparkSession.createDataFrame(table, _PHASES))
    cut = placed.join(schedule, "source").withColumn("block", F.least(F.expr(f"position div {int(block_chars)}"), last))
    of_block = F.filter("phases", lambda p: (p["first_block"] <= F.col("block")) & (F.col("block") <= p["last_block"]))
    timed = cut.withColumn("_p", F.element_at(of_block, 1)).withColumn("_k", F.col("block") - F.col("_p.first_block"))
    return timed.select(
        "doc_id",
        "source",
        "n_chars",
        "block",
        F.expr("(_k * _p.total) div _p.weight").alias("release"),
        F.expr("((_k + 1) * _p.total + _p.weight - 1) div _p.weight").alias("deadline"),
        F.expr("_p.start + (_k div _p.weight) * _p.total + _p.slots[cast(_k % _p.weight as int)]").alias("slot"),
        "position",
    )


def mixed_stream(documents: DataFrame, **options) -> DataFrame:
    """The rows of `documents`, all of them and with all their columns, in the order of the mixed stream.

    The order is that of the rows in the partitions, and so of the files once written: ranges of the schedule
    follow one another, and any prefix of the files holds the sources by their weights as long as they last.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    whole = documents.select(F.struct("*").alias("row"))
    row = whole.select(
        "row",
        F.col("row")[id_col].alias("row_id"),
        F.coalesce(F.col("row")[source_col].cast("string"), F.lit("")).alias("row_source"),
        F.coalesce(F.length(F.col("row")[text_col]), F.lit(0)).cast("bigint").alias("row_chars"),
    )
    # Rows that repeat identifier, source and length share the first of their places.
    places = mix(documents, **options).groupBy("doc_id", "source", "n_chars").agg(F.min(F.struct("slot", "position")).alias("at"))
    same = (
        F.col("row_id").eqNullSafe(F.col("doc_id"))
        & (F.col("row_source") == F.col("source"))
        & (F.col("row_chars") == F.col("n_chars"))
    )
    placed = row.join(places, same, "left").select("row", "at.slot", "at.position")
    ordered = placed.repartitionByRange("slot", "position").sortWithinPartitions("slot", "position")
    return ordered.select(*[F.col("row")[c].alias(c) for c in documents.columns])
