"""Best-fit packing of token pieces into sequences of a fixed length, by hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first, a block of bounded size at a time. Bins that are nearly full
are sequences at once. The others become items: they are dealt into nodes of bounded size and packed best-fit into one
another, full ones are emitted, and the rest goes through the next, smaller round, up to one node. No bin is closed
while others could still be put into it, and no task grows with the input.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.functions.batches import giving_back
from siteferry.llm.tokens import CACHE_BYTES, END_ID, token_ids
from siteferry.session import cut_lineage

CAPACITY = 2048
SLACK = 16

# Bins that one task merges, and bytes of pieces that one packs at once.
NODE_BINS = 32_768
BLOCK_BYTES = 32 << 20

# A round that leaves all but this share of the bins as they were is the last but one.
LEAST_GAIN = 0.002

_PIECES = (
    "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, bin_offset bigint, "
    "bin_fill bigint, ids array<int>"
)
_BINS = "bin bigint, head bigint, base bigint, fill bigint, final boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item, its offset there, and the fill of each bin.

    Open bins are kept by their free space, with one bit for each space that some bin has; the lowest set bit at or
    above an item's length is the tightest bin that takes it.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    fills: list[int] = []
    by_space: dict[int, list[int]] = {}
    spaces = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            stack = by_space[space]
            chosen = stack.pop()
            if not stack:
                spaces ^= 1 << space
        else:
            chosen, space = len(fills), capacity
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += length
        if space > length:
            left = space - length
            stack = by_space.setdefault(left, [])
            if not stack:
                spaces |= 1 << left
            stack.append(chosen)
    return bins, offsets, np.array(fills, dtype=np.int64)


def pack(
    documents: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    slack: int = SLACK,
    node_bins: int = NODE_BINS,
    block_bytes: int = BLOCK_BYTES,
    with_ids: bool = False,
    cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with `with_ids` the ids.

    A document is its token ids and the end id; a null or empty text is the end id alone. Only a document longer than
    `capacity` is cut, into pieces of `capacity`; the last may be shorter. Repeated rows are packed each for
    itself; null identifiers stay null. An empty table gives no rows. Other columns are not read. A worker's cache of
    token ids holds `cache_bytes`: with less the same rows take longer.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def packed(rows: list[tuple], doc_type: pa.DataType, first: int) -> Iterator[pa.RecordBatch]:
        lengths = np.array([row[3] for row in rows], dtype=np.int64)
        bins, offsets, fills = best_fit(lengths, capacity)
        step = 20_000
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            docs, pieces, starts, _, sums, ids = zip(*rows[part])
            own = [None if x is None else np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, type=doc_type),
                    pa.array(pieces, type=pa.int32()),
                    pa.array(starts, type=pa.int64()),
                    pa.array(lengths[part]),
                    pa.array(sums, type=pa.int64()),
                    pa.array(bins[part] + first),
                    pa.array(offsets[part]),
                    pa.array(fills[bins[part]]),
                    pa.array(own, type=pa.list_(pa.int32())),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "bin_fill", "ids"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer, cache_bytes)
        end = np.array([END_ID], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held, doc_type = 0, None
        try:
            for batch in batches:
                texts, doc_type = batch.column("text"), batch.schema.field("doc_id").type
                for at, doc in enumerate(batch.column("doc_id").to_pylist()):
                    data = encode(texts[at].as_py() or "") + end
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                        held += 200 + len(part) * with_ids
                    if held > block_bytes:
                        yield from packed(rows, doc_type, first)
                        first, rows, held = first + len(rows), [], 0
            if rows:
                yield from packed(rows, doc_type, first)
        finally:
            encode.forget()

    # Written once: the tree is built from it and its rows are the result.
    local = cut_lineage(source.mapInArrow(giving_back(cut), _PIECES.format(id=kind)))
    full = F.col("bin_fill") >= capacity - slack
    bins = local.filter(~full & (F.col("bin_offset") == 0)).select(
        "bin", F.col("bin").alias("head"), F.lit(0).cast("bigint").alias("base"), F.col("bin_fill").alias("fill")
    )
    merged = _merge_bins(bins, capacity, slack, node_bins)
    done = local.filter(full).withColumn("sequence_id", F.col("bin")).withColumn("offset", F.col("bin_offset"))
    rest = local.filter(~full).join(merged, "bin")
    rest = rest.withColumn("sequence_id", F.col("head")).withColumn("offset", F.col("base") + F.col("bin_offset"))
    return done.select(columns).unionByName(rest.select(columns))


def _merge_bins(bins: DataFrame, capacity: int, slack: int, node_bins: int) -> DataFrame:
    """(bin, head, base): the sequence that each underfull bin ends in, and where it starts there.

    Each round deals the bins anew into nodes, so bins that fit one another meet wherever they were made. Rounds end
    with the one that needs a single node, or when a round leaves nearly all bins as they were: then what is left fits
    nothing that is left.
    """
    bins = cut_lineage(bins)
    finished, number, last = [], 0, False
    count = bins.select("head").distinct().count()
    while count:
        nodes = -(-count // node_bins)
        dealt = bins.withColumn("node", F.pmod(F.xxhash64("head", F.lit(number)), F.lit(nodes)))
        packed = cut_lineage(dealt.groupBy("node").applyInPandas(_merger(capacity, slack, last or nodes == 1), _BINS))
        finished.append(packed.filter("final").select("bin", "head", "base"))
        bins, before, number = packed.filter("not final").drop("final"), count, number + 1
        count = bins.select("head").distinct().count()
        # one more round packs the rest for good
        last = count > (1 - LEAST_GAIN) * before
    return reduce(DataFrame.unionByName, finished) if finished else bins.select("bin", "head", "base")


def _merger(capacity: int, slack: int, last: bool):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        heads = rows.drop_duplicates("head").sort_values("head")
        chosen, offsets, fills = best_fit(heads["fill"].to_numpy(), capacity)
        names = heads["head"].to_numpy()
        owner = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(owner, chosen, names)
        final = (fills >= capacity - slack) | last
        at = np.searchsorted(names, rows["head"].to_numpy())
        return pd.DataFrame(
            {
                "bin": rows["bin"].to_numpy(),
                "head": owner[chosen[at]],
                "base": rows["base"].to_numpy() + offsets[at],
                "fill": fills[chosen[at]],
                "final": final[chosen[at]],
            }
        )

    return merge


register_pickle_by_value(sys.modules[__name__])
