"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document is its set of distinct word shingles. Documents of equal sets are one item from the start. Each item has a
signature of `coordinates` minima and is posted under each (coordinate, value) pair; only pairs that another item
shares matter. Two items match if they agree in at least `matches` coordinates, which an item with fewer shared pairs
cannot; for the others it is enough to look at their rarest `shared - matches + 1` pairs (the prefix), since any
match meets one of them, and the long posting lists behind it are skipped. Items that meet in a prefix list
form one cluster. Within it, collisions are counted block against block, and pairs at the threshold or above are
confirmed on full shingle sets in the same place. A block pair returns only its components, a row for each member, never
the pairs, so a group of very many near copies costs blocks, not rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteferry.functions.batches import giving_back
from siteferry.functions.scale import BROADCAST_ROWS
from siteferry.llm.components import connected_components
from siteferry.session import cut_lineage

# A pair at a similarity of 0.8 agrees in 51 of 64 coordinates on average; it has fewer than 36 four times in a million.
COORDINATES = 64
MATCHES = 36
BLOCK_ITEMS = 512
BLOCK_SHINGLES = 1 << 20

# Fixed odd multipliers of the hashes, and the bytes handled at a time.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CHUNK_BYTES = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the word shingles of whole texts, many texts at a time.

    A-Z are lower-cased; a word is a run of bytes other than ASCII white space. A word's hash is a polynomial of its
    bytes, had from running sums; a shingle's hash combines those of its words.
    """

    def __init__(self, words: int):
        self.words = words
        self.seeds = _mixed(np.arange(1, 257, dtype=np.uint64))
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.powers = self.inverses = np.ones(0, dtype=np.uint64)
        self.steps = _mixed(np.arange(1001, 1001 + words, dtype=np.uint64)) | np.uint64(1)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            full = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, dtype=np.uint64))))
            self.powers, self.inverses = full(_BASE), full(inverse)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its distinct shingle hashes, sorted; none without words."""
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        self._grow(len(data))
        low = self.lower[data]
        blank = self.space[low]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]  # each word begins at `first` and ends before `last`
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.seeds[low] * self.powers[: len(low)], dtype=np.uint64)))
        word = _mixed((sums[last] - sums[first]) * self.inverses[first] + (last - first).astype(np.uint64))
        owner = np.searchsorted(ends, first, side="right")
        counts = np.bincount(owner, minlength=len(texts))
        starts = np.concatenate(([0], np.cumsum(counts)))
        found = []
        for i in range(len(texts)):
            own = word[starts[i] : starts[i + 1]]
            if not len(own):
                found.append(own)
                continue
            width = min(self.words, len(own))
            total = np.full(len(own) - width + 1, np.uint64(width))
            for j in range(width):
                total += own[j : len(own) - width + 1 + j] * self.steps[j]
            found.append(np.unique(_mixed(total)))
        return found


def _in_chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold about a mebibyte of text each (or one text), with the texts as bytes."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).fill_null(b"")
        at, held, size = 0, [], 0
        for i, text in enumerate(texts):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= _CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(at, len(held)), held
                at, held, size = i + 1, [], 0


def _signer(coordinates: int):
    """A function from the sorted shingles of many texts to their signatures, one row of 32-bit values each."""
    factors = _mixed(np.arange(5001, 5001 + coordinates, dtype=np.uint64)) | np.uint64(1)

    def sign(sets: list[np.ndarray]) -> np.ndarray:
        filled = [s for s in sets if len(s)]
        if not filled:
            return np.zeros((0, coordinates), dtype=np.uint32)
        every = np.concatenate(filled)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in filled])[:-1]))
        out = np.empty((len(filled), coordinates), dtype=np.uint32)
        for j, factor in enumerate(factors):
            high = ((every * factor) >> np.uint64(32)).astype(np.uint32)
            out[:, j] = np.minimum.reduceat(high, starts)
        return out

    return sign


def signatures(source: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, item (a digest of the shingle set; null without shingles) and the signature, from doc_id, text."""
    kind = dict(source.dtypes)["doc_id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, minima = Shingler(words), _signer(coordinates)
        for part, texts in _in_chunks(batches, "text"):
            sets = shingle(texts)
            rows = iter(minima(sets).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], type=pa.binary()),
                    pa.array([next(rows) if len(s) else None for s in sets], type=pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_shingles", "item", "signature"],
            )

    return source.mapInArrow(giving_back(sign), f"doc_id {kind}, n_shingles bigint, item binary, signature array<int>")


def _meetings(items: DataFrame, matches: int) -> DataFrame:
    """(number, hub) for items that can match another: the smallest item with the same pair in its prefix."""
    posted = items.select("number", F.posexplode("signature").alias("place", "value")).select(
        "number", (F.shiftleft(F.col("place").cast("bigint"), 32) + F.col("value")).alias("pair")
    )
    lists = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = posted.join(lists, "pair")
    own = W.partitionBy("number")  # at most one row for each coordinate
    rank, count = F.row_number().over(own.orderBy("n", "pair")), F.count(F.lit(1)).over(own)
    ranked = shared.select("number", "pair", rank.alias("rank"), count.alias("shared"))
    prefix = cut_lineage(ranked.filter(F.col("rank") <= F.col("shared") - matches + 1).select("number", "pair"))
    # Two items that match meet in the prefix of both, so the lists of prefixes hold them together.
    hubs = prefix.groupBy("pair").agg(F.min("number").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return prefix.join(hubs, "pair").select("number", "hub").distinct()


def _block_linker(matches: int, numerator: int, denominator: int):
    """The components within one pair of blocks of a cluster: rows (a, b) of each member and the smallest one."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("number").sort_values("number")
        items, block = rows["number"].tolist(), rows["block"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        distinct, dense = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(dense, np.cumsum(sizes)[:-1])
        marks = np.stack([np.frombuffer(s, dtype=np.uint32) for s in rows["marks"]])
        across = rows["low"].iloc[0] != rows["high"].iloc[0]
        left = np.flatnonzero(block == rows["low"].iloc[0])
        right = np.flatnonzero(block == rows["high"].iloc[0])
        component = np.arange(len(items))
        member = np.zeros(len(distinct), dtype=bool)
        for i in left.tolist():
            near = right if across else right[right > i]
            near = near[component[near] != component[i]]
            small, large = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
            near = near[small * denominator >= large * numerator]
            near = near[(marks[near] == marks[i]).sum(axis=1) >= matches]
            if not len(near):
                continue
            member[sets[i]] = True
            starts = np.concatenate(([0], np.cumsum(sizes[near])[:-1]))
            both = np.add.reduceat(member[np.concatenate([sets[j] for j in near])].astype(np.int64), starts)
            member[sets[i]] = False
            for j in near[denominator * both >= numerator * (sizes[i] + sizes[near] - both)].tolist():
                if component[j] != component[i]:
                    component[component == component[j]] = component[i]
        # Items are sorted, so the first of a component is its smallest; stars settle in fewer rounds than trees.
        _, first, label = np.unique(component, return_index=True, return_inverse=True)
        found = [(items[first[c]], item) for c, item in zip(label, items) if items[first[c]] != item]
        return pd.DataFrame(found, columns=["a", "b"])

    return link


def _links(
    documents: DataFrame,
    heads: DataFrame,
    clusters: DataFrame,
    words: int,
    coordinates: int,
    matches: int,
    numerator: int,
    denominator: int,
    block_items: int,
    block_shingles: int,
) -> DataFrame:
    """Pairs (a, b) of items joined by confirmed links, enough to span every component; documents have doc_id and text."""
    members = cut_lineage(heads.join(clusters, "number").select("number", "item", "cluster", "first_id", "n_shingles"))
    wanted = members.select(F.col("first_id").alias("_wanted")).distinct()
    if members.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # an item of which no row has an identifier is looked up among the rows without one
    texts = documents.join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi").select("text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, minima = Shingler(words), _signer(coordinates)
        for _, held in _in_chunks(batches, "text"):
            sets = [s for s in shingle(held) if len(s)]
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(r) for r in raw], type=pa.binary()),
                    pa.array(raw, type=pa.binary()),
                    pa.array([m.tobytes() for m in minima(sets)], type=pa.binary()),
                ],
                names=["item", "shingles", "marks"],
            )

    sets = texts.mapInArrow(giving_back(shingles), "item binary, shingles binary, marks binary")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_n") / block_items), F.ceil(F.col("_s") / block_shingles)).cast("int")
    block = F.pmod(F.xxhash64("number"), F.col("_blocks")).cast("int")
    placed = members.join(sizes.filter("_n > 1").select("cluster", blocks.alias("_blocks")), "cluster")
    placed = placed.select("number", "item", "cluster", block.alias("block"), "_blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    paired = placed.join(sets, "item").select("*", other.alias("_other"))
    low, high = F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")
    grouped = paired.select("number", "cluster", "block", low, high, "shingles", "marks").groupBy("cluster", "low", "high")
    return grouped.applyInPandas(_block_linker(matches, numerator, denominator), "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    numerator: int = 80,
    denominator: int = 100,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    block_items: int = BLOCK_ITEMS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if denominator * |intersection| >= numerator * |union| of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept says that it is the row's own. A text with fewer
    than `words` words is one shingle; a null or empty one, or one of white space, has none and is linked with nothing.
    Rows that repeat an identifier are kept or not together where their texts are near. A null identifier
    comes after any other; it is the component's only where all are null. An empty table gives no rows. Other
    columns are not read.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(signatures(source, words, coordinates))
    filled = signed.filter("item is not null")
    heads = filled.groupBy("item").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    # Numbers take half the room of digests in all that follows; the written table keeps them as they are.
    heads = cut_lineage(heads.withColumn("number", F.monotonically_increasing_id()))
    clusters = connected_components(_meetings(heads, matches), "number", "hub").select(
        F.col("node").alias("number"), F.col("component").alias("cluster")
    )
    links = _links(
        source, heads, clusters, words, coordinates, matches, numerator, denominator, block_items, block_shingles
    )
    joined = cut_lineage(connected_components(links).select(F.col("node").alias("number"), "component"))
    smallest = heads.join(joined, "number").groupBy("component").agg(F.min("first_id").alias("least_id"))
    classes = joined.join(smallest, "component").select("number", "least_id")
    named = heads.join(classes, "number", "left").select("item", F.coalesce("least_id", "first_id").alias("least_id"))
    # Many rows may share one item; the join is one row to many, so its skewed side can be split.
    placed = signed.select("doc_id", "n_shingles", "item").join(named, "item", "left")
    component = F.when(F.col("item").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `documents` that stay, one document of each component, with all their columns."""
    gone = near_duplicates(documents, id_col, text_col, **options).filter("not kept and doc_id is not null")
    gone = gone.select(F.col("doc_id").alias(id_col)).distinct()
    return documents.join(gone, id_col, "left_anti")


register_pickle_by_value(sys.modules[__name__])
