"""Byte strings that repeat within or across documents, found by merging Burrows-Wheeler transforms.

Shards of text have their suffixes in order; two or more such orders are merged without sorting the suffixes anew. An
interleave of the shards, at first right for no symbol, is refined in rounds: put in stable order by the symbols that
stand before each suffix, it is right for that many symbols more. Suffixes that agree so far are a block; a block of one
shard alone is left as that shard has it, since its common prefixes are known there. What is still one block at the
depth asked for is a repeated interval. A symbol is `STEP` bytes here, numbered in byte order, so 25 rounds reach 200.

No task could hold the transform of a whole corpus, so suffixes are dealt out to tasks by content. Each string of
`length` bytes has a landmark, the gram in it with the least hash; equal strings have the same landmark at the same
place. The strings of a document that share a landmark are one stretch of text. A landmark that stands once in all
documents ends the search for its stretch; the stretches of all others are told apart by a digest and counted, and the
different stretches around one landmark go to the same task. A landmark with too much text around it is split: strings
are dealt out again by the longer text that they share on its left or right, so every task has a bounded share.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.functions.scale import broadcast_if_small
from siteferry.session import cut_lineage, staging_path

LENGTH = 200
GRAM = 24
STEP = 8

# Strings of a document that are looked at together; their places take 18 bits beside the hash.
_PIECE = 1 << 17
_PLACE_BITS = 18

# Text of one shard, of one landmark and of one task.
SHARD_BYTES = 1 << 18
GROUP_BYTES = 1 << 20
TASK_BYTES = 1 << 21

# Odd multipliers that mix three words of a gram.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _words(data: bytes, dtype: str) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), dtype=dtype, buffer=data, strides=(1,))


def _landmarks(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first string, number of strings, place of the landmark, hash of the landmark) of each stretch, piece by piece."""
    grams = length - GRAM + 1
    for at in range(0, len(data) - length + 1, _PIECE):
        piece = data[at : at + _PIECE + length - 1]
        words = _words(piece, "<u8")
        mixed = words[: len(words) - 16] * _MIX[0]
        mixed ^= words[8 : len(words) - 8] * _MIX[1] + (mixed >> np.uint64(31))
        mixed ^= words[16:] * _MIX[2] + (mixed >> np.uint64(29))
        mixed *= _MIX[3]
        mixed ^= mixed >> np.uint64(32)
        places = np.arange(len(mixed), dtype=np.uint64)
        least = (mixed & ~np.uint64((1 << _PLACE_BITS) - 1)) | places
        span = 1
        while span * 2 <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < grams:
            least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
        mark = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(mark)) + 1])
        size = np.diff(np.append(first, len(mark)))
        yield first + at, size, mark[first] + at, mixed[mark[first]].view(np.int64)


def _mark_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for data in _bytes(batch.column(0)) if len(data) >= length for *_, h in _landmarks(data, length)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["mark"])

    return run


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() for x in column.cast(pa.binary()))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=12).digest()


_STRETCHES = "id bigint, start bigint, size int, offset int, mark bigint, digest binary"


def _stretch_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_numpy(), _bytes(batch.column(1))):
                if len(data) < length:
                    continue
                for first, size, mark, hashed in _landmarks(data, length):
                    ends = first + size + length - 1
                    digests = [_digest(data[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(first), i)), pa.array(first), pa.array(size.astype(np.int32)),
                            pa.array((mark - first).astype(np.int32)), pa.array(hashed), pa.array(digests, pa.binary()),
                        ],
                        names=["id", "start", "size", "offset", "mark", "digest"],
                    )

    return run


_TEXTS = "key bigint, digest binary, size int, offset int, n bigint, data binary"


def _text_rows(length: int):
    """Cuts the chosen stretches out of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(_bytes(batch.column(0)), batch.column(1).to_pylist()):
                cut = [data[w["start"] : w["start"] + w["size"] + length - 1] for w in wanted]
                columns = [[w[c] for w in wanted] for c in ("mark", "digest", "size", "offset", "n")]
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "digest", "size", "offset", "n", "data"])

    return run


class Shards:
    """Texts cut into shards, with the numbered symbols that their transforms and merges are made of."""

    def __init__(self, texts: list[bytes], length: int, shard_bytes: int):
        self.length = length
        joined = b"".join(texts)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        symbols = _words(joined + bytes(STEP), ">u8").astype(np.uint64)
        order = np.argsort(symbols)
        ordered = symbols[order]
        self.symbols = np.empty(len(symbols), dtype=np.int64)
        self.symbols[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        strings = sizes - length + 1
        # the suffixes that begin a string of the asked length, and the text that each lies in
        self.text = np.repeat(np.arange(len(texts)), strings)
        self.suffix = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings) + begins[self.text]
        self.shard = (np.cumsum(sizes) // shard_bytes)[self.text]

    def refine(self, suffixes: np.ndarray, blocks: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Refines an interleave to the full length; the block of each suffix, numbers from 0.

        `blocks` keeps suffixes apart from the start. A block in which all suffixes are of one owner needs no more
        rounds: with an owner for each suffix, that is one suffix alone.
        """
        found = np.full(len(suffixes), -1, dtype=np.int64)
        given = 0
        order = np.argsort(blocks, kind="stable")
        block = blocks[order]
        steps = list(range(self.length - STEP, -1, -STEP))
        # a length that is no multiple of the step ends with symbols that overlap those before
        steps += [0] if steps[-1] else []
        for back in steps:
            symbol = self.symbols[suffixes[order] + back]
            # stable order by symbol; the place in the interleave so far is the lower half of the number
            packed = np.sort((symbol << 32) | np.arange(len(order)))
            moved = packed & 0xFFFFFFFF
            symbol, block, order = packed >> 32, block[moved], order[moved]
            begins = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])]))
            sizes = np.diff(np.append(begins, len(order)))
            owner = owners[order]
            settled = np.minimum.reduceat(owner, begins) == np.maximum.reduceat(owner, begins)
            numbers = np.repeat(np.arange(len(begins)), sizes)
            out = settled[numbers]
            left = order[out]
            found[left] = given + np.arange(len(left))
            given += len(left)
            order, block = order[~out], numbers[~out]
            if not len(order):
                return found
        begins = np.concatenate([[0], np.cumsum(block[1:] != block[:-1])])
        found[order] = given + begins
        return found

    def repeated(self, weights: np.ndarray) -> np.ndarray:
        """Whether the string at each suffix stands at two places or more; `weights` counts the places of a text."""
        alone = np.arange(len(self.suffix))
        # the order within each shard, and its equal strings as one
        local = self.refine(self.suffix, self.shard, alone)
        _, first, local = np.unique(local, return_index=True, return_inverse=True)
        times = np.bincount(local, weights=weights[self.text])
        # the interleave of all shards
        merged = self.refine(self.suffix[first], np.zeros(len(first), dtype=np.int64), self.shard[first])
        total = np.bincount(merged, weights=times)
        return total[merged][local] > 1


def _merge(length: int, shard_bytes: int):
    def run(texts: pd.DataFrame) -> pd.DataFrame:
        # texts around one landmark lie side by side, so that most of what they share is settled within a shard
        texts = texts.sort_values(["key", "digest"], ignore_index=True)
        data = [bytes(d) for d in texts["data"]]
        shards = Shards(data, length, shard_bytes)
        mark = shards.repeated(texts["n"].to_numpy(dtype=np.float64)).astype(np.int8)
        ends = np.cumsum([len(d) - length + 1 for d in data])
        rows = []
        for at, to in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            edges = np.diff(np.concatenate([[0], mark[at:to], [0]]))
            rows.append([{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))])
        return pd.DataFrame({"key": texts["key"], "digest": texts["digest"], "ranges": rows})

    return run


_RANGES = "key bigint, digest binary, ranges array<struct<a:int,b:int>>"


def _halves(length: int):
    """Deals the strings of texts out anew: those with more of their text left of the landmark, and the others.

    All strings of either half share the text from where the last begins to where the first ends. A text of one string
    is that string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                # strings by the distance from their start to the landmark: those in the text, and the middle of all
                far, near = r["offset"], r["offset"] - r["size"] + 1
                low, high = r["low"], r["high"]
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    a, b = max(a, near), min(b, far)
                    if a > b:
                        continue
                    start, size = far - b, b - a + 1
                    data = r["data"][start : start + size + length - 1]
                    bounds = (low, middle) if a <= middle else (middle + 1, high)
                    # what every string of this half has: it does not depend on the strings of this text alone
                    mark = start + b
                    core = r["data"][mark - bounds[0] : mark - bounds[1] + length]
                    key = hashlib.blake2b(core, digest_size=8, salt=r["key"].to_bytes(8, "little", signed=True)).digest()
                    rows.append(
                        {
                            "parent": r["key"], "parent_digest": r["digest"], "shift": start,
                            "key": int.from_bytes(key, "little", signed=True), "digest": _digest(data), "size": size,
                            "offset": b, "n": r["n"], "data": data, "low": bounds[0], "high": bounds[1],
                        }
                    )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_HALF_ARROW)

    return run


_HALF = f"parent bigint, parent_digest binary, shift int, {_TEXTS}, low int, high int"
_HALF_ARROW = pa.schema(
    [
        ("parent", pa.int64()), ("parent_digest", pa.binary()), ("shift", pa.int32()), ("key", pa.int64()),
        ("digest", pa.binary()), ("size", pa.int32()), ("offset", pa.int32()), ("n", pa.int64()), ("data", pa.binary()),
        ("low", pa.int32()), ("high", pa.int32()),
    ]
)


def _whole(texts: DataFrame) -> DataFrame:
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    return texts.select("key", "digest", all_of_it.alias("ranges"))


def _ranges(texts: DataFrame, length: int, shard_bytes: int, group_bytes: int, task_bytes: int) -> DataFrame:
    """(key, digest, ranges): the strings of each text that stand at two places or more among the texts of its key.

    `texts` has (key, digest, size, offset, n, data, low, high): different texts of a key differ in digest, n counts
    their places, low and high bound the distance from the start of a string to the landmark.
    """
    texts = cut_lineage(texts)
    groups = texts.groupBy("key").agg(
        F.sum(F.octet_length("data").cast("bigint")).alias("_bytes"), F.count(F.lit(1)).alias("_kinds")
    )
    total = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    if not total:
        return texts.select("key", "digest", F.lit(None).cast("array<struct<a:int,b:int>>").alias("ranges"))
    hot = broadcast_if_small(groups.filter((F.col("_bytes") > group_bytes) & (F.col("_kinds") > 1)).select("key"))
    any_hot = not hot.isEmpty()
    small = texts.join(hot, "key", "left_anti") if any_hot else texts
    tasks = -(-total // task_bytes)
    dealt = small.withColumn("_task", F.pmod(F.xxhash64("key"), F.lit(tasks))).select("_task", "key", "digest", "n", "data")
    found = dealt.groupBy("_task").applyInPandas(_merge(length, shard_bytes), _RANGES)
    if not any_hot:
        return found
    halves = cut_lineage(texts.join(hot, "key", "left_semi").mapInArrow(_halves(length), _HALF))
    kinds = halves.groupBy("key", "digest").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("size", "offset", "data", "low", "high")]
    )
    below = _resolved(kinds, length, shard_bytes, group_bytes, task_bytes)
    shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
    back = halves.select("parent", "parent_digest", "shift", "key", "digest").join(below, ["key", "digest"]).select(
        F.col("parent").alias("key"), F.col("parent_digest").alias("digest"), shifted.alias("ranges")
    )
    return found.unionByName(back)


def _resolved(texts: DataFrame, *sizes: int) -> DataFrame:
    """Like `_ranges`, with the keys of one text decided at once: all of it, if it stands at two places."""
    texts = cut_lineage(texts)
    keys = texts.groupBy("key").agg(F.count(F.lit(1)).alias("_kinds"))
    joined = texts.join(keys, "key")
    several = joined.filter("_kinds > 1").drop("_kinds")
    return _whole(joined.filter("_kinds = 1 AND n > 1")).unionByName(_ranges(several, *sizes))


_SPANS = "n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for data, ranges in zip(_bytes(batch.column(1)), batch.column(2)):
                sizes.append(len(data))
                merged: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"] + length - 1) for r in ranges.as_py() or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else data)
                spans.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(
    documents: DataFrame,
    length: int = LENGTH,
    shard_bytes: int = SHARD_BYTES,
    group_bytes: int = GROUP_BYTES,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the bytes that lie in a repeated string go, `kept` holds the rest.

    A string of `length` bytes of a text in UTF-8 is repeated if it also starts elsewhere, in the same text too; spans
    are the maximal removed runs (start, end). Whether a string is repeated is judged on the input. A null text is
    empty, a shorter one loses nothing, a row that stands twice is a copy of itself, null and repeated identifiers are
    rows like others. No rows give no rows; columns beside doc_id and text are left out.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length is {length}, at least {2 * GRAM} is needed")
    spark = documents.sparkSession
    sizes = (length, shard_bytes, group_bytes, task_bytes)
    numbered = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("id"))
    # texts are needed by identifier twice: laid out by it once, neither join moves them
    name = f"texts_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    laid_out = numbered.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id")
    laid_out.option("path", staging_path(spark, "texts")).saveAsTable(name)
    rows = spark.table(name)

    marks = rows.select("text").mapInArrow(_mark_rows(length), "mark bigint").groupBy("mark").count().filter("count > 1")
    # written first, so that the join reads a plain shuffle on either side and a landmark of very many rows is split
    marks = cut_lineage(marks.select("mark"))
    stretches = rows.select("id", "text").mapInArrow(_stretch_rows(length), _STRETCHES)
    live = cut_lineage(stretches.join(marks, "mark", "left_semi"))
    kinds = cut_lineage(
        live.groupBy("mark", "digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "start", "size", "offset")).alias("_one"))
        .select("mark", "digest", "n", "_one.*")
    )
    number = kinds.groupBy("mark").agg(F.count(F.lit(1)).alias("_kinds"))
    joined = kinds.join(number, "mark")
    alone = joined.filter("_kinds = 1 AND n > 1").withColumnRenamed("mark", "key")
    wanted = joined.filter("_kinds > 1").groupBy("id").agg(
        F.collect_list(F.struct("start", "size", "offset", "mark", "digest", "n")).alias("wanted")
    )
    texts = rows.join(wanted, "id").select("text", "wanted").mapInArrow(_text_rows(length), _TEXTS)
    bounded = texts.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - GRAM))
    found = _whole(alone).unionByName(_ranges(bounded, *sizes)).filter(F.size("ranges") > 0)

    placed = live.join(found.withColumnRenamed("key", "mark"), ["mark", "digest"])
    each = placed.select("id", "start", F.inline("ranges")).select(
        "id", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("range")
    )
    per_row = each.groupBy("id").agg(F.collect_list("range").alias("ranges"))
    cut = rows.join(per_row, "id", "left").select("doc_id", "text", "ranges")
    return cut.mapInArrow(_remove(length), f"doc_id {dict(cut.dtypes)['doc_id']}, {_SPANS}")


register_pickle_by_value(sys.modules[__name__])
