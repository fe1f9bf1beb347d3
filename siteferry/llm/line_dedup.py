"""Fuzzy dedup of lines by MinHash.

A line is lower-cased, its white space made single, and turned into its set of character shingles: the `SHINGLE`
characters from each position on; a shorter line is one shingle. Equal lines are one item from the start. The hashes
of a line's shingles fall into 32 ranges, and the least of each range are independent minima; four of them together are
one band of the signature, which two lines at a similarity s share with a chance of s^4 or more. Each band sends the
line to a bucket. There every line is compared with the hub, the first of the bucket, on full shingle sets. Lines that
are near their hub are joined through it. A line that is not, a loose one, is compared with every line of the bucket,
block against block, so no two near lines of a bucket are left apart; a pair of blocks returns a row per line it links,
never the pairs. Links at a Jaccard similarity of `threshold` or above go into connected components, and of each
component the first line of the corpus stays.

Cutting and joining lines is built-in functions; shingles are hashed and compared in Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.functions.batches import giving_back
from siteferry.functions.scale import computed_once
from siteferry.llm.components import connected_components
from siteferry.session import cut_lineage

SHINGLE = 8
THRESHOLD = 0.8
BANDS, ROWS = 8, 4
BLOCK_LINES = 512

# Bits of a shingle's hash; the bits above them hold the line's place among those hashed together.
_HASH_BITS = 50
_RANGE_BITS = _HASH_BITS - (BANDS * ROWS - 1).bit_length()
_LINES_AT_ONCE = 1 << 13
_BYTES_AT_ONCE = 1 << 18
# Fixed odd multipliers of the hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

# Lines whose texts are looked up by a broadcast of two numbers each; more are joined by shuffle.
BROADCAST_POSITIONS = 1_000_000


def normalised_line(line: Column) -> Column:
    """Lower case, each run of white space as one space, none at the ends."""
    odd = reduce(or_, [line.contains(s) for s in ("  ", "\t", "\r", "\f", "\x0b")])  # spares most lines the pattern
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def _raw_lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0) and each line as it is."""
    split = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)))
    return split.select("doc_id", F.col("pos").alias("line_no"), F.col("col").alias("raw"))


def _lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no and the normalised line, for each line that is not blank."""
    cut = computed_once(_raw_lines(documents, id_col, text_col), line=normalised_line(F.col("raw")))
    return cut.filter("line <> ''").select("doc_id", "line_no", "line")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _shingles(lines: pa.Array) -> np.ndarray:
    """The distinct shingles of all lines, sorted: the line's place above `_HASH_BITS` bits of hash."""
    pad = SHINGLE - 1
    lengths = pc.utf8_length(lines).to_numpy().astype(np.int64)
    text = pa.large_string()
    padded = pc.binary_join_element_wise(lines.cast(text), pa.scalar("\0" * pad, text), pa.scalar("", text))
    size = int(np.frombuffer(padded.buffers()[1], dtype=np.int64)[len(padded)])
    joined = padded.buffers()[2].slice(0, size).to_pybytes().decode("utf-8")
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths + pad) - (lengths + pad)
    # Past its end a line reads as zeros, which no character is, so short lines of different lengths differ.
    codes[((starts + lengths)[:, None] + np.arange(pad)).ravel()] = 0
    power, total, width = int(_BASE), codes, 1
    while width < SHINGLE:  # a window twice as wide from two windows side by side
        total = total[: len(total) - width] * np.uint64(power) + total[width:]
        power, width = power * power % 2**64, 2 * width
    counts = np.maximum(lengths - pad, 1)
    owner = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    kept = (owner.astype(np.uint64) << np.uint64(_HASH_BITS)) | (_mixed(total[place]) >> np.uint64(64 - _HASH_BITS))
    kept.sort()
    return kept[np.concatenate(([True], kept[1:] != kept[:-1]))]


def _owners(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(_HASH_BITS)).astype(np.int64)


def _slices(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text and number of rows (or of one row)."""
    sizes = sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in columns)
    part = np.cumsum(sizes) // _BYTES_AT_ONCE
    cuts = np.flatnonzero(np.diff(part)) + 1
    cuts = np.unique(np.concatenate((cuts, np.arange(0, len(sizes), _LINES_AT_ONCE), [len(sizes)])))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield batch.slice(start, end - start)


def _bands(lines: pa.Array) -> list[pa.Array]:
    """The buckets of each line, one column a band; null where its ranges hold no shingle."""
    shingles = _shingles(lines)
    # The first shingle of each (line, range) is its least.
    cell = (shingles >> np.uint64(_RANGE_BITS)).astype(np.int64)
    first = np.concatenate(([True], cell[1:] != cell[:-1]))
    minima = np.zeros(len(lines) * BANDS * ROWS, dtype=np.uint64)
    minima[cell[first]] = (shingles[first] & np.uint64((1 << _RANGE_BITS) - 1)) + np.uint64(1)
    minima = minima.reshape(len(lines), BANDS, ROWS)
    out = []
    for b in range(BANDS):
        value = np.full(len(lines), np.uint64(b + 1))
        for r in range(ROWS):
            value = _mixed(value * _BASE + minima[:, b, r])
        out.append(pa.array(value.view(np.int64), mask=~minima[:, b].any(axis=1)))
    return out


def _with_bands(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, key and band_0 ... band_7."""
    names = [f"band_{b}" for b in range(BANDS)]
    kinds = dict(lines.dtypes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, ["line"]) if batch.num_rows else ():
                own = [part.column(c) for c in ("doc_id", "line_no", "key")]
                yield pa.RecordBatch.from_arrays(own + _bands(part.column("line")), names=["doc_id", "line_no", "key", *names])

    keyed = lines.select("doc_id", "line_no", _key(F.col("line")).alias("key"), "line")
    schema = f"doc_id {kinds['doc_id']}, line_no int, key binary, " + ", ".join(f"{n} bigint" for n in names)
    return keyed.mapInArrow(giving_back(sign), schema)


def _compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b and whether they are near, from a, b and their lines x and y."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, ["x", "y"]) if batch.num_rows else ():
                x, y = _shingles(part.column("x")), _shingles(part.column("y"))
                every = np.sort(np.concatenate((x, y)))
                sizes = np.bincount(_owners(every), minlength=part.num_rows)
                both = np.bincount(_owners(every[1:][every[1:] == every[:-1]]), minlength=part.num_rows)
                near = pa.array(both >= threshold * (sizes - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), near], names=["a", "b", "near"])

    return pairs.select("a", "b", "x", "y").mapInArrow(giving_back(compare), "a bigint, b bigint, near boolean")


def _stars(ids: np.ndarray, lines: pa.Array, loose: np.ndarray, high: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (least of its component, line) among the lines of a pair of blocks, as far as a loose line has part in them.

    `high` tells the second block from the first; where it is false throughout, the block meets itself.
    """
    order = np.argsort(high, kind="stable")
    ids, loose, split = ids[order], loose[order], int((~high).sum())
    raw = []
    for start in range(0, len(ids), _LINES_AT_ONCE):
        raw.append(_shingles(lines.take(pa.array(order[start : start + _LINES_AT_ONCE]))))
    owner = np.concatenate([_owners(r) + k * _LINES_AT_ONCE for k, r in enumerate(raw)])
    values = np.concatenate(raw) & np.uint64((1 << _HASH_BITS) - 1)
    distinct, dense = np.unique(values, return_inverse=True)
    sizes = np.bincount(owner, minlength=len(ids))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    member = np.zeros(len(distinct), dtype=np.int64)
    component = np.arange(len(ids))
    for i in np.flatnonzero(loose).tolist():
        low, top = (0, len(ids)) if split == len(ids) else (split, len(ids)) if i < split else (0, split)
        if low == top:
            continue
        member[dense[starts[i] : ends[i]]] = 1
        both = np.add.reduceat(member[dense[starts[low] : ends[top - 1]]], starts[low:top] - starts[low])
        member[dense[starts[i] : ends[i]]] = 0
        for j in (low + np.flatnonzero(both >= threshold * (sizes[i] + sizes[low:top] - both))).tolist():
            if component[j] != component[i]:
                component[component == component[j]] = component[i]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, component, ids)
    return [(int(a), int(b)) for a, b in zip(least[component], ids) if a != b]


def _loose_links(met: DataFrame, judged: DataFrame, texts: DataFrame, threshold: float, block_lines: int) -> DataFrame:
    """Links (a, b) of the lines that are not near the hub of a bucket to the other lines of it."""
    # Two lines of a bucket have been compared already: one is the hub.
    apart = judged.filter("not near").select(F.col("a").alias("hub"), F.col("b").alias("line_id"), F.lit(True).alias("loose"))
    marked = met.filter("n > 2").join(apart, ["hub", "line_id"], "left")
    marked = cut_lineage(marked.select("line_id", "bucket", "n", F.coalesce("loose", F.lit(False)).alias("loose")))
    mixed = marked.filter("loose").select("bucket").distinct()
    blocks = F.ceil(F.col("n") / block_lines).cast("int")
    block = F.pmod(F.xxhash64("line_id"), blocks).cast("int")
    members = marked.join(mixed, "bucket").select("line_id", "bucket", "loose", blocks.alias("blocks"), block.alias("block"))
    placed = members.join(texts, "line_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = ["bucket", "low", "top"]
    placed = placed.select(
        "bucket",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("top"),
        "line_id",
        "loose",
        (F.col("block") > F.col("other")).alias("high"),
        "line",
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(groups).combine_chunks()
            ids, loose, high = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("line_id", "loose", "high"))
            lines = rows.column("line").combine_chunks()
            lines = lines if isinstance(lines, pa.Array) else pa.concat_arrays(lines.chunks)
            links = _stars(ids, lines, loose, high, threshold)
            kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])
            return pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], schema=kinds)

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in meeting])
            cuts = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                place = tuple(places[:, start].tolist())
                if held and place != last:
                    yield found(held)
                    held = []
                held.append(batch.slice(start, end - start))
                last = place
        if held:
            yield found(held)

    grouped = placed.repartition(*meeting).sortWithinPartitions(*meeting)
    return grouped.mapInArrow(giving_back(link), "a bigint, b bigint")


def line_classes(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Rows (key, keep_doc_id, keep_line_no) for the lines that occur more than once or are linked; key is a digest.

    keep_ names the first line, by document and then by number, of the component.
    """
    bands = [f"band_{b}" for b in range(BANDS)]
    lines = _lines(documents, id_col, text_col)
    distinct = _with_bands(lines).groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        *[F.min(b).alias(b) for b in bands],
    )
    numbered = distinct.withColumn("line_id", F.monotonically_increasing_id())
    items = cut_lineage(numbered.select("line_id", "key", "first.doc_id", "first.line_no", "copies", *bands))

    # Counted and joined rather than ranked in a window, so no bucket has to be held or sorted by one task.
    posted = items.select("line_id", F.explode(F.array(*bands)).alias("bucket")).filter("bucket is not null")
    hubs = posted.groupBy("bucket").agg(F.min("line_id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut_lineage(posted.join(hubs, "bucket").select("line_id", "bucket", "hub", "n"))
    pairs = met.filter("line_id <> hub").select(F.col("hub").alias("a"), F.col("line_id").alias("b")).distinct()

    wanted = met.select("line_id").distinct()
    at = F.xxhash64("doc_id", "line_no").alias("at")
    places = cut_lineage(items.join(wanted, "line_id", "left_semi").select("line_id", "key", at))
    chosen = places.select("at", "line_id")
    chosen = F.broadcast(chosen) if places.count() <= BROADCAST_POSITIONS else chosen
    found = _raw_lines(documents, id_col, text_col).select("raw", at).join(chosen, "at")
    found = computed_once(found.select("line_id", "raw"), line=normalised_line(F.col("raw")))
    found = found.select("line_id", "line", _key(F.col("line")).alias("found_key"))
    # The digest tells which line is meant where rows repeat an identifier.
    meant = found.join(places.select("line_id", "key"), "line_id").filter("key = found_key")
    texts = cut_lineage(meant.groupBy("line_id").agg(F.first("line").alias("line")))
    left = texts.select(F.col("line_id").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("line_id").alias("b"), F.col("line").alias("y"))
    judged = cut_lineage(_compared(pairs.join(right, "b").join(left, "a"), threshold))
    links = judged.filter("near").select("a", "b").unionByName(_loose_links(met, judged, texts, threshold, block_lines))

    joined = cut_lineage(connected_components(links).select(F.col("node").alias("line_id"), "component"))
    member = items.select("line_id", "key", "doc_id", "line_no", "copies").join(joined, "line_id", "left")
    member = member.filter("copies > 1 or component is not null")
    class_of = F.coalesce("component", "line_id")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no")
    staged = cut_lineage(member.select("key", class_of.alias("class"), first.alias("first")))
    firsts = staged.groupBy("class").agg(F.min("first").alias("keep"))
    return staged.join(firsts, "class").select(
        "key", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no")
    )


def duplicate_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no (from 0), keep_doc_id, keep_line_no, kept.

    Lines end at line feeds. A line that is blank has no row and is never dropped; null and empty texts have no lines.
    A line alone in its class names itself. The first line by doc_id, then by number, stays; rows that repeat an
    identifier and its text keep or lose a line together. A line whose row has no identifier comes last. An empty
    table gives no rows. Other columns are not read.
    """
    classes = line_classes(documents, id_col, text_col, threshold)
    lines = _lines(documents, id_col, text_col).select("doc_id", "line_no", _key(F.col("line")).alias("key"))
    joined = lines.join(classes, "key", "left")
    alone = F.col("keep_line_no").isNull()
    kept = alone | (F.col("keep_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_line_no") == F.col("line_no")))
    return joined.select(
        "doc_id",
        "line_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_doc_id")).alias("keep_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("keep_line_no")).alias("keep_line_no"),
        kept.alias("kept"),
    )


def drop_duplicate_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", **options
) -> DataFrame:
    """`documents` without the lines that are dropped; a document that loses all of its lines goes.

    A text that loses no line is unchanged to the byte; of the others the kept lines are joined again. `count_col`, if
    the table has it, is the new number of characters. A document without lines, or without an identifier, stays as it is.
    """
    gone = duplicate_lines(documents, id_col, text_col, **options).filter("not kept and doc_id is not null")
    # One number per line of one document.
    lists = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    whole = documents.select(F.struct("*").alias("row"))
    joined = whole.join(lists, F.col("row")[id_col] == F.col("doc_id"), "left")
    text, untouched = F.col("row")[text_col], F.col("gone").isNull()
    rest = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("gone", i))
    cut = joined.select("row", "gone", F.when(untouched, text).otherwise(F.array_join(rest, "\n")).alias("rest"))
    kept = cut.filter(untouched | (normalised_line(F.col("rest")) != ""))
    out = {text_col: F.col("rest")}
    if count_col in documents.columns:
        counted = F.length("rest").cast(documents.schema[count_col].dataType)
        out[count_col] = F.when(untouched, F.col("row")[count_col]).otherwise(counted)
    return kept.select(*[(out[c] if c in out else F.col("row")[c]).alias(c) for c in documents.columns])


register_pickle_by_value(sys.modules[__name__])
