"""Saved event captures: one JSON record per line, one JSON array, or one JSON object per file, of any size.

A file is read in pieces that end with a brace, so neither a long line nor one array has to fit into a value. Blocks of
pieces are cut on their own: a first pass reduces each block to a map (in a string or not when entered -> when left, and
how much deeper); the maps are folded in the order of blocks (`functions.scan`), which gives each block the depth it
begins at; a second pass cuts lines at newlines and the elements of an array at the commas of its top level. What a
block holds before its first and after its last border is put together with the blocks beside it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siteferry.functions import variant as V
from siteferry.functions.batches import sliced
from siteferry.functions.scale import BROADCAST_ROWS, broadcast_if_small, computed_once
from siteferry.functions.scan import PART_PIECES, entry_states
from siteferry.functions.schema import columns
from siteferry.functions.text import js_trim
from siteferry.session import cut_lineage

# A record larger than this is none: no single JSON value may be.
MAX_RECORD_CHARS = 128 * 1024 * 1024

_STRING = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.S)
_REST = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.S)
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+(?:"|\Z)|[\[\]{},]', re.S)
_SPACE = b" \t\n\r"
# Units are sent on at once when they hold about this many characters.
_BATCH_CHARS = 2_000_000

_MAP = columns("key string, place bigint, to array<int>, add array<bigint>, opening string, bytes bigint")
_UNIT = columns("capture string, place bigint, number bigint, mode string, what string, text string")


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, bytes, bool]]:
    """(columns of a block, some of its bytes, whether the block goes on after them), never a whole block at once.

    Each piece gets back the brace it was cut at; the last piece of a file gets one too, whether it had one or not. So a
    chunk ends with a brace, and no escape in a string is cut.
    """
    held = None
    for batch in sliced(batches):
        marks = list(zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]))
        pieces = batch.column(batch.schema.get_field_index("value")).to_pylist()
        start = 0
        for i in range(1, len(pieces) + 1):
            if i == len(pieces) or marks[i] != marks[start]:
                if held is not None:
                    yield held[0], held[1], held[0] == marks[start]
                held = (marks[start], b"}".join(pieces[start:i]) + b"}")
                start = i
    if held is not None:
        yield held[0], held[1], False


def _after(text: bytes) -> tuple[int, int]:
    """(state, depth) behind a text that begins outside a string."""
    plain = _STRING.sub(b"", text)
    open_ = plain.find(b'"')
    counted = plain if open_ < 0 else plain[:open_]
    deeper = counted.count(b"[") + counted.count(b"{") - counted.count(b"]") - counted.count(b"}")
    return int(open_ >= 0), deeper


def _map_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    to, add, first, size = [0, 1], [0, 0], None, 0
    for (capture, place), text, more in _chunks(batches, ["capture", "place"]):
        rest = _REST.match(text)
        ways = [_after(text), _after(text[rest.end() :]) if rest else (1, 0)]
        add = [n + ways[s][1] for s, n in zip(to, add)]
        to = [ways[s][0] for s in to]
        first = first or text.lstrip(_SPACE)[:1].decode("latin-1") or None
        size += len(text)
        if not more:
            row = {"key": capture, "place": place, "to": to, "add": add, "opening": first, "bytes": size}
            yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(_MAP))
            to, add, first, size = [0, 1], [0, 0], None, 0


def _lines_of(chunks: Iterable[bytes], first: bool) -> Iterator[tuple[str, bytes]]:
    """Lines of a block, and the parts of lines at its ends."""
    kind, held = "whole" if first else "head", []
    for text in chunks:
        pieces = text.split(b"\n")
        for piece in pieces[:-1]:
            yield kind, b"".join([*held, piece])
            kind, held = "whole", []
        held.append(pieces[-1])
    yield "middle" if kind == "head" else "tail", b"".join(held)


def _elements_of(chunks: Iterable[bytes], state: int, depth: int) -> Iterator[tuple[str, bytes]]:
    """Elements of the array that a block holds or is part of; `end` where it ends, `fault` beside what is no array.

    Of the block only the element that is open is kept.
    """
    inside = depth > 0
    # an array that is open goes on with the first byte; `held` is what the element has so far
    open_, held, kind, closed, seen = inside, [], "head", False, inside or bool(state)
    for text in chunks:
        at, begin = 0, 0
        if closed:
            if text.strip(_SPACE):
                yield "fault", b""
                return
            continue
        if state:
            rest = _REST.match(text)
            if rest is None:
                held.append(text)
                continue
            at, state = rest.end(), 0
            held = held if open_ else []
        for token in _TOKEN.finditer(text, at):
            mark = token[0]
            if mark[:1] == b'"':
                if not open_:
                    yield "fault", b""
                    return
                state = int(_STRING.fullmatch(mark) is None)
                continue
            if mark in (b"[", b"{"):
                depth += 1
                if depth == 1:
                    if inside or mark == b"{" or seen or text[: token.start()].strip(_SPACE):
                        yield "fault", b""
                        return
                    begin, kind, inside, open_ = token.end(), "whole", True, True
            elif mark == b",":
                if depth == 1:
                    yield kind, b"".join([*held, text[begin : token.start()]])
                    begin, held, kind = token.end(), [], "whole"
            else:
                depth -= 1
                if depth == 0 and open_:
                    yield kind, b"".join([*held, text[begin : token.start()]])
                    yield "end" if mark == b"]" else "fault", b""
                    held, open_, closed = [], False, True
                    if text[token.end() :].strip(_SPACE):
                        yield "fault", b""
                        return
                    break
                if depth < 0:
                    yield "fault", b""
                    return
        if open_:
            held.append(text[begin:])
        seen = seen or bool(text.strip(_SPACE))
    if open_ or held:
        yield "middle" if kind == "head" else "tail", b"".join(held)
    elif not closed and seen:
        yield "fault", b""


def _cut(lines_only: bool):
    names = ["capture", "place", "shared", "size", "state", "depth", "opening", "surplus", "begins"]

    def block(mark: tuple, text: bytes, more: bool, chunks: Iterator[tuple[tuple, bytes, bool]]):
        """Rows of the block that begins with `text`, taking its further chunks."""
        capture, place, shared, size, state, depth, opening, surplus, begins = mark
        if not shared:
            opening, begins = text.lstrip(_SPACE)[:1].decode("latin-1"), True

        def texts() -> Iterator[bytes]:
            now, on, length = text, more, len(text)
            while on:
                yield now
                _, now, on = next(chunks)
                length += len(now)
            yield now[:-1] if (surplus if shared else length > size) else now

        mode = "array" if opening == "[" and not lines_only else "lines"
        rest = texts()
        cut = _elements_of(rest, state, depth) if mode == "array" else _lines_of(rest, begins)
        for number, (what, part) in enumerate(cut):
            # the last line of a file that no block follows is a whole one
            what = "whole" if mode == "lines" and what == "tail" and not shared else what
            yield capture, place, number, mode, what, part.decode("utf-8", "replace")
        for _ in rest:
            pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_UNIT)
        rows, weight = [], 0
        chunks = _chunks(batches, names)
        for mark, text, more in chunks:
            for row in block(mark, text, more, chunks):
                rows.append(row)
                weight += len(row[-1]) + 32
                if weight > _BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _stitched(units: DataFrame, part_pieces: int) -> DataFrame:
    """Units cut by block borders put together; what would be too large for a value becomes a fault."""
    parts = units.filter(F.col("what").isin("head", "middle", "tail"))
    heads = parts.groupBy("capture", "place").agg(F.max(F.when(F.col("what") == "head", 1).otherwise(0)).alias("_head"))
    steps = heads.select(
        F.col("capture").alias("key"), "place", F.array(F.lit(0)).alias("to"), F.array(F.col("_head")).alias("add")
    )
    before = entry_states(steps, 0, part_pieces).select(F.col("key").alias("capture"), "place", F.col("base").alias("_before"))
    grouped = parts.join(before, ["capture", "place"]).join(heads, ["capture", "place"])
    unit = F.col("_before") + F.when(F.col("what") == "tail", F.col("_head")).otherwise(0)
    named = cut_lineage(grouped.select("capture", "place", "number", "mode", "text", unit.alias("_unit")))
    large = named.groupBy("capture", "_unit").agg(F.sum(F.length("text").cast("bigint")).alias("_chars"))
    large = broadcast_if_small(large.filter(F.col("_chars") > MAX_RECORD_CHARS).select("capture", "_unit"))
    whole = (
        named.join(large, ["capture", "_unit"], "left_anti")
        .groupBy("capture", "_unit", "mode")
        .agg(F.array_sort(F.collect_list(F.struct("place", "number", "text"))).alias("_parts"))
        .select(
            "capture", F.get("_parts", F.lit(0))["place"].alias("place"), F.get("_parts", F.lit(0))["number"].alias("number"), "mode",
            F.lit("whole").alias("what"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"),
        )
    )
    refused = named.join(large, ["capture", "_unit"], "left_semi").groupBy("capture", "_unit", "mode").agg(F.min("place").alias("place"))
    refused = refused.select(
        "capture", "place", F.lit(0).cast("bigint").alias("number"), "mode", F.lit("fault").alias("what"), F.lit("").alias("text")
    )
    return units.filter(~F.col("what").isin("head", "middle", "tail")).unionByName(whole).unionByName(refused)


def _units(pieces: DataFrame, lines_only: bool, part_pieces: int) -> DataFrame:
    """(capture, place, number, mode, what, text): lines or elements of each file, `end` and `fault` of arrays."""
    shared = pieces.filter("shared")
    nothing = {"state": "int", "depth": "bigint", "opening": "string", "surplus": "boolean", "begins": "boolean"}
    names = ["capture", "place", "shared", "size", *nothing, "value"]
    alone = pieces.filter("not shared").withColumns({n: F.lit(None).cast(k) for n, k in nothing.items()})
    alone = alone.fillna({"state": 0, "depth": 0}).select(names)
    if shared.limit(1).count() == 0:
        return cut_lineage(alone.mapInArrow(_cut(lines_only), _UNIT))
    maps = cut_lineage(shared.select("capture", "place", "value").mapInArrow(_map_blocks, _MAP))
    files = maps.groupBy("key").agg(
        F.min_by("opening", F.when(F.col("opening").isNotNull(), F.col("place"))).alias("opening"),
        F.min("place").alias("_first"), F.max("place").alias("_last"), F.sum("bytes").alias("_bytes"),
    )
    entries = broadcast_if_small(
        entry_states(maps, 0, part_pieces).join(files, "key").select(
            F.col("key").alias("capture"), "place", "state", F.col("base").alias("depth"), "opening", "_last", "_bytes",
            (F.col("place") == F.col("_first")).alias("begins"),
        )
    )
    many = entries.count() > BROADCAST_ROWS
    placed = shared.withColumn("_id", F.monotonically_increasing_id()).join(entries, ["capture", "place"])
    if many:
        placed = placed.repartition("capture", "place").sortWithinPartitions("capture", "place", "_id")
    surplus = (F.col("place") == F.col("_last")) & (F.col("_bytes") > F.col("size"))
    parts = placed.withColumn("surplus", surplus).select(names)
    return _stitched(cut_lineage(alone.unionByName(parts).mapInArrow(_cut(lines_only), _UNIT)), part_pieces)


def read_captures(
    spark: SparkSession, path: str, captures: DataFrame | None = None, part_pieces: int = PART_PIECES
) -> tuple[DataFrame, DataFrame]:
    """Records (capture, value) and files (capture, lines, bad_lines, readable); a capture is a file.

    A file that is one JSON array gives its elements, any other the JSON values on its lines; a file of which no line
    parses is one value, if it is one. A blank file is readable and has no records; a file that is none of these is not
    readable. Bad lines beside good ones are counted and skipped; `lines` counts lines that are not blank, of an array
    its elements. Spark does not list files of zero bytes; `captures` (capture) names every file where those are to be
    reported too.
    """
    pieces = (
        spark.read.option("lineSep", "}")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("capture"),
            F.col("_metadata.file_block_start").alias("place"),
            (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("shared"),
            F.col("_metadata.file_size").alias("size"),
            F.col("value").cast("binary").alias("value"),
        )
    )
    units = cut_lineage(_parsed(_units(pieces, False, part_pieces)))
    arrays = units.filter("mode = 'array'").groupBy("capture").agg(
        F.count_if(F.col("what") == "end").alias("_ends"),
        F.count_if(F.col("what") == "fault").alias("_faults"),
        F.count_if(F.col("what") == "whole").alias("_elements"),
        F.count_if((F.col("what") == "whole") & (F.col("text") == "")).alias("_blank"),
        F.count_if((F.col("what") == "whole") & (F.col("text") != "") & F.col("record").isNull()).alias("_bad"),
    )
    sound = (F.col("_ends") == 1) & (F.col("_faults") + F.col("_bad") == 0) & ((F.col("_blank") == 0) | (F.col("_elements") == 1))
    broken = broadcast_if_small(arrays.filter(~sound).select("capture"))
    by_line = units.filter("mode = 'lines'")
    if not broken.isEmpty():
        # what looks like an array and is none is read by its lines
        again = _units(pieces.join(broken, "capture", "left_semi"), True, part_pieces)
        by_line = by_line.unionByName(cut_lineage(_parsed(again)))
    lines = by_line.filter("what = 'fault' OR text <> ''")
    seen = lines.groupBy("capture").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("record").isNull()).alias("bad_lines"),
        F.count_if(F.col("what") == "fault").alias("_faults"),
        F.sum(F.length("raw").cast("bigint")).alias("_chars"),
    )
    doubtful = seen.filter((F.col("bad_lines") == F.col("lines")) & (F.col("_faults") == 0) & (F.col("_chars") <= MAX_RECORD_CHARS))
    gathered = by_line.join(doubtful.select("capture"), "capture", "left_semi").groupBy("capture").agg(
        F.array_sort(F.collect_list(F.struct("place", "number", "raw"))).alias("_lines")
    )
    whole = computed_once(gathered, record=V.parse_strict(js_trim(F.array_join(F.transform("_lines", lambda p: p["raw"]), "\n"))))
    single = whole.filter(F.col("record").isNotNull()).select("capture", F.col("record").alias("value"))
    good = F.col("record").isNotNull()
    of_lines = lines.filter(good).select("capture", F.col("record").alias("value"))
    elements = units.filter("mode = 'array' AND what = 'whole' AND text <> ''").join(broken, "capture", "left_anti")
    of_arrays = elements.select("capture", F.col("record").alias("value"))
    records = of_lines.unionByName(of_arrays).unionByName(single)
    listed = captures
    if listed is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        listed = files.select(F.col("_metadata.file_path").alias("capture"))
    counted = seen.select("capture", "lines", "bad_lines").unionByName(
        elements.groupBy("capture").agg(F.count(F.lit(1)).alias("lines")).withColumn("bad_lines", F.lit(0).cast("bigint"))
    )
    marked = single.select("capture").withColumn("_whole", F.lit(True))
    status = (
        listed.select("capture").join(counted, "capture", "left")
        .join(marked, "capture", "left")
        .select(
            "capture",
            F.coalesce("lines", F.lit(0)).alias("lines"),
            F.when(F.col("_whole"), 0).otherwise(F.coalesce("bad_lines", F.lit(0))).alias("bad_lines"),
            (
                F.col("lines").isNull() | F.coalesce("_whole", F.lit(False)) | (F.col("bad_lines") < F.col("lines"))
            ).alias("readable"),
        )
    )
    return records, status


def _parsed(units: DataFrame) -> DataFrame:
    """Adds `raw`, the trimmed `text` and the `record` it is, or null."""
    trimmed = computed_once(units.withColumnRenamed("text", "raw"), text=js_trim(F.col("raw")))
    record = F.when((F.col("what") == "whole") & (F.col("text") != ""), V.parse_strict(F.col("text")))
    return computed_once(trimmed, record=record)


register_pickle_by_value(sys.modules[__name__])
