"""SQL dumps of any size and of any number of files, read as one row per statement.

Whether a `;` ends a statement depends on every quote and comment before it, so a plain parallel split is wrong. The
reader works in two passes over the blocks of a dump. The first works out, for every state a block could be entered in,
the state it is left in and how many statements end inside. These small maps are folded as a tree in the order of files
and blocks (`functions.scan`), which gives each block its true entry state and statement number; the second pass then
cuts the text. Files are cut into blocks at line ends, so only five entry states exist: outside everything, inside one
of three quotes, inside a block comment.

Dumps are bytes. What is no text in UTF-8 stands in literals, where a dump of binary columns has it: such a literal is
rewritten as hexadecimal digits, so no byte is lost. Any other statement that is no text, or that is longer than one
value may be, is a row with a `fault` in place of its text, and the rest of the dump is read on.

A list of rows may fill a dump. Where an INSERT spans blocks, its pieces are small and carry what each depth of
parentheses they could be entered at leads to; sums over them tell where rows end, and the list is cut there into
statements of some rows each. A long list within one block is cut in the task that reads it.
A list that holds anything but whole rows before its end is left in one piece.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siteferry.functions.batches import sliced
from siteferry.functions.scale import BROADCAST_ROWS, broadcast_if_small
from siteferry.functions.schema import columns
from siteferry.functions.scan import PART_PIECES, entry_states
from siteferry.functions.sqltext import values_head
from siteferry.functions.text import JS_SPACE_CHARS
from siteferry.operators.dump_statements import Scanner
from siteferry.session import cut_lineage

DIALECTS = {"mysql": "mysql", "mariadb": "mysql", "sqlite": "sqlite"}

# Entry states of a block, by their number in the maps.
OUTSIDE, SINGLE, DOUBLE, BACKTICK, COMMENT = b"N", b"'", b'"', b"`", b"*"
STATES = (OUTSIDE, SINGLE, DOUBLE, BACKTICK, COMMENT)

# One value of a row holds less than two gigabytes.
MAX_STATEMENT_BYTES = 2_000_000_000

# What `list_bytes` may well be; the pieces of a list are about an eighth of it.
LIST_BYTES = 8_000_000

# Depths of parentheses at which a piece of a list that is cut may begin.
DEPTHS = 8


def dialect_of(name: str) -> str:
    if name not in DIALECTS:
        raise ValueError(f"unknown dialect {name}; expected mysql or sqlite")
    return DIALECTS[name]


# What a backslash escape stands for; any other escaped byte is itself.
_ESCAPES = {b"0": b"\0", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"Z": b"\x1a"}


# Texts up to this many bytes are cut by the places of their marks, all at once; of a longer one these would take much room.
_TOGETHER_BYTES = 4_000_000
_MARKS = np.isin(np.arange(256), list(b";#'\"`/-"))
_QUOTES = np.isin(np.arange(256), list(b"'\"`"))
_QUOTED_RUN = re.compile(rb"'[^']*+'?+|\"[^\"]*+\"?+|`[^`]*+`?+")


class Cutter:
    """Regular expressions that cut bytes of one dialect; small enough to be sent with each task."""

    def __init__(self, dialect: str):
        self.dialect = dialect
        self.marked: tuple = (None, None)
        escaped = dialect == "mysql"
        inner = {
            SINGLE: rb"(?:[^'\\]++|\\.|'')*+" if escaped else rb"(?:[^']++|'')*+",
            DOUBLE: rb'(?:[^"\\]++|\\.|"")*+' if escaped else rb'(?:[^"]++|"")*+',
            BACKTICK: rb"(?:[^`]++|``)*+",
        }
        quoted = b"|".join(q + body + q for q, body in inner.items())
        # the longest stretch without a statement end, a comment or an open quote
        self.stretch = re.compile(rb"(?:[^;#'\"`/-]++|-(?!-)|/(?!\*)|" + quoted + rb")*+", re.S)
        self.rest_of_quote = {q: re.compile(body + q, re.S) for q, body in inner.items()}
        self.literal = re.compile(rb"(?:\b_[0-9A-Za-z]+\s*)?'(" + inner[SINGLE] + rb")'|" + quoted, re.S)
        self.escape = re.compile(rb"\\(.)|''" if escaped else rb"''()", re.S)
        # parentheses, and quoted runs to skip; the last of them may go on in the next piece
        self.marks = re.compile(rb"[()]|" + b"|".join(q + body + rb"(?:" + q + rb"|\Z)" for q, body in inner.items()), re.S)
        self.insert = re.compile(rb"(?i)[ \t\n\x0b\f\r]*+(?:INSERT|REPLACE)(?![0-9A-Za-z_])")
        self.list_head = re.compile(values_head(dialect).encode())

    def resume(self, text: bytes, state: bytes) -> int:
        """Where an open quote or comment ends in `text`, or -1 when it does not."""
        if state == COMMENT:
            at = text.find(b"*/")
            return -1 if at < 0 else at + 2
        found = self.rest_of_quote[state].match(text)
        return -1 if found is None else found.end()

    def walk(self, text: bytes, at: int) -> Iterator[tuple]:
        """From outside at `at`: ('text', from, to), ('end', position, next) and last (state, from, to)."""
        size = len(text)
        plain = self.plain_ends(text, at)
        if plain is not None:
            ends, state, opened = plain
            for stop in ends:
                if stop > at:
                    yield "text", at, stop
                yield "end", stop, stop + 1
                at = stop + 1
            if opened > at:
                yield "text", at, opened
            if size > opened:
                yield "text", opened, size
            yield state, size, size
            return
        while True:
            stop = self.stretch.match(text, at).end()
            if stop > at:
                yield "text", at, stop
            if stop == size:
                yield OUTSIDE, size, size
                return
            mark = text[stop : stop + 1]
            if mark == b";":
                yield "end", stop, stop + 1
                at = stop + 1
            elif mark in b"#-":
                at = text.find(b"\n", stop)
                if at < 0:
                    yield OUTSIDE, size, size
                    return
            elif mark == b"/":
                closed = text.find(b"*/", stop + 2)
                if closed < 0:
                    yield COMMENT, size, size
                    return
                at = closed + 2
            else:
                yield "text", stop, size
                yield mark, size, size
                return

    def plain_ends(self, text: bytes, at: int) -> tuple[list[int], bytes, int] | None:
        """(statement ends, state left in, where a quote left open begins or the end) from outside at `at`.

        None for a text with a comment or an escape, and for a long one.
        """
        if not 0 < len(text) - at <= _TOGETHER_BYTES or (self.dialect == "mysql" and text.find(b"\\", at) >= 0):
            return None
        every = np.frombuffer(text, np.uint8)
        if self.marked[0] is not text:
            # kept for the other states that the same text may be entered in
            self.marked = (text, np.flatnonzero(_MARKS[every]))
        places = self.marked[1][np.searchsorted(self.marked[1], at) :]
        marks = every[places]
        quotes = np.flatnonzero(_QUOTES[marks])
        kinds = marks[quotes]
        closed = len(kinds) // 2 * 2
        if (kinds[:closed:2] == kinds[1:closed:2]).all():
            firsts, lasts = quotes[::2], quotes[1::2]
        else:
            # one kind of quote stands within another
            runs = _QUOTED_RUN.findall(kinds.tobytes())
            lengths = np.fromiter(map(len, runs), np.int64, len(runs))
            beyond = np.cumsum(lengths)
            firsts = quotes[beyond - lengths]
            closes_last = lengths[-1] > 1 and runs[-1][-1:] == runs[-1][:1]
            lasts = quotes[beyond[: len(runs) if closes_last else -1] - 1]
        state, opened = OUTSIDE, len(text)
        if len(firsts) > len(lasts):
            opened = int(places[firsts[-1]])
            state = text[opened : opened + 1]
        change = np.zeros(len(places) + 1, np.int64)
        change[firsts] += 1
        change[lasts + 1] -= 1
        outside = np.cumsum(change[:-1]) == 0
        places, marks = places[outside], marks[outside]
        following = every[np.minimum(places + 1, len(text) - 1)]
        odd = (marks == 0x23) | (marks == 0x2D) & (following == 0x2D) | (marks == 0x2F) & (following == 0x2A)
        odd &= (marks == 0x23) | (places + 1 < len(text))
        return None if odd.any() else (places[marks == 0x3B].tolist(), state, opened)

    def head_end(self, text: bytes) -> int:
        """Where the list of an INSERT begins, behind the word VALUES; -1 for any other text."""
        found = self.list_head.match(text) if self.insert.match(text) else None
        return -1 if found is None else found.end()

    def row_ends(self, text: bytes, at: int, state: bytes) -> tuple[int, list[int], list[int]]:
        """(levels gained, rows ended, end of the last row) from `at`; the lists by the depth at which the text begins."""
        level, rows, last = 0, [0] * DEPTHS, [-1] * DEPTHS
        if state not in (OUTSIDE, COMMENT):
            at = self.resume(text, state)
        for found in self.marks.finditer(text, at) if at >= 0 else ():
            mark = text[found.start()]
            if mark == 0x28:
                level += 1
            elif mark == 0x29:
                level -= 1
                if -DEPTHS < level <= 0:
                    rows[-level] += 1
                    last[-level] = found.end()
        return level, rows, last

    def as_text(self, sql: bytes) -> tuple[str | None, str | None]:
        """(text, None), with literals of bytes that are no text in hexadecimal; or (None, fault)."""
        try:
            return sql.decode().strip(JS_SPACE_CHARS), None
        except UnicodeDecodeError:
            pass

        def respell(found: re.Match) -> bytes:
            try:
                found[0].decode()
                return found[0]
            except UnicodeDecodeError:
                if found[1] is None:
                    return found[0]
            value = self.escape.sub(lambda e: _ESCAPES.get(e[1], e[1]) if e[1] else b"'", found[1])
            digits = value.hex().upper().encode()
            return b"0x" + digits if self.dialect == "mysql" else b"x'" + digits + b"'"

        try:
            return self.literal.sub(respell, sql).decode().strip(JS_SPACE_CHARS), None
        except UnicodeDecodeError as wrong:
            return None, f"bytes outside a literal are no text: {wrong.object[wrong.start : wrong.start + 8].hex()}"


def _texts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, bytes, bool]]:
    """Runs of lines of one block as (block columns, bytes, whether the block goes on after it)."""
    held = None
    for batch in sliced(batches):
        places = [batch.schema.get_field_index(c) for c in names]
        lines = batch.column(batch.schema.get_field_index("value"))
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for column in (batch.column(i) for i in places):
            same = pc.equal(column[1:], column[:-1])
            missing = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
            new |= ~pc.or_(pc.fill_null(same, False), missing).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(new) + 1).tolist()] if batch.num_rows else []
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            mark = tuple(batch.column(i)[start].as_py() for i in places)
            if held is not None:
                yield held[0], held[1], held[0] == mark
            run = lines.slice(start, stop - start)
            if run.nbytes > _TOGETHER_BYTES:
                held = (mark, b"\n".join(run.to_pylist()) + b"\n")
            else:
                ended = pc.binary_join_element_wise(run, b"", b"\n").cast(pa.binary())
                size = np.frombuffer(ended.buffers()[1], np.int32)[len(ended)]
                held = (mark, ended.buffers()[2].slice(0, int(size)).to_pybytes())
    if held is not None:
        yield held[0], held[1], False


def _lines(spark: SparkSession, path, per: str) -> DataFrame:
    """(dump_id, place, shared, value): lines with the place of their block in the dump, in bytes."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            *meta,
            F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_block_length").alias("length"),
            F.col("value").cast("binary").alias("value"),
        )
    )
    if per == "file":
        return lines.select(F.col("file").alias("dump_id"), F.col("start").alias("place"), (F.col("length") < F.col("size")).alias("shared"), "value")
    # the files of a folder, by name, are one text
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(*meta)
    dump = F.regexp_replace("file", "/[^/]*$", "")
    before = Window.partitionBy("dump_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    ordered = listed.withColumn("dump_id", dump).select(
        "file", "dump_id", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.sum("size").over(Window.partitionBy("dump_id")).alias("total"),
    )
    # a listing is small beside its files; beyond what may be broadcast, lines are put back in order by their number
    files = broadcast_if_small(ordered)
    if files.count() > BROADCAST_ROWS:
        lines = lines.withColumn("line", F.monotonically_increasing_id())
    placed = lines.join(files, "file").select(
        "dump_id", (F.col("base") + F.col("start")).alias("place"), (F.col("length") < F.col("total")).alias("shared"), "value",
        *([F.col("line")] if "line" in lines.columns else []),
    )
    return placed


_MAP = columns(
    "key string, place bigint, to array<int>, add array<bigint>, first array<bigint>, last array<bigint>, size bigint"
)
_PIECE = columns(
    "dump_id string, stmt_no bigint, place bigint, part int, blank boolean, head int, levels int, rows array<int>, "
    "last array<int>, size bigint, sql binary"
)
_STATEMENT = columns("dump_id string, stmt_no bigint, sql string, fault string, first_row bigint")
_CHUNK = columns(
    "dump_id string, stmt_no bigint, chunk bigint, sql string, fault string, first_row bigint, whole boolean, ended boolean"
)


def _map_blocks(cutter: Cutter):
    """First pass: per block, what each entry state leads to."""

    def run(batches):
        fresh = True
        for mark, text, more in _texts(batches, ["dump_id", "place"]):
            if fresh:
                states, ends, first, last, done, fresh = list(STATES), [0] * 5, [-1] * 5, [-1] * 5, 0, False
            seen: dict[bytes, tuple[bytes, list[int]]] = {}
            plain = _ends_from(cutter, text, 0, None)
            seen[OUTSIDE] = plain
            for s in set(states) - {OUTSIDE}:
                at = cutter.resume(text, s)
                seen[s] = (s, []) if at < 0 else _ends_from(cutter, text, at, plain)
            for i in range(5):
                left, found = seen[states[i]]
                if found:
                    if first[i] < 0:
                        first[i] = done + found[0]
                    last[i] = done + found[-1]
                    ends[i] += len(found)
                states[i] = left
            done += len(text)
            if not more:
                to = [STATES.index(s) for s in states]
                row = {"key": mark[0], "place": mark[1], "to": to, "add": ends, "first": first, "last": last, "size": done}
                yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(_MAP))
                fresh = True

    return run


def _ends_from(cutter: Cutter, text: bytes, at: int, known: tuple[bytes, list[int]] | None) -> tuple[bytes, list[int]]:
    """(state left in, positions of statement ends) from outside at `at`.

    Once a walk ends a statement where the known walk also ended one, the two go on alike.
    """
    plain = cutter.plain_ends(text, at)
    if plain is not None:
        return plain[1], plain[0]
    shared = {} if known is None else {p: i for i, p in enumerate(known[1])}
    found: list[int] = []
    for kind, start, _ in cutter.walk(text, at):
        if kind == "end":
            if start in shared:
                return known[0], found + known[1][shared[start] :]
            found.append(start)
        elif kind != "text":
            return kind, found
    return OUTSIDE, found


_EMIT_BYTES = 2_000_000


class _Rows:
    """Statements gathered into batches of bounded size."""

    def __init__(self, cutter: Cutter, most: int):
        self.cutter, self.most = cutter, most
        self.rows, self.weight = [], 0

    def add_in_chunks(self, dump: str, number: int, parts: list[bytes], list_bytes: int | None) -> Iterator[pa.RecordBatch]:
        """Adds a statement, a long list as several ones; gives out batches that are full meanwhile."""
        if list_bytes is not None and list_bytes < sum(map(len, parts)) <= self.most:
            scanner = Scanner(self.cutter.dialect)
            chunks, parts = _list_chunks(self.cutter, scanner, parts, max(1, list_bytes // 8), self.most)
            for i, (first_row, sql) in enumerate(chunks):
                text = _read_chunk(self.cutter, scanner, chunks[0][1] if i else None, sql, self.most)[0]
                self.rows.append((dump, number, text, None, first_row))
                self.weight += len(sql)
                if self.weight > _EMIT_BYTES:
                    yield self.batch()
            if chunks:
                return
        self.add(dump, number, parts)

    def add(self, dump: str, number: int, parts: list[bytes]) -> None:
        sql = b"".join(parts)
        if len(sql) > self.most:
            text, fault = None, _too_long(self.most)
        else:
            text, fault = self.cutter.as_text(sql)
        if text or fault:
            self.rows.append((dump, number, text, fault, 0))
            self.weight += len(sql)

    def batch(self) -> pa.RecordBatch:
        schema = to_arrow_schema(_STATEMENT)
        values = list(zip(*self.rows))
        self.rows, self.weight = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, schema)], schema=schema)


def _read_chunk(
    cutter: Cutter, scanner: Scanner, first: bytes | None, sql: bytes, most: int
) -> tuple[str | None, int, bool]:
    """(text, whole rows, whether anything follows them) of a chunk, with the head of the list's `first` chunk before it.

    The text is none where the chunk cannot stand alone, as with a clause that goes for the whole list.
    """
    if first is not None:
        sql = first[: cutter.head_end(first)] + b" " + sql.lstrip(b" \t\n\x0b\f\r").removeprefix(b",")
    text = None if len(sql) > most else cutter.as_text(sql)[0]
    found = scanner.head.match(text) if text else None
    if found is None or scanner.is_upsert(text):
        return None, 0, False
    at, count = found.end(), 0
    for _, at in scanner.tuples(text, at):
        count += 1
    return text, count, scanner.rest(text, at) is not None


def _list_chunks(
    cutter: Cutter, scanner: Scanner, parts: list[bytes], piece_bytes: int, most: int
) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    """(rows before, bytes) of the chunks of a list in one block; none, and its parts, if it is not of whole rows."""
    todo, chunks, held, rows_before = parts[::-1], [], b"", 0
    parts.clear()
    while todo:
        taken, size, wanted = [held], len(held), max(piece_bytes, 2 * len(held))
        while todo and size < wanted:
            taken.append(todo.pop())
            size += len(taken[-1])
        held = b"".join(taken)
        begin = 0 if chunks else cutter.head_end(held)
        if begin < 0:
            break
        _, rows, last = cutter.row_ends(held, begin, OUTSIDE)
        if rows[0]:
            sql, held = held[: last[0]], held[last[0] :]
            first = chunks[0][1] if chunks else None
            chunks.append((rows_before, sql))
            if _read_chunk(cutter, scanner, first, sql, most)[1:] != (rows[0], False):
                break
            rows_before += rows[0]
    else:
        if chunks:
            text, count, ended = _read_chunk(cutter, scanner, chunks[0][1], held, most)
            if text is not None and count == 0:
                return [*chunks, *([(rows_before, held)] if ended else [])], []
    return [], [*(sql for _, sql in chunks), held, *reversed(todo)]


def _too_long(most: int) -> str:
    return f"a statement of more than {most} bytes; a quote or a comment may be left open"


def _cut_whole(cutter: Cutter, most: int, list_bytes: int | None = None):
    """Second pass: the statements that lie within one block."""

    def run(batches):
        out, parts, state, number, opened, fresh = _Rows(cutter, most), [], OUTSIDE, 0, False, True
        names = ["dump_id", "place", "shared", "state", "base", "ends"]
        for (dump, place, shared, entered, base, ends), text, more in _texts(batches, names):
            if fresh:
                state, number, parts = STATES[entered], base, []
                # the statement a shared block begins in belongs to the block before as well
                opened = shared and place > 0
                fresh = False
            # what belongs to other blocks as well is not kept: the statement a block is entered in and the one it is left in
            beyond = opened or (shared and number == base + ends)
            at = 0
            if state != OUTSIDE:
                at = cutter.resume(text, state)
                if state != COMMENT and not beyond:
                    parts.append(text if at < 0 else text[:at])
            if at >= 0:
                for kind, start, stop in cutter.walk(text, at):
                    if kind == "text":
                        if not beyond:
                            parts.append(text[start:stop])
                    elif kind == "end":
                        if not beyond:
                            yield from out.add_in_chunks(dump, number, parts, list_bytes)
                        parts, opened, number = [], False, number + 1
                        beyond = shared and number == base + ends
                        if out.weight > _EMIT_BYTES:
                            yield out.batch()
                    else:
                        state = kind
            if not more:
                if not shared:
                    yield from out.add_in_chunks(dump, number, parts, list_bytes)
                fresh = True
        if out.rows:
            yield out.batch()

    return run


def _cut_shared(cutter: Cutter, piece_bytes: int):
    """Second pass: what stands in a block before its first and after its last statement end, in pieces."""

    def run(batches):
        schema = to_arrow_schema(_PIECE)
        done, fresh, state, rows, weight = 0, True, OUTSIDE, [], 0
        parts, size, entered_in, part = [], 0, OUTSIDE, 0

        def close(dump, number, place):
            nonlocal parts, size, part, weight
            text = b"".join(parts)
            if text:
                head = cutter.head_end(text) if entered_in in (OUTSIDE, COMMENT) else -1
                levels, ends, last = cutter.row_ends(text, max(head, 0), entered_in)
                found = (not text.strip(), None if head < 0 else head, levels, ends, last, len(text), text)
                rows.append((dump, number, place, part, *found))
                weight += len(text)
            parts, size, part = [], 0, part + 1

        def batch():
            nonlocal rows, weight
            values = list(zip(*rows))
            rows, weight = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, schema)], schema=schema)

        for mark, text, more in _texts(batches, ["dump_id", "place", "state", "base", "ends", "first", "last"]):
            name, place, entered, base, ends, first, last = mark
            if fresh:
                done, state, part, fresh = 0, STATES[entered], 0, False
                entered_in = state
            whole = ends == 0
            # the first statement of a dump is whole when it ends within the first block
            if whole or (done <= first and place > 0):
                piece = text if whole or first >= done + len(text) else text[: first - done]
                before = len(parts)
                state = _strip(cutter, piece, state, parts)
                size += sum(map(len, parts[before:]))
                if size >= piece_bytes or (not whole and first < done + len(text)):
                    close(name, base, place)
                    entered_in = state
            if not whole and done + len(text) > last + 1:
                fresh_tail = done <= last + 1
                piece = text[last + 1 - done :] if fresh_tail else text
                if fresh_tail:
                    state = entered_in = OUTSIDE
                before = len(parts)
                state = _strip(cutter, piece, state, parts)
                size += sum(map(len, parts[before:]))
                if size >= piece_bytes:
                    close(name, base + ends, place)
                    entered_in = state
            done += len(text)
            if not more:
                close(name, base + ends, place)
                fresh = True
            if weight > _EMIT_BYTES:
                yield batch()
        if rows:
            yield batch()

    return run


def _strip(cutter: Cutter, text: bytes, state: bytes, out: list[bytes]) -> bytes:
    """Appends `text` without comments, for a stretch in which no statement ends; the state after it."""
    if not text:
        return state
    at = 0
    if state != OUTSIDE:
        at = cutter.resume(text, state)
        if state != COMMENT:
            out.append(text if at < 0 else text[:at])
        if at < 0:
            return state
    for kind, start, stop in cutter.walk(text, at):
        if kind == "text":
            out.append(text[start:stop])
        elif kind != "end":
            return kind
    return OUTSIDE


def _stitch(cutter: Cutter, most: int):
    """Statements from their pieces, which lie in the order of blocks."""

    def run(batches):
        out = _Rows(cutter, most)
        for batch in sliced(batches):
            for row in batch.to_pylist():
                out.add(row["dump_id"], row["stmt_no"], [p["sql"] for p in row["pieces"]])
                if out.weight > _EMIT_BYTES:
                    yield out.batch()
        if out.rows:
            yield out.batch()

    return run


def _cut_lists(cutter: Cutter, most: int):
    """Chunks of lists, whose parts follow each other, as statements of their own.

    Beside each stands whether it is whole rows, or whole rows up to where the list ended.
    """

    def run(batches):
        schema = to_arrow_schema(_CHUNK)
        scanner = Scanner(cutter.dialect)
        out, weight, mark, first_row, parts, rows = [], 0, None, 0, [], 0

        def close():
            nonlocal weight
            dump, number, chunk, head = mark
            sql = b"".join(parts)
            text, count, ended = _read_chunk(cutter, scanner, head if chunk > 0 else None, sql, most)
            whole = text is not None and count == rows
            if count == 0 and not ended and chunk > 0:
                text = None
            out.append((dump, number, chunk, text if whole else None, None, first_row, whole, ended))
            weight += len(sql)

        def batch():
            nonlocal out, weight
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            out, weight = [], 0
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for given in sliced(batches):
            for *now, first, ended_rows, sql in zip(*[c.to_pylist() for c in given.columns]):
                if now != mark:
                    if mark is not None:
                        close()
                    mark, first_row, parts, rows = now, first, [], 0
                    if weight > _EMIT_BYTES:
                        yield batch()
                parts.append(sql)
                rows += ended_rows
        if mark is not None:
            close()
            yield batch()

    return run


def _in_chunks(cutter: Cutter, pieces: DataFrame, list_bytes: int, most: int, limit: int | None) -> DataFrame | None:
    """The chunks of the lists among the statements that are longer than `list_bytes`, if of whole rows throughout.

    `limit` is the length beyond which a statement is refused, cut or not.
    """
    at, order = ["dump_id", "stmt_no"], ["place", "part"]
    long = pieces.groupBy(*at).agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") > list_bytes)
    if limit is not None:
        long = long.filter(F.col("_bytes") <= limit)
    long = broadcast_if_small(long.select(*at))
    if long.isEmpty():
        return None
    along = Window.partitionBy(*at).orderBy(*order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("bigint"))
    known = (
        pieces.drop("sql").join(long, at, "left_semi")
        .withColumn("depth", sums("levels"))
        .withColumn("begins", ~F.col("blank") & ~F.coalesce(F.max(~F.col("blank")).over(before), F.lit(False)))
        .withColumn("known", F.col("depth").between(0, DEPTHS - 1))
        .withColumn("n", F.when(F.col("known"), F.get("rows", F.col("depth").cast("int"))).otherwise(0))
        .withColumn("end", F.when(F.col("n") > 0, F.get("last", F.col("depth").cast("int"))))
        .withColumn("chunk", sums((F.col("n") > 0).cast("int")))
        .withColumn("first_row", sums("n"))
    )
    placed = cut_lineage(known.select(*at, *order, "begins", "head", "known", "n", "end", "chunk", "first_row"))
    lists = placed.groupBy(*at).agg(
        F.min("known").alias("known"), F.max(F.when(F.col("begins"), F.col("head"))).alias("head")
    ).filter("known and head is not null").select(*at)
    lists = broadcast_if_small(lists)
    heads = pieces.join(placed.filter("begins").select(*at, *order), [*at, *order], "left_semi")
    heads = heads.select(*at, F.substring("sql", F.lit(1), F.col("head")).alias("head_text"))
    none = F.lit(0).cast("bigint")
    slice_ = lambda chunk, row, half, rows, sql: F.struct(
        chunk.alias("chunk"), row.alias("first_row"), F.lit(half).alias("half"), rows.cast("bigint").alias("rows"), sql.alias("sql")
    )
    head_part = F.substring("sql", F.lit(1), F.col("end"))
    tail_part = F.substring("sql", F.col("end") + 1, F.col("size").cast("int"))
    halves = F.when(F.col("end").isNotNull(), F.array(
        slice_(F.col("chunk"), F.col("first_row"), 0, F.col("n"), head_part),
        slice_(F.col("chunk") + 1, F.col("first_row") + F.col("n"), 1, none, tail_part),
    )).otherwise(F.array(slice_(F.col("chunk"), F.col("first_row"), 0, none, F.col("sql"))))
    cut = (
        pieces.select(*at, *order, "size", "sql")
        .join(placed.join(lists, at, "left_semi").drop("begins", "head", "known"), [*at, *order])
        .select(*at, *order, F.inline(halves))
    )
    parts = cut.join(broadcast_if_small(heads), at).repartition(*at, "chunk").sortWithinPartitions(*at, "chunk", *order, "half")
    parts = parts.select(*at, "chunk", "head_text", "first_row", "rows", "sql")
    made = cut_lineage(parts.mapInArrow(_cut_lists(cutter, most), _CHUNK))
    # what is no whole row ends a list, so it may stand in the last chunk alone
    odd = made.groupBy(*at).agg(
        F.min("whole").alias("whole"), F.min(F.when(F.col("ended"), F.col("chunk"))).alias("ended"), F.max("chunk").alias("chunk")
    ).filter("not whole or ended < chunk").select(*at)
    return made.join(broadcast_if_small(odd), at, "left_anti")


def _size_of(spark: SparkSession, key: str) -> int:
    number, unit = re.match(r"(\d+)\s*([a-z]?)", spark.conf.get(key).lower()).groups()
    return int(number) * 1024 ** "bkmgtp".index(unit or "b")


def _may_split(spark: SparkSession, path) -> bool:
    """Whether some file is large enough to be read in several blocks, from the file listing alone."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    least = min(_size_of(spark, key) for key in keys)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > least).select("length").limit(1).count() > 0


def read_dump(
    spark: SparkSession,
    path,
    dialect: str = "mysql",
    per: str = "file",
    max_statement_bytes: int | None = None,
    part_pieces: int = PART_PIECES,
    list_bytes: int | None = None,
) -> DataFrame:
    """(dump_id, stmt_no, sql, fault): every statement of the dumps below `path`.

    `per` is "file" for one dump per file, or "folder" for one dump per folder, whose files follow each other by name: a
    statement, quote or comment may begin in one file and end in another. `;` inside quotes does not split; `--`, `#`
    and block comments vanish; the last statement needs no `;`; an open quote or comment runs to the end. Statement
    numbers grow along a dump and may have gaps, since empty statements are dropped. A statement longer than
    `max_statement_bytes`, as after a quote left open, and one whose bytes are no text have a fault and no sql.

    With `list_bytes` an INSERT whose list is longer has several rows of one `stmt_no`, each a statement with some of the
    list's rows; one more column, `first_row`, counts the rows before them and is 0 elsewhere. Then, without
    `max_statement_bytes` only what is one value is held to two gigabytes, so such a list that spans blocks may have any length.
    """
    if per not in ("file", "folder"):
        raise ValueError(f"per is {per}; expected file or folder")
    cutter = Cutter(dialect_of(dialect))
    given = lambda df: df.drop("first_row") if list_bytes is None else df
    most = MAX_STATEMENT_BYTES if max_statement_bytes is None else max_statement_bytes
    lines = _lines(spark, path, per)
    if per == "file" and (not _may_split(spark, path) or lines.filter("shared").limit(1).count() == 0):
        none = F.lit(0).cast("bigint")
        alone = lines.select("dump_id", "place", "shared", F.lit(0).alias("state"), none.alias("base"), none.alias("ends"), "value")
        return given(alone.mapInArrow(_cut_whole(cutter, most, list_bytes), _STATEMENT))
    at, none = ["dump_id", "stmt_no"], F.lit(0).cast("bigint")
    ordered = "line" in lines.columns
    blocks = _in_order(lines) if ordered else lines
    shared = blocks.filter("shared")
    maps = cut_lineage(shared.select("dump_id", "place", "value").mapInArrow(_map_blocks(cutter), _MAP))
    at_state = lambda c: F.get(c, F.col("state"))
    entries = broadcast_if_small(
        maps.join(entry_states(maps, 0, part_pieces), ["key", "place"]).select(
            F.col("key").alias("dump_id"), "place", "state", "base", at_state("add").alias("ends"),
            at_state("first").alias("first"), at_state("last").alias("last"), "size",
        )
    )
    # a statement that fills block after block without an end is refused before any of it is brought together
    endless = broadcast_if_small(
        entries.filter("ends = 0")
        .groupBy("dump_id", F.col("base").alias("stmt_no"))
        .agg(F.sum("size").alias("_bytes"))
        .filter(F.col("_bytes") > most)
        .drop("_bytes")
    )
    if not ordered and entries.count() > BROADCAST_ROWS:
        lines, ordered = lines.withColumn("line", F.monotonically_increasing_id()), True
    back = (lambda df: _in_order(df)) if ordered else (lambda df: df)
    known = entries.select("dump_id", "place", "state", "base", "ends")
    placed = back(lines.join(known, ["dump_id", "place"], "left")).select(
        "dump_id",
        "place",
        "shared",
        F.coalesce("state", F.lit(0)).alias("state"),
        F.coalesce("base", F.lit(0)).alias("base"),
        F.coalesce("ends", F.lit(0)).alias("ends"),
        "value",
    )
    whole = placed.mapInArrow(_cut_whole(cutter, most, list_bytes), _STATEMENT)
    pieces = back(lines.filter("shared").join(entries, ["dump_id", "place"])).select(
        "dump_id", "place", "state", "base", "ends", "first", "last", "value"
    )
    pieces = pieces.mapInArrow(_cut_shared(cutter, max(1, (list_bytes or LIST_BYTES) // 8)), _PIECE)
    chunks = None
    if list_bytes is not None:
        if max_statement_bytes is not None:
            pieces = pieces.join(endless, at, "left_anti")
        pieces = cut_lineage(pieces)
        chunks = _in_chunks(cutter, pieces, list_bytes, most, max_statement_bytes)
    if chunks is not None:
        in_chunks = broadcast_if_small(chunks.select(*at).distinct())
        pieces, endless = pieces.join(in_chunks, at, "left_anti"), endless.join(in_chunks, at, "left_anti")
    joined = (
        pieces.join(endless, at, "left_anti")
        .groupBy(*at)
        .agg(F.array_sort(F.collect_list(F.struct("place", "part", "sql"))).alias("pieces"))
    )
    stitched = joined.mapInArrow(_stitch(cutter, most), _STATEMENT)
    refused = endless.select(
        *at, F.lit(None).cast("string").alias("sql"), F.lit(_too_long(most)).alias("fault"), none.alias("first_row")
    )
    found = whole.unionByName(stitched).unionByName(refused)
    return given(found) if chunks is None else found.unionByName(chunks.filter("sql is not null").select(*_STATEMENT.names))


def _in_order(lines: DataFrame) -> DataFrame:
    """Lines of a block together and in their order again, after a join that shuffled them."""
    return lines.repartition("dump_id", "place").sortWithinPartitions("dump_id", "place", "line")


# Tasks get this module's functions with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
