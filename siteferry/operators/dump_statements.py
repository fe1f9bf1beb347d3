"""Statements sorted by kind, INSERT lists as rows, literals as values, rows as typed tables."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siteferry.functions import schema
from siteferry.functions.batches import sliced
from siteferry.functions.scale import computed_once
from siteferry.functions.sqltext import CAST_HEX, MYSQL_ESCAPES, NAME, keyword, quoted, single_quoted, values_head
from siteferry.functions.text import JS_SPACE_CHARS, preview

# The kinds of statements, in the order they are tried.
KINDS = (
    ("noise", r"SET|LOCK TABLES|UNLOCK TABLES|USE|START TRANSACTION|COMMIT|BEGIN|PRAGMA|DELIMITER"),
    ("create_table", r"CREATE\s+(TEMPORARY\s+)?TABLE"),
    ("insert", r"INSERT|REPLACE"),
    ("drop", r"DROP\s+(TABLE|INDEX|VIEW)"),
    ("create_index", r"CREATE\s+(UNIQUE\s+)?INDEX"),
    ("object", r"CREATE\s+(OR\s+REPLACE\s+)?(TRIGGER|VIEW|PROCEDURE|FUNCTION|EVENT)"),
    ("alter", r"ALTER\s+TABLE"),
)


def kind_of(sql: Column) -> Column:
    kind = F.when(sql.rlike(keyword(KINDS[0][1])), KINDS[0][0])
    for name, pattern in KINDS[1:]:
        kind = kind.when(sql.rlike(keyword(pattern)), name)
    return kind.otherwise("unrecognised")


def classify(statements: DataFrame) -> DataFrame:
    """Adds `kind`: the first kind whose words begin the statement."""
    return statements.withColumn("kind", kind_of(F.col("sql")))


def is_upsert(sql: Column, dialect: str) -> Column:
    """Whether ON DUPLICATE KEY stands outside quotes; quotes are taken out only where the words occur."""
    words = r"(?i)\bON\s+DUPLICATE\s+KEY\b"
    return sql.rlike(words) & F.regexp_replace(sql, quoted(dialect), "''").rlike(words)


def has_values(sql: Column, dialect: str) -> Column:
    return sql.rlike(values_head(dialect))


_LITERAL = schema.columns("kind string, text string, bytes binary")
_SCANNED = (
    schema.columns(
        "dump_id string, stmt_no bigint, kind string, sql string, fault string, table string, columns array<string>, "
        "head string, row_no int, tuple string, tuples bigint"
    )
    .add("values", T.ArrayType(_LITERAL))
    .add("rest", T.StringType())
)


def scan_statements(
    classified: DataFrame, dialect: str, texts: bool = True, values: bool = False, split: bool = True
) -> DataFrame:
    """Statements with every VALUES list cut into its rows, in one pass and at any length and nesting.

    One row per tuple (row_no, tuple as text, its decoded values if asked for), one row with `rest` for what such a list
    holds beside whole tuples, and any other statement as it is, with `sql`. Without `split` the tuples of a statement
    are one row, joined by commas, and `tuples` counts them. A tuple ends where its parentheses are balanced outside
    quotes; the first text that is no whole tuple ends the list. Rows are counted on from `first_row`, if there is one.
    """
    first = F.col("first_row") if "first_row" in classified.columns else F.lit(0).cast("bigint").alias("first_row")
    fault = F.col("fault") if "fault" in classified.columns else F.lit(None).cast("string").alias("fault")
    given = classified.select("dump_id", F.col("stmt_no").cast("bigint").alias("stmt_no"), "kind", "sql", fault, first)
    return given.mapInArrow(lambda batches: _scan(batches, Scanner(dialect), texts, values, split), _SCANNED)


def insert_rows(classified: DataFrame, dialect: str) -> DataFrame:
    """One row per tuple of a VALUES list: (dump_id, stmt_no, table, columns, head, row_no, tuple).

    `columns` is null without a column list. The first text that is no whole tuple ends the list; `tail_refusals`
    reports it. Statements refused for their form have no rows.
    """
    scanned = scan_statements(_inserts(classified), dialect)
    return scanned.filter(F.col("row_no").isNotNull()).select(*_ROW, "tuple")


_ROW = ("dump_id", "stmt_no", "table", "columns", "head", "row_no")


def insert_values(classified: DataFrame, dialect: str) -> DataFrame:
    """Like `insert_rows`, with the decoded `values` in place of the tuple's text: both are read in one pass."""
    scanned = scan_statements(_inserts(classified), dialect, texts=False, values=True)
    return scanned.filter(F.col("row_no").isNotNull()).select(*_ROW, "values")


def _inserts(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("kind") == "insert")


def tail_refusals(classified: DataFrame, dialect: str) -> DataFrame:
    """What a VALUES list holds beside whole tuples: (dump_id, stmt_no, reason, preview).

    A dump cut off while it was written and a clause after the rows both end here.
    """
    return scanned_tails(scan_statements(_inserts(classified), dialect, texts=False))


def scanned_tails(scanned: DataFrame) -> DataFrame:
    reason = F.when(F.col("rest") == "", "INSERT with an empty VALUES list").otherwise(
        F.concat(F.lit("text that is no row in the VALUES list of "), F.col("table"))
    )
    left = scanned.filter(F.col("rest").isNotNull())
    return left.select("dump_id", "stmt_no", reason.alias("reason"), preview(F.col("rest")).alias("preview"))


def decode_values(rows: DataFrame, dialect: str) -> DataFrame:
    """Adds `values`: array<struct<kind, text, bytes>> of a tuple's literals.

    Kinds are null, number, string, hex and expr. `text` is the decoded text, the digits of a number or
    the expression; `bytes` is set for hex literals.
    """
    decoded_rows = T.StructType([*rows.schema.fields, _SCANNED["values"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(dialect)
        for batch in sliced(batches):
            literals = Literals()
            for text in batch.column(batch.schema.get_field_index("tuple")).to_pylist():
                literals.end(missing=True) if text is None else scanner.values(text, literals)
            yield pa.RecordBatch.from_arrays([*batch.columns, literals.array()], names=[*batch.schema.names, "values"])

    return rows.mapInArrow(run, decoded_rows)


# Statements and batches of about this many characters are sent on at once.
_BATCH_CHARS = 2_000_000
_SPACE = r"[ \t\n\x0b\f\r]"


class Scanner:
    """Cuts VALUES lists and tuples with one pass over their characters, counting parentheses outside quotes."""

    def __init__(self, dialect: str):
        string, any_quote = single_quoted(dialect), quoted(dialect)
        self.dialect = dialect
        self.head = re.compile(values_head(dialect))
        self.list_at_end = re.compile(rf"\(((?:[^'\"`()]++|{any_quote})*+)\){_SPACE}*\Z")
        self.into = re.compile(rf"(?i)\bINTO\s+(?:{NAME}\s*\.\s*)*({NAME})")
        self.upsert = re.compile(r"(?i)\bON\s+DUPLICATE\s+KEY\b")
        self.quoted = re.compile(any_quote)
        self.between = re.compile(rf"{_SPACE}*+,?{_SPACE}*+")
        # nearly all tuples hold no parentheses, nearly all values are one of these
        self.flat = re.compile(rf"\((?:[^'\"`()]++|{any_quote})*+\)")
        self.token = re.compile(rf"[^'\"`(),]++|{any_quote}|[(),]")
        self.plain = re.compile(
            rf"{_SPACE}*+(?:({string})|([-+]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][-+]?[0-9]++)?)|([Nn][Uu][Ll][Ll])"
            rf"|(0[xX][0-9a-fA-F]++|[xX]'[0-9a-fA-F]*+')){_SPACE}*+(?:,|\Z)"
        )
        self.number = re.compile(r"[-+]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][-+]?[0-9]++)?")
        self.string = re.compile(string)
        self.hexed = re.compile(r"0[xX]([0-9a-fA-F]+)|[xX]'([0-9a-fA-F]*)'")
        self.cast = re.compile(CAST_HEX)
        # a literal may name its character set first: _binary 'text'
        self.introduced = re.compile(rf"_[0-9A-Za-z]+\s*(?:({string})|(0[xX][0-9a-fA-F]+|[xX]'[0-9a-fA-F]*'))")
        self.escape = re.compile(r"\\([\s\S])|''")
        self.heads: dict[str, tuple] = {}

    def read_head(self, text: str) -> tuple[str, str, list[str] | None]:
        """(head without VALUES, table, columns) of the text before a list; most statements of a dump share theirs."""
        if text not in self.heads:
            if len(self.heads) > 1000:
                self.heads.clear()
            head = text[: -len("values")].strip(JS_SPACE_CHARS)
            table = self.into.search(head)
            listed = self.list_at_end.search(head)
            columns = [_plain_name(c) for c in self.items(listed[1])] if listed else None
            self.heads[text] = (head, _plain_name(table[1]) if table else "unknown", columns)
        return self.heads[text]

    def is_upsert(self, sql: str) -> bool:
        return "duplicate" in sql.lower() and bool(self.upsert.search(self.quoted.sub("''", sql)))

    def tuples(self, sql: str, at: int) -> Iterator[tuple[int, int]]:
        """(from, to) of each tuple from `at` on."""
        while True:
            begin = self.between.match(sql, at).end()
            flat = self.flat.match(sql, begin)
            to = flat.end() if flat else self.balanced(sql, begin)
            if to < 0:
                return
            yield begin, to
            at = to

    def balanced(self, text: str, at: int) -> int:
        """Behind the parenthesis that closes the one at `at`; -1 where there is none."""
        if text[at : at + 1] != "(":
            return -1
        depth = 0
        while token := self.token.match(text, at):
            at = token.end()
            first = token[0]
            depth += (first == "(") - (first == ")")
            if depth == 0:
                return at
        return -1

    def rest(self, sql: str, at: int) -> str | None:
        """What is left behind the tuples; None in a statement that is whole."""
        left = sql[at:].strip(JS_SPACE_CHARS).lstrip(", \t\n\x0b\f\r")
        left = (left[:-1] if left.endswith(";") else left).strip(JS_SPACE_CHARS)
        return left or None

    def items(self, text: str) -> list[str]:
        """The trimmed, non-empty items of a list, split at commas outside quotes and parentheses."""
        found, depth, start, at = [], 0, 0, 0
        while token := self.token.match(text, at):
            first = token[0]
            if first == "," and depth == 0:
                found.append(text[start:at])
                start = token.end()
            depth += (first == "(") - (first == ")")
            at = token.end()
        found.append(text[start:])
        return [item for item in (f.strip(JS_SPACE_CHARS) for f in found) if item]

    def values(self, text: str, into: Literals) -> None:
        """Adds the literals of a tuple."""
        kinds, texts, raws = into.kinds, into.texts, into.raws
        at, inner = 1, text[:-1]
        step = self.plain.scanner(inner, 1).match
        while found := step():
            kind = found.lastindex
            at = found.end()
            if kind == 1:
                kinds.append("string")
                texts.append(self.decode(found[1]))
                raws.append(None)
            elif kind == 2:
                kinds.append("number")
                texts.append(found[2])
                raws.append(None)
            elif kind == 3:
                kinds.append("null")
                texts.append(None)
                raws.append(None)
            else:
                into.add(*self.hex_value(self.hexed.fullmatch(found[4])))
        if at < len(inner):
            # the rest of the tuple holds something else: it is cut with care
            for item in self.items(inner[at:]):
                into.add(*self.literal(item))
        into.end()

    def literal(self, text: str) -> tuple:
        if self.string.fullmatch(text):
            return "string", self.decode(text), None
        if self.number.fullmatch(text):
            return "number", text, None
        if text.upper() == "NULL":
            return "null", None, None
        if hexed := self.hexed.fullmatch(text):
            return self.hex_value(hexed)
        if cast := self.cast.fullmatch(text):
            raw = bytes.fromhex(cast[1])
            try:
                return "string", raw.decode(), None
            except UnicodeDecodeError:
                return "hex", None, raw
        if introduced := self.introduced.fullmatch(text):
            if introduced[1] is not None:
                return "string", self.decode(introduced[1]), None
            return self.hex_value(self.hexed.fullmatch(introduced[2]))
        return "expr", text, None

    @staticmethod
    def hex_value(found: re.Match) -> tuple:
        digits = found[1] or found[2] or ""
        return "hex", None, bytes.fromhex("0" * (len(digits) % 2) + digits)

    def decode(self, literal: str) -> str:
        inner = literal[1:-1]
        if self.dialect == "mysql" and "\\" in inner:
            return self.escape.sub(lambda e: MYSQL_ESCAPES.get(e[1], e[1]) if e[1] else "'", inner)
        return inner.replace("''", "'") if "'" in inner else inner


def _plain_name(token: str) -> str:
    q = token[:1]
    return token[1:-1].replace(q + q, q) if q in "`\"" and len(token) > 2 and token.endswith(q) else token


class Literals:
    """Lists of literals by columns, which is far faster than row by row."""

    def __init__(self):
        self.kinds: list[str] = []
        self.texts: list[str | None] = []
        self.raws: list[bytes | None] = []
        self.offsets, self.missing = [0], []

    def add(self, kind: str, text: str | None, raw: bytes | None) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.raws.append(raw)

    def end(self, missing: bool = False) -> None:
        self.offsets.append(len(self.kinds))
        self.missing.append(missing)

    def array(self) -> pa.Array:
        fields = [pa.array(self.kinds, pa.string()), pa.array(self.texts, pa.string()), pa.array(self.raws, pa.binary())]
        struct = pa.StructArray.from_arrays(fields, ["kind", "text", "bytes"])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), struct, mask=pa.array(self.missing, pa.bool_()))


def _batch(rows: list[tuple], literals: Literals | None, schema: pa.Schema) -> pa.RecordBatch:
    """Rows in the order of the schema without `values`, which lies apart."""
    by_column = iter(zip(*rows))
    arrays = []
    for field in schema:
        if field.name != "values":
            arrays.append(pa.array(next(by_column), field.type))
        elif literals is not None:
            arrays.append(literals.array())
        else:
            arrays.append(pa.nulls(len(rows), field.type))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _scan(
    batches: Iterator[pa.RecordBatch], scanner: Scanner, texts: bool, values: bool, split: bool
) -> Iterator[pa.RecordBatch]:
    shape = to_arrow_schema(_SCANNED)
    for part in sliced(batches):
        plain = _plain_rows(part, scanner, texts, values, shape) if split else None
        if plain is None:
            yield from (found for found, _ in _scan_each(part, scanner, texts, values, split, shape))
        elif plain[2].all():
            yield plain[0]
        else:
            # both kinds in the order of their statements
            rows, owners, good = plain
            left = np.flatnonzero(~good)
            others = list(_scan_each(part.take(pa.array(left)), scanner, texts, values, split, shape))
            order = np.argsort(np.concatenate([owners, *(left[o] for _, o in others)]), kind="stable")
            whole = pa.Table.from_batches([rows, *(found for found, _ in others)]).take(pa.array(order))
            yield from whole.combine_chunks().to_batches()


def _scan_each(
    part: pa.RecordBatch, scanner: Scanner, texts: bool, values: bool, split: bool, shape: pa.Schema
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of any statements, one by one, and the place in `part` of the statement of each row."""
    rows: list[tuple] = []
    owners: list[int] = []
    literals = Literals() if values else None
    chars = 0
    for place, (dump, number, kind, sql, fault, first) in enumerate(zip(*[c.to_pylist() for c in part.columns])):
        head = scanner.head.match(sql) if kind == "insert" and sql is not None else None
        if head is None or scanner.is_upsert(sql):
            rows.append((dump, number, kind, sql, fault, None, None, None, None, None, None, None))
            if values:
                literals.end(missing=True)
            chars += 64 + len(sql or "")
        else:
            before, table, columns = scanner.read_head(head[0])
            start = at = head.end()
            row_no, joined = 0, []
            for begin, to in scanner.tuples(sql, at):
                text = sql[begin:to]
                if split:
                    shown = text if texts else None
                    rows.append((dump, number, kind, None, None, table, columns, before, first + row_no, shown, 1, None))
                    if values:
                        scanner.values(text, literals)
                    chars += 64 + to - begin
                else:
                    joined.append(text)
                row_no, at = row_no + 1, to
                if chars > _BATCH_CHARS:
                    owners += [place] * (len(rows) - len(owners))
                    yield _batch(rows, literals, shape), np.array(owners)
                    rows, owners, literals, chars = [], [], Literals() if values else None, 0
            if joined:
                rows.append((dump, number, kind, None, None, table, columns, before, first, ", ".join(joined), len(joined), None))
                chars += at
            rest = scanner.rest(sql, at) if at < len(sql) else None
            if at == start and rest is None:
                rest = ""
            if rest is not None:
                rows.append((dump, number, kind, None, None, table, columns, before, None, None, None, rest))
                chars += len(rest)
            if values:
                for _ in range(bool(joined) + (rest is not None)):
                    literals.end(missing=True)
        owners += [place] * (len(rows) - len(owners))
        if chars > _BATCH_CHARS:
            yield _batch(rows, literals, shape), np.array(owners)
            rows, owners, literals, chars = [], [], Literals() if values else None, 0
    if rows:
        yield _batch(rows, literals, shape), np.array(owners)


# Statements of a slice are cut together up to this many bytes; a longer one is cut by itself, row by row.
_TOGETHER_BYTES = 4_000_000
_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_MARKS = np.isin(np.arange(256), list(b"'(),\\\"`"))
_QUOTE, _OPEN, _CLOSE, _COMMA, _BACKSLASH = b"'(),\\"
_NUMBERS = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\z"


def _shifted(x: np.ndarray, by: int, fill) -> np.ndarray:
    """The element before (1) or behind (-1) each element."""
    out = np.full_like(x, fill)
    out[max(by, 0) : len(x) + min(by, 0)] = x[max(-by, 0) : len(x) - max(by, 0)]
    return out


def _slices_of(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The stretches of `text` as strings; null where not `valid`."""
    lengths = stops - starts if valid is None else np.where(valid, stops - starts, 0)
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(starts), [bits, pa.py_buffer(offsets), pa.py_buffer(text[place])])


def _plain_rows(
    part: pa.RecordBatch, scanner: Scanner, texts: bool, values: bool, shape: pa.Schema
) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray] | None:
    """Rows of the plain statements of `part`, the place of each one's statement, and which statements are plain.

    Plain ones share the head of the first INSERT, and their list is whole rows and nothing else. Where values are
    asked for, these are numbers, NULL and quoted texts without a quote or a backslash inside. All of them are cut at once,
    by the places of their marks; the others are left to the scanner, which gives the same rows for either.
    """
    kinds, sql = part.column("kind"), part.column("sql")
    inserts = pc.fill_null(pc.and_(pc.equal(kinds, "insert"), pc.is_valid(sql)), False)
    if sql.nbytes > _TOGETHER_BYTES or not inserts.true_count:
        return None
    sql = sql.cast(pa.string())
    head = scanner.head.match(sql[pc.index(inserts, True).as_py()].as_py())
    if head is None or "duplicate" in head[0].lower():
        return None
    good = pc.and_(inserts, pc.fill_null(pc.starts_with(sql, head[0]), False))
    if not values:
        good = pc.and_not(good, pc.fill_null(pc.match_substring(sql, "duplicate", ignore_case=True), False))
    good = good.to_numpy(zero_copy_only=False).copy()

    # marks of the lists, with whether a quote is open there
    borders = np.frombuffer(sql.buffers()[1], np.int32)[sql.offset : sql.offset + len(sql) + 1].astype(np.int64)
    text = np.frombuffer(sql.buffers()[2], np.uint8)[borders[0] : borders[-1]]
    borders -= borders[0]
    lists, ends = borders[:-1] + len(head[0].encode()), borders[1:]
    at = np.flatnonzero(_MARKS[text])
    owner = np.repeat(np.arange(len(sql)), np.diff(np.searchsorted(at, borders)))
    kept = good[owner] & (at >= lists[owner])
    at, owner = at[kept], owner[kept]
    mark = text[at]
    quote = mark == _QUOTE
    quotes = np.concatenate(([0], np.cumsum(quote)))
    limits = np.searchsorted(owner, np.arange(len(sql) + 1))
    before = quotes[limits[:-1]]
    good &= ((quotes[limits[1:]] - before) % 2 == 0) & (limits[1:] > limits[:-1])
    open_ = (quotes[1:] - before[owner]) % 2 == 1
    good[owner[(mark == _BACKSLASH) | ~(quote | open_ | (mark == _OPEN) | (mark == _CLOSE) | (mark == _COMMA))]] = False
    kept = ~quote & ~open_ & good[owner]
    at, owner, mark, quotes = at[kept], owner[kept], mark[kept], quotes[1:][kept]

    # rows begin and end as they should, with one comma between them
    opens, closes = mark == _OPEN, mark == _CLOSE
    depth = np.concatenate(([0], np.cumsum(opens.astype(np.int64) - closes)))
    depth = depth[1:] - depth[np.searchsorted(owner, owner)]
    first, last = _shifted(owner, 1, -1) != owner, _shifted(owner, -1, -1) != owner
    behind = np.where(first, lists[owner], _shifted(at, 1, 0) + 1)
    near = (at == behind) | ((at == behind + 1) & _SPACES[text[at - 1]])
    after_row, before_row = ~first & (_shifted(mark, 1, 0) == _CLOSE), ~last & (_shifted(mark, -1, 0) == _OPEN)
    between = (mark == _COMMA) & (depth == 0)
    fine = np.where(between, after_row & before_row & (_shifted(at, 1, -9) == at - 1), (depth == opens) | (mark == _COMMA) & (depth == 1))
    fine &= ~opens | (near & (first | (_shifted(between, 1, False))))
    fine &= ~closes | np.where(last, at + 1 == ends[owner], _shifted(between, -1, False))
    fine &= ~last | closes
    good[owner[~fine]] = False
    good &= np.bincount(owner, minlength=len(sql)) > 0

    listed = None
    if values:
        item = np.flatnonzero((opens | (mark == _COMMA) & (depth == 1)) & good[owner])
        of, start, stop, inner = owner[item], at[item] + 1, at[item + 1], quotes[item + 1] - quotes[item]
        for _ in range(2):
            start = start + ((start < stop) & _SPACES[text[start]])
            stop = stop - ((start < stop) & _SPACES[text[stop - 1]])
        string = (inner == 2) & (stop - start >= 2) & (text[start] == _QUOTE) & (text[stop - 1] == _QUOTE)
        null = (inner == 0) & (stop - start == 4)
        for i, letter in enumerate(b"null"):
            null[null] = text[start[null] + i] | 32 == letter
        literal = _slices_of(text, start + string, stop - string, ~null)
        other = np.flatnonzero(~string & ~null)
        number = pc.match_substring_regex(literal.take(pa.array(other)), _NUMBERS).to_numpy(zero_copy_only=False)
        good[of[other[~(number & (inner[other] == 0))]]] = False
        taken = good[of]
        if not taken.all():
            literal, of, null, string, item = literal.filter(pa.array(taken)), of[taken], null[taken], string[taken], item[taken]
        named = pa.array(["number", "string", "null"]).take(pa.array(np.where(null, 2, string.astype(np.int64))))
        fields = [named, literal, pa.nulls(len(literal), pa.binary())]
        begins = np.append(np.flatnonzero(opens[item]), len(item)).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(begins), pa.StructArray.from_arrays(fields, ["kind", "text", "bytes"]))

    rows = opens & good[owner]
    owners, starts, stops = owner[rows], at[rows], at[closes & good[owner]] + 1
    if not len(owners):
        return None
    of = pa.array(owners)
    number = np.arange(len(owners)) - np.searchsorted(owners, owners)
    firsts = pc.fill_null(part.column("first_row"), 0).to_numpy()[owners]
    before_list, table, columns = scanner.read_head(head[0])
    same = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(len(owners), np.int64)))
    given = {
        **{c: part.column(c).take(of) for c in ("dump_id", "stmt_no", "kind")},
        "table": same(table, pa.string()),
        "columns": same(columns, pa.list_(pa.string())),
        "head": same(before_list, pa.string()),
        "row_no": pa.array((firsts + number).astype(np.int32)),
        "tuple": _slices_of(text, starts, stops) if texts else None,
        "tuples": same(1, pa.int64()),
        "values": listed,
    }
    arrays = [pa.nulls(len(owners), f.type) if given.get(f.name) is None else given[f.name].cast(f.type) for f in shape]
    return pa.RecordBatch.from_arrays(arrays, names=shape.names), owners, good


# The Spark type of a storage class, and of what a MySQL name says beyond it. A number of no declared
# size, or of more digits than a decimal holds, is read as its text, which loses nothing.
CLASS_TYPES = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary", "TEXT": "string", "NUMERIC": "string"}


def spark_type(declared: str, storage_class: str | None) -> str:
    """The Spark type a declared column type is read as."""
    text = declared.strip().lower()
    if storage_class == "INTEGER" and (text.startswith("serial") or re.match(r"bigint\b.*\bunsigned\b", text)):
        return "decimal(20,0)"
    scaled = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text)
    if storage_class == "NUMERIC" and scaled and int(scaled[1]) <= 38:
        return f"decimal({scaled[1]},{scaled[2] or 0})"
    return CLASS_TYPES.get(storage_class or "TEXT", "string")


_NUMBER = r"\A\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*\z"


def _typed(value: Column, kind: str) -> tuple[Column, Column]:
    """(value of the Spark type, reason why there is none); a null has neither."""
    text, raw = value["text"], value["bytes"]
    none = F.lit(None).cast("string")
    if kind == "binary":
        return F.coalesce(raw, F.encode(text, "UTF-8")), F.when(value["kind"] == "expr", "an expression")
    decoded = F.try_validate_utf8(raw.cast("string"))
    shown = F.coalesce(text, decoded)
    if kind == "string":
        expr = F.when(value["kind"] == "expr", "an expression")
        return F.when(expr.isNull(), shown), expr.when(shown.isNull() & raw.isNotNull(), "bytes that are no text")
    is_number = F.coalesce(shown.rlike(_NUMBER), F.lit(False))
    given = (shown if kind.startswith("decimal") else text).try_cast(kind)
    expression = F.when(value["kind"] == "expr", "an expression")
    missing = given.isNull() & (shown.isNotNull() | raw.isNotNull())
    beyond, places = F.lit(f"out of the range of {kind}"), F.lit(f"more decimal places than {kind} has")
    wrong = F.lit(f"not a {kind.split('(')[0]}")
    if kind == "double":
        # what no double is near becomes an infinite one
        endless = F.coalesce((F.abs(given) == float("inf")) & is_number, F.lit(False))
        reason = expression.when(missing, F.when(is_number, beyond).otherwise(wrong)).when(endless, beyond)
        return F.when(~endless, given), reason
    if kind.startswith("decimal"):
        # digits behind the point that the type has no place for would be rounded away
        scale = int(kind[:-1].split(",")[1])
        behind = F.length(F.regexp_extract(shown, r"\.(\d*[1-9])0*\s*\z", 1)) > scale
        scaled = shown.rlike("[eE]") & (shown.try_cast("double") != given.cast("double"))
        rounded = F.coalesce(given.isNotNull() & (behind | scaled), F.lit(False))
        reason = expression.when(missing, F.when(is_number, beyond).otherwise(wrong)).when(rounded, places)
        return F.when(~rounded, given), reason
    # a whole number may be written with a point or an exponent
    wide = shown.try_cast("decimal(38,10)")
    whole = F.coalesce(given, F.when((wide == F.floor(wide)) & text.isNotNull(), wide.try_cast(kind)))
    fraction = F.coalesce(wide != F.floor(wide), F.lit(False))
    reason = expression.when(
        missing & whole.isNull(), F.when(~is_number, wrong).when(fraction, places).otherwise(beyond)
    )
    return whole, reason


# Columns of a table that are typed in one step.
_COLUMNS_AT_ONCE = 3


@dataclass(frozen=True)
class Load:
    """A table's rows, and the values among them that are not of their column's type."""

    rows: DataFrame  # dump_id, stmt_no, row_no, then the columns
    failed: DataFrame  # dump_id, stmt_no, row_no, table, column, raw, reason


def load_table(decoded: DataFrame, columns: Sequence[tuple[str, str]], table: str) -> Load:
    """One table's rows with typed columns, and every value that could not be one; `columns` gives (name, Spark type).

    Values follow the statement's column list where it has one, else their position; a value that belongs to no column of
    the table is listed too. What is listed in `failed` is null in `rows`: nothing is rounded,
    cut or lost unreported. `raw` is the value's text, or the digits of its bytes.
    """
    mine = decoded.filter(F.col("table") == table)
    whole_row = F.col("columns").isNull()

    def value(i: int) -> Column:
        named = F.array_position("columns", F.lit(columns[i][0])).cast("int") - 1
        return F.get("values", F.when(whole_row, F.lit(i)).otherwise(named))

    # values by column, then a few columns a step: a step of many would be code too long for the JVM to compile
    by_name = F.array(*[F.get("values", F.array_position("columns", F.lit(name)).cast("int") - 1) for name, _ in columns])
    rows = computed_once(mine.select("dump_id", "stmt_no", "row_no", "columns", "values"), cells=F.when(whole_row, F.col("values")).otherwise(by_name))
    cell = lambda i: F.get("cells", F.lit(i))
    for start in range(0, len(columns), _COLUMNS_AT_ONCE):
        group = range(start, min(start + _COLUMNS_AT_ONCE, len(columns)))
        rows = computed_once(rows, **{f"typed_{i}": _typed(cell(i), columns[i][1])[0] for i in group})
    rows = rows.select("dump_id", "stmt_no", "row_no", *[F.col(f"typed_{i}").alias(name) for i, (name, _) in enumerate(columns)])
    raw = lambda v: F.coalesce(v["text"], F.hex(v["bytes"]))
    checks = [
        F.struct(F.lit(name).alias("column"), raw(value(i)).alias("raw"), _typed(value(i), kind)[1].alias("reason"))
        for i, (name, kind) in enumerate(columns)
    ]
    wrong = F.filter(F.array(*checks), lambda c: c["reason"].isNotNull())
    # values for which the row, or the statement's list, names no column of the table
    known = F.array(*[F.lit(name) for name, _ in columns])
    homeless = F.filter(
        F.transform("values", lambda v, i: F.struct(
            F.get("columns", i).alias("column"), raw(v).alias("raw"),
            F.when(F.when(whole_row, i >= len(columns)).otherwise(
                ~F.coalesce(F.array_contains(known, F.get("columns", i)), F.lit(False))
            ), "no column for it").alias("reason"),
        )),
        lambda c: c["reason"].isNotNull(),
    )
    failed = mine.select("dump_id", "stmt_no", "row_no", F.lit(table).alias("table"), F.inline(F.concat(wrong, homeless)))
    return Load(rows, failed)


def failed_counts(failed: DataFrame) -> DataFrame:
    """(dump_id, table, column, reason, values, example): failures folded, with the least raw text of each kind."""
    return failed.groupBy("dump_id", "table", "column", "reason").agg(
        F.count(F.lit(1)).alias("values"), F.min("raw").alias("example")
    )


def dump_table(decoded: DataFrame, columns: Sequence[tuple[str, str]], table: str) -> DataFrame:
    """The rows of `load_table` alone; `dump_id`, `stmt_no` and `row_no` trace a value that is null in them."""
    return load_table(decoded, columns, table).rows


def statement_refusals(classified: DataFrame, dialect: str) -> DataFrame:
    """Statements that are not converted at all: (dump_id, stmt_no, reason, preview)."""
    sql = F.col("sql")
    is_insert = F.col("kind") == "insert"
    named = F.upper(F.regexp_extract(sql, r"(?i)(TRIGGER|VIEW|PROCEDURE|FUNCTION|EVENT)", 1))
    fault = F.col("fault") if "fault" in classified.columns else F.lit(None).cast("string")
    reason = (
        F.when(fault.isNotNull(), fault)
        .when(is_insert & ~has_values(sql, dialect), F.lit("INSERT with no VALUES list"))
        .when(is_insert & is_upsert(sql, dialect), F.lit("INSERT ... ON DUPLICATE KEY UPDATE is not converted"))
        .when(F.col("kind") == "object", F.concat(named, F.lit(" is not converted")))
        .when(F.col("kind") == "alter", F.lit("ALTER TABLE is not converted"))
        .when(F.col("kind") == "unrecognised", F.lit("unrecognised statement"))
    )
    return (
        computed_once(classified, reason=reason)
        .filter(F.col("reason").isNotNull())
        .select("dump_id", "stmt_no", "reason", F.coalesce(preview(sql), F.lit("")).alias("preview"))
    )


register_pickle_by_value(sys.modules[__name__])
