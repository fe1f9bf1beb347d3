"""Cheapest repair of conversation structure by the method of the Four Russians.

Role initials must read `(s?(ua)+)?`. Kept, renamed, deleted and inserted turns cost as given below, so the cost of
repairing what is left of a conversation is a vector over the four states of that pattern. Less its smallest entry such
a vector is one of a few dozen, so the step over every block of `BLOCK` turns is looked up in a table made beforehand:
(vector behind the block, block) -> (vector before it, cost). Blocks are processed from the last to the first; then
they are expanded with the vectors behind them and traced from the first turn on. As a cost is known for all that
follows, the first edit in ASCII order among the cheapest is the right one also where many repairs cost the same.

A conversation may hold a third of all rows: rows are sorted over all tasks and cut into segments of bounded size. A
segment is a map of vectors and, once the vector behind it is known, a map of states; both are folded as trees
(`functions.scan`), and each segment is then traced on its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.functions.scan import PART_PIECES, entry_states
from siteferry.llm.tokens import _held
from siteferry.session import cut_lineage

SPACE = " \t\n\x0b\f\r"

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# States of the pattern: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_ACCEPTS = (START, AFTER_A)
_KEEPS = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("a", AFTER_U): AFTER_A, ("u", AFTER_A): AFTER_U}
# A renamed or inserted turn is the user's, but the assistant's after the user's.
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_ROLE = ("user", "user", "assistant", "user")

# Symbols: role s, u, a or another, each whole or truncated; one that must go; one that stands for no turn.
_ROLES = "sua?"
MUST_GO, NOTHING = 8, 9
SYMBOLS = 10
BLOCK = 3

SEGMENT_ROWS = 4096
SEGMENT_CHARS = 4 << 20


class Tables:
    """All steps from one normalised vector to another, over single symbols and over blocks."""

    def __init__(self):
        end = self._insertions([0 if s in _ACCEPTS else None for s in range(4)])
        self.vectors = [end]
        self.end = 0
        known = {end: 0}
        to, add, choice = [], [], []
        while len(to) < len(self.vectors):
            behind = self.vectors[len(to)]
            steps = [self._step(behind, symbol) for symbol in range(SYMBOLS)]
            for vector, _, _ in steps:
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
            to.append([known[vector] for vector, _, _ in steps])
            add.append([cost for _, cost, _ in steps])
            choice.append([edits for _, _, edits in steps])
        # choice[class behind][symbol][state] is (edit, cost, state after it); at the end only insertions are left
        self.choice = choice
        self.step = to
        single, cost = np.array(to), np.array(add, dtype=np.int64)
        self.to = np.empty((len(to), SYMBOLS**BLOCK), dtype=np.int32)
        self.add = np.empty((len(to), SYMBOLS**BLOCK), dtype=np.int64)
        for number, block in enumerate(product(range(SYMBOLS), repeat=BLOCK)):
            state, total = np.arange(len(to)), np.zeros(len(to), dtype=np.int64)
            for symbol in reversed(block):
                total, state = total + cost[state, symbol], single[state, symbol]
            self.to[:, number], self.add[:, number] = state, total
        self.rows = self.to.tolist()

    @staticmethod
    def _insertions(costs: list) -> tuple:
        """Costs with insertions before the turn allowed; two are enough, as more come back to the same state."""
        for _ in range(2):
            costs = [
                min(c for c in (costs[s], None if costs[_NEXT[s]] is None else costs[_NEXT[s]] + INSERT) if c is not None)
                if costs[s] is not None or costs[_NEXT[s]] is not None else None
                for s in range(4)
            ]
        return tuple(costs)

    def _step(self, behind: tuple, symbol: int) -> tuple:
        if symbol == NOTHING:
            return behind, 0, None
        edits = []
        for state in range(4):
            options = [("D", DELETE, state)]
            if symbol != MUST_GO:
                role, extra = _ROLES[symbol // 2], TRUNCATED * (symbol % 2)
                if (role, state) in _KEEPS:
                    options.append(("K", KEEP + extra, _KEEPS[role, state]))
                options.append(("R", RENAME + extra, _NEXT[state]))
            edits.append(options)
        before = self._insertions([min(cost + behind[to] for _, cost, to in options) for options in edits])
        chosen = []
        for state, options in enumerate(edits):
            cheapest = [o for o in options if o[1] + behind[o[2]] == before[state]]
            if INSERT + before[_NEXT[state]] == before[state]:
                cheapest.append(("I", INSERT, _NEXT[state]))
            chosen.append(min(cheapest))
        least = min(before)
        return tuple(c - least for c in before), least, chosen

    def blocks(self, symbols: bytes) -> list[int]:
        """The numbers of the blocks; the first is filled up in front."""
        padded = bytes([NOTHING]) * (-len(symbols) % BLOCK) + symbols
        digits = np.frombuffer(padded, dtype=np.uint8).reshape(-1, BLOCK).astype(np.int64)
        return (digits @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()

    def vector_map(self, symbols: bytes) -> tuple[list[int], list[int]]:
        """For each vector behind the symbols the one before them, and the cost between."""
        state, total = np.arange(len(self.vectors)), np.zeros(len(self.vectors), dtype=np.int64)
        for block in reversed(self.blocks(symbols)):
            total, state = total + self.add[state, block], self.to[state, block]
        return state.tolist(), total.tolist()

    def behind(self, symbols: bytes, last: int) -> list[int]:
        """The vector behind each symbol: block by block by lookup, and within a block by single steps."""
        borders = [last]
        for block in reversed(self.blocks(symbols)):
            borders.append(self.rows[borders[-1]][block])
        found = []
        size = len(symbols)
        for number, border in enumerate(borders[:-1]):
            to = size - number * BLOCK
            for i in range(to - 1, max(to - BLOCK, 0) - 1, -1):
                found.append(border)
                border = self.step[border][symbols[i]]
        return found[::-1]

    def trace(self, symbols: bytes, behind: list[int], state: int, last: bool) -> tuple[str, int, int, list]:
        """(edits, cost, state left in, per edit the role it gives: None for the turn's own)."""
        edits, total, roles = [], 0, []
        for symbol, vector in zip(symbols, behind):
            choice = self.choice[vector][symbol]
            while True:
                edit, cost, after = choice[state]
                edits.append(edit)
                total += cost
                roles.append(_ROLE[state] if edit in "IR" else None)
                state = after
                if edit != "I":
                    break
        while last and state not in _ACCEPTS:
            edits.append("I")
            total += INSERT
            roles.append(_ROLE[state])
            state = _NEXT[state]
        return "".join(edits), total, state, roles


def tables() -> Tables:
    """The tables of this process, made once."""
    held = _held()
    if "conversation tables" not in held:
        held["conversation tables"] = Tables()
    return held["conversation tables"]


def damage(conversations: DataFrame, every: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by the digest of `conv_id:turn`; nulls count as one space there.

    Remainder 0 drops a row, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the user's. A null role or
    text becomes one space; a null conv_id or turn stays.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % every
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("_kind"))
    text = (
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return (
        rows.filter(F.col("_kind") != 0)
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
        .drop("_copy")
    )


def conversation_key(conv_id) -> F.Column:
    """A text that is never null and differs where identifiers differ."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def judged_turns(rows: DataFrame) -> DataFrame:
    """(key, turn, digest, id, role, text, fault): 1 blank, 2 duplicate, 3 truncated, 0 none, the first that holds.

    Turns are ordered by turn (nulls first), then by the digest of role and text. A null role or text becomes one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select(
        conversation_key(F.col("conv_id")).alias("key"), F.col("turn").cast("bigint").alias("turn"), shown("role"), shown("text"),
    )
    named = cut_lineage(
        plain.withColumn("digest", F.md5(F.concat_ws(":", "role", "text"))).withColumn("id", F.monotonically_increasing_id())
    )
    # copies are rare, so only their first places are joined back
    first = (
        named.groupBy("key", "digest")
        .agg(F.min(F.struct("turn", "id")).alias("first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    end = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(end == "", 1)
        .when(F.coalesce(F.struct("turn", "id") != F.col("first"), F.lit(False)), 2)
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    return named.join(first, ["key", "digest"], "left").withColumn("fault", fault).drop("first")


_COUNTS = "rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint"
_SEGMENT = (
    f"key string, place bigint, whole boolean, {_COUNTS}, lo bigint, hi bigint, first_role string, last_role string, "
    "symbols binary, roles array<string>, texts array<string>"
)
_LEGAL = ("su", "ua", "au")


class _Segment:
    """Turns of one conversation that follow each other."""

    def __init__(self, key: str):
        self.key, self.chars = key, 0
        self.roles, self.texts, self.symbols = [], [], bytearray()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.lo = self.hi = None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.roles:
            self.illegal += self.roles[-1][:1] + initial not in _LEGAL
        if turn is not None:
            self.turns += turn != self.hi
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn
        kind = "sua".find(initial) if initial else -1
        self.symbols.append(MUST_GO if fault in (1, 2) else 2 * (kind if kind >= 0 else 3) + (fault == 3))
        self.faults[fault] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    def row(self, place: int, whole: bool) -> dict:
        return {
            "key": self.key, "place": place, "whole": whole, "rows": len(self.roles), "blank": self.faults[1],
            "duplicate": self.faults[2], "truncated": self.faults[3], "illegal": self.illegal, "turns": self.turns,
            "lo": self.lo, "hi": self.hi, "first_role": self.roles[0][:1], "last_role": self.roles[-1][:1],
            "symbols": bytes(self.symbols), "roles": self.roles, "texts": self.texts,
        }


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns as segments; `whole` where a conversation surely has no other."""
    part = TaskContext.get().partitionId()
    ready, weight, place, now, alone = [], 0, part << 32, None, False
    for batch in batches:
        for key, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now.key != key or len(now.roles) >= rows or now.chars >= chars:
                if now is not None:
                    ready.append(now.row(place, alone and now.key != key))
                    weight += now.chars
                    place += 1
                # the first conversation of a task may have begun in another task
                alone = now is not None and now.key != key
                now = _Segment(key)
            now.add(turn, role, text, fault)
            if weight > chars:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
                ready, weight = [], 0
    if now is not None:
        ready.append(now.row(place, False))
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def repair_conversations(
    rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS, part_pieces: int = PART_PIECES
) -> DataFrame:
    """Segments of repaired conversations from rows (conv_id, turn, role, text).

    (key, place, whole, counts of faults, lo and hi turn, first and last role, cost, audit, new_roles, new_texts): places
    order the segments of a conversation, `audit` has one initial per edit (Keep, Rerole, Delete, Insert) and the arrays
    the turns that stand after it. A null role or text becomes one space, a null conv_id is a conversation of its own,
    null turns come first, rows of one turn are ordered by digest, repeated rows are duplicates. No rows give no rows;
    other columns are left out.
    """
    spark = rows.sparkSession
    turns = judged_turns(rows).repartitionByRange("key", F.asc_nulls_first("turn"), "digest", "id")
    turns = turns.sortWithinPartitions("key", F.asc_nulls_first("turn"), "digest", "id")
    schema = _arrow(spark, _SEGMENT)
    segments = cut_lineage(
        turns.select("key", "turn", "role", "text", "fault").mapInArrow(
            lambda batches: _cut(batches, schema, segment_rows, segment_chars), _SEGMENT
        )
    )
    alone = segments.filter("whole").withColumn("state", F.lit(START)).withColumn("vector", F.lit(tables().end))
    parts = segments.filter("not whole")
    maps = parts.select("key", -F.col("place"), "symbols").mapInArrow(_vector_maps, "key string, place bigint, to array<int>, add array<bigint>")
    behind = entry_states(maps, tables().end, part_pieces)
    ahead = cut_lineage(
        parts.join(behind.select("key", (-F.col("place")).alias("place"), F.col("state").alias("vector")), ["key", "place"])
    )
    moves = ahead.select("key", "place", "symbols", "vector").mapInArrow(
        _state_maps, "key string, place bigint, to array<int>, add array<bigint>"
    )
    entered = entry_states(moves, START, part_pieces).select("key", "place", "state")
    last = ahead.groupBy("key").agg(F.max("place").alias("place")).withColumn("final", F.lit(True))
    split = ahead.join(entered, ["key", "place"]).join(last, ["key", "place"], "left").fillna({"final": False})
    names = [*segments.columns, "state", "vector", "final"]
    traced = alone.withColumn("final", F.lit(True)).select(names).unionByName(split.select(names))
    kept = [c for c in segments.columns if c not in ("symbols", "roles", "texts")]
    types = dict(segments.dtypes)
    out = ", ".join(f"{c} {types[c]}" for c in kept) + ", cost bigint, audit string, new_roles array<string>, new_texts array<string>"
    shape = _arrow(spark, out)
    return traced.mapInArrow(lambda batches: _trace(batches, kept, shape), out)


def _vector_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tables().vector_map(s) for s in batch.column(2).to_pylist()]
        yield _maps(batch, found)


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for symbols, vector in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            behind = tables().behind(symbols, vector)
            ends = [tables().trace(symbols, behind, state, False)[1:3] for state in range(4)]
            found.append(([state for _, state in ends], [cost for cost, _ in ends]))
        yield _maps(batch, found)


def _maps(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    to = pa.array([f[0] for f in found], pa.list_(pa.int32()))
    add = pa.array([f[1] for f in found], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), to, add], names=["key", "place", "to", "add"])


def _trace(batches: Iterator[pa.RecordBatch], kept: list[str], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            symbols = row["symbols"]
            behind = tables().behind(symbols, row["vector"])
            audit, cost, _, given = tables().trace(symbols, behind, row["state"], row["final"])
            roles, texts, at = [], [], 0
            for edit, role in zip(audit, given):
                if edit == "I":
                    roles.append(role)
                    texts.append("")
                    continue
                if edit != "D":
                    roles.append(role or row["roles"][at])
                    texts.append(row["texts"][at])
                at += 1
            rows.append({c: row[c] for c in kept} | {"cost": cost, "audit": audit, "new_roles": roles, "new_texts": texts})
        yield pa.RecordBatch.from_pylist(rows, schema=shape)


def repaired_turns(segments: DataFrame) -> DataFrame:
    """(key, place, number, role, text): the turns after repair, in the order of place and number."""
    pairs = F.arrays_zip(F.col("new_roles").alias("role"), F.col("new_texts").alias("text"))
    each = segments.select("key", "place", F.posexplode(pairs).alias("number", "_turn"))
    return each.select("key", "place", "number", F.col("_turn.role").alias("role"), F.col("_turn.text").alias("text"))


_SUMMARY = (
    "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def repair_summary(segments: DataFrame) -> DataFrame:
    """One row per conversation: (key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A conversation of one segment is a row already. The segments of others are sorted and fed to the digest one by one,
    as a digest has to see them in order; only the audit, which is one value of the result, is held.
    """
    segments = cut_lineage(segments)
    lines = F.zip_with("new_roles", "new_texts", lambda role, text: F.concat(role, F.lit(":"), text))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    alone = segments.filter("whole").select(
        "key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )
    shape = _arrow(segments.sparkSession, _SUMMARY)
    parts = segments.filter("not whole").withColumn("lines", lines).drop("new_roles", "new_texts")
    sorted_parts = parts.repartition("key").sortWithinPartitions("key", "place")
    return alone.unionByName(sorted_parts.mapInArrow(lambda batches: _join_segments(batches, shape), _SUMMARY))


def _join_segments(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    import hashlib

    now = None

    def done() -> pa.RecordBatch:
        gaps = 0 if now["hi"] is None else now["hi"] - now["lo"] + 1 - now["turns"]
        row = {c: now[c] for c in ("key", "blank", "duplicate", "truncated", "illegal", "cost")}
        row |= {"gaps": gaps, "audit": "".join(now["audits"]), "repaired_sha256": now["sha"].hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema=shape)

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["key"] != row["key"]:
                if now is not None:
                    yield done()
                now = row | {"sha": hashlib.sha256(), "audits": [], "any": False}
            else:
                now["illegal"] += row["illegal"] + (now["last_role"] + row["first_role"] not in _LEGAL)
                for c in ("blank", "duplicate", "truncated", "cost"):
                    now[c] += row[c]
                now["turns"] += row["turns"] - (row["lo"] is not None and row["lo"] == now["hi"])
                now["lo"] = row["lo"] if now["lo"] is None else now["lo"]
                now["hi"] = now["hi"] if row["hi"] is None else row["hi"]
                now["last_role"] = row["last_role"]
            now["audits"].append(row["audit"])
            for line in row["lines"]:
                now["sha"].update(("\n" if now["any"] else "").encode() + line.encode())
                now["any"] = True
    if now is not None:
        yield done()


register_pickle_by_value(sys.modules[__name__])
