"""Credentials found in text, reported with the value taken out, and texts freed of them."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteferry.functions.scale import broadcast_if_small, computed_once
from siteferry.functions.text import WORD_END, WORD_START, when_array
from siteferry.session import cut_lineage
from siteferry.sources.corpus import list_files, read_corpus_lines


@dataclass(frozen=True)
class Pattern:
    """A credential shape. Every matching text holds one of the `needles`, which are looked for first."""

    id: str
    kind: str
    regex: str
    needles: tuple[str, ...]
    risk: str


# Ids, kinds and the shapes looked for. A name that no value follows does not count. Boundaries are ASCII.
PATTERNS = (
    Pattern(
        "bcrypt",
        "password hash",
        r"\$2[aby]\$\d{2}\$[./A-Za-z0-9]{53}",
        ("$2",),
        "whoever has it can try passwords against it at leisure",
    ),
    Pattern(
        "hash-salt",
        "Drupal hash_salt",
        r"\$settings\['hash_salt'\]\s*=\s*'[^']+'",
        ("hash_salt",),
        "one-time logins can be forged with it",
    ),
    Pattern(
        "private-key",
        "system.private_key",
        r"system\.private_key[\s\S]{0,120}s:\d{2,}:",
        ("system.private_key",),
        "tokens of the site can be forged with it",
    ),
    Pattern(
        "db-password",
        "database password",
        r"'password'\s*=>\s*'[^']+'",
        ("'password'",),
        "lets its reader into the database",
    ),
    Pattern(
        "database-url",
        "database URL with a password",
        rf"(?i){WORD_START}(mysql|mariadb|pgsql|postgres(ql)?)://[^:@\s/]+:[^@\s/]+@",
        ("://",),
        "names server, user and password at once",
    ),
    Pattern(
        "pem",
        "private key",
        r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
        ("PRIVATE KEY-----",),
        "whoever has it is taken for its owner",
    ),
    Pattern(
        "aws-key",
        "AWS access key id",
        rf"{WORD_START}AKIA[0-9A-Z]{{16}}{WORD_END}",
        ("AKIA",),
        "half of a pair; look for the other half close by",
    ),
    Pattern(
        "cf-token",
        "Cloudflare API token",
        rf"{WORD_START}(?:CLOUDFLARE_API_TOKEN|CF_EMAIL_TOKEN)\s*[=:]\s*['\"]?[A-Za-z0-9_-]{{30,}}",
        ("CLOUDFLARE_API_TOKEN", "CF_EMAIL_TOKEN"),
        "can change what the account runs",
    ),
    # any variable whose name ends in _OWNER_TOKEN
    Pattern(
        "owner-token",
        "site owner token",
        rf"{WORD_START}[A-Z][A-Z0-9_]*_OWNER_TOKEN\s*[=:]\s*['\"]?[A-Za-z0-9_-]{{30,}}",
        ("_OWNER_TOKEN",),
        "hands over the site and all its data",
    ),
)

# The width a reported line is cut to.
REPORT_WIDTH = 200

# The one shape that may run over several lines, and what of it stands on its first line.
MULTILINE_ID = "private-key"
MULTILINE_START = r"system\.private_key"


def _near(text: Column, needles: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needles])


def _matches(text: Column, p: Pattern) -> Column:
    """Whether one pattern matches; a plain substring search spares most texts the regex."""
    return _near(text, p.needles) & text.rlike(p.regex)


def _needles(patterns: Sequence[Pattern]) -> list[str]:
    return sorted({n for p in patterns for n in p.needles})


def any_holds(text: Column, patterns: Sequence[Pattern] = PATTERNS) -> Column:
    return reduce(or_, [_matches(text, p) for p in patterns])


def redact(text: Column, patterns: Sequence[Pattern] = PATTERNS) -> Column:
    """Every match of every pattern replaced by `***`; a text without any needle is passed through."""
    by_id = sorted(patterns, key=lambda p: p.id)
    freed = reduce(lambda freed, p: F.regexp_replace(freed, p.regex, "***"), by_id, text)
    return F.when(_near(text, _needles(patterns)), freed).otherwise(text)


def _cut(line: Column) -> Column:
    return F.when(
        F.length(line) > REPORT_WIDTH, F.concat(F.substring(line, 1, REPORT_WIDTH), F.lit("..."))
    ).otherwise(line)


def scan_text(
    df: DataFrame, key: Sequence[str], text: str = "text", patterns: Sequence[Pattern] = PATTERNS
) -> DataFrame:
    """One hit per pattern and line: (key, line, id, kind, risk, redacted).

    Texts without a match are dropped before any line is made, and only lines holding a needle are made
    into rows. A match over several lines is reported on the line it begins. Values are taken out before
    the line is cut, so the cut never leaves half a value behind.
    """
    body = F.col(text)
    found = df.filter(any_holds(body, patterns)).select(*key, body.alias("_body"))
    spanning = next((p for p in patterns if p.id == MULTILINE_ID), None)
    begins = F.array().cast("array<int>") if spanning is None else _first_lines(F.col("_body"), spanning)
    numbered = F.transform(
        F.split("_body", "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("_line"))
    )
    near = F.filter(numbered, lambda l: _near(l["_line"], _needles(patterns)))
    lines = computed_once(found, _begins=begins).select(*key, "_begins", F.inline(near))
    starts = F.array_contains("_begins", F.col("line"))
    return _hits(lines.select(*key, "line", "_line", starts.alias("_starts")), key, patterns)


def _first_lines(body: Column, spanning: Pattern) -> Column:
    """The numbers of the lines on which matches of the one shape that spans lines begin."""
    tail = spanning.regex.removeprefix(MULTILINE_START)
    pieces = F.split(body, rf"{MULTILINE_START}(?={tail})", -1)
    feeds = F.transform(pieces, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    before = lambda i: F.aggregate(F.slice(feeds, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    lines = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: before(i) + 1)
    return F.when(_matches(body, spanning) & (F.size(pieces) > 1), lines).otherwise(F.array().cast("array<int>"))


# What may lie between the first line of a spanning match and its end, and how much of a block's beginning is looked at
# for the end of a match that begins in the block before. Both go on to the end of a run of digits.
HALO = 160


def scan_lines(
    lines: DataFrame, key: Sequence[str], text: str = "text", patterns: Sequence[Pattern] = PATTERNS
) -> DataFrame:
    """The same hits from a frame with one row per line (`line` is its number), for files of any size.

    Where `lines` has the `block` of each line, as `read_lines` gives it, a match over several lines is found as well,
    within a block and across the border of two; else lines are looked at one by one.
    """
    spanning = next((p for p in patterns if p.id == MULTILINE_ID), None)
    near = _near(F.col(text), _needles(patterns))
    if spanning is None or "block" not in lines.columns:
        return _hits(lines.select(*key, "line", F.col(text).alias("_line"), F.lit(False).alias("_starts")), key, patterns)
    starts = _spanning_lines(lines, key, text, spanning).withColumn("_starts", F.lit(True))
    held = lines.filter(near).select(*key, "line", F.col(text).alias("_line"))
    marked = held.join(broadcast_if_small(starts), [*key, "line"], "left").fillna({"_starts": False})
    return _hits(marked, key, patterns)


def _spanning_lines(lines: DataFrame, key: Sequence[str], text: str, pattern: Pattern) -> DataFrame:
    """(key, line) of the lines on which matches of a shape begin that may run over lines and blocks.

    One pass over the lines decides all that begins and ends in a block. What is still open at its end is joined to the
    beginning of the blocks after it; of each block that is a line or two.
    """
    # of the key, blocks need its text alone
    named = lines.select(F.to_json(F.struct(*key)).alias("_key"), *key, "block", "line", F.col(text).alias("_line"))
    seen = cut_lineage(
        named.select("_key", "block", "line", "_line").mapInArrow(
            lambda batches: _read_blocks(batches, pattern.regex), "_key string, block bigint, line bigint, what string, text string"
        )
    )
    # each block has a character at least, so this many after it hold the end of any match
    following = Window.partitionBy("_key").orderBy("block").rowsBetween(1, HALO)
    heads = seen.filter("what = 'head'").select(
        "_key", "block", F.array_join(F.collect_list("text").over(following), "\n").alias("_after")
    )
    open_ = seen.filter("what = 'open'").join(heads, ["_key", "block"])
    ended = open_.filter(F.concat("text", F.lit("\n"), "_after").rlike(rf"\A(?:{pattern.regex})")).select("_key", "line")
    found = seen.filter("what = 'match'").select("_key", "line").unionByName(ended).distinct()
    return found.select(F.from_json("_key", lines.select(*key).schema).alias("_k"), "line").select("_k.*", "line")


def _read_blocks(batches: Iterator[pa.RecordBatch], regex: str) -> Iterator[pa.RecordBatch]:
    """Per block its beginning, the lines on which matches begin, and matches still open at its end."""
    shape, start = re.compile(regex), re.compile(MULTILINE_START)
    rows: list[tuple] = []
    now, head, open_ = None, [], []

    def enough(text: str) -> bool:
        return len(text) > HALO and not text[-1].isdigit()

    def end() -> None:
        rows.append((*now, None, "head", "\n".join(head)))
        for line, text in open_:
            rows.append((*now, line, "match" if shape.match(text) else "open", text))

    for batch in batches:
        for key, block, line, text in zip(*[c.to_pylist() for c in batch.columns]):
            if now != (key, block):
                if now is not None:
                    end()
                now, head, open_ = (key, block), [], []
            if not head or not enough("\n".join(head)):
                head.append(_beginning(text))
            still = []
            for begun, before in open_:
                longer = f"{before}\n{_beginning(text)}"
                if shape.match(longer):
                    rows.append((*now, begun, "match", None))
                elif not enough(longer):
                    still.append((begun, longer))
            open_ = still
            for found in start.finditer(text):
                rest = text[found.start() :]
                if shape.match(rest):
                    rows.append((*now, line, "match", None))
                elif not enough(rest):
                    open_.append((line, rest))
        if len(rows) > 10_000:
            yield _block_rows(rows)
            rows = []
    if now is not None:
        end()
    if rows:
        yield _block_rows(rows)


def _beginning(text: str) -> str:
    """The first characters of a line, to the end of a run of digits."""
    to = HALO + 1
    while to < len(text) and text[to - 1].isdigit():
        to += 1
    return text[:to]


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["_key", "block", "line", "what", "text"]
    )


def scan_corpus(
    spark: SparkSession, roots: Sequence[str], patterns: Sequence[Pattern] = PATTERNS
) -> tuple[DataFrame, DataFrame]:
    """(report, hits) of file trees: one row per file with its number of hits, and the hits; no file is too large."""
    hits = scan_lines(read_corpus_lines(spark, roots), ["path"], patterns=patterns)
    files = list_files(spark, roots, max_bytes=None)
    # listings name local paths in another spelling than readers do
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    return scan_report(files.withColumn("path", plain), hits.withColumn("path", plain)), hits


def _hits(lines: DataFrame, key: Sequence[str], patterns: Sequence[Pattern]) -> DataFrame:
    line = F.col("_line")
    held = lambda p: _matches(line, p) | F.col("_starts") if p.id == MULTILINE_ID else _matches(line, p)
    named = lambda p: F.struct(F.lit(p.id).alias("id"), F.lit(p.kind).alias("kind"), F.lit(p.risk).alias("risk"))
    found = when_array(*[(held(p), named(p)) for p in sorted(patterns, key=lambda p: p.id)])
    freed = redact(line, patterns)
    freed = F.when(F.col("_starts"), F.regexp_replace(freed, rf"{MULTILINE_START}.*", "***")).otherwise(freed)
    told = lines.select(*key, "line", _cut(freed).alias("redacted"), F.explode(found).alias("_p"))
    return told.select(*key, "line", "redacted", "_p.id", "_p.kind", "_p.risk")


def redact_corpus(df: DataFrame, text: str = "text", patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """The corpus with every match replaced, for sharing."""
    return df.withColumn(text, redact(F.col(text), patterns))


def secret_summary(hits: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Hits and distinct texts per pattern (and per further columns of the hits)."""
    return hits.groupBy(*by, "id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct(*[F.col(k) for k in key]).alias("texts")
    )


def scan_report(files: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per file: status scanned or skipped, the reason, and its number of hits."""
    counted = hits.groupBy("path").agg(F.count(F.lit(1)).alias("hits"))
    return files.join(counted, "path", "left").withColumn(
        "hits", F.when(F.col("status") == "scanned", F.coalesce("hits", F.lit(0)))
    )


def artifact_gate(hits: DataFrame) -> DataFrame:
    """One row: `clean` is false as soon as a single hit exists."""
    return hits.limit(1).agg((F.count(F.lit(1)) == 0).alias("clean"))


register_pickle_by_value(sys.modules[__name__])
