"""Regular expressions and column expressions over the text of one SQL statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteferry.functions.text import WORD_END, js_trim

_SINGLE = {"mysql": r"'(?:[^'\\]++|\\[\s\S]|'')*+'", "sqlite": r"'(?:[^']++|'')*+'"}
_DOUBLE = {"mysql": r'"(?:[^"\\]++|\\[\s\S]|"")*+"', "sqlite": r'"(?:[^"]++|"")*+"'}
_BACKTICK = r"`(?:[^`]++|``)*+`"

# Parentheses of a table definition nest this deep at most: a pattern has to be written out to its depth. Rows of
# values, which may nest without limit, are not read by patterns.
TABLE_DEPTH = 24


def single_quoted(dialect: str) -> str:
    return _SINGLE[dialect]


def quoted(dialect: str) -> str:
    """Any quoted run of the dialect."""
    return f"{_SINGLE[dialect]}|{_DOUBLE[dialect]}|{_BACKTICK}"


def parens(dialect: str, depth: int) -> str:
    """A balanced parenthesis with quotes respected and at most `depth` further levels inside."""
    inner = rf"\((?:[^'\"`()]++|{quoted(dialect)})*+\)"
    for _ in range(depth):
        inner = rf"\((?:[^'\"`()]++|{quoted(dialect)}|{inner})*+\)"
    return inner


def top_level_items(dialect: str, depth: int) -> str:
    """One item of a list split on commas outside quotes and parentheses."""
    return rf"(?:[^'\"`(),]++|{quoted(dialect)}|{parens(dialect, depth - 1)})++"


def values_head(dialect: str) -> str:
    """Everything before the first word VALUES that stands outside quotes (group 1), with the word."""
    word = "[0-9A-Za-z_]"
    return (
        rf"\A((?:[^'\"`vV]++|{quoted(dialect)}|(?<={word})[vV]|[vV](?!(?i:alues)(?!{word})))*+)(?i:values)"
    )


def items(text: Column, dialect: str, depth: int) -> Column:
    """The trimmed, non-empty items of a comma list."""
    found = F.regexp_extract_all(text, F.lit(top_level_items(dialect, depth)), 0)
    return F.filter(F.transform(found, js_trim), lambda x: x != "")


def inside(text: Column) -> Column:
    """A parenthesised text without its outer parentheses."""
    return F.substring(text, F.lit(2), F.length(text) - 2)


# A name: quoted, with its quote doubled inside, or bare.
NAME = r"""(?:`(?:[^`]|``)+`|"(?:[^"]|"")+"|[^\s`"'(),.;]+)"""


def tokens(text: Column, dialect: str) -> Column:
    """The text as names and words, whole parentheses, literals and single marks, without the white space between."""
    return F.regexp_extract_all(text, F.lit(rf"{NAME}|{parens(dialect, TABLE_DEPTH)}|{_SINGLE[dialect]}|\S"), 0)


def plain_name(token: Column) -> Column:
    """The name that a token stands for: its quotes taken off and those inside halved."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    of = lambda q: F.replace(inner, F.lit(q + q), F.lit(q))
    closed = lambda q: F.startswith(token, F.lit(q)) & F.endswith(token, F.lit(q)) & (F.length(token) > 2)
    return F.when(closed("`"), of("`")).when(closed('"'), of('"')).otherwise(token)


def parenthesised(token: Column) -> Column:
    return F.startswith(token, F.lit("("))


def identifier(name: Column, dialect: str) -> Column:
    """A name quoted for the dialect, its own quote doubled."""
    q = "`" if dialect == "mysql" else '"'
    return F.concat(F.lit(q), F.replace(name, F.lit(q), F.lit(q + q)), F.lit(q))


# What a backslash escape stands for; any other escaped character is itself.
MYSQL_ESCAPES = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a"}


def decode_string(literal: Column, dialect: str) -> Column:
    """The value of a quoted text, quotes included in `literal`."""
    inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
    plain = F.replace(inner, F.lit("''"), F.lit("'"))
    if dialect != "mysql":
        return plain
    parts = F.regexp_extract_all(inner, F.lit(r"[^\\']++|\\[\s\S]|''|[\s\S]"), 0)

    def value(part: Column) -> Column:
        escaped = F.substring(part, 2, 1)
        decoded = escaped
        for code, meaning in MYSQL_ESCAPES.items():
            decoded = F.when(escaped == code, F.lit(meaning)).otherwise(decoded)
        return (
            F.when(part == "''", F.lit("'")).when(F.startswith(part, F.lit("\\")) & (F.length(part) > 1), decoded).otherwise(part)
        )

    return F.when(F.contains(inner, F.lit("\\")), F.array_join(F.transform(parts, value), "")).otherwise(plain)


def encode_string(value: Column, dialect: str) -> Column:
    """A value as a literal of the dialect."""
    if dialect == "sqlite":
        # a NUL would end the literal, so such a text is written as its bytes
        return F.when(
            F.contains(value, F.lit("\0")),
            F.concat(F.lit("CAST(x'"), F.lower(F.hex(F.encode(value, "UTF-8"))), F.lit("' AS TEXT)")),
        ).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(escaped, F.lit("'"), F.lit("''"))
    return F.concat(F.lit("'"), F.replace(escaped, F.lit("\0"), F.lit("\\0")), F.lit("'"))


CAST_HEX = r"CAST\(\s*[xX]'([0-9a-fA-F]*)'\s+AS\s+TEXT\s*\)"
_NAME_QUOTE = {"mysql": _BACKTICK, "sqlite": _DOUBLE["sqlite"]}


def rewrite(text: Column, source: str, target: str) -> Column:
    """Identifiers and literals re-spelled for the target; everything else stays as it is.

    A text without any character that could need it is passed through.
    """
    if source == "mysql":
        hexed = r"(?<![0-9A-Za-z_])0[xX][0-9a-fA-F]+"
        touched = r"[`\\]|0[xX]"
        tokens = rf"{_SINGLE[source]}|{_NAME_QUOTE[source]}|{hexed}|[^'`0]++|[\s\S]"
    else:
        hexed = r"[xX]'[0-9a-fA-F]*'"
        touched = r"[\"\\\x00]|[xX]'"
        tokens = rf"{CAST_HEX}|{hexed}|{_SINGLE[source]}|{_NAME_QUOTE[source]}|[^'\"xXC]++|[\s\S]"

    def name(t: Column) -> Column:
        q = "`" if source == "mysql" else '"'
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        return identifier(F.replace(inner, F.lit(q + q), F.lit(q)), target)

    def hex_literal(digits: Column) -> Column:
        if target == "sqlite":
            return F.concat(F.lit("x'"), digits, F.lit("'"))
        # an empty byte text has no hexadecimal form there; the empty text is still not null
        return F.when(digits == "", F.lit("''")).otherwise(F.concat(F.lit("0x"), digits))

    def one(t: Column) -> Column:
        long = F.length(t) > 1
        out = F.when(F.startswith(t, F.lit("'")) & long, encode_string(decode_string(t, source), target))
        out = out.when(F.startswith(t, F.lit("`" if source == "mysql" else '"')) & long, name(t))
        if source == "mysql":
            return out.when(F.rlike(t, F.lit(r"\A0[xX]")), hex_literal(F.substring(t, 3, 2**31 - 1))).otherwise(t)
        return (
            out.when(F.rlike(t, F.lit(r"\ACAST\(")), hex_literal(F.regexp_extract(t, CAST_HEX, 1)))
            .when(F.rlike(t, F.lit(r"\A[xX]'")), hex_literal(F.regexp_extract(t, r"'(.*)'", 1)))
            .otherwise(t)
        )

    respelled = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(tokens), 0), one), "")
    return F.when(text.rlike(touched), respelled).otherwise(text)


def keyword(pattern: str) -> str:
    """A pattern for words at the start of a statement, in any case."""
    return rf"(?i)\A(?:{pattern}){WORD_END}"
