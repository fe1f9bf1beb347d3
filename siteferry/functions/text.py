"""Text helpers with the semantics of JavaScript strings, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript calls white space.
JS_SPACE = r" \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
JS_SPACE_CHARS = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# ASCII word boundaries; Java's own \b also looks at letters beyond ASCII.
WORD_START = r"(?<![0-9A-Za-z_])"
WORD_END = r"(?![0-9A-Za-z_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def preview(c: Column, width: int = 160) -> Column:
    """White space collapsed, trimmed, first `width` characters."""
    return F.substring(js_trim(F.regexp_replace(c, rf"[{JS_SPACE}]+", " ")), 1, width)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, which is what a JavaScript string length counts."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def measured_length(c: Column, unit: str = "chars") -> Column:
    if unit == "utf16":
        return utf16_length(c)
    if unit == "chars":
        return F.length(c).cast("bigint")
    raise ValueError(f"unknown unit {unit}; expected chars or utf16")


def grouped(c: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(c.cast("bigint"), 0)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where the pattern does not match at all."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def when_array(*pairs: tuple[Column, Column]) -> Column:
    """An array of the values whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(cond, value) for cond, value in pairs]), lambda x: x.isNotNull())
