"""JSON read as VARIANT, so the type of every value stays visible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names schema_of_variant gives to JSON numbers.
NUMBER_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))$"


def parse_strict(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null.

    `try_parse_json` ignores whatever follows the first value. The text is therefore parsed as the
    only element of an array; a text with a bracket of its own is parsed once more as a member of an
    object, since only then could a stray `]` end the array early.
    """
    as_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = F.try_variant_get(as_array, "$[1]", "variant").isNull() & (
        F.try_variant_get(as_array, "$[0]", "variant").isNotNull()
    )
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    whole = ~F.contains(text, F.lit("]")) | as_member.isNotNull()
    return F.when(as_array.isNotNull() & single & whole, F.try_variant_get(as_array, "$[0]", "variant"))


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def type_of(v: Column, path: str = "$") -> Column:
    """Type name of a member: null when absent, VOID for a JSON null."""
    return F.schema_of_variant(member(v, path))


def is_object(v: Column) -> Column:
    """Told by a cast that looks at the top level only, where a schema would walk the whole value."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(type_of(v, path) == "STRING", F.lit(False))


def is_number(v: Column, path: str) -> Column:
    return F.coalesce(type_of(v, path).rlike(NUMBER_TYPES), F.lit(False))


def string_at(v: Column, path: str) -> Column:
    """The member when it is a JSON string, else null."""
    return F.when(is_string(v, path), F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """The member when it is a JSON number, else null."""
    return F.when(is_number(v, path), F.try_variant_get(v, path, "double"))
