"""Inputs of the registered queries, derived from the given tables.

Each derivation is one SELECT that Spark and a reference database both run, with the table names in
braces, so a check of a query never depends on the operator it checks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteferry.functions.scale import fill_cores
from siteferry.session import staging_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


_LISTS: dict[str, tuple[str, str]] = {}


def each(name: str, columns: tuple[str, ...], rows: tuple[tuple, ...]) -> str:
    """A mark for a derivation's FROM clause that repeats every row once per constant row.

    Spark explodes a constant array in place, so no join is made; the checking SQL joins a list of values.
    """
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    structs = ", ".join(
        "struct(" + ", ".join(f"{text(v)} AS {c}" for c, v in zip(columns, row)) + ")" for row in rows
    )
    values = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    listed = ", ".join(columns)
    _LISTS[f"@{name}@"] = (
        f"LATERAL VIEW inline(array({structs})) {name} AS {listed}",
        f"CROSS JOIN (VALUES {values}) AS {name}({listed})",
    )
    return f"@{name}@"


def _filled(select: str, form: int) -> str:
    for mark, forms in _LISTS.items():
        select = select.replace(mark, forms[form])
    return select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, select: str, heavy: bool = False) -> DataFrame:
    """Runs a derivation over the given tables it names; `heavy` work on its rows gets every core."""
    named = {n: table(spark, sf_dir, n) for n in TABLES if f"{{{n}}}" in select}
    made = spark.sql(_filled(select, 0), **named)
    return fill_cores(made) if heavy else made


def plain(select: str) -> str:
    """The same derivation with bare table names, in parentheses."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", _filled(select, 1)) + ")"


def folders(lines: DataFrame, name: str, files: int | None = 16) -> str:
    """Lines (dump, ord, line) written as one folder per dump; the folder's path.

    The files of a folder follow each other in the order of `ord`; without a number of them a folder holds one file.
    """
    path = staging_path(lines.sparkSession, f"files-{name}")
    dealt = lines.repartitionByRange(files, "dump", "ord") if files else lines.repartition("dump")
    ordered = dealt.sortWithinPartitions("dump", "ord").select("dump", F.col("line").alias("value"))
    ordered.write.partitionBy("dump").text(path)
    return path
