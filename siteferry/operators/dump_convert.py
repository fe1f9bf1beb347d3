"""A dump rewritten for the other dialect, with everything refused or lost listed beside it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.functions.scale import computed_once
from siteferry.functions.sqltext import encode_string, identifier, rewrite
from siteferry.functions.text import grouped, measured_length, preview
from siteferry.operators import dump_catalog as catalog
from siteferry.operators import dump_statements as statements
from siteferry.session import cut_lineage
from siteferry.sources.dump import dialect_of

# The longest statement text the SQLite target takes, and tables exported without rows.
STATEMENT_CHARS = 100_000
STRUCTURE_ONLY = (r"^cache(_|$)", r"^sessions$", r"^watchdog$", r"^cfw_page$")


@dataclass(frozen=True)
class Conversion:
    """The frames of one conversion, over what it staged; each is lazy and can be used alone."""

    emitted: DataFrame  # dump_id, stmt_no, part_no, kind, table, sql, tuples
    over_limit: DataFrame  # dump_id, table, rows, widest
    refusals: DataFrame  # dump_id, stmt_no, reason, preview
    lossy: DataFrame  # dump_id, stmt_no, table, subject, change
    summary: DataFrame  # one row per dump


def width_audit(rows: DataFrame, limit: int | None, unit: str = "chars") -> DataFrame:
    """Rows wider than the limit and the widest, per dump and table, widest first."""
    wide = _widths(rows, unit).filter(F.col("width") > limit if _limited(limit) else F.lit(False))
    return (
        wide.groupBy("dump_id", "table")
        .agg(F.sum("tuples").alias("rows"), F.max("width").alias("widest"))
        .orderBy(F.desc("widest"))
    )


def drop_wide(rows: DataFrame, limit: int | None, unit: str = "chars") -> DataFrame:
    """The rows that fit; the definition of their table is not touched."""
    if not _limited(limit):
        return rows
    return _widths(rows, unit).filter(F.col("width") <= limit).drop("width")


def _widths(rows: DataFrame, unit: str) -> DataFrame:
    return computed_once(rows, width=measured_length(F.col("sql"), unit))


def _limited(limit: int | None) -> bool:
    return limit is not None and limit > 0


def _wide_refusals(rows: DataFrame, limit: int | None, unit: str) -> DataFrame:
    wide = _widths(rows, unit).filter(F.col("width") > limit if _limited(limit) else F.lit(False))
    reason = F.concat(
        F.lit("row too wide for "),
        "table",
        F.lit(": "),
        grouped(F.col("width")),
        F.lit(f" characters against {limit or 0:,}"),
    )
    return wide.select("dump_id", "stmt_no", reason.alias("reason"), preview(F.col("sql")).alias("preview"))


def convert(
    dump: DataFrame,
    from_: str,
    to: str,
    split_rows: bool | None = None,
    limit: int | None = None,
    unit: str = "chars",
    stage_definitions: bool = True,
) -> Conversion:
    """Converts statements (dump_id, stmt_no, sql) between `mysql` and `sqlite`.

    Rows are split and held to the statement ceiling by default into SQLite; a limit of 0 or less turns
    the ceiling off. What is not converted becomes a refusal row; `assert_none` makes that strict.

    The dump is read, classified and cut once, here: statements, rendered rows and what is left over are written to the
    shared folder, and every frame of the result reads them there. So are the items of the definitions, their columns and
    their keys, which the frames name many times over; with `stage_definitions` off they are worked out wherever a frame
    needs them, which is right for one who takes the rows alone.
    """
    from_, to = dialect_of(from_), dialect_of(to)
    if from_ == to:
        raise ValueError(f"from and to are both {from_}; there is nothing to convert")
    split_rows = to == "sqlite" if split_rows is None else split_rows
    if limit is None:
        limit = STATEMENT_CHARS if to == "sqlite" else 0
    scanned = statements.scan_statements(statements.classify(dump), from_, split=split_rows)
    rendered = computed_once(
        scanned,
        rendered=F.when(
            F.col("row_no").isNotNull(),
            F.concat(rewrite(F.col("head"), from_, to), F.lit(" VALUES "), rewrite(F.col("tuple"), from_, to), F.lit(";")),
        ),
    )
    staged = cut_lineage(rendered.drop("columns", "head", "tuple", "values"))
    classified = staged.filter(F.col("sql").isNotNull() | F.col("fault").isNotNull()).select(
        "dump_id", "stmt_no", "kind", "sql", "fault"
    )
    rows = staged.filter(F.col("row_no").isNotNull()).select(
        "dump_id", "stmt_no", F.col("row_no").alias("part_no"), F.lit("row").alias("kind"), "table",
        F.col("rendered").alias("sql"), "tuples",
    )
    stage = cut_lineage if stage_definitions else lambda df: df
    items_ = stage(catalog.table_items(classified, from_))
    mapped = stage(catalog.map_types(catalog.schema_catalog(items_), from_, to))
    keys = stage(catalog.key_catalog(items_, classified, from_))
    drops = classified.filter(F.col("kind") == "drop").select(
        "dump_id",
        "stmt_no",
        F.lit(0).alias("part_no"),
        F.lit("drop").alias("kind"),
        F.lit(None).cast("string").alias("table"),
        F.concat(rewrite(F.col("sql"), from_, to), F.lit(";")).alias("sql"),
    )
    ddl = catalog.render_ddl(mapped, keys, from_, to).unionByName(drops).withColumn("tuples", F.lit(0).cast("bigint"))
    emitted = ddl.unionByName(drop_wide(rows, limit, unit))
    if to == "mysql":
        kept = F.col("kind").isin("create_table", "insert", "drop", "create_index")
        opening = staged.filter(kept).select("dump_id").distinct().select(
            "dump_id",
            F.lit(-1).cast("bigint").alias("stmt_no"),
            F.lit(0).alias("part_no"),
            F.lit("charset").alias("kind"),
            F.lit(None).cast("string").alias("table"),
            F.lit("SET NAMES utf8mb4;").alias("sql"),
            F.lit(0).cast("bigint").alias("tuples"),
        )
        emitted = opening.unionByName(emitted)
    refusals = (
        statements.statement_refusals(classified, from_)
        .unionByName(statements.scanned_tails(staged))
        .unionByName(catalog.definition_refusals(classified, mapped, from_, to))
        .unionByName(_wide_refusals(rows, limit, unit))
    )
    return Conversion(
        emitted,
        width_audit(rows, limit, unit),
        refusals,
        catalog.lossy_report(mapped, keys, to),
        convert_summary(emitted, rows, refusals, unit, staged.select("dump_id")),
    )


def convert_summary(
    emitted: DataFrame, rows: DataFrame, refusals: DataFrame, unit: str = "chars", dumps: DataFrame | None = None
) -> DataFrame:
    """Per dump: statements, tables, indexes, rows, skipped, and the widest INSERT, kept or not.

    A dump listed in `dumps` has a row of zeros where nothing of it was emitted or refused. The inputs are
    folded to one small row per task and dump before anything is shuffled.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    kind = F.col("kind")
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    parts = (
        emitted.select(
            "dump_id",
            F.lit(1).cast("bigint").alias("statements"),
            one(kind == "table").alias("tables"),
            one(kind == "index").alias("indexes"),
            F.col("tuples").alias("rows"),
            zero.alias("skipped"),
            none.alias("widest"),
        )
        .unionByName(
            refusals.select(
                "dump_id", *[zero.alias(c) for c in ("statements", "tables", "indexes", "rows")],
                F.lit(1).cast("bigint").alias("skipped"), none.alias("widest"),
            )
        )
        .unionByName(
            rows.select(
                "dump_id", *[zero.alias(c) for c in ("statements", "tables", "indexes", "rows", "skipped")],
                measured_length(F.col("sql"), unit).alias("widest"),
            )
        )
    )
    if dumps is not None:
        zeros = [zero.alias(c) for c in ("statements", "tables", "indexes", "rows", "skipped")]
        parts = parts.unionByName(dumps.select("dump_id").distinct().select("dump_id", *zeros, none.alias("widest")))
    sums = [F.sum(c).alias(c) for c in ("statements", "tables", "indexes", "rows", "skipped")]
    return parts.groupBy("dump_id").agg(*sums, F.coalesce(F.max("widest"), zero).alias("widest"))


def assert_none(refusals: DataFrame) -> None:
    """Strict mode: raises when a single statement was refused."""
    first = refusals.limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['reason']}: {first[0]['preview']}")


def emitted_counts(lines: DataFrame, sql: str = "sql", by: Sequence[str] = ("dump_id",)) -> DataFrame:
    """Rows per dump and table counted off the emitted one-row INSERTs, not off any counter.

    Rows that keep the word REPLACE count too. `by` names the columns that tell dumps apart; none for bare lines.
    """
    verb = r"(?i)^(?:INSERT|REPLACE)\s+INTO\s+"
    name = F.regexp_extract(sql, verb + r'"((?:[^"]|"")+)"', 1)
    tick = F.regexp_extract(sql, verb + r"`((?:[^`]|``)+)`", 1)
    table = F.when(name != "", F.replace(name, F.lit('""'), F.lit('"'))).otherwise(
        F.replace(tick, F.lit("``"), F.lit("`"))
    )
    return (
        lines.filter(F.col(sql).rlike(verb))
        .groupBy(*by, table.alias("table"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("table") != "")
    )


def is_structure_only(table, patterns: Sequence[str] = STRUCTURE_ONLY):
    return F.coalesce(table.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def structure_only(
    emitted: DataFrame, patterns: Sequence[str] = STRUCTURE_ONLY, all_rows: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The export without the rows of regenerable tables, and the names of the tables it spared."""
    regenerable = is_structure_only(F.col("table"), patterns)
    names = emitted.filter(regenerable).select("dump_id", "table").distinct()
    if all_rows:
        return emitted, names.limit(0)
    return emitted.filter(~(regenerable & (F.col("kind") == "row"))), names


def export_envelope(
    emitted: DataFrame, limit: int = STATEMENT_CHARS, unit: str = "chars", dumps: DataFrame | None = None
) -> DataFrame:
    """Per dump: statements, characters with one newline between statements, widest, and `replayable`.

    A dump listed in `dumps` of which nothing was emitted has zeros and is replayable.
    """
    width = measured_length(F.col("sql"), unit)
    found = (
        emitted.groupBy("dump_id")
        .agg(
            F.count(F.lit(1)).alias("statements"),
            (F.sum(width) + F.count(F.lit(1)) - 1).alias("chars"),
            F.sum(F.when(F.col("kind") == "row", 1).otherwise(0)).alias("rows"),
            F.max(width).alias("max_statement_chars"),
        )
        .withColumn("replayable", F.col("max_statement_chars") <= limit)
    )
    if dumps is None:
        return found
    nothing = {c: 0 for c in ("statements", "chars", "rows", "max_statement_chars")}
    return dumps.select("dump_id").distinct().join(found, "dump_id", "left").fillna({**nothing, "replayable": True})


def write_dump(emitted: DataFrame, path: str) -> None:
    """Writes a dump as text: the charset line, then definitions, then rows in one folder per table.

    The folder of a dump is the last part of its name and a digest of the whole name, so dumps of one base name
    in different places stay apart. Rows stay in the tasks that made them, so a table holding most of the dump is written by many tasks.
    Read in the order of the folder names, the files replay.
    """
    dump = F.concat(F.regexp_extract("dump_id", r"([^/]*)/*$", 1), F.lit("-"), F.md5("dump_id"))
    named = emitted.withColumn("dump", dump)
    opening = named.filter(F.col("kind") == "charset")
    opening.select("dump", "sql").write.partitionBy("dump").text(f"{path}/0-charset")
    ddl = named.filter(F.col("kind").isin("table", "index", "drop"))
    ddl.orderBy("dump", "stmt_no", "part_no").select("dump", "sql").write.partitionBy("dump").text(f"{path}/1-definitions")
    rows = named.filter(F.col("kind") == "row").sortWithinPartitions("dump", "table", "stmt_no", "part_no")
    rows.select("dump", "table", "sql").write.partitionBy("dump", "table").text(f"{path}/2-rows")


def _sql_literal(df: DataFrame, name: str, dialect: str):
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind == "binary":
        if dialect == "sqlite":
            text = F.concat(F.lit("x'"), F.hex(c), F.lit("'"))
        else:
            text = F.when(F.octet_length(c) == 0, F.lit("''")).otherwise(F.concat(F.lit("0x"), F.hex(c)))
    elif kind == "string":
        text = encode_string(c, dialect)
    elif kind == "boolean":
        text = c.cast("int").cast("string")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        text = encode_string(c.cast("string"), dialect)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def render_rows(df: DataFrame, table: str, to: str) -> DataFrame:
    """A frame's rows as one INSERT each, (dump_id, stmt_no, part_no, kind, table, sql, tuples)."""
    values = F.concat_ws(", ", *[_sql_literal(df, c, to) for c in df.columns])
    return df.select(
        F.lit(table).alias("dump_id"),
        F.monotonically_increasing_id().alias("stmt_no"),
        F.lit(0).alias("part_no"),
        F.lit("row").alias("kind"),
        F.lit(table).alias("table"),
        F.concat(F.lit("INSERT INTO "), identifier(F.lit(table), to), F.lit(" VALUES ("), values, F.lit(");")).alias("sql"),
        F.lit(1).cast("bigint").alias("tuples"),
    )


# The column type a Spark type is declared as.
DECLARED_TYPES = {
    "mysql": {"bigint": "bigint(20)", "int": "int(11)", "double": "double", "string": "longtext", "binary": "longblob"},
    "sqlite": {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"},
}


def render_table(df: DataFrame, table: str, to: str) -> DataFrame:
    """A frame as a dump of one table: its CREATE TABLE, then its rows."""
    kinds = DECLARED_TYPES[to]
    quote = "`" if to == "mysql" else '"'
    columns = ",\n\t".join(f"{quote}{n}{quote} {kinds.get(t, kinds['string'])}" for n, t in df.dtypes)
    head = df.sparkSession.range(1).select(
        F.lit(table).alias("dump_id"),
        F.lit(-1).cast("bigint").alias("stmt_no"),
        F.lit(0).alias("part_no"),
        F.lit("table").alias("kind"),
        F.lit(table).alias("table"),
        F.lit(f"CREATE TABLE {quote}{table}{quote} (\n\t{columns}\n);").alias("sql"),
        F.lit(0).cast("bigint").alias("tuples"),
    )
    return head.unionByName(render_rows(df, table, to))
