"""Source and destination compared row by row and count by count."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.functions.scale import BROADCAST_ROWS, broadcast_if_small
from siteferry.session import cut_lineage


def canonical(
    df: DataFrame,
    key: Sequence[str],
    bytes_cols: Sequence[str] = (),
    num_cols: Mapping[str, int] | Sequence[str] = (),
) -> DataFrame:
    """Keys as text, byte columns as upper-case hex, numbers as text: no reader can cut or round them.

    `num_cols` may map a column to a scale; the number is then written with exactly that many places, so
    1.5000 and 1.5 read the same. A text that is no number keeps its own spelling. Null stays null.
    """
    scales = num_cols if isinstance(num_cols, Mapping) else dict.fromkeys(num_cols)
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in key],
        *[F.hex(F.col(c).cast("binary") if t != "binary" else F.col(c)).alias(c) for c, t in _typed(df, bytes_cols)],
        *[_number_text(F.col(c), s).alias(c) for c, s in scales.items()],
    )


def _typed(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str]]:
    types = dict(df.dtypes)
    return [(c, types[c]) for c in columns]


def _number_text(c: Column, scale: int | None) -> Column:
    if scale is None:
        return c.cast("string")
    return F.coalesce(c.try_cast(f"decimal(38,{scale})").cast("string"), c.cast("string"))


def _digest(columns: Sequence[Column]) -> Column:
    """128 bits over the columns; a null is told apart from every value and from its neighbours."""
    parts = [p for c in columns for p in (c.isNull(), c)]
    return F.struct(
        F.xxhash64(F.lit(1), *parts).alias("a"),
        F.xxhash64(F.lit(2), *reversed(parts)).alias("b"),
    )


def compare_keys(expected: DataFrame, actual: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key with row counts of both sides and `state` same, changed, missing, unexpected or duplicate.

    Only keys, counts and digests are shuffled, and copies of one key are folded before the shuffle, so a
    key carrying very many rows is counted like any other.
    """
    folded, state = _fold([expected, actual], key, cols)
    return folded.select(*key, F.col("_n0").alias("expected_rows"), F.col("_n1").alias("actual_rows"), state(0, 1).alias("state"))


def _fold(sides: Sequence[DataFrame], key: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, Callable[[int, int], Column]]:
    """Rows and digest of each key on every side in one aggregate, and the state of one side held against another."""
    kinds = [dict(df.dtypes) for df in sides]
    alike = {c: len({k[c] for k in kinds}) == 1 for c in cols}
    values = [F.col(c) if alike[c] else F.col(c).cast("string") for c in cols]
    marked = [df.select(*key, F.lit(n).alias("_side"), _digest(values).alias("_d")) for n, df in enumerate(sides)]
    of = lambda n, part: F.max(F.when(F.col("_side") == n, F.col(f"_d.{part}")))
    folded = reduce(DataFrame.unionByName, marked).groupBy(*key).agg(
        *[F.count_if(F.col("_side") == n).alias(f"_n{n}") for n in range(len(sides))],
        *[of(n, part).alias(f"_{part}{n}") for n in range(len(sides)) for part in "ab"],
    )

    def state(expected: int, actual: int) -> Column:
        rows, others = F.col(f"_n{expected}"), F.col(f"_n{actual}")
        equal = (F.col(f"_a{expected}") == F.col(f"_a{actual}")) & (F.col(f"_b{expected}") == F.col(f"_b{actual}"))
        return (
            F.when((rows > 1) | (others > 1), "duplicate")
            .when((rows == 0) & (others == 0), "same")
            .when(others == 0, "missing")
            .when(rows == 0, "unexpected")
            .when(equal, "same")
            .otherwise("changed")
        )

    return folded, state


def diff_rows(
    expected: DataFrame,
    actual: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every difference as (key, column, expected, actual, is_truncated); values as upper-case hex.

    A whole-row difference has column `*`. Duplicate keys are reported, not joined. Null and the empty
    text differ. `is_truncated` says the actual bytes are a strict prefix of the expected ones. Values are
    read again only for the keys whose digests differ.
    """
    key, cols = list(key), list(cols)
    differing = cut_lineage(compare_keys(expected, actual, key, cols).filter(F.col("state") != "same"))
    changed = differing.filter(F.col("state") == "changed").select(*key)
    if changed.count() <= broadcast_rows:
        changed = F.broadcast(changed)
    ours = _join_keys(_hexed(expected, "_e", key, cols), changed, key)
    theirs = _join_keys(_hexed(actual, "_a", key, cols), changed, key)
    return _whole_rows(differing, key).unionByName(_cells(_join_keys(ours, theirs, key), key, cols))


def _whole_rows(differing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Reports of keys that one side lacks or holds more than once."""
    text = lambda value: F.lit(value)
    copies = lambda n: F.concat(n.cast("string"), F.lit(" rows"))
    state = F.col("state")
    reports = F.array(
        _whole_row(state == "missing", text("present"), text("missing")),
        _whole_row(state == "unexpected", text("absent"), text("unexpected row")),
        _whole_row((state == "duplicate") & (F.col("expected_rows") > 1), text("unique"), copies(F.col("expected_rows"))),
        _whole_row((state == "duplicate") & (F.col("actual_rows") > 1), text("unique"), copies(F.col("actual_rows"))),
    )
    return differing.select(*key, F.inline(F.filter(reports, lambda r: r.isNotNull())))


def _hexed(df: DataFrame, name: str, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.select(*key, F.struct(*[F.hex(_binary(df, c)).alias(c) for c in cols]).alias(name))


def _cells(pair: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Reports of the columns in which `_e` and `_a` differ."""
    cells = F.array(
        *[
            F.when(
                ~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")),
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"_e.{c}").alias("expected"),
                    F.col(f"_a.{c}").alias("actual"),
                    is_truncated(F.col(f"_e.{c}"), F.col(f"_a.{c}")).alias("is_truncated"),
                ),
            )
            for c in cols
        ]
    )
    return pair.select(*key, F.inline(F.filter(cells, lambda r: r.isNotNull())))


def _join_keys(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which a null key part equals a null one."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in key})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key])
    joined = left.join(named, same, how)
    if how != "full_outer":
        return joined.drop(*[f"_of_{k}" for k in key])
    rest = [c for c in joined.columns if c not in key and c not in {f"_of_{k}" for k in key}]
    return joined.select(*[F.coalesce(k, f"_of_{k}").alias(k) for k in key], *rest)


def _binary(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.col(c) if kind == "binary" else F.col(c).cast("string").cast("binary")


def _whole_row(condition: Column, expected: Column, actual: Column) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit("*").alias("column"),
            expected.alias("expected"),
            actual.alias("actual"),
            F.lit(False).alias("is_truncated"),
        ),
    )


def is_truncated(expected: Column, actual: Column) -> Column:
    """Whether `actual` is a strict prefix of `expected`."""
    return F.coalesce(
        F.startswith(expected, actual) & (F.length(actual) < F.length(expected)), F.lit(False)
    )


def diff_numeric(
    expected: DataFrame, actual: DataFrame, key: Sequence[str], cols: Sequence[str], scale: int
) -> DataFrame:
    """Differences of numbers taken at `scale` decimal places, as text; apart from the bytes above."""
    numbers = lambda df: df.select(*key, *[_number_text(F.col(c), scale).alias(c) for c in cols])
    found = diff_rows(numbers(expected), numbers(actual), key, cols)
    shown = lambda c: F.when(F.col("column") == "*", F.col(c)).otherwise(
        F.decode(F.unhex(c), "UTF-8")
    )
    return found.select(*key, "column", shown("expected").alias("expected"), shown("actual").alias("actual"))


def diff_counts(
    expected: DataFrame, actual: DataFrame, on: Sequence[str] = ("table",), n: str = "n"
) -> DataFrame:
    """Rows per table, or per dump and table, on both sides where they differ; what one side lacks counts 0 there."""
    on = list(on)
    joined = _join_keys(
        expected.select(*on, F.col(n).alias("_e")), actual.select(*on, F.col(n).alias("_a")), on, "full_outer"
    )
    return joined.select(
        *on,
        F.coalesce("_e", F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce("_a", F.lit(0)).cast("bigint").alias("actual"),
    ).filter(F.col("expected") != F.col("actual"))


def violating_structure_only(
    structure_only: DataFrame, counts: DataFrame, on: Sequence[str] = ("table",), n: str = "n"
) -> DataFrame:
    """Tables promised as schema only that still carry rows; `on` holds the dump too where there are several."""
    on = list(on)
    return _join_keys(counts.select(*on, n).filter(F.col(n) > 0), structure_only.select(*on).distinct(), on)


def diff_three(declared: DataFrame, source: DataFrame, target: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Both sides held against a declared expectation, so two readers wrong in the same way are seen.

    (key, column, expected, actual, is_truncated, side). The three are folded by one aggregate; the values of the
    declared side are read again once, for keys that either side has changed.
    """
    key, cols = list(key), list(cols)
    folded, state = _fold([declared, source, target], key, cols)
    states = [state(0, n).alias(f"_state{n}") for n in (1, 2)]
    differing = cut_lineage(
        folded.select(*key, "_n0", "_n1", "_n2", *states).filter("_state1 <> 'same' OR _state2 <> 'same'")
    )
    altered = differing.filter("_state1 = 'changed' OR _state2 = 'changed'").select(*key)
    ours = cut_lineage(_join_keys(_hexed(declared, "_e", key, cols), broadcast_if_small(altered), key))
    reports = []
    for n, (df, side) in enumerate(((source, "source"), (target, "target")), 1):
        mine = differing.select(
            *key, F.col("_n0").alias("expected_rows"), F.col(f"_n{n}").alias("actual_rows"), F.col(f"_state{n}").alias("state")
        )
        changed = broadcast_if_small(mine.filter("state = 'changed'").select(*key))
        theirs = _join_keys(_hexed(df, "_a", key, cols), changed, key)
        found = _whole_rows(mine, key).unionByName(_cells(_join_keys(theirs, ours, key), key, cols))
        reports.append(found.withColumn("side", F.lit(side)))
    return reports[0].unionByName(reports[1])


def table_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per named frame; an empty frame counts 0."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counted)
