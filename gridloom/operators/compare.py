"""Compare two or more tables by key presence: one union and one aggregation, whatever their number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.cluster import quoted, resolve_column

ALL_WITH_STATUS = "all_with_status"
COMMON_ROWS = "common_rows"
LEFT_ONLY = "left_only"
RIGHT_ONLY = "right_only"
DIFFERENT_ROWS = "different_rows"
MODES = (ALL_WITH_STATUS, COMMON_ROWS, LEFT_ONLY, RIGHT_ONLY, DIFFERENT_ROWS)

# Presence is kept as bits of a long; the sign bit stays free.
_BITS = 62


def compare(
    tables: Sequence[tuple[DataFrame, Sequence[str]]],
    mode: str = ALL_WITH_STATUS,
    ordered: bool = False,
) -> DataFrame:
    """One row per distinct key over all tables, with ``in_1..in_N`` and ``status``.

    ``tables`` pairs each table with its key columns; the first one names the output. A key with a
    NULL in it is listed but found nowhere, as NULL equals nothing.
    """
    _check(tables, mode)
    names = [resolve_column(tables[0][0], key) for key in tables[0][1]]
    masks = [f"_mask{i}" for i in range((len(tables) - 1) // _BITS + 1)]
    tagged = [_tagged(df, keys, names, position, masks) for position, (df, keys) in enumerate(_aligned(tables))]
    merged = reduce(DataFrame.union, tagged)
    keys = [F.col(quoted(name)) for name in names]
    presence = merged.groupBy(*keys).agg(*[F.bit_or(mask).alias(mask) for mask in masks])

    complete = reduce(Column.__and__, [key.isNotNull() for key in keys])
    flags = [f"in_{i + 1}" for i in range(len(tables))]
    found = [
        (complete & (F.getbit(F.col(masks[i // _BITS]), F.lit(i % _BITS)) == 1)).alias(flag)
        for i, flag in enumerate(flags)
    ]
    flagged = presence.select(*keys, *found)
    count = reduce(Column.__add__, [F.col(flag).cast("int") for flag in flags])
    listed = F.concat_ws(", ", *[F.when(F.col(flag), f"file {i + 1}") for i, flag in enumerate(flags)])
    status = (
        F.when(count == 1, F.concat(F.lit("Only in: "), listed))
        .when(count == len(tables), "In all files")
        .otherwise(F.concat(F.lit("In files: "), listed))
    )
    wanted = {
        ALL_WITH_STATUS: F.lit(True),
        COMMON_ROWS: count == len(tables),
        LEFT_ONLY: (count == 1) & F.col(flags[0]),
        RIGHT_ONLY: (count == 1) & F.col(flags[1]),
        DIFFERENT_ROWS: count < len(tables),
    }[mode]
    result = flagged.where(wanted).withColumn("status", status)
    return result.orderBy(*keys) if ordered else result


def status_counts(compared: DataFrame) -> DataFrame:
    """How many keys have each status, with the number of all keys beside it."""
    counts = compared.groupBy("status").agg(F.count("*").alias("key_count"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("total_keys", F.sum("key_count").over(everything))


def _check(tables: Sequence[tuple[DataFrame, Sequence[str]]], mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"Unknown compare mode '{mode}'.")
    if len(tables) < 2:
        raise ValueError("At least two tables are needed for a comparison.")
    if len({id(df) for df, _ in tables}) != len(tables):
        raise ValueError("Each table can be compared only once.")
    widths = {len(keys) for _, keys in tables}
    if len(widths) != 1 or widths == {0}:
        raise ValueError("Every table needs the same, non-zero number of keys.")


def _aligned(tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> list[tuple[DataFrame, list[Column]]]:
    """Key columns of comparable types: Spark widens numbers, other differences become text."""
    resolved = [(df, [resolve_column(df, key) for key in keys]) for df, keys in tables]
    columns = [[F.col(quoted(key)) for key in keys] for _, keys in resolved]
    for position in range(len(columns[0])):
        kinds = {df.schema[keys[position]].dataType for df, keys in resolved}
        if len(kinds) > 1 and not all(isinstance(kind, T.NumericType) for kind in kinds):
            for keys in columns:
                keys[position] = keys[position].cast("string")
    return [(df, keys) for (df, _), keys in zip(resolved, columns)]


def _tagged(df: DataFrame, keys: Sequence[Column], names: Sequence[str], position: int, masks: Sequence[str]) -> DataFrame:
    bits = [
        F.lit(1 << position % _BITS if i == position // _BITS else 0).cast("long").alias(mask)
        for i, mask in enumerate(masks)
    ]
    return df.select(*[key.alias(name) for key, name in zip(keys, names)], *bits)
