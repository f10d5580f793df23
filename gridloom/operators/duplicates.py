"""Duplicates by key: which keys repeat, and all rows that carry them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.cluster import quoted, resolve_column


def _keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    if not keys:
        raise ValueError("Name the columns that make a duplicate.")
    return [resolve_column(df, key) for key in keys]


def _considered(df: DataFrame, keys: Sequence[str], ignore_empty: bool) -> DataFrame:
    """With ``ignore_empty``, only rows whose keys all hold more than spaces."""
    if not ignore_empty:
        return df
    for key in keys:
        df = df.where(F.trim(F.col(quoted(key)).cast("string")) != "")
    return df


def duplicate_summary(
    df: DataFrame, keys: Sequence[str], ignore_empty: bool = False, ordered: bool = True
) -> DataFrame:
    """Keys found more than once with ``duplicate_count``. NULL keys count as one group.

    Rows are counted before the shuffle, so a hot key costs one row per task.
    """
    keys = _keys(df, keys)
    columns = [F.col(quoted(key)) for key in keys]
    groups = (
        _considered(df, keys, ignore_empty)
        .groupBy(*columns)
        .agg(F.count("*").alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
    )
    return groups.orderBy(*columns) if ordered else groups


def duplicate_rows(
    df: DataFrame,
    keys: Sequence[str],
    ignore_empty: bool = False,
    ordered: bool = False,
    tie_break: str | None = None,
) -> DataFrame:
    """Every row whose key repeats. A NULL in the key matches nothing, so such rows are left out.

    The repeated keys come from a pre-aggregated pass and meet the rows in a semi join, whose skewed
    partitions Spark splits; a window over the key would put a hot key into one task.
    """
    keys = _keys(df, keys)
    present = df
    for key in keys:
        present = present.where(F.col(quoted(key)).isNotNull())
    repeated = duplicate_summary(present, keys, ignore_empty, ordered=False).select(
        *[F.col(quoted(key)).alias(f"_key{i}") for i, key in enumerate(keys)]
    )
    match = [F.col(quoted(key)) == F.col(f"_key{i}") for i, key in enumerate(keys)]
    rows = present.join(repeated, match, "left_semi")
    if not ordered:
        return rows
    order = list(keys) + ([resolve_column(df, tie_break)] if tie_break else [])
    return rows.orderBy(*[F.col(quoted(name)) for name in order])
