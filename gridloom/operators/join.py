"""Equi-joins of two tables on key pairs, with chosen and safely named output columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridloom.cluster import quoted, resolve_column
from gridloom.sources.naming import first_free, numbered

INNER, LEFT, RIGHT = "inner", "left", "right"

# Rows with a NULL key are spread over this many parts of the shuffle.
_NULL_PARTS = 1024


def output_names(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names of the joined columns: a clash gets the side as prefix, then a number."""
    taken: set[str] = set()
    sides = [("left", c) for c in left] + [("right", c) for c in right]
    return [first_free(chain([column], numbered(f"{side}_{column}")), taken) for side, column in sides]


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    how: str = INNER,
    left_columns: Sequence[str] | None = None,
    right_columns: Sequence[str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Join on equal keys; NULL matches nothing. All columns of both sides unless chosen.

    The join method is Spark's choice by size, and adaptive execution splits skewed keys. On the
    side whose rows are all kept, rows with a NULL key find no partner and would meet in one task;
    a second key spreads them.
    """
    right_keys = left_keys if right_keys is None else right_keys
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("Name at least one key, and as many on the right as on the left.")
    if how not in (INNER, LEFT, RIGHT):
        raise ValueError(f"Unknown join type '{how}'.")
    left_out = [resolve_column(left, c) for c in (left.columns if left_columns is None else left_columns)]
    right_out = [resolve_column(right, c) for c in (right.columns if right_columns is None else right_columns)]
    if not left_out and not right_out:
        raise ValueError("Choose a column of either side to keep.")

    pairs = [(resolve_column(left, a), resolve_column(right, b)) for a, b in zip(left_keys, right_keys)]
    left_side = _side(left, "_l", [a for a, _ in pairs], left_out, spread=how == LEFT)
    right_side = _side(right, "_r", [b for _, b in pairs], right_out, spread=how == RIGHT)
    condition = [
        _equal(f"_lk{i}", left.schema[a].dataType, f"_rk{i}", right.schema[b].dataType)
        for i, (a, b) in enumerate(pairs)
    ]
    if how != INNER:
        condition.append(F.col("_lpart") == F.col("_rpart"))
    joined = left_side.join(right_side, condition, how)
    if ordered:
        order = [F.col(f"{side}{i}") for i in range(len(pairs)) for side in ("_lk", "_rk")]
        joined = joined.orderBy(*order)
    sources = [f"_lc{i}" for i in range(len(left_out))] + [f"_rc{i}" for i in range(len(right_out))]
    return joined.select(*[F.col(s).alias(n) for s, n in zip(sources, output_names(left_out, right_out))])


def _side(df: DataFrame, prefix: str, keys: Sequence[str], outputs: Sequence[str], spread: bool) -> DataFrame:
    """Keys and outputs under private names, so that a table can be joined with itself."""
    key_columns = [F.col(quoted(key)) for key in keys]
    out_columns = [F.col(quoted(name)) for name in outputs]
    # Zero wherever the key is complete. The other side says so by its own keys, as a plain literal
    # would be folded away and the shuffle would not see it.
    missing = reduce(Column.__or__, [key.isNull() for key in key_columns])
    spot = F.pmod(F.xxhash64(*key_columns, *out_columns), F.lit(_NULL_PARTS)).cast("int") + 1 if spread else F.lit(1)
    part = F.when(missing, spot).otherwise(0)
    return df.select(
        *[key.alias(f"{prefix}k{i}") for i, key in enumerate(key_columns)],
        *[out.alias(f"{prefix}c{i}") for i, out in enumerate(out_columns)],
        part.alias(f"{prefix}part"),
    )


def _equal(left: str, left_type: T.DataType, right: str, right_type: T.DataType) -> Column:
    """Keys of one type or both numeric compare as they are, others as text."""
    numeric = isinstance(left_type, T.NumericType) and isinstance(right_type, T.NumericType)
    if left_type == right_type or numeric:
        return F.col(left) == F.col(right)
    return F.col(left).cast("string") == F.col(right).cast("string")
