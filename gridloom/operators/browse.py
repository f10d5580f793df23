"""Browse any table or query result: value filters, facets, sorted pages and row counts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.cluster import quoted, resolve_column, scratch_dir
from gridloom.functions.text import cell_text

# Rows on a page and values in a facet.
PAGE_ROWS = 200
FACET_VALUES = 500

# Pages that start further down are reached by counting key ranges instead of a top-k.
TOP_K_ROWS = 100_000

Filters = Mapping[str, Sequence["str | None"]]


def value_filter(df: DataFrame, filters: Filters | None, as_text: bool = False) -> DataFrame:
    """Rows whose cell is one of the listed values, for every listed column.

    None stands for NULL and an empty list keeps nothing. Listed values are text; on a numeric
    column they are read as numbers, which keeps the filter on the scan. ``as_text`` compares the
    text of every cell instead.
    """
    for name, values in (filters or {}).items():
        column = resolve_column(df, name)
        df = df.where(_any_of(F.col(quoted(column)), df.schema[column].dataType, values, as_text))
    return df


def _any_of(column: Column, dtype: T.DataType, values: Sequence[str | None], as_text: bool) -> Column:
    listed = [v for v in values if v is not None]
    condition = F.lit(False)
    if listed:
        if isinstance(dtype, T.StringType):
            condition = column.isin(listed)
        elif isinstance(dtype, T.NumericType) and not as_text:
            numbers = [n for n in map(lambda v: _number(v, dtype), listed) if n is not None]
            condition = column.isin(numbers) if numbers else condition
        elif isinstance(dtype, T.BooleanType) and not as_text:
            flags = [v == "1" for v in listed if v in ("0", "1")]
            condition = column.isin(flags) if flags else condition
        else:
            condition = cell_text(column, dtype).isin(listed)
    if None in values:
        condition = condition | column.isNull()
    return condition


_PLAIN_NUMBER = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _number(text: str, dtype: T.DataType) -> Column | None:
    """A listed value in the column's type; None if it is no plain number or none that the type holds."""
    text = text.strip()
    if not _PLAIN_NUMBER.fullmatch(text):
        return None
    bits = _INTEGER_BITS.get(dtype.simpleString())
    if bits:
        exact = Decimal(text)
        if exact.is_nan() or abs(exact) >= 1 << 63 or exact != exact.to_integral_value():
            return None
        whole = int(exact)
        return F.lit(whole).cast(dtype) if -(1 << bits - 1) <= whole < 1 << bits - 1 else None
    if isinstance(dtype, T.DecimalType):
        return F.lit(text).try_cast(dtype)
    return F.lit(float(text)).cast(dtype)


def filtered_count(df: DataFrame, filters: Filters | None = None, as_text: bool = False) -> DataFrame:
    """One row: ``total_rows`` under the filters."""
    return value_filter(df, filters, as_text).agg(F.count("*").alias("total_rows"))


def facets(
    df: DataFrame,
    column: str,
    filters: Filters | None = None,
    search: str | None = None,
    limit: int = FACET_VALUES,
    as_text: bool = False,
) -> DataFrame:
    """Values of a column with counts, under the filters of the other columns, in order of value."""
    if limit <= 0:
        raise ValueError("A limit below one shows nothing.")
    name = resolve_column(df, column)
    others = {k: v for k, v in (filters or {}).items() if k.lower() != name.lower()}
    value = F.col(quoted(name))
    rows = value_filter(df, others, as_text).select(value.alias("value"))
    if search:
        text = cell_text(F.col("value"), df.schema[name].dataType)
        rows = rows.where(F.lower(text).contains(search.lower()))
    return rows.groupBy("value").agg(F.count("*").alias("row_count")).orderBy("value").limit(limit)


def page(
    df: DataFrame,
    sort: str | None = None,
    descending: bool = False,
    filters: Filters | None = None,
    limit: int = PAGE_ROWS,
    offset: int = 0,
    tie_break: str | None = None,
    numbered: bool = False,
    as_text: bool = False,
    top_k_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in sort order; NULL first when ascending, last otherwise.

    ``tie_break`` (a unique column, such as a row id) makes pages repeatable. A page near the top is
    a top-k. Further down, ranges of the sort key are counted first, so that no task has to hold
    all rows above the page. Without an order, rows are written down, and those of each file counted.
    """
    if limit <= 0:
        raise ValueError("A limit below one shows nothing.")
    offset = max(0, offset)
    rows = value_filter(df, filters, as_text)
    order = _order(rows, sort, descending, tie_break)
    skipped = 0
    if offset + limit > top_k_rows:
        seek = _seek if order else _seek_unsorted
        rows, skipped = seek(rows, order, offset, limit, top_k_rows)
    if order:
        rows = rows.orderBy(*[_directed(F.col(quoted(name)), down) for name, down in order])
    rows = rows.offset(offset - skipped).limit(limit)
    if numbered:
        # The window sees one page only.
        by = [_directed(F.col(quoted(name)), down) for name, down in order] or [F.lit(1)]
        rows = rows.withColumn("row_number", F.row_number().over(Window.orderBy(*by)).cast("long") + offset)
    return rows


def _order(df: DataFrame, sort: str | None, descending: bool, tie_break: str | None) -> list[tuple[str, bool]]:
    order = []
    if sort and sort.strip():
        order.append((resolve_column(df, sort), descending))
    if tie_break:
        order.append((resolve_column(df, tie_break), False))
    return order


def _directed(column: Column, descending: bool) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_first()


def _seek_unsorted(
    df: DataFrame, order: Sequence[tuple[str, bool]], offset: int, limit: int, top_k_rows: int
) -> tuple[DataFrame, int]:
    """The files that hold the page, and the number of rows before them, of rows that are written down first.

    Without an order, nothing says that two queries see rows in the same partitions; files stay as they are.
    """
    folder = scratch_dir(df.sparkSession, "page")
    df.write.parquet(folder)
    place, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    held = df.sparkSession.read.schema(df.schema).parquet(folder)
    counts = held.groupBy(place.alias("file")).count().collect()
    position, skipped, chosen = 0, 0, []
    for row in sorted(counts, key=lambda r: r["file"]):
        if position < offset + limit and position + row["count"] > offset:
            chosen.append(row["file"])
        elif not chosen:
            skipped += row["count"]
        position += row["count"]
    if not chosen:
        return df.limit(0), offset
    return held.where(place.isin(chosen)).orderBy(place, at), skipped


# Bounds that a round cuts the rows at, and sampled keys for each of them.
_RANGES = 16
_SAMPLED = 64


def _seek(
    df: DataFrame, order: Sequence[tuple[str, bool]], offset: int, limit: int, top_k_rows: int
) -> tuple[DataFrame, int]:
    """The rows of the key ranges that hold the page, and the number of rows before them.

    A bounded sample of keys gives the bounds. Rows are counted by range before the shuffle, so that
    only counts move. A range that is still too large is cut again; the tie-break splits a key that many
    rows share.
    """
    skipped, total = 0, df.count()
    while offset - skipped + limit > top_k_rows and total > top_k_rows:
        bounds = _bounds(df, order, total)
        after = [_from_bound(df, order, bound) for bound in bounds]
        number = sum((F.when(a, 1).otherwise(0) for a in after), F.lit(0))
        counts = {r["n"]: r["count"] for r in df.select(number.alias("n")).groupBy("n").count().collect()}
        position, chosen = skipped, []
        for n in range(len(bounds) + 1):
            rows = counts.get(n, 0)
            if position < offset + limit and position + rows > offset:
                chosen.append(n)
            elif not chosen:
                skipped += rows
            position += rows
        if not chosen:
            return df.limit(0), offset
        kept = sum(counts.get(n, 0) for n in chosen)
        if kept == total:
            break
        total = kept
        if chosen[0]:
            df = df.where(after[chosen[0] - 1])
        if chosen[-1] < len(bounds):
            df = df.where(~after[chosen[-1]])
    return df, skipped


def _bounds(df: DataFrame, order: Sequence[tuple[str, bool]], total: int) -> list[tuple]:
    """Distinct keys in sort order, about evenly spread, from a sample of bounded size."""
    keys = df.select(*[F.col(quoted(name)).cast("string").alias(f"s{i}") for i, (name, _) in enumerate(order)],
                     *[F.col(quoted(name)).alias(f"k{i}") for i, (name, _) in enumerate(order)])
    wanted = _RANGES * _SAMPLED
    every = max(1, total // wanted)
    picked = keys.where(F.pmod(F.xxhash64(*[f"s{i}" for i in range(len(order))], F.spark_partition_id()), F.lit(every)) == 0)
    directed = [_directed(F.col(f"k{i}"), down) for i, (_, down) in enumerate(order)]
    sample = picked.limit(4 * wanted).distinct().orderBy(*directed).select(*[f"s{i}" for i in range(len(order))]).collect()
    step = max(1, len(sample) // _RANGES)
    return [tuple(row) for row in sample[step // 2::step]]


def _from_bound(df: DataFrame, order: Sequence[tuple[str, bool]], bound: tuple) -> Column:
    """Whether a row is at a bound or after it in sort order; NULL is below every value. Never NULL."""
    at_or_after = F.lit(True)
    for (name, down), text in reversed(list(zip(order, bound))):
        key = F.col(quoted(name))
        if text is None:
            equal, after = key.isNull(), F.lit(False) if down else key.isNotNull()
        else:
            value = F.lit(text).cast(df.schema[name].dataType)
            equal = F.coalesce(key == value, F.lit(False))
            after = F.coalesce(key < value, F.lit(True)) if down else F.coalesce(key > value, F.lit(False))
        at_or_after = after | (equal & at_or_after)
    return at_or_after
