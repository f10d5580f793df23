"""CSV export: complete part files, written beside the target and swapped in when done."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.cluster import publish, quoted, resolve_column
from gridloom.functions.text import cell_text
from gridloom.operators.browse import Filters, value_filter

# First characters that a spreadsheet takes for a formula.
FORMULA_STARTS = ("=", "+", "-", "@")

BYTE_ORDER_MARK = "\ufeff"


def guard_formula(text: Column) -> Column:
    """Text that a spreadsheet would run gets a leading apostrophe."""
    return F.when(F.left(text, F.lit(1)).isin(*FORMULA_STARTS), F.concat(F.lit("'"), text)).otherwise(text)


def subset(df: DataFrame, columns: Sequence[str] | None = None, filters: Filters | None = None) -> DataFrame:
    """Chosen columns of the rows that pass the filters; an unknown column is an error."""
    rows = value_filter(df, filters)
    if not columns:
        return rows
    return rows.select(*[F.col(quoted(resolve_column(df, name))) for name in columns])


def export_cells(df: DataFrame, protect_formulas: bool = True) -> DataFrame:
    """Every cell as the text that is written; NULL becomes empty."""
    cells = []
    for field in df.schema.fields:
        text = F.coalesce(cell_text(F.col(quoted(field.name)), field.dataType), F.lit(""))
        cells.append((guard_formula(text) if protect_formulas else text).alias(field.name))
    return df.select(*cells)


def export_csv(
    df: DataFrame,
    target: str,
    delimiter: str = ",",
    header: bool = True,
    columns: Sequence[str] | None = None,
    filters: Filters | None = None,
    protect_formulas: bool = True,
    byte_order_mark: bool = True,
    rows_per_file: int | None = None,
) -> str:
    """Write ``target`` as a folder of CSV files, each with its own header and byte order mark.

    Cells are quoted only where the delimiter, a quote or a line break asks for it. An older folder
    of that name stays until the new one is complete. Files are written in parallel; the mark needs
    a header line to stand in.
    """
    if not target or not target.strip():
        raise ValueError("Name the folder to write to.")
    spark = df.sparkSession
    cells = export_cells(subset(df, columns, filters), protect_formulas)
    plain = not any(ch in cells.columns[0] for ch in (delimiter, '"', "\r", "\n"))
    if header and byte_order_mark and plain:
        cells = cells.withColumnRenamed(cells.columns[0], BYTE_ORDER_MARK + cells.columns[0])
    # A lone empty cell would be a blank line, which readers skip.
    empty = '""' if len(cells.columns) == 1 else ""
    attempt = f"{target.rstrip('/')}__attempt_{uuid.uuid4().hex}"
    writer = cells.write.options(
        sep=delimiter, header=header, quote='"', escape='"', nullValue="", emptyValue=empty,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(attempt)
    publish(spark, attempt, target)
    return target
