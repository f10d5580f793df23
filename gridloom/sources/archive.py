"""ZIP archives of delimited files, read in parallel over archives and line by line."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.text import decode_bytes
from gridloom.sources.delimited import BLOCK, RAW, SOURCE, to_records

# Lines sent to the JVM at a time, so that a large entry is never held as a whole.
LINES_PER_BATCH = 20_000

LINES_SCHEMA = "archive string, entry string, line_number long, line binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives as rows of path and content; Spark's binary files hold up to 2 GB each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)


def archive_lines(archives: DataFrame) -> DataFrame:
    """Lines of every ``.csv`` entry, of any case and depth. An archive without one is an error."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield from _entry_lines(path, content)

    return archives.select("path", "content").mapInPandas(unpack, LINES_SCHEMA)


def _entry_lines(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = [e for e in archive.infolist() if not e.is_dir() and e.filename.lower().endswith(".csv")]
        if not entries:
            raise ValueError(f"ZIP archive '{path}' holds no CSV file.")
        for entry in entries:
            with archive.open(entry) as stream:
                numbers, lines = [], []
                for number, line in enumerate(stream, start=1):
                    if number == 1 and line.startswith(b"\xef\xbb\xbf"):
                        line = line[3:]
                    numbers.append(number)
                    lines.append(line.rstrip(b"\n"))
                    if len(lines) == LINES_PER_BATCH:
                        yield _frame(path, entry.filename, numbers, lines)
                        numbers, lines = [], []
                if lines:
                    yield _frame(path, entry.filename, numbers, lines)


def _frame(path: str, entry: str, numbers: list[int], lines: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"archive": path, "entry": entry, "line_number": numbers, "line": lines})


def archive_records(
    lines: DataFrame, encoding: str = "utf-8", quoted_newlines: bool = False, delimiter: str = ","
) -> DataFrame:
    """Archive lines in the shape of file records, ready for ``parse_records``.

    With ``quoted_newlines`` cells may hold line breaks; the lines of an entry are in one task, in order.
    """
    text = decode_bytes(F.col("line").cast("string"), encoding)
    located = lines.select(
        F.concat_ws("!/", "archive", "entry").alias(SOURCE), F.lit(0).cast("long").alias(BLOCK),
        F.col("line_number").alias("_row_id"), text.alias(RAW))
    if quoted_newlines:
        return to_records(located.drop("_row_id"), True, delimiter)
    return located.withColumn(RAW, F.regexp_replace(RAW, "\r$", "")).where(F.length(RAW) > 0)
