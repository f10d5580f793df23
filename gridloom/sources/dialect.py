"""Dialect profile: delimiter, encoding, header, preamble and trailing columns of every file.

One pass over the text checks bytes and quotes; the first lines of each file are taken with a
per-file row limit that Spark applies before the shuffle, so no file is read in one task. The limit
counts lines with text, and grows until every file has shown three records or has ended.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.cluster import scratch_dir
from gridloom.functions.text import decode_bytes
from gridloom.sources.delimited import (
    BLOCK, RAW, SOURCE, Dialect, FileIndex, ends_inside_quotes, literal_path, open_quote_patterns,
    read_lines)
from gridloom.sources.naming import column_names, generated_names

# Candidate delimiters, best first on ties, and the lines they are counted in.
DELIMITERS = (";", ",", "\t")
DELIMITER_LINES = 5

# Names that mark a first row as a header.
HEADER_WORDS = (
    "id", "name", "nazwa", "email", "e_mail", "city", "miasto", "date", "data",
    "address", "adres", "phone", "telefon", "code", "kod", "description", "opis",
)

# Fixed value: the encoding of text that is not valid UTF-8.
FALLBACK_ENCODING = "windows-1250"

# Lines with text that usually hold the first three records; one cell may hold several lines.
HEAD_LINES = 64
# A head beyond this is a quote that does not close: an error, not a guess.
MOST_HEAD_LINES = HEAD_LINES * 16 ** 4
RECORDS = 3

EMPTY_FILE = "The file holds no records."

PROFILE_SCHEMA = (
    "source_file string, delimiter string, encoding string, has_header boolean, header_line string, "
    "has_preamble boolean, trailing_empty int, quoted_newlines boolean, "
    "source_columns array<string>, column_names array<string>, problem string, _short boolean"
)

_NUMBER = re.compile(r"^\s*[(+-]?\s*[¤]?[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*[¤]?[)+-]?\s*$")
_DATES = (
    "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y", "%Y.%m.%d", "%m.%d.%Y", "%m/%d/%y", "%Y-%m", "%Y/%m",
    "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%B %Y", "%b %Y", "%a, %d %b %Y",
)
_TIME = re.compile(r"^(\d{1,2}:\d{2}(:\d{2}(\.\d{1,7})?)?)(\s*[AaPp][Mm])?\s*(Z|GMT|[+-]\d{2}:?\d{2})?$")


def profile(
    spark: SparkSession,
    paths: str | Sequence[str],
    trim: bool = True,
    assume_header: bool = True,
    delimiter: str | None = None,
    encoding: str | None = None,
    quoted_newlines: bool | None = None,
    glob: str | None = None,
    from_head: bool = False,
) -> DataFrame:
    """One row per file. What the caller names wins over what is detected.

    Encoding and line breaks inside quotes are settled by a pass over all text; with both named, or
    ``from_head``, that pass is left out. Files without a record are listed with a ``problem``.
    """
    checks, wide = None, False
    limit = HEAD_LINES
    while True:
        facts = _head_lines(spark, paths, glob, limit)
        checked = encoding is None or quoted_newlines is None
        if checked and not from_head:
            checks = checks or _kept(_text_checks(read_lines(spark, paths, glob=glob)))
            facts = facts.join(checks, SOURCE)
        elif checked:
            facts = facts.select("*", F.forall("_lines", F.is_valid_utf8).alias("_utf8"), F.exists(
                "_lines", lambda line: _any_ends_inside(line)).alias("_odd_quotes"))
        utf16 = F.substr(F.get("_lines", F.lit(0)).cast("binary"), F.lit(1), F.lit(2)).isin(
            bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
        if encoding is None:
            named = F.when(utf16, "utf-16").when(F.col("_utf8"), "utf-8").otherwise(FALLBACK_ENCODING)
            decoded = F.when(F.col("_utf8"), F.col("_lines")).otherwise(_decoded_lines(FALLBACK_ENCODING))
        else:
            named, decoded = F.when(utf16, "utf-16").otherwise(encoding), _decoded_lines(encoding)
        if wide:
            facts, decoded = _with_utf16(spark, facts, utf16, limit), F.coalesce("_wide", decoded)
        spanning = F.col("_odd_quotes") if quoted_newlines is None else F.lit(quoted_newlines)
        facts = facts.select(
            F.col(SOURCE).alias("source_file"), named.alias("encoding"), spanning.alias("quoted_newlines"),
            decoded.alias("lines"), (F.size("_lines") >= limit).alias("more"))
        described = _kept(facts.mapInPandas(_describer(trim, assume_header, delimiter), PROFILE_SCHEMA))
        seen = described.agg(F.count("*").alias("files"), F.max(F.when(F.col("_short"), F.col("source_file"))).alias("short"),
                             F.bool_or(F.col("encoding") == "utf-16").alias("wide")).first()
        if seen["wide"] and not wide:
            wide = True
            continue
        if seen["short"] is None:
            break
        if limit >= MOST_HEAD_LINES:
            raise ValueError(f"The first {limit} lines of '{seen['short']}' hold no {RECORDS} records: a quote does not close.")
        limit *= 16
    index = FileIndex(spark, paths, glob)
    if len(index) == seen["files"]:
        return described.drop("_short")
    files = index.rows().withColumnRenamed(SOURCE, "source_file")
    return files.join(described.drop("_short"), "source_file", "left").withColumn(
        "problem", F.when(F.col("column_names").isNull(), F.coalesce("problem", F.lit(EMPTY_FILE))))


def _kept(rows: DataFrame) -> DataFrame:
    """A few facts for each file, written down, so that the files are not read again for them."""
    folder = scratch_dir(rows.sparkSession, "profile")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _describer(trim: bool, assume_header: bool, delimiter: str | None):
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([
                describe_head(row.source_file, row.encoding, bool(row.quoted_newlines), list(row.lines),
                              trim, assume_header, delimiter, bool(row.more))
                for row in batch.itertuples(index=False)
            ], columns=[f.split()[0] for f in _FIELDS])

    return describe


_FIELDS = PROFILE_SCHEMA.split(", ")


def _any_ends_inside(raw: Column) -> Column:
    """Whether a line would leave a quoted cell open, with any of the candidate delimiters.

    The delimiter is told from the head, after this pass; one that is no delimiter here can only make
    a file seem to span lines, which costs time and changes no record.
    """
    found = F.lit(False)
    for mark in DELIMITERS:
        found = found | ends_inside_quotes(raw, mark)
    return found


def _text_checks(raw: DataFrame) -> DataFrame:
    """Per file, over every line: all of it valid UTF-8, and any line that leaves a quoted cell open."""
    return raw.groupBy(SOURCE).agg(
        F.bool_and(F.is_valid_utf8(F.col(RAW))).alias("_utf8"), F.bool_or(_any_ends_inside(F.col(RAW))).alias("_odd_quotes")
    )


def _with_utf16(spark: SparkSession, facts: DataFrame, utf16: Column, limit: int) -> DataFrame:
    """The first lines of files in UTF-16, which Spark's lines cannot show, decoded in ``_wide``."""
    names = [r[0] for r in facts.where(utf16).select(SOURCE).collect()]
    lines = read_lines(spark, [literal_path(n) for n in names], "utf-16")
    return facts.join(_gathered(_tops(lines, limit)).withColumnRenamed("_lines", "_wide"), SOURCE, "left")


def _decoded_lines(encoding: str) -> Column:
    return F.transform("_lines", lambda line: F.make_valid_utf8(decode_bytes(line, encoding)))


def _head_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None, limit: int) -> DataFrame:
    """The first lines with text of every file as an array; blank ones inside a quoted cell count, too.

    A file larger than a split opens a partition of its own, and reading stops after its first
    lines. Smaller files share partitions; there a task counts the lines of every file that starts in it.
    No more than ``limit`` lines of a file are exchanged.
    """
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = F.col("_metadata.file_size")
    large = read_lines(spark, paths, glob=glob, where=size > split).withColumn(RAW, F.col(RAW).cast("binary"))

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _top_of_partition(batches, limit)

    small = _tops(read_lines(spark, paths, glob=glob, where=size <= split).where(F.col(BLOCK) == 0), limit)
    return _gathered(small.unionByName(large.mapInPandas(top, _HEAD_SCHEMA)))


def _tops(lines: DataFrame, limit: int) -> DataFrame:
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tops_of_files(batches, limit)

    return lines.select(SOURCE, F.col(RAW).cast("binary").alias(RAW)).mapInArrow(tops, _HEAD_SCHEMA)


def _gathered(heads: DataFrame) -> DataFrame:
    """The lines of each file, of which there are few, in their order."""
    line = F.struct("_n", F.col(RAW).cast("string").alias(RAW))
    return heads.groupBy(SOURCE).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x[RAW]).alias("_lines"))


_HEAD_SCHEMA = f"{SOURCE} string, _n int, {RAW} binary"


def _tops_of_files(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The first lines of every file of a partition, whose lines follow each other: a counter for each file that starts.

    Only lines that are kept become Python objects.
    """
    source, taken, quotes = None, 0, 0
    for batch in batches:
        files, numbers, kept = [], [], []
        start = 0
        ends = pc.run_end_encode(batch.column(0))
        for name, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
            if name != source:
                source, taken, quotes = name, 0, 0
            at, start = start, end
            while at < end and taken < limit:
                for line in batch.column(1).slice(at, min(2 * limit, end - at)).to_pylist():
                    at += 1
                    # a blank line counts only inside a quoted cell
                    if line or quotes % 2:
                        taken += 1
                        quotes += line.count(b'"')
                        files.append(name)
                        numbers.append(taken)
                        kept.append(line)
                        if taken == limit:
                            break
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(numbers, pa.int32()), pa.array(kept, pa.binary())], names=[SOURCE, "_n", RAW])


def _top_of_partition(batches: Iterator[pd.DataFrame], limit: int = HEAD_LINES) -> Iterator[pd.DataFrame]:
    """The first lines of a partition that starts at the top of a file; nothing of any other."""
    taken, quotes, source = 0, 0, None
    for batch in batches:
        if batch.empty:
            continue
        if source is None:
            source = batch[SOURCE].iloc[0]
            if batch[BLOCK].iloc[0] != 0:
                return
        same, kept = batch[batch[SOURCE] == source], []
        for line in same[RAW]:
            if line or quotes % 2:
                kept.append(line)
                quotes += line.count(b'"')
            if taken + len(kept) == limit:
                break
        yield pd.DataFrame({SOURCE: source, "_n": range(taken + 1, taken + len(kept) + 1), RAW: kept})
        taken += len(kept)
        if taken == limit or len(same) < len(batch):
            return


def describe_head(
    source: str, encoding: str, quoted_newlines: bool, lines: list[str],
    trim: bool, assume_header: bool, delimiter: str | None = None, more: bool = False,
) -> tuple:
    """The profile row of one file from its first lines; ``more`` says that they are not all it has."""
    mark = delimiter or _delimiter(lines)
    records = list(_first_records(lines, mark, RECORDS, more))
    if not records or more and len(records) < RECORDS:
        return (source, mark, encoding, None, None, None, None, quoted_newlines, None, None, EMPTY_FILE, bool(more))
    cells = [[c.strip() for c in r[0]] if trim else r[0] for r in records]
    texts = [r[1] for r in records]
    preamble = len(cells) > 1 and len(cells[0]) == 1 and len(cells[1]) > 1 and ":" in cells[0][0]
    if preamble:
        cells, texts = cells[1:], texts[1:]
    first, second = cells[0], cells[1] if len(cells) > 1 else None
    spare = 0 if second is None else _shared_blank_tail(first, second)
    names = first[:len(first) - spare]
    has_header = assume_header if second is None else looks_like_header(names, second[:len(second) - spare])
    source_columns = names if has_header else generated_names(len(names))
    return (
        source, mark, encoding, has_header, texts[0] if has_header else None,
        preamble, spare, quoted_newlines, source_columns, column_names(source_columns), None, False,
    )


def _shared_blank_tail(*records: Sequence[str]) -> int:
    """How many cells at the end are blank in every record; one cell of the shortest stays."""
    runs = [next((n for n, cell in enumerate(reversed(r)) if cell.strip()), len(r)) for r in records]
    return max(0, min(*runs, *(len(r) - 1 for r in records)))


def _delimiter(lines: Sequence[str]) -> str:
    sample = "".join(lines[:DELIMITER_LINES])
    best = max(DELIMITERS, key=sample.count)
    return best if sample.count(best) else ","


def _first_records(lines: Sequence[str], delimiter: str, wanted: int, more: bool = False) -> Iterator[tuple[list[str], str]]:
    """Cells and raw text of the first records; blank lines are skipped. Of ``more`` lines, only closed records count."""
    opens, stays = (re.compile(p) for p in open_quote_patterns(delimiter))
    held: list[str] = []
    for line in lines:
        if not held and not line.strip("\r"):
            continue
        inside = (stays if held else opens).match(line) is not None
        held.append(line)
        if not inside:
            yield _cells("\n".join(held), delimiter), "\n".join(held)
            held, wanted = [], wanted - 1
            if not wanted:
                return
    if held and not more:
        yield _cells("\n".join(held), delimiter), "\n".join(held)


def _cells(record: str, delimiter: str) -> list[str]:
    """The cells of a record. A quote is a mark only where it opens a cell; all others are text."""
    other = f"[^{re.escape(delimiter)}]*"
    cell = re.compile(rf'"(?P<quoted>(?:[^"]|"")*)"?(?P<after>{other})|(?P<plain>{other})')
    found, at = [], 0
    record = record.rstrip("\r")
    while True:
        part = cell.match(record, at)
        found.append(part["plain"] if part["quoted"] is None else part["quoted"].replace('""', '"') + part["after"])
        at = part.end() + 1
        if at > len(record):
            return found


def looks_like_header(first: Sequence[str], second: Sequence[str]) -> bool:
    """Names over values: every cell has a name, and one is a well-known word or stands over a value."""
    columns = list(zip(first, second, strict=False))
    named = all(name.strip() for name in first)
    if not columns or len(first) != len(second) or not named:
        return False
    known = {name.lower() for name in column_names(first)} & set(HEADER_WORDS)
    over_value = [name for name, value in columns if looks_like_value(value) and not looks_like_value(name)]
    return bool(known or over_value)


def looks_like_value(text: str) -> bool:
    """A number, a date or time, a boolean, or something with an at sign."""
    bare = text.strip()
    if "@" in text or bare.lower() in ("true", "false") or _NUMBER.match(text):
        return True
    return _is_date(bare)


def _is_date(text: str) -> bool:
    if not any(ch.isdigit() for ch in text):
        return False
    if _TIME.match(text):
        return True
    day, _, time = text.partition("T") if re.match(r"^\d{4}-\d{2}-\d{2}T", text) else (text, "", "")
    if not time:
        found = re.match(r"^(.*?\d)\s+(\d{1,2}:\d{2}.*)$", text)
        day, time = found.groups() if found else (text, "")
    if time and not _TIME.match(time):
        return False
    return any(_parses(day, pattern) for pattern in _DATES)


def _parses(text: str, pattern: str) -> bool:
    try:
        dt.datetime.strptime(text, pattern)
        return True
    except ValueError:
        return False


_LAYOUT = [f.split()[0] for f in _FIELDS if f.split()[0] not in ("source_file", "quoted_newlines", "problem", "_short")]


def layouts(profiled: DataFrame) -> DataFrame:
    """Files grouped by equal dialect and header: each group can be scanned together."""
    return profiled.where("problem IS NULL").groupBy(*_LAYOUT).agg(
        F.bool_or("quoted_newlines").alias("quoted_newlines"),
        F.count("*").alias("file_count"),
        F.min("source_file").alias("first_file"),
    )


def files_of(profiled: DataFrame, layout) -> list[str]:
    """The files of one layout, which a scan of them has to name; they come one layout at a time."""
    same = F.col("problem").isNull()
    for name in _LAYOUT:
        same = same & F.col(name).eqNullSafe(F.lit(layout[name]))
    return [row[0] for row in profiled.where(same).select("source_file").toLocalIterator()]


def dialect_of(row) -> Dialect:
    """A profile or layout row as the settings of a scan."""
    return Dialect(
        header=tuple(row.source_columns),
        delimiter=row.delimiter,
        encoding=row.encoding,
        has_header=row.has_header,
        header_line=row.header_line,
        has_preamble=row.has_preamble,
        trailing_empty=row.trailing_empty,
        quoted_newlines=row.quoted_newlines,
    )


def detect(spark: SparkSession, paths: str | Sequence[str], **options) -> Dialect:
    """The one dialect that all files with records share; files that differ must be read apart."""
    found = layouts(profile(spark, paths, **options)).orderBy("first_file").take(2)
    if not found:
        raise ValueError("None of the files holds a record.")
    if len(found) > 1:
        raise ValueError(
            f"'{found[0].first_file}' and '{found[1].first_file}' are laid out differently; "
            "ingest_by_layout reads each layout apart."
        )
    return dialect_of(found[0])
