"""Ingest: map, trim and convert records, set bad ones apart, and keep a manifest.

Each file is parsed once, into a staged Parquet folder that holds good and bad rows. Everything
else here reads that folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from gridloom.cluster import compiled_in_pieces, hadoop_path, path_exists, publish
from gridloom.functions.convert import COLUMN_TYPES, DATE_FORMATS, conversion_error, convert
from gridloom.functions.text import has_padding, strip
from gridloom.sources.delimited import (
    BLOCK, ERROR, FILE_PROBLEM, HEADER_LINE, LEAD, PREAMBLE_LINE, RAW, ROW, SOURCE,
    Dialect, FileIndex, ends_inside_quotes, literal_path, parse_records, read_lines, read_records, to_records,
)
from gridloom.operators.versions import PART, Version, current, generation_of, parts_of
from gridloom.sources.dialect import EMPTY_FILE, detect, dialect_of, files_of, layouts, profile
from gridloom.sources.naming import column_names, identifier

# Column names that are made from headers never start with an underscore, so these are free.
AT = "_at"
INTERNAL = (SOURCE, BLOCK, ROW, RAW, LEAD, ERROR, PART, AT)

# Side folders of staged rows, which Spark's readers pass over: leading records that do not read like one,
# and files whose newer rows replace older ones.
PLACED, SUPERSEDED = "_leads", "_superseded"

# The table of files that could not be taken, beside the tables of layouts.
PROBLEMS = "problems"

# Fixed value: records shown before an import.
PREVIEW_ROWS = 100

# A preview stops reading after so many characters.
PREVIEW_CHARS = 4_000_000


@dataclass(frozen=True)
class ColumnMapping:
    """Which source column to take, under what name and type."""

    source_index: int
    name: str
    data_type: str = "Text"
    include: bool = True


def resolve_mappings(mappings: Sequence[ColumnMapping] | None, header: Sequence[str]) -> list[ColumnMapping]:
    """The columns to import; all of them as text when nothing is configured."""
    if mappings is None:
        return [ColumnMapping(i, name) for i, name in enumerate(header)]
    chosen = [m for m in mappings if m.include]
    faults = [f"The mapping '{m.name}' has the unknown type '{m.data_type}'." for m in chosen if m.data_type not in COLUMN_TYPES]
    faults += [f"The mapping of source column {m.source_index} is blank; name it." for m in chosen if not m.name.strip()]
    faults += [f"The mapping '{m.name}' wants source column {m.source_index} of {len(header)}." for m in chosen
               if m.source_index not in range(len(header))]
    if not chosen:
        faults.append("No mapping is included, so nothing would be imported.")
    if faults:
        raise ValueError(" ".join(faults))
    return chosen


def typed_rows(
    parsed: DataFrame,
    dialect: Dialect,
    mappings: Sequence[ColumnMapping] | None = None,
    trim: bool = True,
    date_formats: Sequence[str] = DATE_FORMATS,
    keep_rejected: bool = False,
) -> DataFrame:
    """Parsed records as typed columns with origin, ``_lead``, ``_error`` and, if needed, ``_raw``.

    Rejected rows have their raw text and no values, so that no later expression meets them,
    unless ``keep_rejected``.
    """
    chosen = resolve_mappings(mappings, dialect.header)
    names = column_names([m.name for m in chosen])
    padded = has_padding(F.col(RAW), dialect.delimiter).alias("_padded")
    texts = []
    for position, mapping in enumerate(chosen):
        cell = F.coalesce(F.col(f"_cells.c{mapping.source_index}"), F.lit(""))
        trimmed = F.when(F.col("_padded"), strip(cell)).otherwise(cell) if trim else cell
        texts.append(trimmed.alias(f"_t{position}"))
    origin = [SOURCE, BLOCK, ROW, RAW, LEAD, ERROR]
    cells = parsed.select("*", padded).select(*origin, *texts)

    typed = [m.data_type != "Text" for m in chosen]
    values = [
        convert(F.col(f"_t{i}"), m.data_type, date_formats, trimmed=trim).alias(f"_v{i}")
        for i, m in enumerate(chosen) if typed[i]
    ]
    converted = cells.select("*", *values) if values else cells
    problems = [
        conversion_error(F.col(f"_t{i}"), F.col(f"_v{i}"), m.data_type)
        for i, m in enumerate(chosen) if typed[i]
    ]
    error = F.coalesce(F.col(ERROR), *problems)
    good = F.lit(True) if keep_rejected else F.col(ERROR).isNull()
    outputs = [
        F.when(good, F.col(f"_v{i}" if typed[i] else f"_t{i}")).alias(
            name, metadata={"original_name": dialect.header[m.source_index]}
        )
        for i, (name, m) in enumerate(zip(names, chosen))
    ]
    judged = converted.withColumn(ERROR, error)
    keep_raw = F.when(F.col(ERROR).isNotNull(), F.col(RAW)).alias(RAW)
    return judged.select(SOURCE, BLOCK, ROW, LEAD, ERROR, keep_raw, *outputs)


class Staged:
    """Ingested records in a folder: the good rows, the rejected ones and the manifest.

    Which records lead a file was settled when they were staged: data has lead 0. ``placed`` lists further
    leads; ``newest`` has, for each file that was taken again, the part whose rows count.
    """

    def __init__(self, rows: DataFrame, placed: DataFrame | None = None, newest: DataFrame | None = None):
        self.rows = rows if newest is None else rows.join(newest, SOURCE, "left").where(
            F.col("_newest").isNull() | (F.col("_newest") == F.col(PART))).drop("_newest")
        self.placed = placed
        self.columns = [c for c in rows.columns if c not in INTERNAL]

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: Version | None = None) -> "Staged":
        """The rows of a folder; of a table with versions, those of the one that holds or is given."""
        folder = folder.rstrip("/")
        version = version or current(spark, folder)
        if version is None:
            side = f"{folder}/{PLACED}"
            return cls(_timed(spark.read.parquet(folder)), spark.read.parquet(side) if path_exists(spark, side) else None)
        parts, whole = parts_of(spark, folder, version), generation_of(spark, folder, version)
        found = [rows for rows in (whole, _timed(parts) if parts is not None else None) if rows is not None]
        if not found:
            raise ValueError(f"'{folder}' has no rows yet.")
        rows = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
        placed, again = parts_of(spark, folder, version, PLACED), parts_of(spark, folder, version, SUPERSEDED)
        if again is not None:
            order = F.array_position(F.array(*map(F.lit, version.parts)), F.col(PART))
            again = again.groupBy(SOURCE).agg(F.max_by(PART, order).alias("_newest"))
        return cls(rows, None if placed is None else placed.select(SOURCE, ROW), again)

    def settled(self) -> DataFrame:
        """All rows that count, with every lead marked in the row itself."""
        if self.placed is None:
            return self.rows
        marked = self.rows.join(self.placed.withColumn("_out", F.lit(True)), [SOURCE, ROW], "left")
        return marked.select(*[F.when(F.col("_out"), F.lit(HEADER_LINE)).otherwise(F.col(c)).cast("tinyint").alias(c) if c == LEAD
                               else F.col(c) for c in self.rows.columns])

    def _body(self) -> DataFrame:
        """All records but the leading ones: a filter, unless a header had other names than were asked for."""
        body = self.rows.where(F.col(LEAD) == 0)
        return body if self.placed is None else body.join(self.placed, [SOURCE, ROW], "left_anti")

    def accepted(self, origin: bool = False) -> DataFrame:
        """Rows that have all fields and convert. ``origin`` adds their file and row id."""
        extra = [SOURCE, ROW] if origin else []
        return self._body().where(F.col(ERROR).isNull()).select(*extra, *map(F.col, self.columns))

    def rejected(self) -> DataFrame:
        """Bad rows: file, record number in that file from 1, reason and raw text.

        A file that holds no records, or cannot be read, has one row without number and text.
        """
        upto = Window.partitionBy(SOURCE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        own = self.rows.where(F.col(LEAD) != FILE_PROBLEM)
        splits = own.groupBy(SOURCE, BLOCK).agg(F.min(ROW).alias("_first"), F.max(ROW).alias("_last")).select(
            SOURCE, BLOCK, "_first", F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(upto), F.lit(0)).alias("_before"))
        bad = self._body().where(F.col(ERROR).isNotNull()).select(SOURCE, BLOCK, ROW, ERROR, RAW)
        numbered = bad.join(splits, [SOURCE, BLOCK]).select(
            F.col(SOURCE).alias("source_file"),
            (F.col("_before") + F.col(ROW) - F.col("_first") + 1).alias("row_number"),
            F.col(ERROR).alias("message"),
            F.col(RAW).alias("raw_row"),
        )
        return numbered.unionByName(self.rows.where(F.col(LEAD) == FILE_PROBLEM).select(
            F.col(SOURCE).alias("source_file"), F.lit(None).cast("long").alias("row_number"),
            F.col(ERROR).alias("message"), F.lit(None).cast("string").alias("raw_row")))

    def manifest(self) -> DataFrame:
        """Per file: rows taken, rows rejected, columns, time and what is wrong with it as a whole; newest first."""
        flagged = self.rows.select(SOURCE, ROW, LEAD, ERROR, AT)
        data, bad = F.col(LEAD) == 0, F.col(ERROR).isNotNull()
        if self.placed is not None:
            flagged = flagged.join(self.placed.withColumn("_out", F.lit(True)), [SOURCE, ROW], "left")
            data = data & F.col("_out").isNull()
        return flagged.groupBy(F.col(SOURCE).alias("source_file")).agg(
            F.count_if(data & ~bad).alias("row_count"),
            F.count_if(data & bad).alias("rejected_count"),
            F.first(F.array(*map(F.lit, self.columns))).alias("column_names"),
            F.max(AT).alias("imported_at"),
            F.max(F.when(F.col(LEAD) == FILE_PROBLEM, F.col(ERROR))).alias("problem"),
        ).orderBy(F.desc("imported_at"), "source_file")


def _timed(rows: DataFrame) -> DataFrame:
    """Staged rows with the time at which they were written."""
    return rows.withColumn(AT, F.col("_metadata.file_modification_time"))


def stage(rows: DataFrame, folder: str, dialect: Dialect, files: FileIndex | None = None, side: str | None = None) -> None:
    """Write typed rows and settle which records lead their file, by their place.

    Rows that read like a header or preamble elsewhere in a file are data: they are written again as
    such, and few. A first record that is no known header, of files that have one, is listed in ``side``.
    ``files`` are those that were to be read; the ones without any record get a row that says so.
    """
    spark = rows.sparkSession
    with compiled_in_pieces(spark):
        rows.write.mode("overwrite").parquet(folder)
    staged = spark.read.schema(rows.schema).parquet(folder)
    first = first_leads(staged)
    headed = F.col("_first") == HEADER_LINE
    seen = first.agg(F.count("*").alias("files"), F.coalesce(F.sum("_doubtful"), F.lit(0)).alias("doubtful"),
                     F.count_if(headed).alias("headed")).first()
    more = []
    leads_only = seen["doubtful"] == seen["headed"] and (seen["headed"] == seen["files"] or not dialect.has_header)
    if (dialect.has_header or dialect.has_preamble) and (dialect.has_preamble or not leads_only):
        top = staged.where(F.col(BLOCK) == 0).groupBy(SOURCE).agg(
            F.min(ROW).alias("_first"), (F.min_by(LEAD, ROW) == PREAMBLE_LINE).alias("_preamble"))
        place = F.col("_first") + F.col("_preamble").cast("int")
        leads = top.select(SOURCE, F.explode(F.array_compact(F.array(
            F.when(F.col("_preamble"), F.col("_first")), place if dialect.has_header else F.lit(None).cast("long")))).alias(ROW))
        doubtful = staged.where(F.col(LEAD).isin(HEADER_LINE, PREAMBLE_LINE))
        more.append(doubtful.join(leads, [SOURCE, ROW], "left_anti").select(*[
            F.lit(0).cast("tinyint").alias(c) if c == LEAD else F.col(c) for c in rows.columns]))
        if dialect.has_header:
            # their own text was taken for data
            unlike = staged.where((F.col(BLOCK) == 0) & (F.col(LEAD) == 0)).select(SOURCE, ROW).join(leads, [SOURCE, ROW], "left_semi")
            if not unlike.isEmpty():
                unlike.write.mode("overwrite").parquet(side or f"{folder}/{PLACED}")
    if files is not None and len(files) != seen["files"]:
        empty = files.rows().join(staged.select(SOURCE).distinct(), SOURCE, "left_anti")
        more.append(problem_rows(empty.withColumn("problem", F.lit(EMPTY_FILE)), rows))
    for part in more:
        if part.limit(1).collect():
            part.coalesce(1).write.mode("append").parquet(folder)


def first_leads(staged: DataFrame) -> DataFrame:
    """Per file: ``_first``, the lead of its first record (lowest row of its first split), and ``_doubtful``, rows that lead.

    Only fixed-width minima, which hash aggregation keeps, so no task sorts its rows.
    """
    low = staged.groupBy(SOURCE).agg(F.min(BLOCK).alias(BLOCK), F.count_if(F.col(LEAD) != 0).alias("_doubtful"))
    return staged.join(F.broadcast(low), [SOURCE, BLOCK]).groupBy(SOURCE, "_doubtful").agg(
        F.min_by(LEAD, ROW).alias("_first"))


def problem_rows(files: DataFrame, like: DataFrame) -> DataFrame:
    """A row for each (file, ``problem``), in the shape of staged rows."""
    known = {SOURCE: F.col(SOURCE), BLOCK: F.lit(0).cast("long"), ROW: F.lit(-1).cast("long"),
             LEAD: F.lit(FILE_PROBLEM).cast("tinyint"), ERROR: F.col("problem")}
    return files.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def add_problems(spark: SparkSession, problems: dict[str, str], like: DataFrame, folder: str) -> None:
    """Rows for files that could not be read, added to a staged folder."""
    files = spark.createDataFrame(sorted(problems.items()), f"{SOURCE} string, problem string")
    problem_rows(files, like).coalesce(1).write.mode("append").parquet(folder)


def ingest(
    spark: SparkSession,
    paths: str | Sequence[str],
    folder: str,
    dialect: Dialect | None = None,
    mappings: Sequence[ColumnMapping] | None = None,
    trim: bool = True,
    date_formats: Sequence[str] = DATE_FORMATS,
    glob: str | None = None,
) -> Staged:
    """Read delimited files of one dialect into a new folder.

    When none is given, the first lines tell it, and UTF-8 text without line breaks in cells is
    taken for granted and checked in the same pass. Only if that proves wrong is all text profiled
    and read again.
    """
    if path_exists(spark, folder):
        raise ValueError(f"'{folder}' exists already.")
    files = FileIndex(spark, paths, glob)
    attempt = f"{folder.rstrip('/')}__attempt_{uuid.uuid4().hex}"
    try:
        if dialect is None:
            guess = detect(spark, paths, trim=trim, glob=glob, encoding="utf-8", quoted_newlines=False)
            seen = Observation()
            records = read_records(spark, paths, guess, glob).observe(
                seen, F.bool_or(~F.is_valid_utf8(F.col(RAW)) | ends_inside_quotes(F.col(RAW), guess.delimiter)).alias("unlike"))
            stage(typed_rows(parse_records(records, guess), guess, mappings, trim, date_formats), attempt, guess, files)
            dialect = detect(spark, paths, trim=trim, glob=glob) if seen.get["unlike"] else None
        if dialect is not None:
            parsed = parse_records(read_records(spark, paths, dialect, glob), dialect)
            stage(typed_rows(parsed, dialect, mappings, trim, date_formats), attempt, dialect, files)
        publish(spark, attempt, folder)
    except BaseException:
        filesystem, location = hadoop_path(spark, attempt)
        filesystem.delete(location, True)
        raise
    return Staged.open(spark, folder)


def stage_layouts(
    spark: SparkSession, paths: str | Sequence[str], folder: str, trim: bool = True, glob: str | None = None, part: str = "all"
) -> dict[str, list[str]]:
    """Detect every file's dialect and stage the files of each layout below a folder of their own.

    A layout is known by its column names and a digest of them, so that equal files that come later
    land in the same folder. Files that hold no records, or cannot be read, are listed in the table
    ``problems``. Returns the parts of each table: one for each dialect that its files have.
    """
    profiled = profile(spark, paths, trim=trim, glob=glob)
    parts: dict[str, list[str]] = {}
    for row in layouts(profiled).collect():
        names = list(row.column_names)
        name = f"{identifier('_'.join(names))}_{md5(repr(names).encode()).hexdigest()[:12]}"
        dialect = dialect_of(row)
        files = files_of(profiled, row)
        rows = parse_records(read_records(spark, [literal_path(p) for p in files], dialect), dialect)
        parts.setdefault(name, []).append(f"{part}-{len(parts.get(name, []))}")
        own = f"{PART}={parts[name][-1]}"
        if part == "all" and path_exists(spark, f"{folder}/{name}/{own}"):
            raise ValueError(f"'{folder}/{name}/{own}' exists already.")
        stage(typed_rows(rows, dialect, trim=trim), f"{folder}/{name}/{own}", dialect, side=f"{folder}/{name}/{PLACED}/{own}")
    bad = profiled.where("problem IS NOT NULL").select(F.col("source_file").alias(SOURCE), "problem")
    if bad.limit(1).collect():
        empty = spark.createDataFrame([], f"{SOURCE} string, {BLOCK} long, {ROW} long, {LEAD} tinyint, {ERROR} string, {RAW} string")
        problem_rows(bad, empty).write.mode("overwrite").parquet(f"{folder}/{PROBLEMS}/{PART}={part}")
        parts[PROBLEMS] = [part]
    return parts


def ingest_by_layout(
    spark: SparkSession, paths: str | Sequence[str], folder: str, trim: bool = True, glob: str | None = None
) -> dict[str, Staged]:
    """Files of mixed dialects, each layout in a table of its own, and the ``problems``."""
    return {name: Staged.open(spark, f"{folder}/{name}") for name in stage_layouts(spark, paths, folder, trim, glob)}


def promote(staged: Staged, mappings: Sequence[ColumnMapping] | None = None) -> DataFrame:
    """Chosen text columns of staged rows under their final names, without a second parse."""
    chosen = resolve_mappings(mappings, staged.columns)
    if any(m.data_type != "Text" for m in chosen):
        raise ValueError("Staged text can only be promoted as text; ingest the files again to convert it.")
    names = column_names([m.name for m in chosen])
    picked = [
        F.col(staged.columns[m.source_index]).alias(name, metadata={"original_name": staged.columns[m.source_index]})
        for name, m in zip(names, chosen)
    ]
    return staged.accepted().select(*picked)


def preview(
    spark: SparkSession, path: str, dialect: Dialect | None = None, rows: int = PREVIEW_ROWS, trim: bool = True
) -> DataFrame:
    """The first records of one file under its columns; ragged ones too, with their raw text.

    Only as many lines as needed are read, from the first split on. The driver holds at most
    ``PREVIEW_CHARS`` characters of them; a record that is longer is shown as far as it was read.
    """
    dialect = dialect or detect(spark, path, trim=trim, from_head=True)
    lines = read_lines(spark, path, dialect.encoding, dialect.quoted_newlines).where(F.length(RAW) > 0)
    lines = lines.withColumn(RAW, F.left(RAW, F.lit(PREVIEW_CHARS)))
    leads = int(dialect.has_header) + int(dialect.has_preamble)
    count = rows + leads
    while True:
        head = lines.take(count)
        local = spark.createDataFrame(head, lines.schema).coalesce(1)
        first = to_records(local, dialect.quoted_newlines, dialect.delimiter)
        enough = not dialect.quoted_newlines or len(head) < count or first.count() > rows + leads
        if enough or sum(len(line[RAW]) for line in head) > PREVIEW_CHARS:
            break
        count *= 4
    first = first.orderBy(ROW).offset(leads).limit(rows)
    shown = typed_rows(parse_records(first, dialect), dialect, trim=trim, keep_rejected=True)
    order = [c for c in shown.columns if c not in INTERNAL]
    return shown.select(*map(F.col, order), F.col(RAW).alias("ragged_row")).orderBy(shown[ROW])
