"""Watched folders: new files are ingested by a stream, changed ones again, bad rows and bad files set apart."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.cluster import hadoop_path, list_paths
from gridloom.functions.convert import DATE_FORMATS
from gridloom.operators.ingest import (
    PART, PLACED, PROBLEMS, SUPERSEDED, ColumnMapping, Staged, add_problems, stage, stage_layouts, typed_rows)
from gridloom.operators.versions import FILES, commit, current, side_rows
from gridloom.sources.delimited import SOURCE, Dialect, FileIndex, literal_path, metadata_path, parse_records, read_records
from gridloom.sources.dialect import EMPTY_FILE

# Names of files to pick up, in any case, and how often to look, in seconds.
CSV_GLOB = "*.[cC][sS][vV]"
RESCAN_SECONDS = 15

# Files that a batch takes at most, so that the list of their paths stays short.
FILES_PER_BATCH = 1000

_FILES_SCHEMA = f"{SOURCE} string, modified timestamp, length long, reason string"

# The columns of Spark's binary file source; contents are not read unless asked for.
_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
_AS_FOUND = (f"_metadata.file_path AS {SOURCE}", "_metadata.file_modification_time AS modified", "_metadata.file_size AS length")


def _listing(reader):
    return reader.format("binaryFile").schema(_FILE_SCHEMA).option("pathGlobFilter", CSV_GLOB)


class _Inbox:
    """The files of a watched folder beside the register of those that were taken or refused.

    ``home`` is the table that has the register: a side table, keyed by path, whose last entry for a path
    says how the file was when a batch met it. It is read once for each batch, and no data with it.
    """

    def __init__(self, spark: SparkSession, folder: str, home: str):
        self.spark, self.folder, self.home = spark, folder, home

    def register(self) -> DataFrame | None:
        version = current(self.spark, self.home)
        return side_rows(self.spark, self.home, version, FILES) if version else None

    def unknown(self, most: int) -> list[Row]:
        """Files that changed after they were met, and empty ones that were not met as they are now.

        A scan gives no row for a file of no bytes, so these are taken from the folder's listing.
        """
        empty = self._empty()
        register = self.register()
        if register is None:
            return empty[:most]
        known = register.groupBy(SOURCE).agg(F.max_by(F.struct("modified", "length"), "modified").alias("_known"))
        there = _listing(self.spark.read).load(self.folder).selectExpr(*_AS_FOUND)
        if empty:
            there = there.unionByName(self.spark.createDataFrame(empty, there.schema))
        met = there.join(known, SOURCE, "left")
        changed = F.col("_known").isNotNull() & ((F.col("modified") != F.col("_known.modified")) | (F.col("length") != F.col("_known.length")))
        new_empty = F.col("_known").isNull() & (F.col("length") == 0)
        return met.where(changed | new_empty).select(there.columns).orderBy("modified", SOURCE).limit(most).collect()

    def _empty(self) -> list[Row]:
        filesystem, location = hadoop_path(self.spark, self.folder)
        found = [s for s in filesystem.listStatus(location) if s.isFile() and s.getLen() == 0 and fnmatchcase(s.getPath().getName(), CSV_GLOB)]
        if not found:
            return []
        rows = self.spark.createDataFrame(
            [(metadata_path(s.getPath().toUri().toString()), s.getModificationTime(), 0) for s in found], f"{SOURCE} string, millis long, length long")
        return rows.select(SOURCE, F.timestamp_millis("millis").alias("modified"), "length").orderBy(SOURCE).collect()

    def note(self, files: list[Row], reasons: dict[str, str], part: str) -> None:
        """Enter the files of a part in the register."""
        rows = [(f[SOURCE], f["modified"], f["length"], reasons.get(f[SOURCE])) for f in files]
        self.spark.createDataFrame(rows, _FILES_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/{FILES}/{PART}={part}")


def _watch(
    spark: SparkSession, folder: str, home: str, checkpoint: str, files_per_batch: int, once: bool,
    take: Callable[[list[str], str], None], refuse: Callable[[dict[str, str], str], None],
    replace: Callable[[list[str], str], None],
) -> StreamingQuery:
    """Hands the paths of each batch to ``take``; those that cannot be read go to ``refuse``.

    The stream carries paths only, so a file that cannot be read does not stop it. Files are tried one
    by one only after a batch has failed. Files that changed are taken again when the watch starts and
    with every batch; ``replace`` says so of their older rows, and publishes the part.
    """
    inbox = _Inbox(spark, folder, home)

    def bring(new: list[Row], batch: str) -> None:
        part = f"{batch}-{uuid.uuid4().hex[:8]}"
        known = {f[SOURCE] for f in new}
        more = [f for f in inbox.unknown(files_per_batch) if f[SOURCE] not in known]
        files = [*new, *more]
        if not files:
            return
        empty = {f[SOURCE]: EMPTY_FILE for f in files if not f["length"]}
        found = sorted(f[SOURCE] for f in files if f["length"])
        refused: dict[str, str] = {}
        try:
            if found:
                take([literal_path(p) for p in found], part)
        except Exception as error:
            refused = {p: problem for p in found if (problem := _problem(spark, literal_path(p)))}
            if not refused:
                raise error
            if len(refused) < len(found):
                take([literal_path(p) for p in found if p not in refused], part)
        reasons = refused | empty
        if reasons:
            refuse(reasons, part)
        inbox.note(files, reasons, part)
        replace([f[SOURCE] for f in more], part)

    bring([], f"again{uuid.uuid4().hex[:8]}")
    paths = _listing(spark.readStream).option("maxFilesPerTrigger", files_per_batch).load(folder).selectExpr(*_AS_FOUND)
    writer = paths.writeStream.foreachBatch(lambda rows, batch_id: bring(sorted(rows.collect()), str(batch_id)))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{RESCAN_SECONDS} seconds")
    return writer.start()


def _problem(spark: SparkSession, path: str) -> str | None:
    """Why a file cannot be read; None if it can."""
    try:
        spark.read.text(path).write.format("noop").mode("overwrite").save()
        return None
    except Exception as error:
        lines = [line.strip() for line in str(error).splitlines() if line.strip()]
        return f"The file cannot be read: {lines[0] if lines else type(error).__name__}"


def _publish(spark: SparkSession, table: str, replaced: list[str], parts: list[str]) -> None:
    """Parts of one batch become visible with all their sides; of files that were taken before, their rows count."""
    if replaced:
        files = spark.createDataFrame([(p,) for p in replaced], f"{SOURCE} string").coalesce(1)
        for part in parts:
            files.write.mode("overwrite").parquet(f"{table}/{SUPERSEDED}/{PART}={part}")
    commit(spark, table, lambda v: v.with_parts(parts))


def watch_folder(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    dialect: Dialect,
    mappings: Sequence[ColumnMapping] | None = None,
    trim: bool = True,
    date_formats: Sequence[str] = DATE_FORMATS,
    files_per_batch: int = FILES_PER_BATCH,
    once: bool = False,
) -> StreamingQuery:
    """Ingest the CSV files at the top of ``folder`` into ``table`` as they appear, and again when they change.

    The checkpoint remembers every path, the table how each file was. A batch that is run again after a
    failure replaces its part, so it leaves no second copy. Rows, leads and problems of a batch become
    visible together. Files that are empty or cannot be read have a row in the rejected ones. A changed
    file is noticed with the next batch or start. ``once`` takes what is there and stops.
    """
    def take(paths: list[str], part: str) -> None:
        rows = typed_rows(parse_records(read_records(spark, paths, dialect), dialect), dialect, mappings, trim, date_formats)
        own = f"{PART}={part}"
        stage(rows, f"{table}/{own}", dialect, FileIndex(spark, paths), f"{table}/{PLACED}/{own}")

    def refuse(problems: dict[str, str], part: str) -> None:
        # only the columns are needed, of a file that need not be there
        like = typed_rows(parse_records(_no_records(spark), dialect), dialect, mappings, trim, date_formats)
        add_problems(spark, problems, like, f"{table}/{PART}={part}")

    return _watch(spark, folder, table, checkpoint, files_per_batch, once, take, refuse,
                  lambda replaced, part: _publish(spark, table, replaced, [part]))


def _no_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"{SOURCE} string, _block_start long, _raw string, _row_id long")


def watched(spark: SparkSession, table: str) -> Staged:
    """What the stream has ingested so far."""
    return Staged.open(spark, table)


def watch_any(
    spark: SparkSession,
    folder: str,
    tables: str,
    checkpoint: str,
    trim: bool = True,
    files_per_batch: int = FILES_PER_BATCH,
    once: bool = False,
) -> StreamingQuery:
    """Ingest files of any dialect: each is profiled, and each layout has a table below ``tables``.

    Files that are empty or cannot be read are listed in the table ``problems``, which also has the
    register of files. Every table changes in one step, but not all of them in the same.
    """
    problems = f"{tables}/{PROBLEMS}"

    staged: dict[str, list[str]] = {}

    def take(paths: list[str], part: str) -> None:
        staged.clear()
        staged.update(stage_layouts(spark, paths, tables, trim=trim, part=part))

    def refuse(reasons: dict[str, str], part: str) -> None:
        add_problems(spark, reasons, _no_records(spark).select(
            SOURCE, "_block_start", "_row_id", F.lit(0).cast("tinyint").alias("_lead"),
            F.lit(None).cast("string").alias("_error"), "_raw"), f"{problems}/{PART}={part}")

    def replace(replaced: list[str], part: str) -> None:
        known = [path.rsplit("/", 1)[-1] for path in list_paths(spark, tables)] if replaced else list(staged)
        for name in [n for n in known if n != PROBLEMS]:
            _publish(spark, f"{tables}/{name}", replaced, staged.get(name, [part]))
        _publish(spark, problems, replaced, [part])
        staged.clear()

    return _watch(spark, folder, problems, checkpoint, files_per_batch, once, take, refuse, replace)


def watched_layouts(spark: SparkSession, tables: str) -> dict[str, Staged]:
    """Every layout met so far, by name, and the ``problems``, if there are any."""
    found = {}
    for path in list_paths(spark, tables):
        try:
            found[path.rsplit("/", 1)[-1]] = Staged.open(spark, path)
        except ValueError:
            continue  # a register, but no rows
    return found
