"""Results kept as new tables, and tables rewritten into fewer files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from gridloom.cluster import folder_bytes, hadoop_path, list_paths, path_exists, publish, quoted
from gridloom.operators.browse import Filters
from gridloom.operators.ingest import Staged
from gridloom.operators.versions import FILES, GENERATIONS, PART, Version, batch_of, children, commit, current, remove, side_rows
from gridloom.sinks.export import subset
from gridloom.sources.delimited import LEAD, SOURCE

# Size that rewritten files aim at.
TARGET_FILE_BYTES = 256 * 1024 * 1024


def materialize(
    df: DataFrame, name: str, folder: str, columns: Sequence[str] | None = None, filters: Filters | None = None
) -> int:
    """Save columns and rows of a table or query result as table ``name``; returns its row count."""
    spark = df.sparkSession
    if path_exists(spark, folder):
        raise ValueError(f"'{folder}' exists already.")
    subset(df, columns, filters).write.option("path", folder).format("parquet").saveAsTable(name)
    return spark.table(name).count()


def _fingerprint(df: DataFrame) -> list[Column]:
    """Row count and the sum of row hashes: equal for equal rows in any order."""
    row_hash = F.xxhash64(*[F.col(quoted(name)) for name in df.columns]).cast("decimal(38,0)")
    return [F.count("*").alias("row_count"), F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("row_hash")]


def fingerprint(df: DataFrame) -> DataFrame:
    return df.agg(*_fingerprint(df))


def _partition_columns(spark: SparkSession, folder: str) -> list[str]:
    """The columns that a table's folders name, outermost first."""
    names: list[str] = []
    while True:
        parts = [p for p in list_paths(spark, folder) if "=" in p.rsplit("/", 1)[-1]]
        if not parts:
            return names
        names.append(parts[0].rsplit("/", 1)[-1].split("=", 1)[0])
        folder = parts[0]


def compact(
    spark: SparkSession, folder: str, table: str | None = None, target_file_bytes: int = TARGET_FILE_BYTES
) -> DataFrame:
    """Rewrite a Parquet folder into fewer files, check the copy and put it in place.

    Files are merged by reading several of them in one task, without a shuffle. Partition folders stay
    as they are, their values to the letter. The copy is read once to compare it with what the copying
    saw, and replaces the folder only if count and row hashes agree. Returns the row count, whether the
    rows are the same, and the file counts. A staged table, watched or not, keeps what is known of its
    rows (``compact_staged``).
    """
    if current(spark, folder) or {SOURCE, LEAD} <= set(spark.read.parquet(folder).columns):
        return compact_staged(spark, folder, target_file_bytes)
    size = folder_bytes(spark, folder)
    files = max(1, -(-size // target_file_bytes))
    partitions = _partition_columns(spark, folder)
    fields = [T.StructField(f.name, T.StringType()) if f.name in partitions else f for f in spark.read.parquet(folder).schema]
    before = spark.read.schema(T.StructType(fields)).parquet(folder)
    attempt = f"{folder.rstrip('/')}__compact_{uuid.uuid4().hex}"
    seen = Observation()
    copied = before.observe(seen, *_fingerprint(before)).coalesce(files).write
    (copied.partitionBy(*partitions) if partitions else copied).parquet(attempt)
    after = spark.read.schema(T.StructType(fields)).parquet(attempt)
    old, new = seen.get, fingerprint(after).first().asDict()
    if old != new:
        raise ValueError(f"The compacted copy of '{folder}' has other rows; it stays in '{attempt}'.")
    counts = len(before.inputFiles()), len(after.inputFiles())
    publish(spark, attempt, folder)
    if table:
        spark.catalog.refreshTable(table)
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    return spark.createDataFrame([(new["row_count"], old == new, *counts)], _RESULT)


_RESULT = "row_count long, same_rows boolean, files_before int, files_after int"


def compact_staged(spark: SparkSession, folder: str, target_file_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Write the older parts of a staged table together, while it is read and while a watch adds to it.

    The copy has every lead marked in its own row, the times at which rows were taken, and the register of
    files; rows of files that were taken again are left out. It is compared with what the copying saw, and
    one version puts it in the place of the parts. Parts of the newest batch stay, as a repeated batch may
    replace them. Files that the version no longer names go with the next compaction.
    """
    folder = folder.rstrip("/")
    version = current(spark, folder)
    folded = version.foldable() if version else ()
    if version and not folded:
        return spark.createDataFrame([(0, True, 0, 0)], _RESULT)
    old = Staged.open(spark, folder, replace(version, parts=folded) if version else None)
    settled = old.settled()
    before = settled.select(*[c for c in settled.columns if c != PART], F.lit("").alias(PART))
    name = uuid.uuid4().hex
    place = f"{folder}/{GENERATIONS}/{name}"
    files = old.rows.inputFiles()
    sizes = sum(hadoop_path(spark, f)[0].getFileStatus(hadoop_path(spark, f)[1]).getLen() for f in files)
    seen = Observation()
    before.observe(seen, *_fingerprint(before)).coalesce(max(1, -(-sizes // target_file_bytes))).write.parquet(f"{place}/rows")
    after = spark.read.parquet(f"{place}/rows")
    wrote, found = seen.get, fingerprint(after).first().asDict()
    if wrote != found:
        raise ValueError(f"The compacted copy of '{folder}' has other rows; it stays in '{place}'.")
    register = side_rows(spark, folder, replace(version, parts=folded), FILES) if version else None
    if register is not None:
        last = register.groupBy(SOURCE).agg(F.max_by(F.struct("modified", "length", "reason"), "modified").alias("_last"))
        last.select(SOURCE, "_last.*").coalesce(1).write.parquet(f"{place}/{FILES}")
    stale = _left_behind(spark, folder, version) if version else ()

    def published(now: Version) -> Version:
        if now.generation != (version.generation if version else None):
            raise RuntimeError(f"'{folder}' was compacted by another writer.")
        gone = (*folded, *([version.generation] if version and version.generation else []))
        return replace(now, generation=name, parts=tuple(p for p in now.parts if p not in folded), retired=gone)

    commit(spark, folder, published)
    if version:
        remove(spark, folder, (*version.retired, *stale))
    return spark.createDataFrame([(found["row_count"], wrote == found, len(files), len(after.inputFiles()))], _RESULT)


def _left_behind(spark: SparkSession, folder: str, version: Version) -> tuple[str, ...]:
    """Parts of attempts that failed: of batches before the newest one, and not named."""
    there = [n.split("=", 1)[1] for n in (p.rsplit("/", 1)[-1] for p in children(spark, folder)) if n.startswith(f"{PART}=")]
    newest = max((int(batch_of(p)) for p in version.parts if batch_of(p).isdigit()), default=0)
    return tuple(p for p in there if p not in version.parts and batch_of(p).isdigit() and int(batch_of(p)) < newest)
